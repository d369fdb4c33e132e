"""Syntax and origin of source files."""

from __future__ import annotations

import ast
import json
import random
import warnings
from pathlib import Path

import pytest

from filigree.llm import origin, syntax, syntax_js, syntax_py

GOOD = json.loads((Path(__file__).parent / "cases.json").read_text())
MODES = {"ts": (True, False), "js": (False, False), "tsx": (True, True)}


@pytest.mark.parametrize("lang", list(MODES))
def test_script_cases(lang):
    ts, jsx = MODES[lang]
    wrong = [t for t in GOOD[lang]["good"] if syntax_js.errors(t, ts, jsx) or not syntax_js.accepts(t, ts, jsx)]
    wrong += [t for t in GOOD[lang]["bad"] if syntax_js.accepts(t, ts, jsx)]
    assert wrong == []


def _library(n, seed):
    files = sorted(Path(ast.__file__).parent.glob("**/*.py"))
    files = [f for f in files if "test_unicode_identifiers" not in f.name and "pyrepl" not in str(f) and "bad" not in f.name and "lib2to3" not in str(f)]
    return random.Random(seed).sample(files, min(n, len(files)))


def _parses(text):
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
        return True
    except (SyntaxError, ValueError):
        return False


def test_python_library_is_accepted():
    for f in _library(120, 1):
        text = f.read_text(encoding="utf-8", errors="replace")
        assert syntax_py.accepts(text) == _parses(text), f


def test_broken_python_is_refused_like_ast():
    r = random.Random(2)
    for f in _library(40, 3):
        text = f.read_text(encoding="utf-8", errors="replace")[:5000]
        lines = text.split("\n")
        cut = text[: r.randrange(len(text) + 1)]
        less = lines[:]
        del less[r.randrange(len(less))]
        for t in (cut, "\n".join(less), "\n".join([*lines[:3], "<<<<<<< HEAD", *lines[3:]])):
            assert syntax_py.accepts(t) == _parses(t), (f, t[-200:])


NESTED = [
    "f'{' '.join(c)!r}'", "f'{f'{f'{1}'}'}'", "f'{x:{'>'}{10}}'", "f'{a['b']}'", "f'{a[\"b\"]}{'c'}' 'd'", "f'{'", "f'{'a' 'b'}'", "f'{'a' b}'", "f'{a!x}'", "f'{\n1\n}'", "f\'\'\'{'\\n'}\'\'\'",
    "x·y = 3", "x󠄀 = 4", "a→b", "f'{x = }'", "f'{x == 'y'}'", "f'{'\\n'.join(a)}'", "rf'{'d'}'", "f'\\N{DIGIT ONE}{'a'}'", "f'{lambda x: 1}'", "f'{(lambda x: 1)}'", "f'{'a':>{'b'}}'", "f'{}'", "f'{x!r:{y}}{'z'}'",
    "f'{{'{'a'}'", "f'{'a' # c\n}'", "f'{d['k']:'>3}'", "print(f'{x['a']}', f'{y['b']}')", "f'{yield 'x'}'", "f'{*'ab',}'", "f'{x:=5}{'a'}'", "f'}'", "f'{'a'}}'", "f'{'a}'", "f'{('a'}'", "f'{'a':{}}'",
]


def test_quotes_inside_fields_and_rare_identifiers():
    for t in NESTED:
        assert syntax_py.accepts(t) == _parses(t), t
    deep = "f'{" * 60 + "1" + "}'" * 60
    assert syntax_py.accepts(deep) and not syntax_py.accepts(deep[:-1])


def test_deep_nesting_is_parsed_and_deeper_is_its_own_cause():
    import sys

    before = sys.getrecursionlimit()
    try:
        sys.setrecursionlimit(syntax.DEEPEST)
        n = 30_000
        assert syntax.judge("const a = " + "[" * n + "1" + "]" * n + ";", "ts")[0] and syntax.judge("a = " + "[" * n + "1" + "]" * n + "\n", "py")[0]
        assert not syntax.judge("const a = " + "[" * n + "1" + "]" * (n - 1) + ";", "ts")[0]
        sys.setrecursionlimit(5_000)
        assert syntax.judge("let b = " + "(" * n + "2" + ")" * n + ";", "ts")[2] == "too-deep"
    finally:
        sys.setrecursionlimit(before)


def test_all_errors_are_found_with_recovery():
    e = syntax_js.errors("let a = ;\nlet b = 1;\nlet c = ;\nfunction f() {\n  let d = ;\n  return 1;\n}\n", True, False)
    assert len(e) == 3
    p = syntax_py.errors("x = \ny = 1\nz = (1 +)\n")
    assert len(p) == 2


def test_components():
    ok = lambda t, e="vue": not syntax.file_errors(t, e)
    assert ok("<template>\n  <div />\n</template>\n") and ok("") and ok("  \n")
    assert ok('<script lang="ts">\nlet x: number = 1;\n</script>\n<p>{{ a }}</p>') and ok("<!-- <script> -->\n<script>\nlet a = 1\n</script>")
    assert not ok('<script lang="ts">\nlet x: number = 1;\n') and not ok("  return total;\n};\n</script>\n") and not ok("<script>\nlet x = {\n</script>\n<p/>")


def test_parse_files(spark):
    rows = [(1, "r", "a.ts", "let x: number = 1"), (2, "r", "b.js", "let x: number = 1"), (3, "r", "c.py", "def f(:\n"), (4, "r", "d.ts", "class A {\n"), (5, "r", "e.ts", "a;\n<<<<<<< HEAD\nb;\n=======\nc;\n>>>>>>> x\n"), (6, "r", "f.ts", None), (7, "r", "g.css", "x {"), (8, "r", None, "x"), (9, "r", "h.py", "import { a } from 'b';\n"), (10, "r", "i.jsx", "const a = <p>it's</p>;"), (2, "r", "b.js", "let x: number = 1")]
    f = spark.createDataFrame([(*x, "clash") for x in rows], "id long, repo string, rel string, text string, language string")
    got = {r.file: r for r in syntax.parse_files(f).collect()}
    assert {k for k, r in got.items() if not r.ok} == {2, 3, 4, 5, 9} and set(got) == {1, 2, 3, 4, 5, 6, 9, 10}
    assert got[2].cause == "other-language" and "TypeScript" in got[2].accepted_by and got[4].cause == "cut-off" and got[5].cause == "conflict" and got[9].cause == "other-language"
    assert got[5].line == 2 and got[3].n_errors == len(got[3].errors) == 1
    assert sorted(r.file for r in syntax.broken_files(f).collect()) == [2, 3, 4, 5, 9]
    sym = spark.createDataFrame([(4, 1), (4, 2), (1, 1)], "file long, line int")
    ref = spark.createDataFrame([(9, 0)], "file long, pos int")
    rates = {r.language: r for r in syntax.parse_rates(f, sym, ref).collect()}
    assert (rates["TypeScript"].files, rates["TypeScript"].broken, rates["TypeScript"].symbols) == (4, 2, 2) and rates["Python"].refs == 1
    assert syntax.parse_files(f.limit(0)).count() == 0


def test_very_long_and_deep_texts():
    assert syntax_js.accepts("x = 1;\n" * 50_000, True, False)
    assert syntax_py.accepts("x = 1\n" * 50_000)
    assert isinstance(syntax_js.errors("(" * 50_000, True, False), list)
    assert syntax_py.accepts("(" * 50_000) is False


GENERATED = "// Code generated by mill 1.2. DO NOT EDIT.\n" + "".join(f"export const a{i} = field({i + 1}, 'a_{i}', {i * 7 % 5});\n" for i in range(20))
HAND = "// Writes the DO NOT EDIT banner at the top of every emitted module.\nimport { a1 } from './x';\nconst banner = 'Code generated by mill. DO NOT EDIT.';\nexport function f(a) {\n  let total = 0;\n  for (const x of a) {\n    total += x.size * 3;\n  }\n  return { total };\n}\n"
MINI = "/*! x v1 */\n" + "!function(t){t.a=t.b||'c'}(window);var q=function(e){for(var t=0;t<e.length;t++)e[t]=n(3,e[t]);return e};" * 8
TABLE = "export const T = [\n" + "  1.5, 2.25, 3.75, 4.5, 5.5, 6.5,\n" * 12 + "];\n"
BLOB = "DATA = (\n" + "    'aGVsbG8gd29ybGQ5OTk5QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo0NTY3'\n" * 6 + ")\n"


def test_sorts_of_single_files():
    assert origin.sorts(GENERATED, "ts") == ["generated"] and origin.sorts(GENERATED.split("\n", 1)[1], "ts") == ["generated"]
    assert origin.sorts(HAND, "js") == [] and origin.sorts("", "ts") == []
    assert origin.sorts(MINI, "js") == ["minified"] and origin.sorts(TABLE, "ts") == ["data"] and origin.sorts(BLOB, "py") == ["data"]
    assert origin.sorts("const LIMITS = {\n  a: 1,\n  b: 'x',\n  c: true,\n};\n", "ts") == []
    assert origin.sorts("# Vendored from pkg 1.2, local patches listed in NOTICE\n" + "x = 1\n", "py") == ["vendored"]
    assert origin.sorts("# Vendored wine is listed in the shop\nx = 1\n", "py") == []
    assert origin.sorts("export const words = '" + "alpha beta " * 60 + "';\n", "ts") == []
    assert origin.sorts("import { a, b1 } from './a';\nimport { c, d2 } from './b';\n" * 6, "ts") == []


def test_shared_subtrees_and_mirrors(spark):
    code = "".join(f"export function step{c}(x) {{ return x.{c}{c} + other({ord(c) * 7 % 31}); }}\n" for c in "abcdefgh")
    small = "export const one = 1;\n"
    rows = [
        (1, "r1", "lib/x/a.ts", code), (2, "r2", "deps/y/b.ts", "/* copied */\n" + code + "// patched: z\n"), (3, "r1", "src/own.ts", code.replace("step", "stop")),
        (4, "r1", "lib/x/s.ts", small), (5, "r2", "deps/y/t.ts", small), (6, "r3", "src/s.ts", small),
        (7, "m1", "src/w.ts", code.replace("other", "mirror")), (8, "m2", "src/w.ts", code.replace("other", "mirror")), (9, "r1", None, code), (10, "r1", "src/e.ts", None),
    ]
    f = spark.createDataFrame([*rows, rows[0]], "id long, repo string, rel string, text string").withColumnRenamed("id", "id")
    got = {r.file: list(r.origin) for r in origin.classify_origin(f).collect()}
    # the small file is vendored only where its whole directory is; a mirror is no second repository
    assert got == {1: ["vendored"], 2: ["vendored"], 4: ["vendored"], 5: ["vendored"]}
    assert origin.classify_origin(f.limit(0)).count() == 0


def _code(tag, n=8):
    return "".join(f"export function {tag}{c}(x) {{ return x.{c}{c} + {tag}({ord(c) * 7 % 31}, 'value of {c}'); }}\n" for c in "abcdefghijkl"[:n])


def test_forks_are_one_family(spark):
    own = {f"src/{t}.ts": _code(t) for t in ("alpha", "beta", "gamma", "delta")}
    package = {f"{t}.ts": _code(t) for t in ("pack", "pick")}
    rows = [(repo, rel, text) for repo in ("base", "fork", "fork2") for rel, text in own.items()]
    rows = [(r, p, t + f"export const only = '{r}';\n" if (r, p) == ("fork", "src/beta.ts") else t.replace("value", "worth") if (r, p) == ("fork2", "src/gamma.ts") else t) for r, p, t in rows]
    # a package that the forks and an unrelated repository hold is vendored in all of them
    rows += [(r, f"lib/{p}", t) for r in ("base", "fork", "fork2", "zoo") for p, t in package.items()]
    rows += [("zoo", f"src/{t}.ts", _code(t)) for t in ("lion", "puma", "lynx")]
    f = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, repo string, rel string, text string")
    got = {rows[r.file][:2] for r in origin.classify_origin(f).collect()}
    assert got == {(r, f"lib/{p}") for r in ("base", "fork", "fork2", "zoo") for p in package}
    fam = {r.repo: r.family for r in origin.families(origin.merkle(origin.leaves(f).distinct())).collect()}
    assert fam == {"base": "base", "fork": "base", "fork2": "base", "zoo": "zoo"}


def test_headers_behind_many_comments_and_long_counters():
    head = "// one more line of the licence\n" * 200
    body = "export const a = () => make('x');\n"
    assert origin.sorts(head + "// @generated by mill\n" + body, "ts") == ["generated"] and origin.sorts(head + body, "ts") == []
    assert origin.sorts(body + "// @generated by mill\n" + head, "ts") == ["generated"]
    for start in (10**11 - 4, 10**30 - 4):
        assert all(origin.follows(str(start + i), str(start + i + 1)) for i in range(9))
        assert origin.sorts("".join(f"export const a{start + i} = field('{'xyz'[i % 3]}');\n" for i in range(12)), "ts") == ["generated"]
    assert origin.follows("9" * 5000, "1" + "0" * 5000) and not origin.follows("9" * 5000, "9" * 5000) and not origin.follows("12", "14")


def test_ambiguous_and_nested_texts_stay_cheap():
    import time

    cases = ["x = " + "a ? (b): c => (d ? (e): " * 60 + "f", "x = " + "a ? (b) : (c) => " * 60 + "d;", "x = " + "a<(b<(c<(" * 25 + "d" + "))))" * 25 + ";", "x = " + "(" * 300 + "1" + ")" * 300 + ";", "x = `a${" * 60 + "b" + "}`" * 60 + ";"]
    start = time.perf_counter()
    for t in cases:
        for ts, jsx in MODES.values():
            syntax_js.errors(t, ts, jsx)
        origin.sorts(t, "js")
    assert time.perf_counter() - start < 20


def test_data_on_long_lines_and_ambiguous_lists():
    import signal

    line = ", ".join(str(i * 7919 % 100003) for i in range(7500))
    assert len(line) > 50_000
    assert origin.sorts(f"export const T = [\n{line}\n];\n", "ts") == ["data"]

    def late(*_):
        raise TimeoutError

    before = signal.signal(signal.SIGALRM, late)
    signal.alarm(10)
    try:
        for n in (30, 30_000):
            assert origin.sorts("const x = [\n" + ", ".join(["1"] * n) + ", name\n];\n", "ts") == []
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)


def test_what_an_ambient_block_accepts_is_not_remembered_elsewhere():
    plain, ambient = "const Q: string;\n", "declare namespace N {\n  const Q: string;\n}\n"
    for _ in range(2):
        assert syntax_js.errors(ambient, True, False) == []
        assert syntax_js.errors(plain, True, False) and not syntax_js.accepts(plain, True, False)
