"""Facts of one source text: imports, symbols, request literals, routes.

TypeScript and JavaScript are read with a tokenizer and a stack of brackets,
Python with the ``ast`` module, or line by line where that refuses the text;
so broken files give what can be read of them, marked ``partial``.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.functions.names import route_segments

# Marks of request clients; keys and methods whose strings are no requests; decorators that make routes.
HTTP_MARKERS = ("HttpClient", "this.http.", "fetch(", "axios")
ROUTER_KEYS = frozenset(("path", "redirectTo", "routerLink"))
NO_REQUEST = frozenset(("navigate", "navigateByUrl", "getElementById", "querySelector", "addControl", "removeControl", "setControl", "replace"))
ROUTE_DECORATORS = frozenset("route get post put patch delete head options trace api_route".split())
ROUTE_CALLS, PATH_CALLS = frozenset(("path", "re_path", "url", "register")), frozenset(("path", "re_path", "url"))
LITERAL_BYTES = 120
INCLUDE_MARK = "django-include:"
_DOTTED = re.compile(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*\Z", re.A)


@dataclass
class Facts:
    """What one text says; lists keep the order of the text unless noted."""

    refs: list[tuple[str, int]] = field(default_factory=list)
    symbols: list[tuple[str, str, bool, int]] = field(default_factory=list)
    urls: list[str] = field(default_factory=list)
    seqs: list[list[str]] = field(default_factory=list)
    extends: list[str] = field(default_factory=list)
    members: list[tuple[str, int]] = field(default_factory=list)
    routes: list[tuple[list[str], str]] = field(default_factory=list)
    includes: list[tuple[list[str], str]] = field(default_factory=list)
    http: bool = False
    partial: bool = False


def contract_path(url: str) -> str | None:
    """The plain-Python form of ``functions.classify.contract_path``."""
    segs = [s for s in re.split(r"[?#]", url, maxsplit=1)[0].split("/") if s]
    segs = ["{}" if s.startswith(":") or s[0] == "<" and s[-1] == ">" or s.isascii() and s.isdigit() else s for s in segs]
    return "/".join(segs) if len(segs) > 1 else None


_TOKEN = re.compile(
    r"""(?P<ws>[^\S\n]+|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<nl>\n)|(?P<id>[A-Za-z_$ª-ￜ][\w$]*)|(?P<num>\.?\d[\w.]*)"""
    r"""|(?P<str>'(?:[^'\\\n]|\\[\s\S])*'|"(?:[^"\\\n]|\\[\s\S])*")|(?P<p>=>|\.\.\.|\?\.|[^\s])"""
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
_VALUE_WORDS = frozenset("return typeof case in of delete void throw new else do instanceof yield await".split())
# What may stand before a method's name, and words that are none.
_BEFORE_METHOD = frozenset(("{", "}", ";", ",", "async", "static", "get", "set", "*", "public", "private", "protected", "override", ")"))
_NO_METHOD = frozenset(("if", "for", "while", "switch", "catch", "function", "return", "super", "with"))


def _template_end(text: str, at: int) -> int:
    """Offset after the template literal that starts at ``at``; nested ones are followed."""
    i, depth = at + 1, 0
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 1
        elif depth == 0 and c == "`":
            return i + 1
        elif depth == 0 and text.startswith("${", i):
            depth, i = 1, i + 1
        elif depth and c == "`":
            i = _template_end(text, i) - 1
        elif depth:
            depth += (c == "{") - (c == "}")
        i += 1
    return len(text)


def tokens(text: str) -> Iterator[tuple[str, str, int]]:
    """``(kind, text, line)`` of a script: id, num, str, tpl, re or p; regular expressions by the token before."""
    at, line, prev = 0, 1, ("p", ";")
    while at < len(text):
        if text[at] == "`":
            end = _template_end(text, at)
            yield "tpl", text[at:end], line
            line += text.count("\n", at, end)
            at, prev = end, ("tpl", "`")
            continue
        if text[at] == "/" and (prev[0] == "p" and prev[1] not in ")]}" or prev[0] == "id" and prev[1] in _VALUE_WORDS):
            m = _REGEX.match(text, at)
            if m:
                yield "re", m.group(), line
                at, prev = m.end(), ("re", "/")
                continue
        m = _TOKEN.match(text, at)
        kind, tok = m.lastgroup, m.group()
        if kind not in ("ws", "nl"):
            yield kind, tok, line
            prev = (kind, tok)
        line += tok.count("\n")
        at = m.end()


@dataclass
class _Frame:
    opener: str
    skip: bool
    cls: bool = False


def script_facts(text: str) -> Facts:
    """Facts of a TypeScript or JavaScript text (types and elements are read past)."""
    f = Facts(http=any(m in text for m in HTTP_MARKERS))
    ts = list(tokens(text))
    n = len(ts)
    stack: list[_Frame] = []
    value = lambda i: ts[i][1] if 0 <= i < n else ""
    kind = lambda i: ts[i][0] if 0 <= i < n else ""
    spec: set[int] = set()  # tokens that are module names
    skip_until = -1  # strings before this token are no requests
    export_depth, class_next = -1, False
    unquote = lambda s: s[1:-1]
    for i, (k, v, line) in enumerate(ts):
        depth = len(stack)
        if k == "p":
            if v in "([{":
                before, skip = value(i - 1), bool(stack and stack[-1].skip)
                call = v == "(" and (kind(i - 1) == "id" and before not in ("if", "for", "while", "switch", "catch", "function", "with") or before in (")", "]", ">"))
                if call and value(i - 2) in (".", "?."):
                    skip |= before in NO_REQUEST or before == "get" and "http" not in _receiver(ts, i - 2)
                if call and before in ("require", "import") and value(i - 2) not in (".", "?."):
                    skip = True
                    if kind(i + 1) == "str":
                        f.refs.append((unquote(value(i + 1)), line))
                if v == "[" and (kind(i - 1) in ("id", "str") or before in (")", "]")) and before not in _VALUE_WORDS:
                    skip = True
                if call:
                    arg = _first_string(ts, i)
                    if arg is not None and arg.startswith("/") and (u := contract_path(arg)):
                        f.urls.append(u)
                body = v == "{" and class_next
                if body:
                    class_next = False
                stack.append(_Frame(v, skip, body))
            elif v in ")]}":
                if stack:
                    stack.pop()
                if v == "}" and len(stack) == export_depth and value(i + 1) not in (")", ",", ".", "(", "[", "?", ":", "=", "|", "&", ";", "as", "satisfies", "from"):
                    export_depth = -1
            elif v == ";" and depth == export_depth:
                export_depth = -1
            continue
        exported = export_depth >= 0
        if k == "id" and value(i - 1) not in (".", "?."):
            nk, nv = kind(i + 1), value(i + 1)
            if v == "import" and nv not in ("(", "."):
                _import_source(ts, i, f, spec)
            elif v == "export":
                j = i + 2 if nv == "type" and value(i + 2) in ("{", "*") else i + 1
                if value(j) in ("{", "*"):
                    _import_source(ts, j - 1, f, spec, brace_only=True)
                else:
                    export_depth = depth
            elif v in ("module", "namespace") and nk == "str":
                spec.add(i + 1)
                if "*" not in nv:
                    f.refs.append((unquote(nv), line))
            elif v == "function" and (nk == "id" or nv == "*" and kind(i + 2) == "id"):
                _symbol(f, nv if nk == "id" else value(i + 2), "function", exported, line)
            elif v == "class":
                class_next = True
                if nk == "id" and nv not in ("extends", "implements"):
                    _symbol(f, nv, "class", exported, line)
                j = next((j for j in range(i + 1, min(n, i + 40)) if value(j) in ("extends", "{")), n)
                if value(j) == "extends" and kind(j + 1) == "id" and value(j + 2) not in (".", "("):
                    f.extends.append(value(j + 1))
            elif v == "interface" and nk == "id" and value(i + 2) in ("{", "extends", "<"):
                _symbol(f, nv, "interface", exported, line)
            elif v == "enum" and nk == "id":
                _symbol(f, nv, "enum", exported, line)
            elif v == "type" and nk == "id" and value(i + 2) in ("=", "<"):
                _symbol(f, nv, "type_alias", exported, line)
                skip_until = next((j for j in range(i, n) if value(j) == ";" or j > i + 3 and ts[j][2] > ts[j - 1][2] and value(j) not in ("|", "&") and value(j - 1) not in ("=", "|", "&", "{", ",", "(")), n)
            elif v in ("const", "let", "var") and nk == "id" and nv != "enum":
                _symbol(f, nv, "const", exported, line)
            elif stack and stack[-1].opener == "{" and nv == "(" and v not in _NO_METHOD and (value(i - 1) in _BEFORE_METHOD or stack[-1].cls and ts[i - 1][2] < line):
                close = _match(ts, i + 1)
                if value(close + 1) in ("{", ":") and (stack[-1].cls or value(close + 1) == "{"):
                    _symbol(f, v, "method", exported, line)
            if v in ROUTER_KEYS and nv == ":":
                skip_until = _value_end(ts, i + 2)
        if k in ("str", "tpl") and i not in spec:
            if k == "str" and unquote(v) in ROUTER_KEYS and value(i + 1) == ":":
                skip_until = _value_end(ts, i + 2)
            if i >= skip_until and not (stack and stack[-1].skip):
                lit = unquote(v) if k == "str" else v
                if not lit.lstrip("`").startswith("#") and len(lit.encode()) <= LITERAL_BYTES and not re.search(r"\s", lit):
                    segs = route_segments(lit)
                    if segs:
                        f.seqs.append(segs)
    f.partial = bool(stack)
    f.urls = sorted(set(f.urls))
    f.seqs = [list(s) for s in sorted({tuple(s) for s in f.seqs})]
    return f


def _symbol(f: Facts, name: str, kind: str, exported: bool, line: int) -> None:
    if len(name) < 3 or kind == "const" and not (name[0].isupper() or len(name) >= 6) or kind == "method" and name in ("constructor", "toString", "valueOf"):
        return
    f.symbols.append((name, kind, exported, line))


def _match(ts: list, i: int) -> int:
    depth = 0
    for j in range(i, len(ts)):
        if ts[j][0] == "p":
            depth += (ts[j][1] in "([{") - (ts[j][1] in ")]}")
            if depth == 0:
                return j
    return len(ts)


def _value_end(ts: list, i: int) -> int:
    depth = 0
    for j in range(i, len(ts)):
        if ts[j][0] == "p":
            if depth == 0 and ts[j][1] in ",})":
                return j
            depth += (ts[j][1] in "([{") - (ts[j][1] in ")]}")
    return len(ts)


def _receiver(ts: list, i: int) -> str:
    """The text before a member access, back to where its expression starts."""
    out, depth, j = [], 0, i
    while j > 0:
        j -= 1
        k, v, _ = ts[j]
        if v in (")", "]"):
            depth += 1
        elif v in ("(", "["):
            if depth == 0:
                break
            depth -= 1
        elif depth == 0 and not (k in ("id", "tpl", "str") or v in (".", "?.", "!")):
            break
        out.append(v)
    return "".join(reversed(out))


def _first_string(ts: list, i: int) -> str | None:
    """The first argument of a call that is a string literal."""
    depth = 0
    for j in range(i, min(len(ts), i + 400)):
        k, v, _ = ts[j]
        if k == "p":
            depth += (v in "([{") - (v in ")]}")
            if depth == 0:
                return None
        elif k == "str" and depth == 1 and ts[j - 1][1] in ("(", ",") and j + 1 < len(ts) and ts[j + 1][1] in (",", ")"):
            return v[1:-1]
    return None


def _import_source(ts: list, i: int, f: Facts, spec: set[int], brace_only: bool = False) -> None:
    """The module of the import or re-export whose keyword is token ``i``."""
    line, j, n = ts[i][2], i + 1, len(ts)
    if j < n and ts[j][0] == "str" and not brace_only:
        spec.add(j)
        f.refs.append((ts[j][1][1:-1], line))
        return
    while j < min(n, i + 2000):
        k, v, _ = ts[j]
        if v == "{":
            j = _match(ts, j)
        elif v == "from" and j + 1 < n and ts[j + 1][0] == "str":
            spec.add(j + 1)
            f.refs.append((ts[j + 1][1][1:-1], line))
            return
        elif v in (";", "=", "(") or k == "id" and v in ("import", "export", "const", "function", "class"):
            return
        j += 1
        if brace_only and j < n and ts[j][1] not in ("from", "as", "*") and ts[j - 1][1] == "}":
            return


_SCRIPT = re.compile(r"<script(?=[\s/>])([^>]*)>", re.I)
_LANG = re.compile(r"(?<![a-z0-9])lang\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>/]*))", re.I)


def component_facts(text: str) -> Facts:
    """Facts of the script blocks of a component file, lines as in the file."""
    out, at = Facts(), 0
    while m := _SCRIPT.search(text, at):
        if m.group(1).endswith("/"):
            at = m.end()
            continue
        end = text.lower().find("</script>", m.end())
        if end < 0:
            break
        lang = _LANG.search(m.group(1))
        if lang is None or next((g for g in lang.groups() if g is not None), "").lower() in ("js", "javascript", "ts", "typescript", "tsx", "jsx"):
            one = script_facts("\n" * text.count("\n", 0, m.end()) + text[m.end() : end])
            for name in ("refs", "symbols", "urls", "seqs", "extends"):
                getattr(out, name).extend(getattr(one, name))
            out.http |= one.http
            out.partial |= one.partial
        at = end + len("</script>")
    out.urls = sorted(set(out.urls))
    out.seqs = [list(s) for s in sorted({tuple(s) for s in out.seqs})]
    return out


def python_facts(text: str) -> Facts:
    """Facts of a Python text."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _python_lines(text)
    f = Facts()
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            f.refs += [(s, node.lineno) for s in sorted({a.name for a in node.names})]
        elif isinstance(node, ast.ImportFrom):
            spec = "." * node.level + (node.module or "")
            if spec == "__future__":
                f.refs.append((spec, node.lineno))
                continue
            f.members += [(spec + ("" if spec.endswith(".") else ".") + a.name, node.lineno) for a in node.names if a.name != "*"]
            f.refs.append((spec, node.lineno))
        elif isinstance(node, ast.Call):
            name = _callee(node)
            if isinstance(node.func, ast.Name) and name == "include" and (s := _string(node.args[0] if node.args else None)) and _DOTTED.match(s):
                f.refs.append((INCLUDE_MARK + s, node.lineno))
            if name in PATH_CALLS and (s := _first_text(node)) is not None and (u := contract_path(s)):
                f.urls.append(u)
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            cls = isinstance(node, ast.ClassDef)
            for d in node.decorator_list:
                if (s := _first_text(d)) is not None and (u := contract_path(s)):
                    f.urls.append(u)
                if not cls and isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr in ROUTE_DECORATORS and (s := _string(d.args[0] if d.args else None)) and "/" in s and (segs := route_segments(s)):
                    f.routes.append((segs, node.name))
            if len(node.name) >= 3 and node.name != "__init__":
                f.symbols.append((node.name, "class" if cls else "function", False, node.lineno))
    f.refs.sort(key=lambda r: r[1])
    f.symbols.sort(key=lambda r: r[3])
    _routes(tree, [], f, 0)
    f.urls = sorted(set(f.urls))
    return f


def _callee(call: ast.Call) -> str:
    return call.func.id if isinstance(call.func, ast.Name) else call.func.attr if isinstance(call.func, ast.Attribute) else ""


def _string(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def _first_text(node: ast.AST) -> str | None:
    """The first string anywhere under a node, in the order of the text."""
    found = [n for n in ast.walk(node) if _string(n) is not None]
    return min(found, key=lambda n: (n.lineno, n.col_offset)).value if found else None


def _view(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return node.attr
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == "as_view" and isinstance(node.func.value, (ast.Name, ast.Attribute)):
        return _view(node.func.value)
    return None


def _routes(node: ast.AST, prefix: list[str], f: Facts, depth: int) -> None:
    """Route calls below a node; an include's list takes the pattern as its prefix, a view ends the descent."""
    if depth > 400:
        f.partial = True
        return
    if isinstance(node, ast.Call) and _callee(node) in ROUTE_CALLS and len(node.args) > 1 and (pattern := _string(node.args[0])) is not None:
        segs, target = prefix + route_segments(pattern), node.args[1]
        if (view := _view(target)) is not None:
            f.routes.append((segs, view))
            return
        if isinstance(target, ast.Call) and isinstance(target.func, ast.Name) and target.func.id == "include" and (s := _string(target.args[0] if target.args else None)) and _DOTTED.match(s):
            f.includes.append((segs, s))
        _routes(target, segs, f, depth + 1)
        return
    for child in ast.iter_child_nodes(node):
        _routes(child, prefix, f, depth + 1)


_PY_IMPORT = re.compile(r"^\s*(?:import\s+([\w.]+(?:\s+as\s+\w+)?(?:\s*,\s*[\w.]+(?:\s+as\s+\w+)?)*)|from\s+(\.*[\w.]*)\s+import\s+(.*))$")
_PY_DEF = re.compile(r"^\s*(?:async\s+)?(def|class)\s+(\w+)")


def _python_lines(text: str) -> Facts:
    """What single lines of a broken Python text say."""
    f = Facts(partial=True)
    for n, line in enumerate(text.splitlines(), 1):
        if m := _PY_IMPORT.match(line.split("#", 1)[0]):
            if m.group(1):
                f.refs += [(x.split()[0], n) for x in m.group(1).split(",") if x.split()]
            elif m.group(2):
                f.refs.append((m.group(2), n))
                names = [x.split()[0] for x in re.sub(r"[()\\]", "", m.group(3)).split(",") if x.split()]
                f.members += [(m.group(2) + ("" if m.group(2).endswith(".") else ".") + x, n) for x in names if x.isidentifier()]
        elif (m := _PY_DEF.match(line)) and len(m.group(2)) >= 3 and m.group(2) != "__init__":
            f.symbols.append((m.group(2), "class" if m.group(1) == "class" else "function", False, n))
    return f


def facts(text: str | None, language: str) -> Facts:
    if not text:
        return Facts()
    if language == "python":
        return python_facts(text)
    return component_facts(text) if language in ("vue", "svelte") else script_facts(text)


SCHEMA = (
    "repo string, file long, refs array<struct<specifier:string,line:int>>, symbols array<struct<name:string,kind:string,exported:boolean,line:int>>, urls array<string>, "
    "seqs array<array<string>>, extends array<string>, members array<struct<specifier:string,line:int>>, routes array<struct<segments:array<string>,view:string>>, "
    "includes array<struct<segments:array<string>,module:string>>, http boolean, partial boolean"
)


def parse(files: DataFrame) -> DataFrame:
    """One nested row of facts per file (``SCHEMA``); ``files`` needs ``repo, id, language, text``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                x = facts(r.text, r.language)
                two = lambda v, a, b: [{a: p, b: q} for p, q in v]
                rows.append((r.repo, r.id, two(x.refs, "specifier", "line"), [dict(zip(("name", "kind", "exported", "line"), s)) for s in x.symbols], x.urls, x.seqs, x.extends, two(x.members, "specifier", "line"), two(x.routes, "segments", "view"), two(x.includes, "segments", "module"), x.http, x.partial))
            yield pd.DataFrame(rows, columns="repo file refs symbols urls seqs extends members routes includes http partial".split())

    return files.select("repo", "id", "language", "text").where("language IS NOT NULL").mapInPandas(run, SCHEMA)


def child_tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """The nested facts as the flat tables that the operators take."""
    one = lambda col, *names: parsed.select("repo", "file", F.posexplode(col).alias("pos", "x")).select("repo", "file", "pos", *[F.col(f"x.{n}").alias(n) for n in names])
    return {
        "refs": one("refs", "specifier", "line"),
        "symbols": one("symbols", "name", "kind", "exported", "line").drop("pos"),
        "members": one("members", "specifier", "line"),
        "routes": one("routes", "segments", "view").drop("pos"),
        "includes": one("includes", "segments", "module").drop("pos"),
        "urls": parsed.select("repo", "file", F.explode("urls").alias("url")),
        "literals": parsed.select("repo", "file", F.explode("seqs").alias("seq")),
        "extends": parsed.select("repo", "file", F.explode("extends").alias("base")),
        "http": parsed.where("http").select("repo", "file"),
    }
