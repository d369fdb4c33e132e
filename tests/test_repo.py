"""From a tree of files to answers: sources, extraction, indexes, lookups, protocol, streaming."""

from __future__ import annotations

import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from filigree import pipeline, serve
from filigree.__main__ import main
from filigree.operators.incremental import VersionedTarget
from filigree.plans import catalogue
from filigree.sinks import render
from filigree.sources import extract, gitlog, indexes, manifests, walk
from filigree.streaming import refresh


def tree(root, files):
    for rel, text in files.items():
        p = root / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return root


MONO = {
    "package.json": '{"name": "shop", "workspaces": ["packages/*"] /* c */,}',
    "packages/web/package.json": '{"name": "web", "dependencies": {"next": "1"}, "imports": {"#gone": null, "#h": "./src/home.ts"}}',
    "packages/web/tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@shared/*": ["../shared/*"]}}}',
    "packages/web/src/index.ts": "import { h } from './home';\nimport { u } from '@shared/util';\nimport x from '#h';\nimport y from '#gone';\nimport k from '@acme/kit/deep';\nimport e from '@acme/kit';\nimport './a.css';\nimport './missing';\n",
    "packages/web/src/home.ts": "export const homePage = 1;\n",
    "packages/shared/util.ts": "export const utility = 1;\n",
    "packages/kit/package.json": '{"name": "@acme/kit", "exports": {".": {"types": "./x.d.ts", "import": "./main.ts"}}}',
    "packages/kit/main.ts": "export {}\n",
    "packages/kit/src/deep.ts": "export {}\n",
    "packages/api/pyproject.toml": '[project]\ndependencies = ["Flask>=2"]\n',
    "packages/api/app.py": "from models import User\nimport os\n",
    "packages/api/models.py": "class User:\n    pass\n",
    "node_modules/x/index.ts": "import '../../packages/shared/util'\n",
    "ignored/z.ts": "export {}\n",
    ".gitignore": "ignored/\n",
}


def test_indexes_of_a_monorepo(spark, tmp_path):
    ix = pipeline.build(spark, tree(tmp_path / "m", MONO))
    found = pipeline.write_indexes(ix)
    text = (tmp_path / "m/.filigree/imports.md").read_text()
    lines = [x for x in text.splitlines() if indexes.ARROW in x]
    assert lines == [
        "packages/api/models.py ← packages/api/app.py",
        "packages/kit/main.ts ← packages/web/src/index.ts",
        "packages/kit/src/deep.ts ← packages/web/src/index.ts",
        "packages/shared/util.ts ← packages/web/src/index.ts",
        "packages/web/src/home.ts ← packages/web/src/index.ts",
    ]
    assert text.startswith("# Reverse Import Index — shop\n\n") and "5 imports into 5 files · import resolution 75% · 2 unresolved" in text
    assert found["unresolved"] == [("packages/web/src/index.ts", "#gone"), ("packages/web/src/index.ts", "./missing")]
    assert not (tmp_path / "m/.filigree/routes.md").exists()
    back = indexes.imports_table(spark, str(tmp_path / "m/.filigree/imports.md"))
    assert {tuple(r) for r in back.collect()} == {(a, x) for a, b in indexes.parse_imports(text).items() for x in b}


ROUTED = {
    "backend/server.py": "from flask import Flask\nimport db\napp = Flask(__name__)\n\n@app.route('/api/users')\ndef users():\n    return db.all()\n",
    "backend/db.py": "def all():\n    return []\n",
    "frontend/api.ts": "export function load() { return fetch('/api/users'); }\n",
    "frontend/list.ts": "import { load } from './api';\n",
    "dj/urls.py": "from django.urls import path\nfrom views import TagView\nurlpatterns = [path('tags/', TagView.as_view())]\n",
    "dj/views.py": "class TagView:\n    pass\n",
    "dj/ui/api.ts": "export function tags() { return fetch('tags/') }\n",
}


@pytest.fixture(scope="module")
def routed(spark, tmp_path_factory):
    root = tree(tmp_path_factory.mktemp("routed"), ROUTED)
    pipeline.write_indexes(pipeline.build(spark, root))
    return root


def test_routes_and_lookups(spark, routed, capsys):
    r = indexes.parse_routes((routed / ".filigree/routes.md").read_text())
    assert {(x["view"], x["file"], tuple(x["routes"]), tuple(x["callers"])) for x in r} == {("users", "backend/server.py", ("api/users",), ("frontend/api.ts",)), ("TagView", "dj/views.py", ("tags",), ("dj/ui/api.ts",))}
    assert {(x.view, x.caller) for x in indexes.routes_table(spark, str(routed / ".filigree/routes.md")).collect()} == {("users", "frontend/api.ts"), ("TagView", "dj/ui/api.ts")}
    at = ["--root", str(routed)]
    assert main([*at, "importers", "frontend/api.ts"]) == 0
    assert capsys.readouterr().out == "1  frontend/list.ts\n"
    assert main([*at, "importers", "frontend/api", "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["importers"] == []
    assert main([*at, "deps", "./frontend/../frontend/list.ts"]) == 0
    assert capsys.readouterr().out == "frontend/api.ts\n"
    assert main([*at, "callers", "users"]) == 0
    assert capsys.readouterr().out == "backend/server.py  (routes: api/users)\n  frontend/api.ts\n    imported by: frontend/list.ts\n"
    assert main([*at, "callers", "--path", "/tags/", "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["matches"][0]["view"] == "TagView"
    assert main([*at, "importers", "../out"]) == 2
    assert main(["--root", str(routed / "dj"), "deps", "x"]) == 2
    capsys.readouterr()
    assert "similar indexed paths: frontend/api.ts" in serve.answer_deps(routed, "api.ts", False)
    assert "similar indexed views: users" in serve.answer_callers(routed, "user", None, False)


def test_freshness_and_protocol(routed):
    assert serve.freshness(routed)["state"] == "fresh"
    (routed / "frontend/new.ts").write_text("export {}\n")
    f = serve.freshness(routed)
    assert (f["state"], f["changed_count"], f["changed"]) == ("stale", 1, ["frontend/new.ts"])
    os.remove(routed / "frontend/new.ts")
    ask = lambda **m: json.loads(serve.handle(routed, json.dumps({"jsonrpc": "2.0", "id": 1, **m})))
    assert ask(method="initialize")["result"]["serverInfo"]["name"] == "filigree"
    assert [t["name"] for t in ask(method="tools/list")["result"]["tools"]] == ["importers", "route_callers"]
    call = lambda name, **a: ask(method="tools/call", params={"name": name, "arguments": a})["result"]
    text = lambda r: r["content"][0]["text"]
    assert ask(method="initialize", params={"protocolVersion": "2025-06-18"})["result"]["protocolVersion"] == "2025-06-18"
    assert ask(method="initialize", params={"protocolVersion": "1999"})["result"]["protocolVersion"] == "2025-11-25"
    seen = ask(method="server/discover")["result"]
    assert seen["resultType"] == "complete" and "2024-11-05" in seen["supportedVersions"] and seen["_meta"]["io.modelcontextprotocol/serverInfo"]["name"] == "filigree"
    got = call("importers", path="backend/db.py")
    assert json.loads(text(got))["importers"] == [{"path": "backend/server.py", "depth": 1}] and not got["isError"]
    none = call("importers", path="backend/db.py", depth=0)
    assert text(none).startswith("no importers for 'backend/db.py'") and text(none).endswith("index fresh") and not none["isError"]
    assert json.loads(text(call("route_callers", view="users")))["matches"][0]["importers"] == {"frontend/api.ts": ["frontend/list.ts"]}
    assert "similar indexed views: users" in text(call("route_callers", view="user"))
    for bad in ({"path": "../x"}, {"file": "backend/db.py"}, {"path": 3}, {"path": "a", "depth": -1}, {"path": "a", "depth": True}, {"path": "a", "depth": "1"}):
        assert call("importers", **bad)["isError"], bad
    assert call("route_callers")["isError"]
    assert serve.handle(routed, json.dumps({"jsonrpc": "2.0", "id": 5, "method": "notifications/initialized"})) is None and serve.handle(routed, "[1]") is None
    assert ask(method="nope")["error"]["code"] == -32601 and ask(method="tools/call", params={"name": "x"})["error"]["code"] == -32602
    assert json.loads(serve.handle(routed, "{"))["error"]["code"] == -32700 and serve.handle(routed, '{"method": "ping"}') is None


def test_command_line_analysis(tmp_path, capsys):
    root = tree(tmp_path / "p", {"src/a.ts": "import { b } from './b';\nimport './gone';\nexport const a = b;\n", "src/b.ts": "export const b = 1;\n", "importers/c.ts": "export const c = 1;\n"})
    state, out = tmp_path / "state", tmp_path / "docs" / "MAP.md"
    assert main([str(root), "--index-dir", str(state), "--unresolved"]) == 0
    assert "src/a.ts: ./gone" in capsys.readouterr().out and (state / "imports.md").is_file() and not (root / ".filigree").exists()
    assert main([str(root), "--map", "--out", str(out), "--index-dir", str(state), "--no-index", "--no-git"]) == 0
    said = capsys.readouterr().out
    assert "map: " in said and "seconds: " in said and out.is_file() and not (state / "index.json").exists()
    assert main(["importers", "src/b.ts", "--repo", str(root), "--index-dir", str(state), "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["importers"] == [{"path": "src/a.ts", "depth": 1}]
    assert main(["deps", "src/a.ts", "--repo", str(root)]) == 2
    assert main(["agents", "--repo", str(root), "--write", "AGENTS.md"]) == 0 and "importers" in (root / "AGENTS.md").read_text()
    with pytest.raises(SystemExit):
        main([str(root), "--no-index"])


def test_map_fits_or_splits(spark, tmp_path):
    files = {f"src/{d}/{n}.ts": (f"import {{ x }} from './{m}';\n" if m else "") + f"export class {d.title()}{n.title()} {{}}\n" for d in ("auth", "billing", "search") for n, m in (("index", "service"), ("service", "types"), ("types", ""))}
    root = tree(tmp_path / "p", files)
    ix = pipeline.build(spark, root)
    text = pipeline.write_map(ix)
    assert "## Authentication" in text and "3 files under `src/billing`" in text and "Key symbols: " in text
    index = json.loads((root / ".filigree/index.json").read_text())
    assert index["files"] == 9 and sorted(f for c in index["clusters"] for f in c["files"]) == sorted(files)
    assert pipeline.write_map(ix) == text  # the same again
    root_page = pipeline.write_map(ix, budget=10)
    # nothing links the three directories, so they ride in one bucket
    assert "[Files in src](domains/files-in-src.md): 9 files; Authentication; Billing; Search" in root_page
    assert "## Billing" in (root / ".filigree/domains/files-in-src.md").read_text()
    units = [{"label": f"Unit {i}", "domains": [{"name": f"Domain {j}", "files": ["x"]} for j in range(40)], "terms": ["term"] * 8, "budget": 300} for i in range(6)]
    facts = pipeline.map_facts(ix)
    for u in units:
        u["domains"] = [{**facts["domains"][0], **d} for d in u["domains"]]
    tight, _ = render.split_map("t", facts, units, [f"u{i}" for i in range(6)], 150, "../x")
    loose, _ = render.split_map("t", facts, units, [f"u{i}" for i in range(6)])
    assert render.count_tokens(tight) <= 150 < render.count_tokens(loose) and tight.count("(../x/u") == 6 and "Domain 39" in loose


def test_script_facts():
    f = extract.script_facts(
        "import a, { b } from './x';\nimport type { C } from \"@s/c\";\nexport * from './re';\nexport { d } from './d';\nimport './side';\nconst fs = require('fs');\nconst m = await import('./lazy');\n"
        "declare module 'aug' {}\nexport class Foo extends Bar { constructor(http: HttpClient) {} getUser(id: string): any { return this.http.get(`/api/users/${id}/`); } }\n"
        "export function load() { router.navigate(['/skip/me']); form.get('name'); return fetch('/api/tags/'); }\nconst routes = [{ path: 'nope/x', redirectTo: 'q' }];\ntype Kinds = 'aaa' | 'bbb';\nconst value = data['documents'];\nconst hash = '#frag/x';\nconst text = 'has spaces/in it';\n"
    )
    assert [s for s, _ in f.refs] == ["./x", "@s/c", "./re", "./d", "./side", "fs", "./lazy", "aug"]
    assert [line for _, line in f.refs] == list(range(1, 9))
    assert f.urls == ["api/tags"] and f.seqs == [["api", "tags"], ["api", "users"]] and f.extends == ["Bar"] and f.http and not f.partial
    assert ("Foo", "class", True, 9) in f.symbols and ("getUser", "method", True, 9) in f.symbols and ("load", "function", True, 10) in f.symbols and ("Kinds", "type_alias", False, 12) in f.symbols
    assert not any(s[0] == "constructor" for s in f.symbols)
    assert extract.script_facts("const re = /['\"`]/; import x from 'y'").refs == [("y", 1)]
    assert extract.script_facts("function f() {").partial
    assert extract.component_facts("<template/>\n<script lang='ts'>\nimport A from './A.vue'\n</script>\n<script lang='coffee'>\nimport 'no'\n</script>").refs == [("./A.vue", 3)]


def test_python_facts():
    f = extract.python_facts("from django.urls import path, include\nfrom . import views\nfrom __future__ import annotations\nimport a.b as c, d\n@app.get('/api/users', name='x')\nasync def users(): pass\nclass Ab: pass\nurlpatterns = [path('tags/', views.TagView.as_view()), path('v1/', include([path('docs/<int:pk>/', DocView)])), path('x/', include('conduit.urls')), router.register('r', R)]\n")
    assert [s for s, _ in f.refs] == ["django.urls", ".", "__future__", "a.b", "d", "django-include:conduit.urls"]
    assert [m for m, _ in f.members] == ["django.urls.path", "django.urls.include", ".views"]
    assert f.routes == [(["api", "users"], "users"), (["tags"], "TagView"), (["v1", "docs"], "DocView"), ([], "R")] and f.includes == [([], "conduit.urls")]
    assert f.symbols == [("users", "function", False, 6)] and f.urls == ["api/users", "docs/{}"]
    broken = extract.python_facts("import os\nfrom .x import y, z\ndef good(): pass\ndef bad(:\n")
    assert broken.partial and [s for s, _ in broken.refs] == ["os", ".x"] and broken.members == [(".x.y", 2), (".x.z", 2)] and broken.symbols == [("good", "function", False, 3), ("bad", "function", False, 4)]
    assert extract.facts(None, "python") == extract.Facts() and extract.facts("", "ts") == extract.Facts()


def test_manifests(tmp_path):
    root = tree(tmp_path, {**MONO, "manage.py": "import django", "tsconfig.json": '{"extends": "./base"}', "base.json": '{"compilerOptions": {"paths": {"~/*": ["src/*"],}}}', "requirements-dev.txt": "Django_REST.framework==1 # x\n-r other\n", "pnpm-workspace.yaml": "packages:\n  - 'tools/**'\n  - '!x'\n"})
    p = manifests.read(root)
    assert p.name == "shop" and p.package_dirs == ["packages/api", "packages/kit", "packages/web"] and "django-rest-framework" in p.deps
    assert manifests.extended_configs(root) == ["base.json"] and "base.json" in [r for r, _, _ in walk.snapshot(root)]
    assert p.frameworks() == ["Next.js", "Django", "Flask"] and p.frameworks("packages/web") == ["Next.js"]
    assert p.scopes[0] == ("", [("~/*", ["src/*"])], None) and p.scopes[1] == ("packages/web", [("@shared/*", ["packages/shared/*"])], "packages/web")
    assert manifests.workspace_patterns(root) == ["packages/*", "tools/**"]
    assert manifests.strip_jsonc('{"a": "//x", /* y */ "b": [1, 2,], // z\n}') == '{"a": "//x",  "b": [1, 2] \n}'
    assert manifests.entry_labels(p, ["packages/web/app/(g)/[id]/page.tsx", "packages/web/pages/api/x.ts", "src/index.ts", "shop/urls.py"]) == [("packages/web/app/(g)/[id]/page.tsx", "page /:id"), ("packages/web/pages/api/x.ts", "API /api/x"), ("src/index.ts", "entry: src/index.ts"), ("shop/urls.py", "urls shop")]


def test_walk_rules(tmp_path):
    root = tree(tmp_path, {"a.ts": "x", "dist/b.ts": "x", "packages/dist/c.ts": "x", "env/pyvenv.cfg": "", "env/d.py": "x", ".hid/e.ts": "x", "k/.gitignore": "*.gen.ts\n!keep.gen.ts\n/top\n", "k/a.gen.ts": "x", "k/keep.gen.ts": "x", "k/top/x.ts": "x", "k/s/top/y.ts": "x"})
    rels = [r for r, _, _ in walk.walk(root, lambda rel: rel.startswith("packages/"))]
    assert rels == ["a.ts", "k/keep.gen.ts", "k/s/top/y.ts", "packages/dist/c.ts"]


def test_git_log(spark):
    log = "\0abc 100\n\na.ts\nb.ts\n\0bad\n\n\0def 200\n\n"
    got = gitlog.parse_log(spark.createDataFrame([("r", log)], "repo string, log string")).collect()
    assert [(r.commit_id, r.seconds, r.files) for r in got] == [("abc", 100, ["a.ts", "b.ts"])]


def test_map_sentences():
    assert render.relations(None, 0, 0) == "relationships come from resolved imports and directory structure only"
    assert render.relations(4, 1, 2) == "relationships come from resolved imports, 4 git co-change pairs, 1 API contract, 2 cross-language symbol contracts and directory structure"


def test_block_merge():
    b = render.agents_block(True)
    one = render.merge_block("intro\r\n", b)
    assert "\r\n" in one and render.merge_block(one, b) == one and render.merge_block(None, b) == b + "\n"
    assert render.merge_block(render.merge_block("x", render.agents_block(False)), b) == render.merge_block("x", b)
    with pytest.raises(ValueError):
        render.merge_block(render.START, b)


def test_stream_feeds_the_target(spark, tmp_path):
    schema = "repo string, rel string, mtime_ns long, hash string, first_seen timestamp"
    t = VersionedTarget(spark, str(tmp_path / "t"), ["repo", "rel"], "hash")
    step = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: refresh.follow(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, t, lambda d: d, str(tmp_path / "cp")).awaitTermination()
    step([("r", "a", 1, "h1", None), ("r", "a", 2, "h2", None), ("r", "b", 1, "h", None)])
    run()
    step([("r", "a", 3, "h3", None)])
    run()
    assert sorted((r.rel, r.hash) for r in t.read().collect()) == [("a", "h3"), ("b", "h")]


def test_every_query_has_a_name_and_most_have_sql():
    q, s = catalogue.queries(), catalogue.oracle_sql()
    assert set(s) <= set(q) and len(s) > 60


def test_binary_source(spark, tmp_path):
    tree(tmp_path / "shared", {"a.ts": "x\n", "node_modules/b.ts": "x", "c.txt": "x"})
    got = walk.binary_files(spark, str(tmp_path / "shared"), "r").select("rel", "language", "loc", "class").collect()
    assert [tuple(r) for r in got] == [("a.ts", "ts", 1, "source")]


def test_null_and_empty_tables(spark):
    from filigree.functions import classify as C

    df = spark.createDataFrame([(None, None), ("a.ts", ""), ("a.d.ts", "x"), ("b/Test_x.py", "y"), ("m.ts", "z" * 2001)], "rel string, text string")
    got = [tuple(r) for r in df.select(C.language(F.col("rel")), C.file_class(F.col("rel"), F.coalesce("text", F.lit(""))), C.loc(F.col("text"))).collect()]
    assert got[1:] == [("ts", "source", 0), ("ts", "vendored", 1), ("python", "test", 1), ("ts", "generated", 1)]


def test_store_parses_only_what_changed(spark, tmp_path, monkeypatch):
    from filigree.sources import store

    texts = {"a.ts": "import './b';", "b.ts": "export class Bee {}", "c.py": "import os"}
    seen = []
    real = extract.parse

    def spy(df):
        seen.append(sorted(r.rel for r in df.select("rel").collect()) if "rel" in df.columns else [])
        return real(df)

    monkeypatch.setattr(store.extract, "parse", spy)
    s = store.FactStore(spark, str(tmp_path / "s"))

    def run(t):
        df = spark.createDataFrame([("r", i, r, "python" if r.endswith(".py") else "ts", str(hash(x)), x) for i, (r, x) in enumerate(sorted(t.items()))], "repo string, id long, rel string, language string, hash string, text string")
        return {r.file: [x.specifier for x in r.refs] for r in s.parse(df).collect()}

    assert run(texts) == {0: ["./b"], 1: [], 2: ["os"]}
    assert run({**{k: v for k, v in texts.items() if k != "a.ts"}, "c.py": "import re"}) == {0: [], 1: ["re"]}
    assert seen == [["a.ts", "b.ts", "c.py"], ["c.py"]]


def test_build_reuses_stats_and_history(spark, tmp_path, monkeypatch):
    import subprocess

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path / "p"), "-c", "user.name=t", "-c", "user.email=t@example.org", *a], check=True, capture_output=True)
    root = tree(tmp_path / "p", {"a.ts": "import './b';\n", "b.ts": "export const b = 1;\n", "c.ts": "export const c = 1;\n"})
    git("init", "-q")
    for i in range(3):
        (root / "a.ts").write_text(f"import './b';\n// {i}\n")
        (root / "b.ts").write_text(f"export const b = {i};\n")
        git("add", "-A")
        git("commit", "-qm", str(i))
    read, real = [], Path.read_bytes
    monkeypatch.setattr(Path, "read_bytes", lambda p: read.append(p.name) or real(p))
    store = str(tmp_path / "store")

    def build():
        read.clear()
        ix = pipeline.build(spark, root, store)
        sources = sorted(x for x in read if x.endswith(".ts"))
        rel = {r.id: r.rel for r in ix.nodes.collect()}
        classes = {(r.rel, r.loc, r["class"], r.hash) for r in ix.files.collect()}
        return ix, sources, {(rel[r.src], rel[r.dst]) for r in ix.edges.collect()}, classes

    def log(ix):
        churn, pairs, has = pipeline.history(ix)
        return sorted(tuple(r) for r in churn.collect()), sorted(tuple(r) for r in pairs.collect()), has

    one, sources, edges, classes = build()
    assert sources == ["a.ts", "b.ts", "c.ts"] and edges == {("a.ts", "b.ts")}
    first = log(one)
    assert first[2] and len(first[0]) == 3 and [(r[1], r[2]) for r in first[1]] == [(0, 1)]
    two, sources, again, same = build()
    assert sources == [] and again == edges and same == classes
    with monkeypatch.context() as m:
        m.setattr(pipeline.gitlog, "read_log", lambda *_: pytest.fail("the log was read although HEAD stands still"))
        assert log(two) == first
    (root / "a.ts").write_text("import './c';\n// longer than before\n")
    (root / "aa.ts").write_text("import './a';\n")
    three, sources, edges, _ = build()
    assert sources == ["a.ts", "aa.ts"] and edges == {("a.ts", "c.ts"), ("aa.ts", "a.ts")}
    # the remembered pair follows its paths to the new numbers
    assert [(r[1], r[2]) for r in log(three)[1]] == [(0, 2)]
    git("add", "-A")
    git("commit", "-qm", "more")
    assert {r[1]: r[2] for r in log(build()[0])[0]} == {0: 4, 1: 1, 2: 3, 3: 1}
