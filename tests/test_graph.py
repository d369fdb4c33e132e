"""Graph, resolution, contract and cluster operators on small cases."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from filigree.functions import names
from filigree.operators import cluster, cochange, contracts, evals, freshness, graph, resolve, summary
from filigree.plans import links

NODE = "repo string, id long, rel string, python boolean, test boolean"


def nodes(spark, rels, repo="r"):
    return spark.createDataFrame([(repo, i, r, r.endswith(".py"), ".test." in r) for i, r in enumerate(rels)], NODE)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_closure_has_least_hops_and_ends_in_cycles(spark):
    e = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (0, 3), (3, 1), (5, 5), (None, 0)], "src long, dst long")
    t = spark.createDataFrame([(0,), (5,), (None,)], "target long")
    assert rows(graph.closure(e, t)) == [(0, 1, 1), (0, 2, 2), (0, 3, 2)]
    assert rows(graph.closure(e, t, 1)) == [(0, 1, 1)]
    assert graph.closure(e, t, 0).count() == 0
    assert rows(graph.closure(e, t, reverse=False)) == [(0, 1, 2), (0, 2, 2), (0, 3, 1)]
    assert graph.closure(e.limit(0), t).count() == 0


def test_closure_against_breadth_first_search(spark):
    r = random.Random(5)
    e = [(r.randrange(60), r.randrange(60)) for _ in range(120)]
    want = set()
    for t in range(0, 60, 7):
        seen, front, d = {t}, {t}, 0
        while front:
            d += 1
            front = {a for a, b in e if b in front and a not in seen}
            seen |= front
            want |= {(t, x, d) for x in front}
    got = graph.closure(spark.createDataFrame(e, "src long, dst long"), spark.createDataFrame([(t,) for t in range(0, 60, 7)], "target long"))
    assert {tuple(x) for x in got.collect()} == want


def test_pagerank_sums_to_one_and_both_ways_agree(spark):
    n = nodes(spark, [f"f{i}.ts" for i in range(30)])
    r = random.Random(6)
    e = spark.createDataFrame([("r", a, b) for a, b in {(r.randrange(20), r.randrange(30)) for _ in range(60)} if a != b], "repo string, src long, dst long")
    a = {x.id: x.rank for x in graph.pagerank(n, e).collect()}
    b = {x.id: x.rank for x in graph.pagerank_rounds(n, e).collect()}
    assert abs(sum(a.values()) - 1) < 1e-9
    assert all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_resolution_order(spark):
    n = nodes(spark, ["src/auth.ts", "src/auth/index.ts", "src/auth.js", "src/app.ts", "lib/util.tsx", "src/x.vue", "pkg/__init__.py", "pkg/a.py", "pkg/sub/__init__.py", "tool/run.py", "tool/helper.py", "src/self.ts"])
    k = {r.key: r.id for r in resolve.file_keys(n).collect()}
    assert k["src/auth"] == 0 and k["src/auth.js"] == 2 and k["pkg"] == 6 and k["lib/util"] == 4
    refs = [(3, 0, "./auth"), (3, 1, "./auth.js"), (3, 2, "../lib/util.js"), (3, 3, "./x.vue"), (3, 4, "./gone"), (3, 5, "./a.css?raw"), (3, 6, "react"), (3, 7, "@s/p/q"), (3, 8, "@/lib/util"), (3, 9, "node:fs"), (3, 10, "own/x"), (3, 11, "./dist/y"), (11, 0, "./self"), (7, 0, ".sub"), (7, 1, "pkg.sub"), (7, 2, "pkg.zzz"), (7, 3, "os.path"), (7, 4, "__future__"), (9, 0, "helper"), (7, 5, "...x")]
    alias = spark.createDataFrame([("r", "@/*", "*", 0)], "repo string, pattern string, target string, place int")
    local, disk = spark.createDataFrame([("r", "own")], "repo string, package string"), spark.createDataFrame([("r", "src/dist/y")], "repo string, path string")
    out = resolve.outcomes(spark.createDataFrame(refs, "file long, pos int, specifier string"), n, local, alias, disk, root_base=False)
    got = {(r.file, r.pos): (r.outcome, r.target, r.package) for r in out.collect()}
    assert got[3, 0] == ("resolved", 0, None) and got[3, 1] == ("resolved", 2, None) and got[3, 2] == ("resolved", 4, None) and got[3, 3] == ("resolved", 5, None)
    assert got[3, 4][0] == "unresolved" and got[3, 5][0] == "asset" and got[3, 6] == ("external", None, "react") and got[3, 7] == ("external", None, "@s/p")
    assert got[3, 8] == ("resolved", 4, None) and got[3, 9] == ("external", None, "fs") and got[3, 10][0] == "unresolved" and got[3, 11][0] == "excluded"
    assert got[7, 0] == ("resolved", 8, None) and got[7, 1] == ("resolved", 8, None) and got[7, 2][0] == "unresolved" and got[7, 3] == ("external", None, "os")
    assert got[7, 4][0] == "ignored" and got[9, 0] == ("resolved", 10, None) and got[7, 5][0] == "unresolved"
    assert (11, 11) not in {(r.src, r.dst) for r in resolve.resolved_edges(out).collect()}
    rate = resolve.rates(out).first()
    assert rate.rate == pytest.approx(rate.resolved / (rate.resolved + rate.unresolved))


def test_alias_stop_ends_the_search(spark):
    n = nodes(spark, ["p/src/x.ts", "p/a.ts", "app/m.ts"])
    refs = spark.createDataFrame([(2, 0, "pkg/x"), (2, 1, "pkg/a")], "file long, pos int, specifier string")
    rule = [("r", "", "pkg/x", None, 0, True), ("r", "", "pkg/*", "p/*", 1, False), ("r", "", "pkg/*", "p/src/*", 2, False)]
    alias = spark.createDataFrame(rule, "repo string, scope string, pattern string, target string, place int, stop boolean")
    got = {r.pos: r.outcome for r in resolve.outcomes(refs, n, None, alias, None, root_base=False).collect()}
    assert got == {0: "external", 1: "resolved"}


def _sym(spark, data):
    return spark.createDataFrame([("r", *x) for x in data], "repo string, file long, name string, kind string, exported boolean, python boolean")


def test_route_join_mount_and_shadow(spark):
    routes = spark.createDataFrame(
        [("r", 0, ["api", "documents"], "DocView"), ("r", 0, ["api", "documents", "chat"], "ChatView"), ("r", 0, ["api", "tags"], "TagView"), ("r", 0, ["x"], "Lost")],
        "repo string, file long, segments array<string>, view string",
    )
    sym = _sym(spark, [(1, "DocView", "class", False, True), (1, "ChatView", "class", False, True), (1, "TagView", "class", False, True), (2, "Twice", "class", False, True)])
    lit = spark.createDataFrame([("r", 5, ["documents", "chat"]), ("r", 6, ["documents"]), ("r", 6, ["documents", "chat"]), ("r", 7, ["tags"]), ("r", 8, ["tags"])], "repo string, file long, seq array<string>")
    callers = spark.createDataFrame([("r", 5), ("r", 6), ("r", 7)], "repo string, file long")
    got = {r.view: (r.routes, r.callers) for r in contracts.route_links(routes, sym, lit, callers).collect()}
    assert got == {"ChatView": (["documents/chat"], [5, 6]), "DocView": (["documents"], [6]), "TagView": (["tags"], [7])}


def test_http_closure_needs_one_owner(spark):
    sym = _sym(spark, [(1, "Base", "class", True, False), (2, "Mid", "class", True, False), (3, "Two", "class", True, False), (4, "Two", "class", True, False)])
    ext = spark.createDataFrame([("r", 2, "Base"), ("r", 5, "Mid"), ("r", 6, "Two"), ("r", 7, "None")], "repo string, file long, base string")
    start = spark.createDataFrame([("r", 1), ("r", 3)], "repo string, file long")
    assert [x[1] for x in rows(contracts.http_files(start, ext, sym))] == [1, 2, 3, 5]


def test_semantic_pairs(spark):
    sym = _sym(spark, [(1, "create_user", "function", False, True), (2, "createUsers", "function", True, False), (3, "create_user", "const", True, False), (4, "createUser", "function", False, False), (1, "get", "function", False, True), (2, "get", "function", True, False)])
    none = spark.createDataFrame([], "repo string, lo long, hi long")
    assert rows(contracts.semantic_pairs(sym, none)) == [("r", 1, 2)]
    assert contracts.semantic_pairs(sym, spark.createDataFrame([("r", 1, 2)], "repo string, lo long, hi long")).count() == 0


def test_cochange_credit(spark):
    n = nodes(spark, ["a.ts", "b.ts", "c.test.ts", "d.test.ts"])
    day = 86400
    c = [("1", "r", 0, ["a.ts", "b.ts"]), ("2", "r", 180 * day, ["a.ts ", "b.ts", "c.test.ts"]), ("3", "r", 180 * day, ["c.test.ts", "d.test.ts"]), ("4", "r", 180 * day, ["d.test.ts", "c.test.ts"]), ("5", "r", 900 * day, ["README"]), ("6", "r", -700 * day, ["a.ts", "b.ts"]), ("2", "r", 180 * day, ["b.ts", "a.ts", "c.test.ts"])]
    t = cochange.touched(spark.createDataFrame(c, "commit_id string, repo string, seconds long, files array<string>"), n)
    p = cochange.pairs(t, n).collect()
    assert [(r.lo, r.hi, r.commits) for r in p] == [(0, 1, 2)]
    assert p[0].w == pytest.approx(0.5 + 0.5)
    assert {r.id: r.n for r in cochange.churn(t).collect()} == {0: 2, 1: 2, 2: 3, 3: 2}


CLIQUES = [(i, j, 1.0) for b in (0, 5) for i in range(b, b + 5) for j in range(i + 1, b + 5)] + [(4, 5, 0.1)]


def graph_of(n, pairs):
    return cluster.Graph.of(range(n), *zip(*pairs))


def test_arrays_find_two_cliques_and_repeat():
    g = graph_of(10, CLIQUES)
    m = cluster.partition(g, 1.0, 7).tolist()
    assert m == [0] * 5 + [5] * 5 == cluster.partition(g, 1.0, 7).tolist()
    assert (cluster.stability(g, cluster.targeting(g)) == 1.0).all()


def random_pairs(r, n, m, first=0):
    return [(first + a, first + b, r.choice([1.0, 0.5, 1 / 3])) for a, b in sorted({tuple(sorted((r.randrange(n), r.randrange(n)))) for _ in range(m)}) if a != b]


def test_clusters_are_connected_and_capped():
    r = random.Random(8)
    g = graph_of(80, random_pairs(r, 80, 160))
    for gamma in (0.5, 2.0):
        m = cluster.partition(g, gamma, 3)
        assert (g.ids[cluster.parts(g, m)] == m).all()
    m = cluster.folded(g, cluster.partition(g, 4.0, 3))
    small = [c for c in set(m.tolist()) if (m == c).sum() < cluster.LEAST_SIZE]
    assert not any((m[g.src] == c).any() and (m[g.dst[m[g.src] == c]] != c).any() for c in small)
    assert len(set(cluster.targeting(g, 3).tolist())) <= max(3, len(set(cluster.parts(g, np.zeros(80, int)).tolist())))
    # joining never joins what has no link
    apart = graph_of(6, [(0, 1, 1.0), (2, 3, 1.0), (4, 5, 1.0)])
    c, place = apart.contract(np.array([0, 0, 2, 2, 4, 4]))
    assert len(set(cluster.capped(c.ids, np.array([2, 2, 2]), c.src, c.dst, c.w, 1).tolist())) == 3
    chain = graph_of(5, [(0, 1, 1.0), (1, 2, 2.0), (2, 3, 1.0), (3, 4, 3.0)])
    assert cluster.capped(chain.ids, np.array([1, 2, 2, 2, 1]), chain.src, chain.dst, chain.w, 2).tolist() == [0, 0, 0, 3, 3]


def test_moves_gain_modularity():
    r = random.Random(11)
    g = graph_of(60, random_pairs(r, 60, 200))

    def quality(label):
        inner = g.w[label[g.src] == label[g.dst]].sum()
        return inner / g.k.sum() - sum(float(g.k[label == c].sum()) ** 2 for c in set(label.tolist())) / float(g.k.sum()) ** 2

    m = cluster.partition(g, 1.0, 5)
    assert quality(m) > quality(np.zeros(60, int)) + 0.2 and quality(m) > quality(np.arange(60))


def test_tables_give_the_clusters_of_the_arrays(spark, monkeypatch):
    r = random.Random(5)
    e = [("a", *x) for x in random_pairs(r, 40, 70)] + [("b", *x) for x in random_pairs(r, 30, 90, 100)] + [("c", i + 200, j + 200, w) for i, j, w in CLIQUES]
    n = [("a", i, f"d/f{i:03}.ts") for i in range(40)] + [("b", i, f"d/f{i}.ts") for i in range(100, 130)] + [("c", i, f"d/f{i}.ts") for i in range(200, 210)] + [("none", 300, "x/a.ts"), ("none", 301, "y/b.ts")]
    ns, es = spark.createDataFrame(n, "repo string, id long, rel string"), spark.createDataFrame(e, "repo string, lo long, hi long, w double")
    got = {}
    for edges in (cluster.KERNEL_EDGES, 0):
        monkeypatch.setattr(cluster, "KERNEL_EDGES", edges)
        got[edges] = rows(cluster.clusters(ns, es, most=4, ladder=(1.4,), runs=1))
    assert got[0] == got[1_000_000] and len(got[0]) == len(n)
    by = {i: c for _, i, c, _ in got[0]}
    assert by[300] != by[301] and len({by[i] for i in range(200, 205)}) == 1 and by[200] != by[209]


def test_levels_that_fit_are_finished_in_a_task(spark, monkeypatch):
    r = random.Random(6)
    pairs = random_pairs(r, 60, 110), random_pairs(r, 20, 30, 100)
    e = [(x, *p) for x, ps in zip("ab", pairs) for p in ps]
    n = [("a", i) for i in range(60)] + [("b", i) for i in range(100, 120)] + [("c", 200)]
    ns, es = spark.createDataFrame(n, "repo string, id long"), spark.createDataFrame(e, "repo string, lo long, hi long, w double")
    want = set()
    for repo in "abc":
        g = cluster.Graph.of([i for x, i in n if x == repo], *(zip(*[p[1:] for p in e if p[0] == repo]) if repo != "c" else ([], [], [])))
        want |= {(repo, int(i), int(c)) for i, c in zip(g.ids, cluster.folded(g, cluster.partition(g, 1.0, 3)))}
    jobs = {}
    # at 50, "a" is too large at first and handed over as a contracted graph
    for limit in (cluster.KERNEL_EDGES, 50):
        monkeypatch.setattr(cluster, "KERNEL_EDGES", limit)
        spark.sparkContext.setJobGroup(f"limit {limit}", "")
        got = cluster.distributed(ns, es, 1 << 30, 3, (1.0,), 0).collect()
        jobs[limit] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"limit {limit}"))
        assert {(x.repo, x.id, x.cluster) for x in got} == want
    # no rounds of joins where all fit
    assert jobs[1_000_000] < 0.5 * jobs[50], jobs


def test_confidence_drops_missing_agreement(spark):
    m = spark.createDataFrame([("r", i, i // 2) for i in range(4)], "repo string, id long, cluster long")
    e = spark.createDataFrame([("r", 0, 1)], "repo string, src long, dst long")
    un = spark.createDataFrame([("r", 2)], "repo string, file long")
    st = spark.createDataFrame([(i, 1.0) for i in range(4)], "id long, stability double")
    cc = spark.createDataFrame([("r", 0, 1)], "repo string, lo long, hi long")
    rates = spark.createDataFrame([("r", 0.5)], "repo string, rate double")
    got = {r.cluster: (r.agreement, r.score, r.band) for r in summary.confidence(m, e, un, st, cc, rates).collect()}
    assert got[0] == (1.0, pytest.approx(1.0), "high")
    assert got[1] == (None, pytest.approx(0.35 / 0.8, abs=1e-6), "low")


def test_flows(spark):
    n = nodes(spark, [f"f{i}" for i in range(12)])
    m = spark.createDataFrame([("r", i, 0 if i < 5 else 1) for i in range(12)], "repo string, id long, cluster long")
    sc = spark.createDataFrame([(i, 1.0) for i in range(12)], "id long, score double")
    # in cluster 1 the second hop is a fan of two leaves; 11 is under the floor, 10 has no way on
    e = spark.createDataFrame([("r", a, b) for a, b in [(0, 1), (1, 2), (1, 3), (3, 4), (4, 0), (0, 9), (5, 6), (6, 7), (6, 8), (10, 11)]], "repo string, src long, dst long")
    entries = spark.createDataFrame([(0, "main"), (0, "other"), (5, "fan"), (10, "low"), (2, "alone"), (3, None)], "id long, label string")
    low = sc.where("id <> 11")
    got = {r.label: (list(r.path), r.leaves) for r in summary.flows(m, n, low, e, entries).collect()}
    assert got == {"main": ([0, 1, 3, 4], 0), "fan": ([5, 6], 2)}
    assert summary.flows(m, n, sc, e, entries.limit(0)).count() == 0 == summary.flows(m.limit(0), n, sc, e, entries).count()
    f = summary.quartile_floor(m.join(sc.withColumn("score", F.col("id") / 2.0), "id")).collect()
    assert {r.cluster: r.floor for r in f} == {0: 0.5, 1: 3.0}


def test_names():
    assert names.humanize("password_reset") == "Password Reset" and names.humanize("userProfile") == "User Profile" and names.humanize("auth") == "Authentication"
    assert names.distinct_names(["packages/shop/src", "src", None]) == ["Shop", "Core", "Root"]
    assert names.distinct_names(["billing/api"], ["API"]) == ["Billing API"] and names.distinct_names(["api"], ["API", "API 2"]) == ["API 3"]
    assert names.assign_slugs(["Core", "Core 2", "core"]) == ["core", "core-2", "core-3"]
    assert names.route_segments(r"^documents/(?P<pk>[^/]+)/notes/$") == ["documents", "notes"] and names.route_segments("`${base}docs/${id}/x1/`") == ["docs", "x1"]
    assert names.path_terms("src/runtime.development.js") == ["runtime", "development"]


def test_evaluation_measures(spark):
    p = spark.createDataFrame([(1, "a"), (1, "b"), (2, "x"), (1, "a")], "task long, item string")
    e = spark.createDataFrame([(1, "a"), (1, "c"), (1, "d"), (3, "q")], "task long, item string")
    got = {r.task: r.f1 for r in evals.set_f1(p, e).collect()}
    assert got == {1: pytest.approx(2 / 5), 2: 0.0, 3: 0.0}
    m = evals.micro_score(p, e).first()
    assert (m.tp, m.fp, m.fn) == (1, 2, 3)
    b = evals.bootstrap(spark.createDataFrame([(i, 0.5) for i in range(20)], "task long, d double"), samples=50).first()
    assert (b.low, b.high, b.better, b.worse) == (0.5, 0.5, 20, 0)
    r = np.random.default_rng(4)
    d = r.normal(0.1, 1, 150)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(d)], "task long, d double")
    b = evals.bootstrap(df, samples=4000)
    means = d[r.integers(0, 150, (4000, 150))].mean(1)
    got = b.first()
    assert abs(got.low - np.quantile(means, 0.025)) < 0.02 and abs(got.high - np.quantile(means, 0.975)) < 0.02 and got.delta == pytest.approx(d.mean())
    assert tuple(got) == pytest.approx(tuple(evals.bootstrap(df.repartition(7), samples=4000).first()))
    assert evals.bootstrap(df.limit(0), samples=10).first().low is None
    q = spark.createDataFrame([(1, "Parsing tokens")], "query long, text string")
    t = spark.createDataFrame([(7, "token parsing of files"), (8, "the tokens"), (9, None), (10, "")], "id long, text string")
    assert [(r.id, r.score) for r in evals.lexical_search(q, t).orderBy("rank").collect()] == [(7, 2), (8, 1)]


def test_lexical_search_by_blocks(spark, monkeypatch):
    r = random.Random(3)
    vocabulary = ["".join(r.choice("bcdfgh") for _ in range(6)) for _ in range(60)]
    text = lambda: " ".join(vocabulary[min(r.randrange(60), r.randrange(60))] for _ in range(r.randrange(25)))
    t = [(i, text()) for i in range(400)] + [(None, "bbbbbb cccccc"), (900, "bbbbbb cccccc"), (7, text()), (8, None)]
    q = [(i, text()) for i in range(40)] + [(99, "bbbbbb cccccc dd")]
    words = lambda rows: {i: {w for j, x in rows if i == j and x for w in x.split()} for i, _ in rows}
    want, of = set(), words(t)
    for i, w in words(q).items():
        n = sorted((-len(w & x), j is None, j or 0, j) for j, x in of.items() if w & x)[:5]
        want |= {(i, k + 1, j, -s) for k, (s, _, _, j) in enumerate(n)}
    ts, qs = spark.createDataFrame(t, "id long, text string"), spark.createDataFrame(q, "query long, text string")
    for queries, texts, rare in ((512, 4096, 256), (7, 16, 256), (7, 3, 1), (16, 50, 1 << 40)):
        monkeypatch.setattr("filigree.operators.search.QUERIES", queries, raising=False)
        monkeypatch.setattr("filigree.operators.search.TEXTS", texts, raising=False)
        monkeypatch.setattr("filigree.operators.search.RARE", rare, raising=False)
        got = evals.lexical_search(qs, ts, 5)
        assert {tuple(x) for x in got.collect()} == want
    # no row for each word that a pair shares
    assert not {"SortMergeJoin", "HashJoin"} & set(re.findall("SortMergeJoin|HashJoin", got._jdf.queryExecution().toString()))
    assert evals.lexical_search(qs.limit(0), ts).count() == 0 == evals.lexical_search(qs, ts.limit(0)).count()


def test_freshness(spark):
    s = spark.createDataFrame([("r", "a", 1, 1), ("r", "b", 1, None), ("r", "c", 1, 1)], "repo string, path string, mtime_ns long, size long")
    n = spark.createDataFrame([("r", "a", 2, 1), ("r", "b", 1, None), ("r", "d", 1, 1), ("q", "z", 1, 1)], "repo string, path string, mtime_ns long, size long")
    assert rows(freshness.diff(s, n.where("repo = 'r'"))) == [("r", "a", "changed"), ("r", "c", "deleted"), ("r", "d", "added")]
    got = {r.repo: (r.state, r.changed_count, r.changed) for r in freshness.state(s, n).collect()}
    assert got == {"r": ("stale", 3, ["a", "c", "d"]), "q": ("unknown", 0, [])}


def test_top_per_ties_and_hubs(spark):
    n = nodes(spark, ["b.ts", "a.ts", "c.ts"])
    e = spark.createDataFrame([("r", 2, 0), ("r", 2, 1)], "repo string, src long, dst long")
    assert [(r.rank, r.rel) for r in graph.hubs(n, e, 1).collect()] == [(1, "a.ts")]
    assert graph.suggest(n.select("repo", F.col("rel").alias("path")), "").count() == 0


def test_ordered_matching_review_and_ceiling(spark):
    u = spark.createDataFrame([("r", "/api/x/"), ("r", "/no"), ("q", "/api/x/")], "grp string, url string")
    p = spark.createDataFrame([("r", 2, "^/api/", "late"), ("r", 1, "^/api/x", "early")], "grp string, place int, regex string, view string")
    assert rows(evals.first_match(u, p)) == [("q", "/api/x/", None), ("r", "/api/x/", "early"), ("r", "/no", None)]
    v = spark.createDataFrame([("a", True), ("a", False), ("b", True), ("b", None)], "arm string, accepted boolean")
    assert rows(evals.accept_rates(v)) == [("a", 2, 1, 0.5), ("b", 1, 1, 1.0)]
    items = spark.createDataFrame([(i,) for i in range(9)], "id long")
    order = [r.id for r in evals.blind_order(items, 3).orderBy("place").collect()]
    assert sorted(order) == list(range(9)) and order != list(range(9)) and order == [r.id for r in evals.blind_order(items.repartition(3), 3).orderBy("place").collect()]
    a = spark.createDataFrame([(1, "a"), (2, "x")], "task long, item string")
    c = evals.index_ceiling(a, spark.createDataFrame([(1, "a"), (3, "q")], "task long, item string")).first()
    assert (c.tasks, c.recall, c.full, c.passed) == (2, 0.5, 1, False)


def tables(spark, d, files, edges, symbols):
    """The tables that plans on links read, of present files of one repository."""
    spark.createDataFrame([(i, "r", rel, None) for i, rel in files], "id long, repo string, rel string, deleted_at timestamp").write.parquet(f"{d}/files.parquet")
    spark.createDataFrame(edges, "src long, dst long").write.parquet(f"{d}/edges.parquet")
    spark.createDataFrame(symbols, "file long, name string, kind string, exported boolean").write.parquet(f"{d}/symbols.parquet")
    return str(d)


def test_every_python_import_brings_its_routes(spark, tmp_path):
    d = tables(spark, tmp_path, [(1, "a.py"), (2, "b.py"), (22, "c.py"), (3, "d.ts")], [(1, 2), (22, 2), (2, 1), (3, 2)], [(2, "get_tags", "function", True)])
    assert rows(links.route_include_stitch(spark, d)) == [("r", 1, "v1/m1/api/get/tags", "get_tags"), ("r", 2, "api/get/tags", "get_tags"), ("r", 22, "v1/m1/api/get/tags", "get_tags")]


def test_every_sender_starts_the_closure(spark, tmp_path):
    d = tables(spark, tmp_path, [(1, "base.ts"), (2, "sub.ts"), (3, "subsub.ts"), (4, "other.ts"), (7, "seventh.ts"), (8, "base.test.ts")], [(2, 1), (3, 2), (4, 3)], [(1, "Base", "class", True), (2, "sub", "function", True), (7, "SEVEN", "const", True), (8, "Tested", "class", True)])
    assert rows(links.http_closure(spark, d)) == [("r", 1), ("r", 2), ("r", 7)]
