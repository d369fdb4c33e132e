"""Queries on the import graph, co-change, fusion and clusters, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.operators import cochange, contracts, graph
from filigree.plans import adapters as A
from filigree.session import cut, table


def _targets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").where("id % 50 = 0").select(F.col("id").alias("target")).distinct()


def importers_closure(spark: SparkSession, d: str) -> DataFrame:
    return graph.closure(table(spark, d, "edges"), _targets(spark, d)).select("target", "node", F.col("depth").cast("long").alias("depth"))


def importers_depth2(spark: SparkSession, d: str) -> DataFrame:
    return graph.closure(table(spark, d, "edges"), _targets(spark, d), 2).select("target", "node", F.col("depth").cast("long").alias("depth"))


def deps_closure(spark: SparkSession, d: str) -> DataFrame:
    return graph.closure(table(spark, d, "edges"), _targets(spark, d), reverse=False).select("target", "node", F.col("depth").cast("long").alias("depth"))


def deps_direct(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(table(spark, d, "edges").where("src <> dst"), _targets(spark, d).select(F.col("target").alias("src")))


def imports_index(spark: SparkSession, d: str) -> DataFrame:
    n = A.nodes(spark, d)
    return graph.import_index(n, A.edges(spark, d, n))


def import_pairs(spark: SparkSession, d: str) -> DataFrame:
    n = A.nodes(spark, d)
    return graph.import_pairs(n, A.edges(spark, d, n))


def import_hubs(spark: SparkSession, d: str) -> DataFrame:
    n = A.nodes(spark, d)
    return graph.hubs(n, A.edges(spark, d, n)).select("repo", F.col("rank").cast("long").alias("rank"), "rel", "importers")


def suggest_paths(spark: SparkSession, d: str) -> DataFrame:
    return graph.suggest(A.nodes(spark, d).select("repo", F.col("rel").alias("path")), "Ledger").select("repo", F.col("rank").cast("long").alias("rank"), "path")


def _cochange(spark: SparkSession, d: str, n: DataFrame) -> DataFrame:
    return cochange.pairs(cochange.touched(table(spark, d, "commits"), n), n)


def churn(spark: SparkSession, d: str) -> DataFrame:
    return cochange.churn(cochange.touched(table(spark, d, "commits"), A.nodes(spark, d)))


def cochange_pairs(spark: SparkSession, d: str) -> DataFrame:
    n = A.nodes(spark, d)
    return cochange.normalised(_cochange(spark, d, n)).select("repo", "lo", "hi", F.round("w", 6).alias("w"), "commits")


def directory_pairs(spark: SparkSession, d: str) -> DataFrame:
    return graph.directory_pairs(A.nodes(spark, d))


def _fused(spark: SparkSession, d: str, n: DataFrame, e: DataFrame) -> DataFrame:
    url = contracts.url_pairs(A.urls(spark, d, n))
    sem = contracts.semantic_pairs(A.symbols(spark, d, n), url)
    return graph.fuse(e, cochange.normalised(_cochange(spark, d, n)), url, sem, graph.directory_pairs(n))


def fused_graph(spark: SparkSession, d: str) -> DataFrame:
    n = cut(A.nodes(spark, d))
    return _fused(spark, d, n, A.edges(spark, d, n)).select("repo", "lo", "hi", F.round("w", 6).alias("w"))


def degrees(spark: SparkSession, d: str) -> DataFrame:
    n = cut(A.nodes(spark, d))
    e = cut(A.edges(spark, d, n))
    return graph.degrees(n, e, _fused(spark, d, n, e)).select("repo", "id", "fan_in", "fan_out", F.round("degree", 5).alias("degree"))


def pagerank(spark: SparkSession, d: str) -> DataFrame:
    n = cut(A.nodes(spark, d))
    return graph.pagerank(n, A.edges(spark, d, n)).select("repo", "id", F.round("rank", 9).alias("rank"))


def _importance(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    n = cut(A.nodes(spark, d))
    e = cut(A.edges(spark, d, n))
    fan = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in"))
    fan = n.select("id").join(fan, "id", "left").select("id", F.coalesce("fan_in", F.lit(0)).alias("fan_in"))
    entries = n.where(F.col("rel").rlike(r"(^|/)(index|__init__)\.[^/]*$")).select("id")
    ch = cochange.churn(cochange.touched(table(spark, d, "commits"), n))
    return n, e, graph.importance(graph.pagerank(n, e), fan, ch, entries)


def importance(spark: SparkSession, d: str) -> DataFrame:
    return _importance(spark, d)[2].select("repo", "id", F.round("score", 6).alias("score"))


def directory_partition(spark: SparkSession, d: str) -> DataFrame:
    return graph.directory_partition(A.nodes(spark, d))


def cluster_deps(spark: SparkSession, d: str) -> DataFrame:
    n = cut(A.nodes(spark, d))
    return graph.cluster_edges(graph.directory_partition(n), A.edges(spark, d, n))


def match_clusters(spark: SparkSession, d: str) -> DataFrame:
    n = cut(A.nodes(spark, d))
    other = n.select("repo", "id", (F.col("id") % 7).alias("cluster"))
    return graph.match_clusters(graph.directory_partition(n), other)


QUERIES = {
    f.__name__: f
    for f in (importers_closure, importers_depth2, deps_closure, deps_direct, imports_index, import_pairs, import_hubs, suggest_paths, churn, cochange_pairs, directory_pairs, fused_graph, degrees, pagerank, importance, directory_partition, cluster_deps, match_clusters)
}

_N = A.SQL["nodes"]
_NE = f"{_N},\n{A.SQL['dedges']}"


def _closure(a: str, b: str, cap: int) -> str:
    return f"""WITH RECURSIVE t AS (SELECT DISTINCT id FROM files WHERE id % 50 = 0), s AS (SELECT DISTINCT {a} AS x, {b} AS y FROM edges WHERE src <> dst),
r(target, node, depth) AS (SELECT id, id, 0 FROM t UNION SELECT r.target, s.y, r.depth + 1 FROM r JOIN s ON r.node = s.x WHERE r.depth < {cap} AND s.y <> r.target)
SELECT target, node, CAST(min(depth) AS BIGINT) AS depth FROM r WHERE depth > 0 GROUP BY target, node"""


_TOUCH = f"""{_N},
c0 AS (SELECT repo, commit_id, rel, max(seconds) AS seconds FROM (SELECT repo, commit_id, seconds, regexp_replace(unnest(files), '\\s+$', '') AS rel FROM commits) u GROUP BY ALL),
c1 AS (SELECT c.repo, c.commit_id, n.id, c.seconds FROM c0 c JOIN nodes n ON c.repo = n.repo AND c.rel = n.rel),
c2 AS (SELECT repo, commit_id, max(seconds) AS tm FROM c1 GROUP BY ALL),
c3 AS (SELECT *, greatest(0, max(tm) OVER (PARTITION BY repo) - tm) / 86400.0 AS age FROM c2),
touch AS (SELECT DISTINCT c1.repo, c1.commit_id, c1.id, c3.age FROM c1 JOIN c3 ON c1.repo = c3.repo AND c1.commit_id = c3.commit_id WHERE c3.age <= 730)"""
_PAIRS = """sized AS (SELECT *, count(*) OVER (PARTITION BY repo, commit_id) AS n FROM touch),
p0 AS (SELECT a.repo, a.id AS lo, b.id AS hi, sum(pow(0.5, a.age / 180) / (a.n - 1)) AS w, count(*) AS commits FROM sized a JOIN sized b ON a.repo = b.repo AND a.commit_id = b.commit_id AND a.id < b.id
  WHERE a.n BETWEEN 2 AND 50 GROUP BY ALL HAVING count(*) >= 2),
p1 AS (SELECT p0.* FROM p0 JOIN nodes a ON p0.lo = a.id JOIN nodes b ON p0.hi = b.id WHERE NOT (a.test AND b.test)),
coch AS (SELECT p1.repo, lo, hi, least(w / s.scale, 1.0) AS w, commits FROM p1 JOIN (SELECT repo, quantile_disc(w, 0.99) AS scale FROM p1 GROUP BY repo) s ON p1.repo = s.repo)"""
_COMMON = "', '".join(contracts.COMMON_STEMS)
_SEM = f"""{A.SQL['sym']},
{A.SQL['urls']},
urlp AS (SELECT DISTINCT a.repo, least(a.file, b.file) AS lo, greatest(a.file, b.file) AS hi FROM urls a JOIN urls b ON a.repo = b.repo AND a.url = b.url AND a.python AND NOT b.python),
st0 AS (SELECT DISTINCT repo, file, python, lower(replace(name, '_', '')) AS l FROM sym WHERE lower(kind) IN ('function', 'class', 'method') AND (python OR coalesce(exported, false))),
st1 AS (SELECT DISTINCT repo, file, python, CASE WHEN length(l) > 3 AND l LIKE '%s' AND l NOT LIKE '%ss' THEN left(l, length(l) - 1) ELSE l END AS stem FROM st0),
st2 AS (SELECT *, count(*) FILTER (python) OVER (PARTITION BY repo, stem) AS py, count(*) FILTER (NOT python) OVER (PARTITION BY repo, stem) AS ts FROM st1 WHERE length(stem) >= 3 AND stem NOT IN ('{_COMMON}')),
semp AS (SELECT DISTINCT a.repo, least(a.file, b.file) AS lo, greatest(a.file, b.file) AS hi FROM st2 a JOIN st2 b ON a.repo = b.repo AND a.stem = b.stem AND a.python AND NOT b.python
  WHERE a.py BETWEEN 1 AND 3 AND a.ts BETWEEN 1 AND 3 EXCEPT SELECT repo, lo, hi FROM urlp)"""
_DIRP = """dirp AS (SELECT a.repo, a.id AS lo, b.id AS hi FROM nodes a JOIN nodes b ON a.repo = b.repo AND a.dir = b.dir AND a.id < b.id
  WHERE (a.repo, a.dir) IN (SELECT (repo, dir) FROM nodes GROUP BY repo, dir HAVING count(*) BETWEEN 2 AND 30))"""
_FUSED = f"""fused AS (SELECT repo, lo, hi, sum(w) AS w FROM (
  SELECT repo, least(src, dst) AS lo, greatest(src, dst) AS hi, 1.0::DOUBLE AS w FROM dedges UNION ALL SELECT repo, lo, hi, 0.55 * w FROM coch
  UNION ALL SELECT repo, lo, hi, 0.45 FROM urlp UNION ALL SELECT repo, lo, hi, 0.30 FROM semp UNION ALL SELECT repo, lo, hi, 0.25 FROM dirp) u GROUP BY repo, lo, hi)"""
_ALL = f"WITH {_TOUCH},\n{A.SQL['dedges']},\n{_PAIRS},\n{_SEM},\n{_DIRP},\n{_FUSED}"
_RANKS = (
    """sz AS MATERIALIZED (SELECT repo, count(*)::DOUBLE AS n FROM nodes GROUP BY repo),
ks AS MATERIALIZED (SELECT src, count(*)::DOUBLE AS k FROM dedges GROUP BY src),
r0 AS MATERIALIZED (SELECT nodes.repo, id, 1 / n AS r FROM nodes JOIN sz ON nodes.repo = sz.repo)"""
    + "".join(
        f""",
g{i} AS MATERIALIZED (SELECT e.dst AS id, sum(p.r / ks.k) AS got FROM dedges e JOIN r{i - 1} p ON e.src = p.id JOIN ks ON e.src = ks.src GROUP BY e.dst),
r{i} AS MATERIALIZED (SELECT p.repo, p.id, 0.15 / sz.n + 0.85 * (coalesce(g.got, 0) + l.lost / sz.n) AS r FROM r{i - 1} p JOIN sz ON p.repo = sz.repo
  JOIN (SELECT repo, sum(CASE WHEN id IN (SELECT src FROM ks) THEN 0 ELSE r END) AS lost FROM r{i - 1} GROUP BY repo) l ON p.repo = l.repo LEFT JOIN g{i} g ON p.id = g.id)"""
        for i in range(1, 41)
    )
)
_PARTITION = "part AS (SELECT repo, id, dense_rank() OVER (PARTITION BY repo ORDER BY dir) - 1 AS cluster FROM nodes)"

SQL = {
    "importers_closure": _closure("dst", "src", 40),
    "importers_depth2": _closure("dst", "src", 2),
    "deps_closure": _closure("src", "dst", 40),
    "deps_direct": "SELECT DISTINCT src, dst FROM edges WHERE src % 50 = 0 AND src <> dst AND src IN (SELECT id FROM files) AND dst IS NOT NULL",
    "imports_index": f"""WITH {_NE} SELECT a.repo, b.rel AS target, string_agg(DISTINCT a.rel, ', ' ORDER BY a.rel) AS importers FROM dedges e JOIN nodes a ON e.src = a.id JOIN nodes b ON e.dst = b.id GROUP BY a.repo, b.rel""",
    "import_pairs": f"""WITH {_NE} SELECT DISTINCT a.repo, b.rel AS target, a.rel AS importer FROM dedges e JOIN nodes a ON e.src = a.id JOIN nodes b ON e.dst = b.id""",
    "import_hubs": f"""WITH {_NE}, h AS (SELECT e.repo, n.rel, count(*) AS importers FROM dedges e JOIN nodes n ON e.dst = n.id GROUP BY e.repo, n.rel),
k AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY importers DESC, rel) AS rank FROM h) SELECT repo, rank, rel, importers FROM k WHERE rank <= 8""",
    "suggest_paths": f"""WITH {_N}, k AS (SELECT repo, rel AS path, row_number() OVER (PARTITION BY repo ORDER BY rel) AS rank FROM nodes WHERE contains(lower(rel), 'ledger')) SELECT repo, rank, path FROM k WHERE rank <= 5""",
    "churn": f"WITH {_TOUCH} SELECT repo, id, count(DISTINCT commit_id) AS n FROM touch GROUP BY repo, id",
    "cochange_pairs": f"WITH {_TOUCH},\n{_PAIRS} SELECT repo, lo, hi, round(w, 6) AS w, commits FROM coch",
    "directory_pairs": f"WITH {_N},\n{_DIRP} SELECT repo, lo, hi FROM dirp",
    "fused_graph": f"{_ALL} SELECT repo, lo, hi, round(w, 6) AS w FROM fused",
    "degrees": f"""{_ALL}, ends AS (SELECT lo AS id, w FROM fused UNION ALL SELECT hi, w FROM fused)
SELECT repo, id, (SELECT count(*) FROM dedges e WHERE e.dst = n.id) AS fan_in, (SELECT count(*) FROM dedges e WHERE e.src = n.id) AS fan_out, round(coalesce((SELECT sum(w) FROM ends WHERE ends.id = n.id), 0), 5) AS degree FROM nodes n""",
    "pagerank": f"WITH {_NE},\n{_RANKS} SELECT repo, id, round(r, 9) AS rank FROM r40",
    "importance": f"""WITH {_TOUCH},\n{A.SQL['dedges']},\n{_RANKS},
x AS (SELECT r.repo, r.id, r.r, coalesce((SELECT count(*) FROM dedges e WHERE e.dst = r.id), 0)::DOUBLE AS f,
  ln(1 + coalesce((SELECT count(DISTINCT commit_id) FROM touch t WHERE t.id = r.id), 0)) AS c,
  (SELECT CASE WHEN regexp_matches(n.rel, '(^|/)(index|__init__)\\.[^/]*$') THEN 1.0 ELSE 0.0 END FROM nodes n WHERE n.id = r.id) AS e FROM r40 r),
m AS (SELECT repo, max(r) AS mr, max(f) AS mf, max(c) AS mc FROM x GROUP BY repo)
SELECT x.repo, id, round(0.35 * r / mr + 0.25 * e + 0.20 * CASE WHEN mc > 0 THEN c / mc ELSE 0 END + 0.20 * CASE WHEN mf > 0 THEN f / mf ELSE 0 END, 6) AS score FROM x JOIN m ON x.repo = m.repo""",
    "directory_partition": f"WITH {_N},\n{_PARTITION} SELECT repo, id, cluster FROM part",
    "cluster_deps": f"WITH {_NE},\n{_PARTITION} SELECT DISTINCT e.repo, a.cluster, b.cluster AS depends_on FROM dedges e JOIN part a ON e.src = a.id JOIN part b ON e.dst = b.id WHERE a.cluster <> b.cluster",
    "match_clusters": f"""WITH {_N},\n{_PARTITION}, n AS (SELECT repo, cluster, id % 7 AS matched, count(*) AS shared FROM part GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY repo, cluster ORDER BY shared DESC, matched) AS r FROM n) SELECT repo, cluster, matched, shared FROM k WHERE r = 1""",
}
