"""Queries on clusters, their summaries and the evaluation measures, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.operators import cluster, cochange, evals, freshness, graph, resolve, summary
from filigree.plans import adapters as A
from filigree.plans import graph as G
from filigree.plans import links as L
from filigree.session import cut, table


def _scores(n: DataFrame) -> DataFrame:
    """A score per file that needs no graph: a hash of its id in 0..1."""
    return n.select("id", ((F.col("id") * 7919) % 1000 / 1000.0).alias("score"))


def _stability(n: DataFrame) -> DataFrame:
    return n.select("id", ((F.col("id") % 5) / 4.0).alias("stability"))


def cluster_members(spark: SparkSession, d: str) -> DataFrame:
    n = cut(A.nodes(spark, d))
    return cluster.clusters(n, cut(G._fused(spark, d, n, A.edges(spark, d, n))))


def cluster_distributed(spark: SparkSession, d: str) -> DataFrame:
    """One resolution without reruns; graphs too large for a task by joins and aggregations."""
    n = cut(A.nodes(spark, d))
    return cluster.distributed(n, G._fused(spark, d, n, A.edges(spark, d, n)), most=1 << 30, ladder=(1.0,), runs=0)


def dominant_dirs(spark: SparkSession, d: str) -> DataFrame:
    n = A.nodes(spark, d)
    m = n.select("repo", "id", (F.col("id") % 6).alias("cluster"))
    return summary.dominant_dirs(m, n, _scores(n)).select("repo", "cluster", F.col("rank").cast("long").alias("rank"), "dir", F.round("weight", 6).alias("weight"))


def pick_symbols(spark: SparkSession, d: str) -> DataFrame:
    n = A.nodes(spark, d)
    s = summary.pick_symbols(graph.directory_partition(n), A.symbols(spark, d, n), _scores(n))
    return s.select("repo", "cluster", F.col("rank").cast("long").alias("rank"), "name", F.round("weight", 6).alias("weight"))


def routing_terms(spark: SparkSession, d: str) -> DataFrame:
    n = A.nodes(spark, d)
    return summary.routing_terms(graph.directory_partition(n), n).select("repo", "cluster", F.col("rank").cast("long").alias("rank"), "term", "n")


def domain_budgets(spark: SparkSession, d: str) -> DataFrame:
    n = cut(A.nodes(spark, d))
    return summary.budgets(graph.directory_partition(n), cochange.churn(cochange.touched(table(spark, d, "commits"), n)))


def cluster_confidence(spark: SparkSession, d: str) -> DataFrame:
    n = cut(A.nodes(spark, d))
    out = cut(L._outcomes(spark, d))
    c = summary.confidence(graph.directory_partition(n), A.edges(spark, d, n), out.where("outcome = 'unresolved'"), _stability(n), cochange.pairs(cochange.touched(table(spark, d, "commits"), n), n), resolve.rates(out))
    r6 = [F.round(x, 6).alias(x) for x in ("resolution", "stability", "agreement", "score")]
    return c.select("repo", "cluster", "size", *r6, "band")


def global_confidence(spark: SparkSession, d: str) -> DataFrame:
    return summary.global_confidence(cluster_confidence(spark, d)).select("repo", F.round("score", 5).alias("score"))


def cluster_order(spark: SparkSession, d: str) -> DataFrame:
    n = A.nodes(spark, d)
    return summary.ranked_clusters(graph.directory_partition(n), _scores(n)).select("repo", "cluster", "place", F.round("importance", 6).alias("importance"), "size")


def _entries(n: DataFrame) -> DataFrame:
    return n.where(F.col("rel").rlike(r"(^|/)(index|__init__|main)\.[^/]*$") | (F.col("id") % 9 == 0)).select("id", F.concat(F.lit("page /"), "rel").alias("label"))


def flows(spark: SparkSession, d: str) -> DataFrame:
    n = cut(A.nodes(spark, d))
    m = n.select("repo", "id", (F.col("id") % 3).alias("cluster"))
    return summary.flows(m, n, _scores(n), A.edges(spark, d, n), _entries(n))


def labels_derived(spark: SparkSession, d: str) -> DataFrame:
    n = cut(A.nodes(spark, d))
    m, sc = graph.directory_partition(n), _scores(n)
    ext = L._outcomes(spark, d).where("outcome = 'external'").select("file", "package")
    return summary.labels(summary.ranked_clusters(m, sc), summary.dominant_dirs(m, n, sc), summary.pick_symbols(m, A.symbols(spark, d, n), sc), summary.cluster_externals(m, ext))


def cluster_externals(spark: SparkSession, d: str) -> DataFrame:
    n = cut(A.nodes(spark, d))
    ext = L._outcomes(spark, d).where("outcome = 'external'").select("file", "package")
    x = summary.cluster_externals(n.select("repo", "id", (F.col("id") % 6).alias("cluster")), ext)
    return x.select("repo", "cluster", F.col("rank").cast("long").alias("rank"), "package", "n")


def coarse_units(spark: SparkSession, d: str) -> DataFrame:
    n = cut(A.nodes(spark, d))
    near = graph.directory_pairs(n).withColumn("w", F.lit(0.25))
    return summary.coarse_units(n.select("repo", "id", (F.col("id") % 60).alias("cluster")), n, near)


def nested_clusters(spark: SparkSession, d: str) -> DataFrame:
    n = cut(A.nodes(spark, d))
    near = graph.directory_pairs(n).withColumn("w", F.lit(0.25))
    return summary.nest(graph.directory_partition(n), summary.coarse_units(n.select("repo", "id", (F.col("id") % 60).alias("cluster")), n, near))


def _answers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """What resolution found of every file's imports, and what is recorded of them: ``task, item`` each."""
    n = cut(A.nodes(spark, d))
    pair = [F.col("src").alias("task"), F.col("dst").alias("item")]
    return L.resolved_edges(spark, d).select(*pair).distinct(), A.edges(spark, d, n).select(*pair).distinct()


def set_f1(spark: SparkSession, d: str) -> DataFrame:
    return evals.set_f1(*_answers(spark, d)).withColumn("f1", F.round("f1", 6))


def route_score(spark: SparkSession, d: str) -> DataFrame:
    s = evals.micro_score(*_answers(spark, d))
    return s.select("tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def lexical_search(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    q = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query"), "text")
    return evals.lexical_search(q, docs.select(F.col("doc_id").alias("id"), "text")).select("query", F.col("rank").cast("long").alias("rank"), "id", "score")


def _tasks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    n = cut(A.nodes(spark, d))
    e = cut(A.edges(spark, d, n))
    reached = cut(graph.closure(e, n.where("id % 50 = 0").select(F.col("id").alias("target"))))
    return n, e, reached, evals.navigation_tasks(reached, n)


def nav_tasks(spark: SparkSession, d: str) -> DataFrame:
    return _tasks(spark, d)[3].select("target", "answers", F.col("max_depth").cast("long").alias("max_depth"), "directories")


def gate_tasks(spark: SparkSession, d: str) -> DataFrame:
    n, e, reached, t = _tasks(spark, d)
    g = evals.gate(t, reached, {"path_guess": evals.path_guess(t, n), "hub_guess": evals.hub_guess(t, n, e)})
    return g.select("target", F.round("path_guess", 6).alias("path_guess"), F.round("hub_guess", 6).alias("hub_guess"), "admitted")


def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    f = set_f1(spark, d)
    return evals.bootstrap(f.select("task", (F.col("f1") - 0.5).alias("d")))


def label_quality(spark: SparkSession, d: str) -> DataFrame:
    n = A.nodes(spark, d)
    labels = n.select(F.col("repo").alias("grp"), "id", F.regexp_extract("rel", r"([^/]*)$", 1).alias("name"), F.concat(F.lit("key files under "), "rel").alias("summary"))
    return evals.label_quality(labels, n.select(F.col("repo").alias("grp"), "id", F.regexp_extract("rel", r"^(.*)\.", 1).alias("text"))).select("count", F.round("grounded", 6).alias("grounded"), F.round("collisions", 6).alias("collisions"))


def arm_summary(spark: SparkSession, d: str) -> DataFrame:
    f = set_f1(spark, d).select(F.when(F.col("task") % 2 == 0, "with_map").otherwise("without_map").alias("arm"), (F.col("f1") == 1).alias("correct"), "f1", F.col("predicted").alias("tokens"))
    return evals.summarize_arms(f).select("arm", "episodes", "correct", F.round("mean_f1", 6).alias("mean_f1"), "tokens", F.round("accuracy", 6).alias("accuracy"))


def index_ceiling(spark: SparkSession, d: str) -> DataFrame:
    c = evals.index_ceiling(*_answers(spark, d))
    return c.select("tasks", F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"), "full", "passed")


def first_match_routes(spark: SparkSession, d: str) -> DataFrame:
    n = A.nodes(spark, d)
    top = n.select("repo", F.substring_index("rel", "/", 1).alias("top")).where("rel LIKE '%/%'").distinct()
    pats = top.select(F.col("repo").alias("grp"), F.col("top").alias("place"), F.concat(F.lit("^"), F.substring("top", 1, 1), F.lit("[a-z]*/.*[a-m]\\.")).alias("regex"), F.col("top").alias("view"))
    return evals.first_match(n.select(F.col("repo").alias("grp"), F.col("rel").alias("url")), pats)


def cochange_delta(spark: SparkSession, d: str) -> DataFrame:
    n = cut(A.nodes(spark, d))
    p = cochange.pairs(cochange.touched(table(spark, d, "commits"), n), n)
    return evals.unexplained_cochange(p, n.select("id", (F.col("id") % 3).alias("cluster")), n.select("id", (F.col("id") % 6).alias("cluster")), A.edges(spark, d, n))


def query_parity(spark: SparkSession, d: str) -> DataFrame:
    n = cut(A.nodes(spark, d))
    e = A.edges(spark, d, n)
    return evals.parity(e, L.resolved_edges(spark, d)).select("repo", "src", "dst", "side")


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from filigree.operators.incremental import latest_success

    s = latest_success(table(spark, d, "stored_files"), table(spark, d, "runs"), ["repo", "rel"], ["mtime_ns", "size"]).select("repo", F.col("rel").alias("path"), "mtime_ns", "size")
    return s, table(spark, d, "files").where("deleted_at IS NULL").select("repo", F.col("rel").alias("path"), "mtime_ns", F.col("bytes").alias("size")).distinct()


def freshness_diff(spark: SparkSession, d: str) -> DataFrame:
    return freshness.diff(*_snapshots(spark, d))


def freshness_state(spark: SparkSession, d: str) -> DataFrame:
    return freshness.state(*_snapshots(spark, d)).select("repo", "state", F.col("changed_count").cast("long").alias("changed_count"), F.array_join("changed", ",").alias("changed"))


def stat_reuse(spark: SparkSession, d: str) -> DataFrame:
    from filigree.operators.incremental import stat_hits

    return stat_hits(*[table(spark, d, t) for t in ("files", "stored_files", "runs")])


def git_memo(spark: SparkSession, d: str) -> DataFrame:
    from filigree.operators.incremental import memo_pairs

    return memo_pairs(*[table(spark, d, t) for t in ("stored_git", "repo_status", "runs")], A.nodes(spark, d))


def repo_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return freshness.fingerprint(table(spark, d, "files").where("deleted_at IS NULL"))


QUERIES = {
    f.__name__: f
    for f in (cluster_members, cluster_distributed, dominant_dirs, pick_symbols, routing_terms, domain_budgets, cluster_confidence, global_confidence, cluster_order, flows, labels_derived, cluster_externals, coarse_units, nested_clusters, set_f1, route_score, lexical_search, nav_tasks, gate_tasks, bootstrap_ci, label_quality, arm_summary, cochange_delta, index_ceiling, first_match_routes, query_parity, freshness_diff, freshness_state, stat_reuse, git_memo, repo_fingerprint)
}

_N = A.SQL["nodes"]
_NE = f"{_N},\n{A.SQL['dedges']}"
_SCORED = "sc AS (SELECT id, (id * 7919) % 1000 / 1000.0 AS score FROM nodes)"
_SETS = f"""{L._OUT}, {A.SQL['dedges']}, p AS (SELECT DISTINCT file AS src, target AS dst FROM o WHERE outcome = 'resolved' AND file <> target), x AS (SELECT DISTINCT src, dst FROM dedges),
u AS (SELECT src, dst, max(a) AS a, max(b) AS b FROM (SELECT src, dst, 1 AS a, 0 AS b FROM p UNION ALL SELECT src, dst, 0, 1 FROM x) y GROUP BY ALL),
f AS (SELECT src AS task, CAST(sum(a) AS BIGINT) AS predicted, CAST(sum(b) AS BIGINT) AS expected, CAST(sum(a * b) AS BIGINT) AS hit FROM u GROUP BY src),
g AS (SELECT *, CASE WHEN hit > 0 THEN 2.0 * hit / (predicted + expected) ELSE 0.0::DOUBLE END AS f1 FROM f)"""


def _words(col: str) -> str:
    stem = "CASE WHEN length(w) > 3 AND w LIKE '%ies' THEN left(w, length(w) - 3) || 'y' WHEN length(w) > 3 AND w LIKE '%s' AND NOT regexp_matches(w, '(ss|us|is)$') THEN left(w, length(w) - 1) ELSE w END"
    stop = "', '".join(evals.STOP)
    return f"list_filter(list_distinct(list_transform(regexp_extract_all(lower(regexp_replace(coalesce({col}, ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[a-z]+'), lambda w: {stem})), lambda w: w NOT IN ('{stop}'))"


_TASKS = f"""WITH RECURSIVE {_NE},
r(target, node, depth) AS (SELECT id, id, 0 FROM nodes WHERE id % 50 = 0 UNION SELECT r.target, e.src, r.depth + 1 FROM r JOIN dedges e ON r.node = e.dst WHERE r.depth < 40 AND e.src <> r.target),
reached AS (SELECT target, node, min(depth) AS depth FROM r WHERE depth > 0 GROUP BY target, node),
tasks AS (SELECT target, count(*) AS answers, CAST(max(depth) AS BIGINT) AS max_depth, count(DISTINCT n.dir) AS directories FROM reached JOIN nodes n ON reached.node = n.id GROUP BY target HAVING count(*) BETWEEN 2 AND 20 AND max(depth) >= 2)"""
_STOPQ = "', '".join(evals.STOP)
_CONF = f"""{L._OUT},
{A.SQL['dedges']},
{G._TOUCH[len(_N) + 2 :]},
{G._PAIRS},
{G._PARTITION},
sz AS (SELECT repo, cluster, count(*) AS size, avg((id % 5) / 4.0) AS stability FROM part GROUP BY repo, cluster),
hitc AS (SELECT e.repo, p.cluster, count(*) AS n FROM dedges e JOIN part p ON e.src = p.id GROUP BY ALL),
missc AS (SELECT p.repo, p.cluster, count(*) AS n FROM o JOIN part p ON o.file = p.id WHERE o.outcome = 'unresolved' GROUP BY ALL),
rate AS (SELECT repo, coalesce(count(*) FILTER (outcome = 'resolved') / nullif(count(*) FILTER (outcome IN ('resolved', 'unresolved')), 0), 1.0) AS rate FROM o GROUP BY repo),
agr AS (SELECT a.repo, a.cluster, avg(CASE WHEN EXISTS (SELECT 1 FROM dedges e WHERE (e.src = c.lo AND e.dst = c.hi) OR (e.src = c.hi AND e.dst = c.lo)) THEN 1.0 ELSE 0.0 END) AS agreement
  FROM p1 c JOIN part a ON c.lo = a.id JOIN part b ON c.hi = b.id WHERE a.cluster = b.cluster GROUP BY ALL),
cf0 AS (SELECT sz.repo, sz.cluster, sz.size, sz.stability, agr.agreement, CASE WHEN coalesce(h.n, 0) + coalesce(m.n, 0) > 0 THEN coalesce(h.n, 0) / (coalesce(h.n, 0) + coalesce(m.n, 0)) ELSE coalesce(rate.rate, 1.0) END AS resolution
  FROM sz LEFT JOIN hitc h ON sz.repo = h.repo AND sz.cluster = h.cluster LEFT JOIN missc m ON sz.repo = m.repo AND sz.cluster = m.cluster LEFT JOIN agr ON sz.repo = agr.repo AND sz.cluster = agr.cluster LEFT JOIN rate ON sz.repo = rate.repo),
conf AS (SELECT *, round(CASE WHEN agreement IS NULL THEN (0.45 * resolution + 0.35 * stability) / (0.45 + 0.35) ELSE 0.45 * resolution + 0.35 * stability + 0.20 * agreement END, 9) AS score FROM cf0)"""

SQL = {
    "dominant_dirs": f"""WITH {_N}, {_SCORED}, w AS (SELECT repo, n.id % 6 AS cluster, dir, round(sum(score + 0.01), 9) AS weight FROM nodes n JOIN sc ON n.id = sc.id GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY repo, cluster ORDER BY weight DESC, dir) AS rank FROM w) SELECT repo, cluster, rank, dir, round(weight, 6) AS weight FROM k WHERE rank <= 3""",
    "pick_symbols": f"""WITH {_N}, {A.SQL['sym']}, {_SCORED}, {G._PARTITION},
w AS (SELECT p.repo, p.cluster, s.name, round(max(2.0 * CASE lower(s.kind) WHEN 'function' THEN 5 WHEN 'class' THEN 5 WHEN 'interface' THEN 4 WHEN 'enum' THEN 3 WHEN 'type_alias' THEN 3 WHEN 'method' THEN 2 WHEN 'const' THEN 1 ELSE 0 END
  + CASE WHEN coalesce(s.exported, false) THEN 3.0 ELSE 0.0 END + 5.0 * sc.score), 9) AS weight FROM part p JOIN sym s ON p.id = s.file JOIN sc ON p.id = sc.id GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY repo, cluster ORDER BY weight DESC, name) AS rank FROM w) SELECT repo, cluster, rank, name, round(weight, 6) AS weight FROM k WHERE rank <= 8""",
    "domain_budgets": f"""WITH {G._TOUCH}, {G._PARTITION}, ch AS (SELECT id, count(DISTINCT commit_id) AS n FROM touch GROUP BY id),
g AS (SELECT p.repo, p.cluster, count(*) AS size, CAST(coalesce(sum(ch.n), 0) AS BIGINT) AS churn FROM part p LEFT JOIN ch ON p.id = ch.id GROUP BY ALL), w AS (SELECT *, size * ln(2.0 + churn) AS w FROM g)
SELECT repo, cluster, size, churn, CAST(greatest(300, least(1200, floor(round(w / greatest(sum(w) OVER (PARTITION BY repo), 1.0) * count(*) OVER (PARTITION BY repo) * 1200, 9)))) AS BIGINT) AS budget FROM w""",
    "cluster_confidence": f"""WITH {_CONF} SELECT repo, cluster, size, round(resolution, 6) AS resolution, round(stability, 6) AS stability, round(agreement, 6) AS agreement, round(score, 6) AS score,
  CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.45 THEN 'medium' ELSE 'low' END AS band FROM conf""",
    "global_confidence": f"WITH {_CONF} SELECT repo, round(sum(round(score, 6) * size) / sum(size), 5) AS score FROM conf GROUP BY repo",
    "cluster_order": f"""WITH {_N}, {_SCORED}, {G._PARTITION}, g AS (SELECT p.repo, p.cluster, round(sum(score), 9) AS importance, count(*) AS size FROM part p JOIN sc ON p.id = sc.id GROUP BY ALL)
SELECT repo, cluster, row_number() OVER (PARTITION BY repo ORDER BY importance DESC, size DESC, cluster) - 1 AS place, round(importance, 6) AS importance, size FROM g""",
    "cluster_externals": f"""WITH {L._OUT}, c AS (SELECT n.repo, n.id % 6 AS cluster, x.package, count(*) AS n FROM nodes n JOIN (SELECT DISTINCT file, package FROM o WHERE outcome = 'external') x ON n.id = x.file GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY repo, cluster ORDER BY n DESC, package) AS rank FROM c) SELECT repo, cluster, rank, package, n FROM k WHERE rank <= 5""",
    "coarse_units": f"""WITH {_N}, {G._DIRP}, fullc AS (SELECT DISTINCT repo, lo % 60 AS cluster FROM dirp WHERE lo % 60 <> hi % 60 UNION SELECT DISTINCT repo, hi % 60 FROM dirp WHERE lo % 60 <> hi % 60)
SELECT n.repo, n.id, CASE WHEN f.cluster IS NOT NULL THEN 'full' ELSE 'bucket' END AS kind, CASE WHEN f.cluster IS NOT NULL THEN CAST(f.cluster AS VARCHAR) WHEN n.rel LIKE '%/%' THEN string_split(n.rel, '/')[1] ELSE '(root)' END AS unit
FROM nodes n LEFT JOIN fullc f ON n.repo = f.repo AND n.id % 60 = f.cluster""",
    "set_f1": f"WITH {_SETS} SELECT task, predicted, expected, hit, round(f1, 6) AS f1 FROM g",
    "route_score": f"""WITH {_SETS}, s AS (SELECT CAST(coalesce(sum(hit), 0) AS BIGINT) AS tp, CAST(coalesce(sum(predicted - hit), 0) AS BIGINT) AS fp, CAST(coalesce(sum(expected - hit), 0) AS BIGINT) AS fn FROM g)
SELECT tp, fp, fn, round(tp / greatest(tp + fp, 1), 6) AS precision, round(tp / greatest(tp + fn, 1), 6) AS recall FROM s""",
    "arm_summary": f"""WITH {_SETS} SELECT CASE WHEN task % 2 = 0 THEN 'with_map' ELSE 'without_map' END AS arm, count(*) AS episodes, count(*) FILTER (round(f1, 6) = 1) AS correct, round(avg(round(f1, 6)), 6) AS mean_f1, CAST(sum(predicted) AS BIGINT) AS tokens,
  round(count(*) FILTER (round(f1, 6) = 1) / count(*), 6) AS accuracy FROM g GROUP BY 1""",
    "lexical_search": f"""WITH d AS (SELECT DISTINCT doc_id, text FROM documents), t AS (SELECT doc_id AS id, unnest({_words('text')}) AS word FROM d), q AS (SELECT id AS query, word FROM t WHERE id % 50 = 0),
n AS (SELECT query, id, count(*) AS score FROM q JOIN (SELECT DISTINCT * FROM t) t ON q.word = t.word GROUP BY query, id), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM n)
SELECT query, rank, id, score FROM k WHERE rank <= 50""",
    "nav_tasks": f"{_TASKS} SELECT target, answers, max_depth, directories FROM tasks",
    "gate_tasks": f"""{_TASKS},
tk AS (SELECT repo, id, rel, tok FROM (SELECT repo, id, rel, unnest(list_distinct(regexp_split_to_array(lower(rel), '[/\\-_.]'))) AS tok FROM nodes) x WHERE length(tok) > 2 AND tok NOT IN ('{_STOPQ}')),
pg AS (SELECT t.target, t.answers, b.id, row_number() OVER (PARTITION BY t.target ORDER BY count(*) DESC, b.rel) AS k FROM tasks t JOIN tk a ON t.target = a.id JOIN tk b ON a.repo = b.repo AND a.tok = b.tok AND b.id <> t.target GROUP BY t.target, t.answers, b.id, b.rel),
hc AS (SELECT n.repo, n.id, n.rel, (SELECT count(*) FROM dedges e WHERE e.dst = n.id) AS c FROM nodes n),
hg AS (SELECT t.target, t.answers, h.id, row_number() OVER (PARTITION BY t.target ORDER BY h.c DESC, h.rel) AS k FROM tasks t JOIN nodes n ON t.target = n.id JOIN hc h ON n.repo = h.repo AND h.id <> t.target),
s AS (SELECT t.target, t.answers, (SELECT count(*) FROM pg WHERE pg.target = t.target AND k <= t.answers) AS np, (SELECT count(*) FROM pg JOIN reached r ON pg.target = r.target AND pg.id = r.node WHERE pg.target = t.target AND k <= t.answers) AS hp,
  (SELECT count(*) FROM hg WHERE hg.target = t.target AND k <= t.answers) AS nh, (SELECT count(*) FROM hg JOIN reached r ON hg.target = r.target AND hg.id = r.node WHERE hg.target = t.target AND k <= t.answers) AS hh FROM tasks t),
z AS (SELECT target, CASE WHEN hp > 0 THEN 2.0 * hp / (np + answers) ELSE 0.0::DOUBLE END AS a, CASE WHEN hh > 0 THEN 2.0 * hh / (nh + answers) ELSE 0.0::DOUBLE END AS b FROM s)
SELECT target, round(a, 6) AS path_guess, round(b, 6) AS hub_guess, greatest(a, b) <= 0.35 AS admitted FROM z""",
    "cochange_delta": f"""WITH {G._TOUCH}, {A.SQL['dedges']}, {G._PAIRS} SELECT repo, lo, hi FROM p1 WHERE lo % 3 = hi % 3 AND lo % 6 <> hi % 6
  AND NOT EXISTS (SELECT 1 FROM dedges e WHERE (e.src = lo AND e.dst = hi) OR (e.src = hi AND e.dst = lo))""",
    "query_parity": f"""WITH {L._OUT}, {A.SQL['dedges']}, x AS (SELECT DISTINCT repo, file AS src, target AS dst FROM o WHERE outcome = 'resolved' AND file <> target)
SELECT *, 'left' AS side FROM (SELECT repo, src, dst FROM dedges EXCEPT SELECT * FROM x) a UNION ALL SELECT *, 'right' FROM (SELECT * FROM x EXCEPT SELECT repo, src, dst FROM dedges) b""",
    "freshness_diff": """WITH s AS (SELECT repo, rel AS path, mtime_ns, size FROM (SELECT *, row_number() OVER (PARTITION BY repo, rel ORDER BY run_id DESC, mtime_ns DESC, size DESC) AS k FROM stored_files WHERE run_id IN (SELECT run_id FROM runs WHERE status = 'succeeded')) x WHERE k = 1),
n AS (SELECT DISTINCT repo, rel AS path, mtime_ns, bytes AS size FROM files WHERE deleted_at IS NULL)
SELECT coalesce(s.repo, n.repo) AS repo, coalesce(s.path, n.path) AS path, CASE WHEN s.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' ELSE 'changed' END AS change
FROM s FULL JOIN n ON s.repo = n.repo AND s.path = n.path WHERE s.path IS NULL OR n.path IS NULL OR s.mtime_ns IS DISTINCT FROM n.mtime_ns OR s.size IS DISTINCT FROM n.size""",
}
SQL["index_ceiling"] = f"""WITH {_SETS}, s AS (SELECT hit / expected AS r, f1 FROM g WHERE expected > 0)
SELECT count(*) AS tasks, round(avg(r), 6) AS recall, round(avg(f1), 6) AS f1, count(*) FILTER (r = 1) AS full, avg(r) >= 0.8 AS passed FROM s"""
SQL["first_match_routes"] = f"""WITH {_N}, p AS (SELECT DISTINCT repo, string_split(rel, '/')[1] AS top FROM nodes WHERE rel LIKE '%/%')
SELECT n.repo AS grp, n.rel AS url, (SELECT min(p.top) FROM p WHERE p.repo = n.repo AND regexp_matches(n.rel, '^' || left(p.top, 1) || '[a-z]*/.*[a-m]\\.')) AS view FROM (SELECT DISTINCT repo, rel FROM nodes) n"""
SQL["stat_reuse"] = """WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, rel ORDER BY run_id DESC, mtime_ns DESC NULLS LAST, size DESC NULLS LAST, hash DESC NULLS LAST, loc DESC NULLS LAST) AS k
  FROM stored_files WHERE run_id IN (SELECT run_id FROM runs WHERE status = 'succeeded')) x WHERE k = 1),
n AS (SELECT DISTINCT repo, rel, mtime_ns, bytes FROM files WHERE deleted_at IS NULL),
j AS (SELECT n.repo, n.rel, s.hash, s.loc, coalesce(s.mtime_ns = n.mtime_ns AND s.size = n.bytes, false) AS hit FROM n LEFT JOIN s ON n.repo = s.repo AND n.rel = s.rel)
SELECT repo, rel, CASE WHEN hit THEN hash END AS hash, CASE WHEN hit THEN loc END AS loc, NOT hit AS reread FROM j"""
SQL["git_memo"] = f"""WITH {_N}, g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY run_id DESC, head DESC NULLS LAST) AS k FROM stored_git WHERE run_id IN (SELECT run_id FROM runs WHERE status = 'succeeded')) x WHERE k = 1),
p AS (SELECT g.repo, unnest(g.pairs) AS p FROM g JOIN (SELECT DISTINCT repo, head FROM repo_status) r ON g.repo = r.repo AND g.head = r.head)
SELECT DISTINCT p.repo, least(a.id, b.id) AS lo, greatest(a.id, b.id) AS hi, p.p.w AS w FROM p JOIN nodes a ON p.repo = a.repo AND p.p.a = a.rel JOIN nodes b ON p.repo = b.repo AND p.p.b = b.rel WHERE a.id <> b.id"""
SQL["nested_clusters"] = f"""WITH {_N}, {G._DIRP}, {G._PARTITION}, fullc AS (SELECT DISTINCT repo, lo % 60 AS cluster FROM dirp WHERE lo % 60 <> hi % 60 UNION SELECT DISTINCT repo, hi % 60 FROM dirp WHERE lo % 60 <> hi % 60),
u AS (SELECT n.repo, n.id, CASE WHEN f.cluster IS NOT NULL THEN 'full' ELSE 'bucket' END AS kind, CASE WHEN f.cluster IS NOT NULL THEN CAST(f.cluster AS VARCHAR) WHEN n.rel LIKE '%/%' THEN string_split(n.rel, '/')[1] ELSE '(root)' END AS unit
  FROM nodes n LEFT JOIN fullc f ON n.repo = f.repo AND n.id % 60 = f.cluster),
k AS (SELECT p.repo, p.cluster, u.kind, u.unit, row_number() OVER (PARTITION BY p.repo, p.cluster ORDER BY count(*) DESC, u.unit, u.kind) AS k FROM part p JOIN u ON p.id = u.id GROUP BY p.repo, p.cluster, u.kind, u.unit)
SELECT repo, cluster, kind, unit FROM k WHERE k = 1"""
SQL["repo_fingerprint"] = """WITH h AS (SELECT DISTINCT repo, sha256(rel || ':' || coalesce(hash, '')) AS h FROM files WHERE deleted_at IS NULL),
g AS (SELECT repo, left(h, 3) AS b, sha256(string_agg(h, chr(10) ORDER BY h)) AS g FROM h GROUP BY repo, left(h, 3)) SELECT repo, sha256(string_agg(g, chr(10) ORDER BY b)) AS fingerprint FROM g GROUP BY repo"""
SQL["label_quality"] = f"""WITH {_N}, l AS (SELECT repo AS grp, id, string_split(rel, '/')[-1] AS name, 'key files under ' || rel AS summary, regexp_extract(rel, '^(.*)\\.', 1) AS txt FROM nodes),
k AS (SELECT *, array_to_string(list_sort({_words('name')}), ' ') AS key, {_words("(name || ' ' || summary)")} AS content, {_words('txt')} AS ok FROM l),
c AS (SELECT *, count(*) OVER (PARTITION BY grp, key) AS same FROM k)
SELECT count(*) AS count, round(avg(CASE WHEN len(list_filter(content, lambda w: NOT list_contains(ok, w) AND w NOT IN ('{"', '".join(evals.BOILERPLATE)}'))) = 0 THEN 1.0 ELSE 0.0 END), 6) AS grounded, round(avg(CASE WHEN same > 1 THEN 1.0 ELSE 0.0 END), 6) AS collisions FROM c"""
SQL["freshness_state"] = f"""WITH d AS ({SQL['freshness_diff']}), c AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path) AS k FROM d),
known AS (SELECT DISTINCT repo FROM stored_files WHERE run_id IN (SELECT run_id FROM runs WHERE status = 'succeeded')),
r AS (SELECT DISTINCT repo FROM files WHERE deleted_at IS NULL UNION SELECT repo FROM known)
SELECT r.repo, CASE WHEN known.repo IS NULL THEN 'unknown' WHEN count(c.path) = 0 THEN 'fresh' ELSE 'stale' END AS state, CASE WHEN known.repo IS NULL THEN 0 ELSE count(c.path) END AS changed_count,
  CASE WHEN known.repo IS NULL THEN '' ELSE coalesce(string_agg(c.path, ',' ORDER BY c.path) FILTER (c.k <= 5), '') END AS changed FROM r LEFT JOIN known ON r.repo = known.repo LEFT JOIN c ON r.repo = c.repo GROUP BY r.repo, known.repo"""
