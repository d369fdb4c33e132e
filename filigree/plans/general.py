"""Queries of the general data problems (2, 4 and 6) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.operators import incremental, orphans, skew
from filigree.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.pending_work(*[table(spark, d, t) for t in ("files", "stored_files", "repo_status", "stored_git", "runs")])


def p2_target_state(spark: SparkSession, d: str) -> DataFrame:
    s = incremental.latest_success(table(spark, d, "stored_files"), table(spark, d, "runs"), ["repo", "rel"], ["hash", "parse_hash"])
    return s.select("repo", "rel", "run_id", "hash", "parse_hash")


def _p4(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, t) for t in ("refs", "edges", "files", "shared_files")]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_rows(*_p4(spark, d))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(*_p4(spark, d))


def p4_current_orphans(spark: SparkSession, d: str) -> DataFrame:
    _, edges, files, shared = _p4(spark, d)
    return orphans.current_orphans(orphans.signed_balance(edges, files, shared)).select("key", F.col("refs").cast("long").alias("refs"))


def _p6(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return skew.importer_counts(table(spark, d, "edges")), skew.dependent_counts(table(spark, d, "clusters"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    files = skew.heavy_by_refinement(table(spark, d, "edges"), "dst", "src", 10, 0.01)
    clusters = skew.heavy_by_refinement(skew.dependents(table(spark, d, "clusters")), "cluster_id", "dependent", 10, 0.01)
    kind = lambda df, k: df.select(F.lit(k).alias("key_kind"), F.col("key").alias("key_id"))
    return kind(files, "file").unionByName(kind(clusters, "cluster"))


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    a, b = _p6(spark, d)
    return a.unionByName(b).select("key_kind", F.col("key").alias("key_id"), "n")


def p6_seen_quantiles(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edges").select(F.col("dst").alias("key"), F.unix_micros(F.col("seen_at").cast("timestamp")).alias("value"), "src").where(F.col("value").isNotNull()).distinct()
    return skew.exact_quantiles(e.select("key", "value"), [0.25, 0.5, 0.9]).select(F.col("key").alias("dst"), "n", "q", "value")


QUERIES = {f.__name__: f for f in (p2_found, p2_target_state, p4_found, p4_report, p4_current_orphans, p6_found, p6_counts, p6_seen_quantiles)}

_STATE = """
state AS (
  SELECT s.repo, s.rel, s.run_id, s.hash, s.parse_hash,
         row_number() OVER (PARTITION BY s.repo, s.rel ORDER BY s.run_id DESC, s.hash DESC NULLS LAST, s.parse_hash DESC NULLS LAST) AS rn
  FROM stored_files s WHERE s.run_id IN (SELECT run_id FROM runs WHERE status = 'succeeded'))"""

_THERE = """
f AS (SELECT DISTINCT id, repo, rel, first_seen, deleted_at FROM files),
sh AS (SELECT DISTINCT id FROM shared_files),
e AS (SELECT DISTINCT src, dst, seen_at FROM edges),
live_edge AS (
  SELECT e.*, (EXISTS (SELECT 1 FROM sh WHERE sh.id = e.src)
      OR EXISTS (SELECT 1 FROM f WHERE f.id = e.src AND (e.seen_at IS NULL OR (f.first_seen <= e.seen_at AND NOT coalesce(f.deleted_at <= e.seen_at, false)))))
    AND (EXISTS (SELECT 1 FROM sh WHERE sh.id = e.dst)
      OR EXISTS (SELECT 1 FROM f WHERE f.id = e.dst AND (e.seen_at IS NULL OR (f.first_seen <= e.seen_at AND NOT coalesce(f.deleted_at <= e.seen_at, false))))) AS there
  FROM e),
r AS (SELECT DISTINCT file, pos, specifier, seen_at FROM refs),
rf AS (
  SELECT r.*, f.repo, f.rel, f.rel LIKE '%.py' AS py,
    CASE WHEN f.rel LIKE '%/%' THEN regexp_replace(f.rel, '/[^/]*$', '') ELSE '' END AS dir,
    (sh.id IS NOT NULL) OR (f.id IS NOT NULL AND (r.seen_at IS NULL OR (f.first_seen <= r.seen_at AND NOT coalesce(f.deleted_at <= r.seen_at, false)))) AS file_there
  FROM r LEFT JOIN f ON r.file = f.id LEFT JOIN sh ON r.file = sh.id),
j AS (
  SELECT *, row_number() OVER () AS rid,
    coalesce(specifier LIKE '.%', false) AND rel IS NOT NULL AND (py OR NOT regexp_matches(specifier, '\\.(css|scss|svg|png|json)$')) AS judged,
    length(regexp_extract(specifier, '^\\.+')) AS dots,
    CASE WHEN dir = '' THEN [] ELSE string_split(dir, '/') END AS up
  FROM rf),
p AS (
  SELECT *, CASE WHEN py THEN CASE WHEN len(up) >= dots - 1 THEN
        trim(array_to_string(up[1:len(up) - (dots - 1)], '/') || '/' || replace(specifier[dots + 1:], '.', '/'), '/') END
      ELSE array_to_string(list_reduce(list_concat([[]::VARCHAR[]], list_transform(string_split(dir || '/' || specifier, '/'), lambda x: [x])),
        lambda a, x: CASE WHEN x[1] IN ('.', '') THEN a WHEN x[1] = '..' THEN a[1:len(a) - 1] ELSE list_concat(a, x) END), '/') END AS path
  FROM j WHERE judged),
c AS (
  SELECT rid, repo, seen_at, path FROM p WHERE path IS NOT NULL
  UNION SELECT rid, repo, seen_at, regexp_replace(path, '\\.(js|jsx|mjs|cjs)$', '') FROM p WHERE NOT py AND regexp_matches(path, '\\.(js|jsx|mjs|cjs)$')),
cand AS (
  SELECT rid, repo, seen_at, path AS rel FROM c
  UNION SELECT rid, repo, seen_at, path || '.' || ext FROM c, (SELECT unnest(['ts','tsx','mts','cts','js','jsx','mjs','cjs','vue','svelte','py']) AS ext)
  UNION SELECT rid, repo, seen_at, CASE WHEN path = '' THEN '' ELSE path || '/' END || base || '.' || ext
    FROM c, (SELECT unnest(['ts','tsx','mts','cts','js','jsx','mjs','cjs','vue','svelte','py']) AS ext), (SELECT unnest(['index', '__init__']) AS base)),
hit AS (
  SELECT DISTINCT cand.rid FROM cand JOIN f ON cand.repo = f.repo AND cand.rel = f.rel
  WHERE cand.seen_at IS NULL OR (f.first_seen <= cand.seen_at AND NOT coalesce(f.deleted_at <= cand.seen_at, false))),
ref_row AS (SELECT j.*, NOT file_there OR (judged AND hit.rid IS NULL) AS orphan FROM j LEFT JOIN hit ON j.rid = hit.rid)"""

SQL = {
    "p2_found": f"""WITH {_STATE},
git AS (SELECT g.repo, g.head, row_number() OVER (PARTITION BY g.repo ORDER BY g.run_id DESC, g.head DESC NULLS LAST) AS rn
  FROM stored_git g WHERE g.run_id IN (SELECT run_id FROM runs WHERE status = 'succeeded'))
SELECT DISTINCT 'file' AS kind, f.repo, f.rel FROM files f LEFT JOIN state s ON f.repo = s.repo AND f.rel = s.rel AND s.rn = 1
WHERE f.deleted_at IS NULL AND NOT coalesce(s.hash = f.hash AND s.parse_hash = f.hash, false)
UNION ALL
SELECT DISTINCT 'head', r.repo, '' FROM repo_status r LEFT JOIN git g ON r.repo = g.repo AND g.rn = 1 WHERE NOT coalesce(g.head = r.head, false)""",
    "p2_target_state": f"WITH {_STATE} SELECT repo, rel, run_id, hash, parse_hash FROM state WHERE rn = 1",
    "p4_found": f"""WITH {_THERE}
SELECT DISTINCT 'refs' AS tab, file AS key_a, CAST(pos AS BIGINT) AS key_b FROM ref_row WHERE orphan
UNION ALL SELECT DISTINCT 'edges', src, dst FROM live_edge WHERE NOT there""",
    "p4_report": f"""WITH {_THERE}, home AS (SELECT id, min(repo) AS repo FROM files GROUP BY id),
a AS (SELECT 'refs' AS tab, seen_at, repo, orphan FROM ref_row
  UNION ALL SELECT 'edges', l.seen_at, home.repo, NOT there FROM live_edge l LEFT JOIN home ON l.src = home.id)
SELECT tab, strftime(seen_at, '%Y-%m') AS month, repo, count(*) AS n, CAST(sum(CASE WHEN orphan THEN 1 ELSE 0 END) AS BIGINT) AS orphans,
  round(1 - sum(CASE WHEN orphan THEN 1 ELSE 0 END) / count(*), 6) AS resolution_rate FROM a GROUP BY ALL""",
    "p4_current_orphans": """WITH p AS (SELECT DISTINCT id, first_seen, deleted_at FROM files),
here AS (SELECT id FROM p WHERE deleted_at IS NULL UNION SELECT id FROM shared_files)
SELECT dst AS key, CAST(count(*) AS BIGINT) AS refs FROM (SELECT DISTINCT src, dst FROM edges) e
WHERE dst IS NOT NULL AND dst NOT IN (SELECT id FROM here) GROUP BY dst""",
    "p6_found": """WITH e AS (SELECT DISTINCT src, dst FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL),
c AS (SELECT DISTINCT cluster_id, x FROM (SELECT cluster_id, unnest(depended_on_by) AS x FROM clusters) u WHERE x IS NOT NULL AND cluster_id IS NOT NULL)
SELECT 'file' AS key_kind, dst AS key_id FROM e GROUP BY dst HAVING count(*) >= 10 AND count(*) >= 0.01 * (SELECT count(*) FROM e)
UNION ALL SELECT 'cluster', cluster_id FROM c GROUP BY cluster_id HAVING count(*) >= 10 AND count(*) >= 0.01 * (SELECT count(*) FROM c)""",
    "p6_counts": """SELECT 'file' AS key_kind, dst AS key_id, count(DISTINCT src) AS n FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY dst
UNION ALL SELECT 'cluster', cluster_id, count(DISTINCT x) FROM (SELECT cluster_id, unnest(depended_on_by) AS x FROM clusters) u WHERE x IS NOT NULL AND cluster_id IS NOT NULL GROUP BY cluster_id""",
    "p6_seen_quantiles": """WITH e AS (SELECT DISTINCT dst, src, epoch_us(seen_at) AS v FROM edges WHERE seen_at IS NOT NULL AND dst IS NOT NULL),
o AS (SELECT dst, v, row_number() OVER (PARTITION BY dst ORDER BY v) AS k, count(*) OVER (PARTITION BY dst) AS n FROM e)
SELECT dst, n, q, v AS value FROM o JOIN (SELECT unnest([0.25::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE]) AS q) t ON k = greatest(1, CAST(ceil(q * n) AS BIGINT))""",
}
