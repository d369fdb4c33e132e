"""Queries of the training-text problems (1, 3, 5, 7, 8 and 9) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.llm import canon, cooccur, leaks, mixing, origin, syntax
from filigree.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.broken_files(table(spark, d, "files")).select("file")


def p1_errors(spark: SparkSession, d: str) -> DataFrame:
    return syntax.broken_files(table(spark, d, "files")).select("file", "repo", "language", "cause", "line", "message", "n_errors", "accepted_by")


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.parse_rates(*[table(spark, d, t) for t in ("files", "symbols", "refs")])


def _paths(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(F.col("grp").alias("repo"), F.col("a").alias("path_a"), F.col("b").alias("path_b"), *columns)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _paths(cooccur.lifted_pairs(table(spark, d, "commits"), 5, 3))


def p3_surprise(spark: SparkSession, d: str) -> DataFrame:
    s = cooccur.surprising_pairs(table(spark, d, "commits"))
    return _paths(s, "nab", "na", "nb", "n", F.round("lift", 6).alias("lift"), F.round("expected", 6).alias("expected"), "p_value", "significant", "met")


def p3_agreement(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.agreement(cooccur.surprising_pairs(table(spark, d, "commits")), 5, 3).withColumnRenamed("grp", "repo")


def p3_pair_counts(spark: SparkSession, d: str) -> DataFrame:
    b, items = cooccur.numbered(cooccur.baskets(table(spark, d, "commits")))
    return _paths(cooccur.named(cooccur.pair_counts(b, items, 1), items), "nab")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return origin.classify_origin(table(spark, d, "files")).select("file").distinct()


def p5_origin(spark: SparkSession, d: str) -> DataFrame:
    return origin.classify_origin(table(spark, d, "files")).select("file", "repo", "rel", F.array_join("origin", ",").alias("origin")).distinct()


def p5_shared_subtrees(spark: SparkSession, d: str) -> DataFrame:
    return origin.shared_subtrees(origin.merkle(origin.leaves(table(spark, d, "files")).distinct()))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leak_report(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture_report(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return canon.lookalike_pairs(table(spark, d, "documents"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    return canon.lookalike_classes(table(spark, d, "documents")).select("doc_id", "form", "spellings", "documents", "links")


def p9_links(spark: SparkSession, d: str) -> DataFrame:
    return canon.lookalike_links(table(spark, d, "documents"))


def p9_canonical(spark: SparkSession, d: str) -> DataFrame:
    return canon.canonical(table(spark, d, "documents").select("doc_id", "text").distinct()).select("doc_id", F.col("canon").alias("text"))


QUERIES = {f.__name__: f for f in (p1_found, p1_errors, p1_rates, p3_found, p3_surprise, p3_agreement, p3_pair_counts, p5_found, p5_origin, p5_shared_subtrees, p7_found, p7_items, p8_mixture, p8_report, p9_found, p9_classes, p9_links, p9_canonical)}

_CANON = canon.canonical_sql("text")
_WORDS = f"""
docs AS (SELECT DISTINCT doc_id, {leaks.WORDS_SQL} AS w FROM documents WHERE text IS NOT NULL),
its AS (SELECT DISTINCT item_id, task_set, {leaks.WORDS_SQL} AS w FROM eval_items WHERE text IS NOT NULL),
dn AS (SELECT doc_id, array_to_string(w[i:i + 14], ' ') AS g FROM docs, unnest(range(1, CAST(len(w) - 13 AS BIGINT))) AS t(i)),
n AS (SELECT item_id, array_to_string(w[i:i + 14], ' ') AS g FROM its, unnest(range(1, CAST(len(w) - 13 AS BIGINT))) AS t(i)),
found AS (SELECT DISTINCT doc_id, item_id FROM dn JOIN n USING (g))"""

_BASKETS = """
entry AS (
  SELECT DISTINCT repo, commit_id, regexp_replace(f, '\\s+$', '') AS path
  FROM (SELECT repo, commit_id, unnest(files) AS f FROM commits) u
  WHERE f IS NOT NULL AND regexp_replace(f, '\\s+$', '') <> ''),
basket AS (SELECT repo, commit_id FROM entry GROUP BY repo, commit_id HAVING count(*) <= 50),
kept AS (SELECT e.* FROM entry e JOIN basket b ON e.repo = b.repo AND e.commit_id = b.commit_id),
item AS (SELECT repo, path, count(*) AS n FROM kept GROUP BY repo, path),
total AS (SELECT repo, count(*) AS n FROM basket GROUP BY repo),
pair AS (SELECT a.repo, a.path AS path_a, b.path AS path_b, count(*) AS nab
  FROM kept a JOIN kept b ON a.repo = b.repo AND a.commit_id = b.commit_id AND a.path < b.path
  GROUP BY a.repo, a.path, b.path)"""

SQL = {
    "p3_found": f"""WITH {_BASKETS}
SELECT p.repo, p.path_a, p.path_b FROM pair p JOIN item a ON p.repo = a.repo AND p.path_a = a.path JOIN item b ON p.repo = b.repo AND p.path_b = b.path
JOIN total t ON p.repo = t.repo WHERE p.nab >= 5 AND p.nab * t.n >= 3 * a.n * b.n""",
    "p3_pair_counts": f"WITH {_BASKETS} SELECT repo, path_a, path_b, nab FROM pair",
    "p7_found": f"WITH {_WORDS} SELECT doc_id, item_id FROM found",
    "p7_items": f"""WITH {_WORDS} SELECT item_id, task_set, (SELECT count(*) FROM found f WHERE f.item_id = i.item_id) AS n_documents
FROM (SELECT DISTINCT item_id, task_set FROM eval_items) i""",
    "p9_found": f"""WITH c AS (SELECT DISTINCT doc_id, text, {_CANON} AS canon FROM documents WHERE regexp_matches({_CANON}, '\\S'))
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM c a JOIN c b ON a.canon = b.canon AND a.doc_id < b.doc_id AND a.text <> b.text""",
    "p9_classes": f"""WITH c AS (SELECT DISTINCT doc_id, sha256({_CANON}) AS form, sha256(text) AS raw FROM documents WHERE regexp_matches({_CANON}, '\\S')),
r AS (SELECT form, raw, count(*) AS copies FROM c GROUP BY form, raw), f AS (SELECT form, count(*) AS spellings, CAST(sum(copies) AS BIGINT) AS documents FROM r GROUP BY form HAVING count(*) > 1)
SELECT c.doc_id, c.form, f.spellings, f.documents, f.documents - r.copies AS links FROM c JOIN f ON c.form = f.form JOIN r ON c.form = r.form AND c.raw = r.raw""",
    "p9_links": f"""WITH c AS (SELECT DISTINCT doc_id, {_CANON} AS form, sha256(text) AS raw FROM documents WHERE regexp_matches({_CANON}, '\\S')),
r AS (SELECT form, raw, min(doc_id) AS doc_id FROM c GROUP BY form, raw), h AS (SELECT *, row_number() OVER (PARTITION BY form ORDER BY doc_id, raw) AS k FROM r)
SELECT a.doc_id, b.doc_id AS links_to FROM h a JOIN h b ON a.form = b.form AND b.k = 1 WHERE a.k > 1""",
    "p9_canonical": f"SELECT DISTINCT doc_id, {_CANON} AS text FROM documents",
}
