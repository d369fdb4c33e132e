"""Queries of the row-wise operators over the file, reference and document tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.functions import classify as C
from filigree.functions import names, paths
from filigree.session import table


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").select("id", "repo", "rel", "text").distinct()


def classify_files(spark: SparkSession, d: str) -> DataFrame:
    rel, text = F.col("rel"), F.coalesce("text", F.lit(""))
    cls = C.file_class(rel, text)
    return _files(spark, d).select("id", C.language(rel).alias("language"), cls.alias("class"), paths.dirname(rel).alias("dir"), paths.stem(rel).alias("stem"), C.loc(text).alias("loc"), C.is_analyzed(cls).alias("analyzed"))


def exclude_stats(spark: SparkSession, d: str) -> DataFrame:
    c = _files(spark, d).select("repo", C.file_class(F.col("rel"), F.coalesce("text", F.lit(""))).alias("class"))
    n = lambda v: F.sum((F.col("class") == v).cast("long"))
    return c.groupBy("repo").agg(F.count("*").alias("files"), n("generated").alias("generated"), n("config").alias("config"), n("vendored").alias("declarations"), n("test").alias("tests"))


def text_profile(spark: SparkSession, d: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    longest = F.coalesce(F.array_max(F.transform(C.lines(t), F.octet_length)), F.lit(0)).cast("long")
    docs = table(spark, d, "documents").select("doc_id", "text").distinct()
    return docs.select("doc_id", C.loc(t).alias("loc"), F.sha2(t, 256).alias("sha"), C.token_estimate(t).alias("tokens"), longest.alias("longest_line"))


def source_tokens(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files").where("deleted_at IS NULL").select("id", "repo", "bytes").distinct()
    return f.groupBy("repo").agg(F.floor(F.coalesce(F.sum("bytes"), F.lit(0)) / 4).cast("long").alias("tokens"))


def lexical_paths(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "refs").where("specifier LIKE '.%' AND specifier LIKE '%/%'").select("specifier").distinct()
    spec = F.col("specifier")
    return s.select("specifier", paths.lexical_rel(F.concat(F.lit("a/b/"), spec)).alias("inside"), paths.lexical_rel(spec).alias("from_root"), paths.join_relative(F.lit("a/b"), spec).alias("joined"))


def stem_keys(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "symbols").select("name", "kind").where("name IS NOT NULL").distinct()
    sal = F.coalesce(*[F.when(F.lower("kind") == k, F.lit(v)) for k, v in C.SALIENCE.items()], F.lit(0))
    return s.select("name", "kind", C.stem_key(F.col("name")).alias("stem_key"), sal.cast("int").alias("salience"))


def specifier_kinds(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "refs").select("specifier").where("specifier IS NOT NULL AND specifier <> ''").distinct()
    x = F.col("specifier")
    return s.select("specifier", C.is_asset(x).alias("asset"), C.is_external(x).alias("external"), C.looks_like_package(x).alias("packageish"), C.package_name(x).alias("package"))


def contract_paths(spark: SparkSession, d: str) -> DataFrame:
    s = _files(spark, d).select(F.concat(F.lit("/"), F.replace("rel", F.lit("_"), F.lit("/:")), F.lit("/"), F.col("id"), F.lit("?x=1#y")).alias("url")).distinct()
    return s.select("url", C.contract_path(F.col("url")).alias("path"), C.route_path(F.col("url")).alias("trimmed"))


def route_segments(spark: SparkSession, d: str) -> DataFrame:
    s = _files(spark, d).select("id", F.concat(F.lit("^"), "rel", F.lit("/<int:pk>/(?P<x>[a-z]+)/\\d+/notes/${id}$")).alias("raw"))
    return s.select("id", F.array_join(C.flat_route_segments(F.col("raw")), ",").alias("segments"))


def human_names(spark: SparkSession, d: str) -> DataFrame:
    import pandas as pd

    def made(s):
        return pd.DataFrame({"name": s.map(names.name_from_dir), "slug": s.map(names.slugify), "terms": s.map(lambda x: ",".join(names.path_terms(x)))})

    made.__annotations__ = {"s": pd.Series, "return": pd.DataFrame}
    made = F.pandas_udf(made, "name string, slug string, terms string")
    dirs = _files(spark, d).select(paths.dirname(F.col("rel")).alias("dir")).distinct()
    return dirs.select("dir", made("dir").alias("m")).select("dir", "m.*")


QUERIES = {f.__name__: f for f in (classify_files, exclude_stats, text_profile, source_tokens, lexical_paths, stem_keys, specifier_kinds, contract_paths, route_segments, human_names)}

_Q = "', '"
_LINES = "CASE WHEN t = '' THEN [] WHEN t LIKE '%\n' THEN string_split(t, '\n')[:-2] ELSE string_split(t, '\n') END"
_CLASS = f"""
f0 AS (SELECT DISTINCT id, repo, rel, coalesce(text, '') AS t FROM files),
f1 AS (SELECT *, list_transform({_LINES}, lambda x: CASE WHEN x LIKE '%\r' THEN x[:-2] ELSE x END) AS ls, lower(rel) AS low,
  lower(string_split(rel, '/')[-1]) AS base, regexp_extract(rel, '\\.([^./]+)$', 1) AS ext FROM f0),
f2 AS (SELECT *, CASE WHEN rel LIKE '%.d.ts' THEN 'vendored'
  WHEN {" OR ".join(f"contains(left(t, {C.HEAD_CHARS}), '{m}')" for m in C.GENERATED_MARKERS)} OR len(list_filter(ls[1:{C.LINES_READ}], lambda x: strlen(x) > {C.LINE_BYTES})) > 0 THEN 'generated'
  WHEN regexp_matches(low, '__tests__/|__mocks__/|^tests?/|/tests?/|/e2e/|\\.test\\.|\\.spec\\.') OR regexp_matches(base, '^test_|_test\\.py$|^conftest\\.py$') THEN 'test'
  WHEN regexp_matches(base, '\\.config\\.|^\\.eslintrc|^\\.prettierrc') OR base IN ('next-env.d.ts', 'commitlint.config.js') THEN 'config'
  ELSE 'source' END AS cls FROM f1)"""
_FOLD = "list_reduce(list_concat([[]::VARCHAR[]], list_transform(string_split({p}, '/'), lambda x: [x])), lambda a, x: CASE WHEN x[1] IN ('.', '') THEN a WHEN x[1] = '..' THEN {up} ELSE list_concat(a, x) END)"
_JOIN = "array_to_string(" + _FOLD.replace("{up}", "a[1:len(a) - 1]") + ", '/')"
_LEX = "CASE WHEN list_contains({f}, '!') THEN NULL ELSE array_to_string({f}, '/') END".replace("{f}", _FOLD.replace("{up}", "CASE WHEN len(a) = 0 OR list_contains(a, '!') THEN list_concat(a, ['!']) ELSE a[1:len(a) - 1] END"))
_PKG = "CASE WHEN b LIKE '@%' AND len(string_split(b, '/')) >= 2 THEN string_split(b, '/')[1] || '/' || string_split(b, '/')[2] ELSE string_split(b, '/')[1] END"

SQL = {
    "classify_files": f"""WITH {_CLASS} SELECT id, CASE WHEN ext IN ('ts','mts','cts') THEN 'ts' WHEN ext = 'tsx' THEN 'tsx' WHEN ext IN ('js','mjs','cjs') THEN 'js' WHEN ext = 'jsx' THEN 'jsx'
  WHEN ext = 'py' THEN 'python' WHEN ext IN ('vue', 'svelte') THEN ext END AS language, cls AS class,
  CASE WHEN rel LIKE '%/%' THEN regexp_replace(rel, '/[^/]*$', '') ELSE '' END AS dir, string_split(string_split(rel, '/')[-1], '.')[1] AS stem, len(ls) AS loc,
  cls IN ('source', 'test', 'config') AS analyzed FROM f2""",
    "exclude_stats": f"""WITH {_CLASS} SELECT repo, count(*) AS files, count(*) FILTER (cls = 'generated') AS generated, count(*) FILTER (cls = 'config') AS config,
  count(*) FILTER (cls = 'vendored') AS declarations, count(*) FILTER (cls = 'test') AS tests FROM f2 GROUP BY repo""",
    "text_profile": f"""WITH d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS t FROM (SELECT DISTINCT doc_id, text FROM documents) x),
l AS (SELECT *, list_transform({_LINES}, lambda x: CASE WHEN x LIKE '%\r' THEN x[:-2] ELSE x END) AS ls FROM d)
SELECT doc_id, len(ls) AS loc, sha256(t) AS sha, CAST(floor(length(t) / 4) AS BIGINT) + 1 AS tokens, coalesce(list_max(list_transform(ls, lambda x: strlen(x))), 0) AS longest_line FROM l""",
    "source_tokens": "SELECT repo, CAST(floor(coalesce(sum(bytes), 0) / 4) AS BIGINT) AS tokens FROM (SELECT DISTINCT id, repo, bytes FROM files WHERE deleted_at IS NULL) f GROUP BY repo",
    "lexical_paths": f"""SELECT specifier, {_LEX.replace("{p}", "'a/b/' || specifier")} AS inside, {_LEX.replace("{p}", "specifier")} AS from_root, {_JOIN.replace("{p}", "'a/b/' || specifier")} AS joined
FROM (SELECT DISTINCT specifier FROM refs WHERE specifier LIKE '.%' AND specifier LIKE '%/%') s""",
    "stem_keys": """SELECT name, kind, CASE WHEN length(l) > 3 AND l LIKE '%s' AND l NOT LIKE '%ss' THEN left(l, length(l) - 1) ELSE l END AS stem_key,
  CAST(CASE lower(kind) WHEN 'function' THEN 5 WHEN 'class' THEN 5 WHEN 'interface' THEN 4 WHEN 'enum' THEN 3 WHEN 'type_alias' THEN 3 WHEN 'method' THEN 2 WHEN 'const' THEN 1 ELSE 0 END AS INTEGER) AS salience
FROM (SELECT DISTINCT name, kind, lower(replace(name, '_', '')) AS l FROM symbols WHERE name IS NOT NULL) s""",
    "specifier_kinds": f"""WITH s AS (SELECT DISTINCT specifier AS x, regexp_replace(specifier, '^(node:|npm:|jsr:)', '') AS b FROM refs WHERE specifier <> '')
SELECT x AS specifier, lower(regexp_extract(regexp_replace(string_split(x, '/')[-1], '[?#].*$', ''), '\\.([^.]*)$', 1)) IN ('{_Q.join(C.ASSET_EXTENSIONS)}') AS asset,
  x NOT LIKE '.%' AND (regexp_matches(x, '^(node:|bun:|npm:|jsr:)') OR x IN ('{_Q.join(C.RUNTIME_MODULES)}') OR (x NOT LIKE '@%' AND x NOT LIKE '~%' AND regexp_matches(string_split(x, '/')[1], '^[a-z0-9._-]+$'))) AS external,
  regexp_matches(string_split(x, '/')[1], '^[a-z0-9._-]+$') AS packageish, {_PKG} AS package FROM s""",
    "contract_paths": """WITH s AS (SELECT DISTINCT '/' || replace(rel, '_', '/:') || '/' || id || '?x=1#y' AS url FROM files),
p AS (SELECT url, list_transform(list_filter(string_split(regexp_replace(url, '[?#].*$', ''), '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '^(:.*|<.*>|[0-9]+)$') THEN '{}' ELSE x END) AS g FROM s)
SELECT url, CASE WHEN len(g) >= 2 THEN array_to_string(g, '/') END AS path, trim(trim(url), '/') AS trimmed FROM p""",
    "route_segments": r"""WITH s AS (SELECT DISTINCT id, '^' || rel || '/<int:pk>/(?P<x>[a-z]+)/\d+/notes/${id}$' AS raw FROM files)
SELECT id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(raw, '\([^()]*\)|<[^<>]*>|\[[^\[\]]*\]|\{[^{}]*\}|\\.', '/', 'g'), '[^A-Za-z0-9_-]+'), lambda x: regexp_matches(x, '^[A-Za-z].+$')), ',') AS segments FROM s""",
}
