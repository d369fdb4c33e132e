"""Queries on resolution and on contracts between languages, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.operators import contracts, graph, resolve
from filigree.plans import adapters as A
from filigree.session import cut, table


def url_contract_join(spark: SparkSession, d: str) -> DataFrame:
    return contracts.url_pairs(A.urls(spark, d))


def semantic_join(spark: SparkSession, d: str) -> DataFrame:
    n = A.nodes(spark, d)
    return contracts.semantic_pairs(A.symbols(spark, d, n), contracts.url_pairs(A.urls(spark, d, n)))


def _includes(spark: SparkSession, d: str, n: DataFrame) -> DataFrame:
    e = A.edges(spark, d, n).join(n.where("python").select(F.col("id").alias("src")), "src").join(n.where("python").select(F.col("id").alias("dst")), "dst")
    return e.select("repo", F.col("src").alias("file"), F.array(F.lit("v1"), F.concat(F.lit("m"), (F.col("src") % 3).cast("string"))).alias("segments"), F.col("dst").alias("target"))


def route_include_stitch(spark: SparkSession, d: str) -> DataFrame:
    n = A.nodes(spark, d)
    return contracts.stitch(A.routes(spark, d, n), _includes(spark, d, n)).select("repo", "file", F.array_join("segments", "/").alias("route"), "view").distinct()


def http_closure(spark: SparkSession, d: str) -> DataFrame:
    n = cut(A.nodes(spark, d))
    s = A.symbols(spark, d, n).join(n.where("test").select(F.col("id").alias("file")), "file", "left_anti")
    return contracts.http_files(A.senders(spark, d, n), A.extends(spark, d, n), s)


def _links(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = cut(A.nodes(spark, d))
    return n, contracts.route_links(A.routes(spark, d, n), A.symbols(spark, d, n), A.literals(spark, d, n), A.senders(spark, d, n))


def route_join(spark: SparkSession, d: str) -> DataFrame:
    _, r = _links(spark, d)
    return r.select("repo", "view", "view_file", F.array_join("routes", ",").alias("routes"), F.array_join(F.col("callers").cast("array<string>"), ",").alias("callers"))


def callers_by_path(spark: SparkSession, d: str) -> DataFrame:
    _, r = _links(spark, d)
    return r.select("repo", F.explode("routes").alias("route"), F.col("callers").alias("c")).select("repo", "route", F.explode("c").alias("caller")).distinct()


def caller_importers(spark: SparkSession, d: str) -> DataFrame:
    n, r = _links(spark, d)
    c = r.select("repo", "view", F.explode("callers").alias("dst")).distinct()
    return c.join(A.edges(spark, d, n).select("src", "dst"), "dst").select("repo", "view", F.col("dst").alias("caller"), F.col("src").alias("importer")).distinct()


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    n = cut(A.nodes(spark, d))
    alias = n.select("repo").distinct().select("repo", F.lit("@/*").alias("pattern"), F.lit("src/*").alias("target"), F.lit(0).alias("place"))
    gone = table(spark, d, "files").where("deleted_at IS NOT NULL").select("repo", F.col("rel").alias("path")).distinct()
    return resolve.outcomes(table(spark, d, "refs"), n, None, alias, gone)


def resolve_refs(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(spark, d).select("file", F.col("pos").cast("long").alias("pos"), "specifier", "outcome", "target", "package")


def resolved_edges(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolved_edges(_outcomes(spark, d))


def resolution_rate(spark: SparkSession, d: str) -> DataFrame:
    return resolve.rates(_outcomes(spark, d)).select("repo", "resolved", "unresolved", "external", "asset", "excluded", F.round("rate", 6).alias("rate"))


def top_externals(spark: SparkSession, d: str) -> DataFrame:
    return resolve.externals(_outcomes(spark, d)).select("repo", F.col("rank").cast("long").alias("rank"), "package", "n")


def file_externals(spark: SparkSession, d: str) -> DataFrame:
    return resolve.file_externals(_outcomes(spark, d)).select("file", F.array_join("packages", ",").alias("packages"))


def python_packages(spark: SparkSession, d: str) -> DataFrame:
    return resolve.python_packages(A.nodes(spark, d))


def python_roots(spark: SparkSession, d: str) -> DataFrame:
    return resolve.python_roots(A.nodes(spark, d)).select("repo", "root", F.col("place").cast("long").alias("place"))


def nearest_scope(spark: SparkSession, d: str) -> DataFrame:
    n = A.nodes(spark, d)
    scopes = n.select("repo", F.regexp_extract("rel", r"^((?:packages|apps|services)/[^/]+)/", 1).alias("dir")).where("dir <> ''").distinct()
    more = n.select("repo", F.regexp_extract("rel", r"^((?:packages|apps|services)/[^/]+/[^/]+)/", 1).alias("dir")).where("dir <> ''").distinct()
    return resolve.nearest_scope(n, scopes.unionByName(more))


QUERIES = {f.__name__: f for f in (url_contract_join, semantic_join, route_include_stitch, http_closure, route_join, callers_by_path, caller_importers, resolve_refs, resolved_edges, resolution_rate, top_externals, file_externals, python_packages, python_roots, nearest_scope)}

from filigree.plans.graph import _SEM  # noqa: E402

_N = A.SQL["nodes"]
_NE = f"{_N},\n{A.SQL['dedges']}"
_WORDS = "list_filter(string_split(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '_'), lambda x: regexp_matches(x, '^[a-z][a-z0-9]+$'))"
_ROUTES = f"""{A.SQL['sym']},
routes AS (SELECT DISTINCT repo, file, list_concat(['api'], {_WORDS}) AS segments, name AS view FROM sym WHERE python AND lower(kind) IN ('function', 'class') AND len({_WORDS}) > 0),
lits AS (SELECT DISTINCT repo, file, {_WORDS} AS seq FROM sym WHERE NOT python AND len({_WORDS}) > 0),
senders AS (SELECT DISTINCT repo, file FROM sym WHERE NOT python AND lower(kind) IN ('class', 'const') AND file NOT IN (SELECT id FROM nodes WHERE test))"""
_LINKS = f"""{_ROUTES},
firsts AS (SELECT repo, segments[1] AS s, count(*) AS n FROM routes WHERE len(segments) > 1 GROUP BY ALL),
nested AS (SELECT repo, count(*) AS n FROM routes WHERE len(segments) > 1 GROUP BY repo),
mount AS (SELECT f.repo, f.s FROM firsts f JOIN nested t ON f.repo = t.repo WHERE f.n > 1 AND 2 * f.n > t.n),
k0 AS (SELECT r.*, CASE WHEN m.s IS NULL THEN segments ELSE segments[2:] END AS key FROM routes r LEFT JOIN mount m ON r.repo = m.repo AND r.segments[1] = m.s),
defs AS (SELECT DISTINCT repo, name, file, kind, exported FROM sym WHERE python AND lower(kind) IN ('class', 'function')),
dn AS (SELECT repo, name, count(*) AS n, min(file) AS only FROM defs GROUP BY repo, name),
v AS (SELECT k.repo, k.view, k.key, CASE WHEN d.n = 1 THEN d.only WHEN EXISTS (SELECT 1 FROM defs x WHERE x.repo = k.repo AND x.name = k.view AND x.file = k.file) THEN k.file END AS view_file
  FROM k0 k JOIN dn d ON k.repo = d.repo AND k.view = d.name WHERE len(k.key) > 0),
vk AS (SELECT DISTINCT * FROM v WHERE view_file IS NOT NULL),
keys AS (SELECT DISTINCT repo, key FROM vk),
cl AS (SELECT l.* FROM lits l JOIN senders s ON l.repo = s.repo AND l.file = s.file),
cs AS (SELECT repo, file, list_distinct(flatten(list(seq))) AS segs FROM cl GROUP BY repo, file),
m0 AS (SELECT k.repo, k.key, c.file FROM keys k JOIN cs c ON k.repo = c.repo AND list_has_all(c.segs, k.key)),
holding AS (SELECT m.*, cl.seq FROM m0 m JOIN cl ON m.repo = cl.repo AND m.file = cl.file AND list_has_all(cl.seq, m.key)),
sh AS (SELECT h.repo, h.key, h.file, bool_and(EXISTS (SELECT 1 FROM keys k WHERE k.repo = h.repo AND len(k.key) > len(h.key) AND k.key[1:len(h.key)] = h.key AND list_has_all(h.seq, k.key))) AS shadowed FROM holding h GROUP BY ALL),
mc AS (SELECT m.repo, m.key, m.file AS caller FROM m0 m LEFT JOIN sh ON m.repo = sh.repo AND m.key = sh.key AND m.file = sh.file WHERE NOT coalesce(sh.shadowed, false)),
links AS (SELECT vk.repo, vk.view, vk.view_file, list_sort(list(DISTINCT array_to_string(vk.key, '/'))) AS routes, list_sort(list(DISTINCT mc.caller) FILTER (mc.caller IS NOT NULL)) AS callers
  FROM vk LEFT JOIN mc ON vk.repo = mc.repo AND vk.key = mc.key GROUP BY ALL HAVING count(mc.caller) > 0)"""
_PKG = """inits AS (SELECT DISTINCT repo, dir FROM nodes WHERE regexp_matches(rel, '(^|/)__init__\\.py$') AND dir <> ''),
tops AS (SELECT i.repo, i.dir, CASE WHEN i.dir LIKE '%/%' THEN regexp_replace(i.dir, '/[^/]*$', '') ELSE '' END AS up FROM inits i
  WHERE (i.repo, CASE WHEN i.dir LIKE '%/%' THEN regexp_replace(i.dir, '/[^/]*$', '') ELSE '' END) NOT IN (SELECT (repo, dir) FROM inits)),
roots AS (SELECT repo, root, row_number() OVER (PARTITION BY repo ORDER BY CASE root WHEN '' THEN 0 WHEN 'src' THEN 1 ELSE 2 END, root) - 1 AS place
  FROM (SELECT repo, up AS root FROM tops UNION SELECT DISTINCT repo, '' FROM nodes) u)"""
_EXTS = "['ts','tsx','mts','cts','js','jsx','mjs','cjs','vue','svelte','py']"
_FOLD = "array_to_string(list_reduce(list_concat([[]::VARCHAR[]], list_transform(string_split(dir || '/' || specifier, '/'), lambda x: [x])), lambda a, x: CASE WHEN x[1] IN ('.', '') THEN a WHEN x[1] = '..' THEN a[1:len(a) - 1] ELSE list_concat(a, x) END), '/')"
_OUT = f"""{_N},
{_PKG},
fk0 AS (SELECT repo, id, rel, -1 AS rank, rel AS key FROM nodes
  UNION ALL SELECT repo, id, rel, list_position({_EXTS}, regexp_extract(rel, '\\.([^./]+)$', 1)) - 1, regexp_replace(rel, '\\.[^./]+$', '') FROM nodes WHERE list_contains({_EXTS}, regexp_extract(rel, '\\.([^./]+)$', 1))
  UNION ALL SELECT repo, id, rel, list_position({_EXTS}, regexp_extract(rel, '\\.([^./]+)$', 1)) - 1, dir FROM nodes WHERE regexp_matches(rel, '(^|/)index\\.[^./]+$') AND list_contains({_EXTS}, regexp_extract(rel, '\\.([^./]+)$', 1))
  UNION ALL SELECT repo, id, rel, 11, dir FROM nodes WHERE regexp_matches(rel, '(^|/)__init__\\.[^./]+$') AND list_contains({_EXTS}, regexp_extract(rel, '\\.([^./]+)$', 1))),
fk AS (SELECT repo, key, id FROM (SELECT *, row_number() OVER (PARTITION BY repo, key ORDER BY rank, rel) AS k FROM fk0) x WHERE k = 1),
rr AS (SELECT DISTINCT r.file, r.pos, r.specifier, n.repo, n.rel, n.dir, n.python FROM refs r JOIN nodes n ON r.file = n.id WHERE r.specifier <> ''),
rp AS (SELECT *, length(regexp_extract(specifier, '^\\.+')) AS dots, CASE WHEN dir = '' THEN [] ELSE string_split(dir, '/') END AS up, replace(specifier, '.', '/') AS dotted FROM rr),
path AS (
  SELECT repo, file, pos, specifier, 0 AS base, CASE WHEN python THEN CASE WHEN len(up) >= dots - 1 THEN trim(array_to_string(up[1:len(up) - (dots - 1)], '/') || '/' || replace(specifier[dots + 1:], '.', '/'), '/') END ELSE {_FOLD} END AS p FROM rp WHERE specifier LIKE '.%'
  UNION ALL SELECT repo, file, pos, specifier, 0, 'src/' || specifier[3:] FROM rp WHERE NOT python AND specifier LIKE '@/%'
  UNION ALL SELECT repo, file, pos, specifier, 300000, specifier FROM rp WHERE NOT python AND specifier NOT LIKE '.%'),
cand AS (
  SELECT repo, file, pos, specifier, base AS prio, p AS key FROM path
  UNION ALL SELECT repo, file, pos, specifier, base + 1, regexp_replace(p, '\\.(js|jsx|mjs|cjs)$', '') FROM path WHERE regexp_matches(p, '\\.(js|jsx|mjs|cjs)$')
  UNION ALL SELECT repo, file, pos, specifier, base + 2, CASE WHEN p = '' THEN 'index' ELSE p || '/index' END FROM path
  UNION ALL SELECT rp.repo, file, pos, specifier, place * 3, CASE WHEN root = '' THEN dotted ELSE root || '/' || dotted END FROM rp JOIN roots ON rp.repo = roots.repo WHERE python AND specifier NOT LIKE '.%' AND specifier <> '__future__'
  UNION ALL SELECT repo, file, pos, specifier, 900000, dir || '/' || dotted FROM rp WHERE python AND specifier NOT LIKE '.%' AND specifier <> '__future__' AND dir <> '' AND (repo, dir) NOT IN (SELECT (repo, dir) FROM inits)),
hit AS (SELECT c.file, c.pos, c.specifier, arg_min(fk.id, c.prio) AS target FROM cand c JOIN fk ON c.repo = fk.repo AND c.key = fk.key GROUP BY ALL),
gone AS (SELECT DISTINCT repo, rel FROM files WHERE deleted_at IS NOT NULL),
o0 AS (SELECT rp.*, hit.target, regexp_replace(rp.specifier, '^(node:|npm:|jsr:)', '') AS b,
  (rp.repo, string_split(rp.specifier, '.')[1]) IN (SELECT (repo, string_split(dir, '/')[-1]) FROM tops) AS first_party,
  (rp.repo, {_FOLD.replace('dir ||', 'rp.dir ||').replace('|| specifier', '|| rp.specifier')}) IN (SELECT (repo, rel) FROM gone) AS on_disk,
  lower(regexp_extract(regexp_replace(string_split(rp.specifier, '/')[-1], '[?#].*$', ''), '\\.([^.]*)$', 1)) IN ('css','scss','sass','less','styl','json','json5','svg','png','jpg','jpeg','gif','webp','avif','ico','woff','woff2','ttf','otf','html','md','mdx','txt','yaml','yml','graphql','gql','wasm') AS asset
  FROM rp LEFT JOIN hit ON rp.file = hit.file AND rp.pos = hit.pos AND rp.specifier = hit.specifier),
o1 AS (SELECT *, CASE WHEN python AND specifier = '__future__' THEN 'ignored'
  WHEN python THEN CASE WHEN target IS NOT NULL THEN 'resolved' WHEN specifier LIKE '.%' OR first_party THEN 'unresolved' ELSE 'external' END
  WHEN specifier NOT LIKE '.%' AND target IS NOT NULL THEN 'resolved' WHEN specifier LIKE '.%' AND asset THEN 'asset'
  WHEN specifier NOT LIKE '.%' AND (regexp_matches(specifier, '^(node:|bun:|npm:|jsr:)') OR (NOT regexp_matches(specifier, '^[@~]') AND regexp_matches(specifier, '^[a-z0-9._-]+(/|$)')) OR regexp_matches(specifier, '^@[a-z0-9._-]+/[a-z0-9._-]+(/|$)')) THEN 'external'
  WHEN target IS NOT NULL THEN 'resolved' WHEN specifier LIKE '.%' AND on_disk THEN 'excluded' ELSE 'unresolved' END AS outcome FROM o0),
o AS (SELECT repo, file, CAST(pos AS BIGINT) AS pos, specifier, outcome, CASE WHEN outcome = 'resolved' THEN target END AS target, CASE WHEN outcome = 'external' THEN
  CASE WHEN python THEN string_split(specifier, '.')[1] WHEN b LIKE '@%' AND len(string_split(b, '/')) >= 2 THEN string_split(b, '/')[1] || '/' || string_split(b, '/')[2] ELSE string_split(b, '/')[1] END END AS package FROM o1)"""

SQL = {
    "url_contract_join": f"WITH {_N},\n{_SEM} SELECT repo, lo, hi FROM urlp",
    "semantic_join": f"WITH {_N},\n{_SEM} SELECT repo, lo, hi FROM semp",
    "route_include_stitch": f"""WITH {_NE},\n{_ROUTES},
inc AS (SELECT e.repo, e.src AS file, ['v1', 'm' || (e.src % 3)] AS prefix, e.dst AS target FROM dedges e JOIN nodes a ON e.src = a.id JOIN nodes b ON e.dst = b.id WHERE a.python AND b.python)
SELECT DISTINCT repo, file, array_to_string(segments, '/') AS route, view FROM routes
UNION SELECT i.repo, i.file, array_to_string(list_concat(i.prefix, r.segments), '/'), r.view FROM inc i JOIN routes r ON i.repo = r.repo AND i.target = r.file""",
    "http_closure": f"""WITH RECURSIVE {_NE},\n{_ROUTES},
own AS (SELECT repo, name AS base, min(file) AS owner FROM (SELECT DISTINCT repo, name, file, exported FROM sym WHERE NOT python AND lower(kind) = 'class' AND file NOT IN (SELECT id FROM nodes WHERE test)) x GROUP BY repo, name HAVING count(*) = 1),
ext AS (SELECT DISTINCT e.repo, e.src AS file, s.name AS base FROM dedges e JOIN sym s ON e.dst = s.file WHERE NOT s.python AND lower(s.kind) = 'class'),
link AS (SELECT DISTINCT ext.repo, ext.file, own.owner FROM ext JOIN own ON ext.repo = own.repo AND ext.base = own.base),
r(repo, file) AS (SELECT repo, file FROM senders UNION SELECT l.repo, l.file FROM r JOIN link l ON r.repo = l.repo AND r.file = l.owner)
SELECT DISTINCT repo, file FROM r""",
    "route_join": f"WITH {_N},\n{_LINKS} SELECT repo, view, view_file, array_to_string(routes, ',') AS routes, array_to_string(list_sort(list_transform(callers, lambda x: x)), ',') AS callers FROM links",
    "callers_by_path": f"WITH {_N},\n{_LINKS} SELECT DISTINCT repo, route, unnest(callers) AS caller FROM (SELECT repo, unnest(routes) AS route, callers FROM links) x",
    "caller_importers": f"WITH {_NE},\n{_LINKS} SELECT DISTINCT c.repo, c.view, c.caller, e.src AS importer FROM (SELECT repo, view, unnest(callers) AS caller FROM links) c JOIN dedges e ON c.caller = e.dst",
    "resolve_refs": f"WITH {_OUT} SELECT file, pos, specifier, outcome, target, package FROM o",
    "resolved_edges": f"WITH {_OUT} SELECT DISTINCT repo, file AS src, target AS dst FROM o WHERE outcome = 'resolved' AND file <> target",
    "resolution_rate": f"""WITH {_OUT} SELECT repo, count(*) FILTER (outcome = 'resolved') AS resolved, count(*) FILTER (outcome = 'unresolved') AS unresolved, count(*) FILTER (outcome = 'external') AS external,
  count(*) FILTER (outcome = 'asset') AS asset, count(*) FILTER (outcome = 'excluded') AS excluded, round(coalesce(count(*) FILTER (outcome = 'resolved') / nullif(count(*) FILTER (outcome IN ('resolved', 'unresolved')), 0), 1.0), 6) AS rate FROM o GROUP BY repo""",
    "top_externals": f"""WITH {_OUT}, c AS (SELECT repo, package, count(*) AS n FROM o WHERE outcome = 'external' GROUP BY repo, package), k AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, package) AS rank FROM c)
SELECT repo, rank, package, n FROM k WHERE rank <= 10""",
    "file_externals": f"""WITH {_OUT}, f AS (SELECT file, package, min(pos) AS pos FROM o WHERE outcome = 'external' GROUP BY file, package) SELECT file, string_agg(package, ',' ORDER BY pos, package) AS packages FROM f GROUP BY file""",
    "python_packages": f"WITH {_N},\n{_PKG} SELECT repo, dir FROM tops",
    "python_roots": f"WITH {_N},\n{_PKG} SELECT repo, root, place FROM roots",
    "nearest_scope": f"""WITH {_N}, sc AS (SELECT DISTINCT repo, regexp_extract(rel, '^((?:packages|apps|services)/[^/]+)/', 1) AS dir FROM nodes UNION
  SELECT repo, regexp_extract(rel, '^((?:packages|apps|services)/[^/]+/[^/]+)/', 1) FROM nodes)
SELECT n.repo, n.rel, coalesce(arg_max(sc.dir, length(sc.dir)), '') AS scope FROM nodes n LEFT JOIN sc ON n.repo = sc.repo AND sc.dir <> '' AND (n.dir = sc.dir OR starts_with(n.dir, sc.dir || '/')) GROUP BY n.repo, n.rel""",
}
