"""Resolution of import specifiers to files, as joins on ordered candidates.

A reference is turned into candidate paths with priorities; every candidate is
looked up among the keys of the repository's files, and the hit of the lowest
priority wins.  No file index is collected: the lookup is one equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.functions import classify as C
from filigree.functions.paths import CODE_EXTENSIONS, SCRIPT_SUFFIX, dirname, extension, join_relative, python_relative

_EXT = rf"\.({'|'.join(CODE_EXTENSIONS)})$"


def file_keys(nodes: DataFrame) -> DataFrame:
    """``repo, key, id``: what each path resolves to.

    A full path is its own key.  Without its extension a path answers by the
    order of extensions, an ``index`` for its directory too, an ``__init__``
    last of all; of equal ranks the first path wins, and a full path beats all.
    """
    rel = F.col("rel")
    bare = F.regexp_replace(rel, _EXT, "")
    code = rel.rlike(_EXT)
    rank = F.coalesce(*[F.when(extension(rel) == e, F.lit(i)) for i, e in enumerate(CODE_EXTENSIONS)], F.lit(99))
    index = F.when(code & bare.rlike(r"(^|/)index$"), F.struct(dirname(bare).alias("key"), rank.alias("rank")))
    init = F.when(code & bare.rlike(r"(^|/)__init__$"), F.struct(dirname(bare).alias("key"), F.lit(11).alias("rank")))
    own = F.struct(rel.alias("key"), F.lit(-1).alias("rank"))
    stemmed = F.when(code, F.struct(bare.alias("key"), rank.alias("rank")))
    k = nodes.select("repo", "id", "rel", F.explode(F.array_compact(F.array(own, stemmed, index, init))).alias("k"))
    return k.groupBy("repo", "k.key").agg(F.min(F.struct("k.rank", "rel", "id")).alias("best")).select("repo", "key", F.col("best.id").alias("id"))


def variants(path: Column, prio: int) -> list[Column]:
    """The three lookups of one candidate path: as it is, without a script ending, and its index."""
    slash = F.when(path == "", F.lit("index")).otherwise(F.concat(path, F.lit("/index")))
    cut = F.when(path.rlike(SCRIPT_SUFFIX), F.regexp_replace(path, SCRIPT_SUFFIX, ""))
    return [F.struct(F.lit(prio * 3 + i).alias("prio"), p.alias("key")) for i, p in enumerate((path, cut, slash))]


def python_packages(nodes: DataFrame) -> DataFrame:
    """Top-level Python packages: ``repo, dir``.

    Directories with ``__init__.py`` whose parent has none.
    """
    init = nodes.where(F.col("rel").rlike(r"(^|/)__init__\.py$")).select("repo", dirname(F.col("rel")).alias("dir")).where("dir <> ''").distinct()
    parent = init.select("repo", F.col("dir").alias("up"))
    top = init.withColumn("up", dirname(F.col("dir")))
    return top.join(parent, ["repo", "up"], "left_anti").select("repo", "dir")


def python_roots(nodes: DataFrame) -> DataFrame:
    """Import roots in order: ``repo, root, place``: the root, ``src``, then parents of top packages by name."""
    top = python_packages(nodes)
    up = top.select("repo", dirname(F.col("dir")).alias("root")).distinct()
    roots = up.select("repo", "root", F.when(F.col("root") == "", 0).when(F.col("root") == "src", 1).otherwise(2).alias("tier"))
    base = nodes.select("repo").distinct().select("repo", F.lit("").alias("root"), F.lit(0).alias("tier"))
    every = roots.unionByName(base).distinct()
    from pyspark.sql import Window

    return every.select("repo", "root", (F.row_number().over(Window.partitionBy("repo").orderBy("tier", "root")) - 1).alias("place"))


def outcomes(refs: DataFrame, nodes: DataFrame, local_packages: DataFrame | None = None, aliases: DataFrame | None = None, all_paths: DataFrame | None = None, root_base: bool = True, extra_roots: DataFrame | None = None) -> DataFrame:
    """What became of each reference: ``repo, file, pos, specifier, outcome, target, package``.

    ``aliases(repo, scope, pattern, target, place, stop)`` are path aliases
    with at most one ``*`` each, in the order of ``place``; a file uses those
    of its nearest scope directory ('' is every file's last resort), and a
    matching row with ``stop`` ends the search there.  ``root_base`` tries bare
    specifiers at the repository root at last, ``extra_roots(repo, root)`` are
    further Python roots; ``local_packages(repo, package)`` are names the repository
    owns; ``all_paths(repo, path)`` are paths on disk that the inventory left
    out.  Outcomes: ``resolved``, ``unresolved``, ``asset``, ``external``,
    ``excluded`` and ``ignored`` (``__future__``).  Null specifiers are left
    out; each (file, pos, specifier) is judged once.
    """
    n = nodes.select(F.col("id").alias("file"), "repo", "rel", "python")
    r = refs.where("specifier IS NOT NULL AND specifier <> ''").select("file", "pos", "specifier").distinct().join(n, "file")
    keys = file_keys(nodes)
    spec, base = F.col("specifier"), dirname(F.col("rel"))
    dotted = F.replace(spec, F.lit("."), F.lit("/"))

    # relative references of both kinds
    rel_path = F.when(F.col("python"), python_relative(base, spec)).otherwise(join_relative(base, spec))
    relative = r.where(spec.startswith("."))
    rel_c = relative.withColumn("path", rel_path).select("repo", "file", "pos", "specifier", F.explode(F.array(*variants(F.col("path"), 0))).alias("c"))

    # absolute Python references: the roots in order, then the sibling outside packages
    every = python_roots(nodes)
    if extra_roots is not None:
        every = every.unionByName(extra_roots.select("repo", "root", F.lit(1000).alias("place"))).groupBy("repo", "root").agg(F.min("place").alias("place"))
    roots = every.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("place", "root"))).alias("roots"))
    py = r.where(F.col("python") & ~spec.startswith(".") & (spec != "__future__")).join(roots, "repo", "left")
    inits = nodes.where(F.col("rel").rlike(r"(^|/)__init__\.py$")).select("repo", dirname(F.col("rel")).alias("_dir"), F.lit(True).alias("in_package")).distinct()
    py = py.withColumn("_dir", base).join(inits, ["repo", "_dir"], "left")
    at_root = F.transform("roots", lambda x: F.struct((x["place"] * 3).alias("prio"), F.when(x["root"] == "", dotted).otherwise(F.concat(x["root"], F.lit("/"), dotted)).alias("key")))
    sibling = F.when(F.col("in_package").isNull() & (F.col("_dir") != ""), F.struct(F.lit(900_000).alias("prio"), F.concat("_dir", F.lit("/"), dotted).alias("key")))
    py_c = py.select("repo", "file", "pos", "specifier", F.explode(F.concat(at_root, F.array_compact(F.array(sibling)))).alias("c"))

    # bare references of the others: aliases in order, then the repository root
    bare = r.where(~F.col("python") & ~spec.startswith("."))
    bare_c = bare.select("repo", "file", "pos", "specifier", F.explode(F.array(*variants(spec, 100_000))).alias("c"))
    if not root_base:
        bare_c = bare_c.where(F.lit(False))
    stops = None
    if aliases is not None:
        if "scope" not in aliases.columns:
            aliases = aliases.withColumns({"scope": F.lit(""), "stop": F.lit(False)})
        near = nearest_scope(nodes, aliases.where("scope <> ''").select("repo", F.col("scope").alias("dir")))
        star = aliases.select("repo", "scope", "pattern", F.col("target").alias("_target"), "place", "stop", F.substring_index("pattern", "*", 1).alias("_head"), F.when(F.col("pattern").contains("*"), F.substring_index("pattern", "*", -1)).alias("_tail"))
        # the table of aliases is configuration, not data; its rows are matched by repository and scope
        m = bare.join(near, ["repo", "rel"]).join(star, ["repo", "scope"]).where(F.when(F.col("_tail").isNull(), spec == F.col("pattern")).otherwise(spec.startswith(F.col("_head")) & spec.endswith(F.col("_tail")) & (F.length(spec) >= F.length("_head") + F.length("_tail"))))
        got = F.substr(spec, F.length("_head") + 1, F.length(spec) - F.length("_head") - F.length(F.coalesce("_tail", F.lit(""))))
        path = F.replace(F.col("_target"), F.lit("*"), F.when(F.col("_tail").isNull(), F.lit("")).otherwise(got))
        m = m.withColumn("path", path)
        at_place = F.transform(F.array(*variants(F.col("path"), 0)), lambda x: F.struct((x["prio"] + F.col("place") * 3).alias("prio"), x["key"].alias("key")))
        bare_c = bare_c.unionByName(m.where("path IS NOT NULL").select("repo", "file", "pos", "specifier", F.explode(at_place).alias("c")))
        stops = m.where("stop").groupBy("file", "pos", "specifier").agg(F.min(F.col("place") * 3 + 2).alias("stop"))

    cand = rel_c.unionByName(py_c).unionByName(bare_c).select("repo", "file", "pos", "specifier", "c.prio", "c.key").where("key IS NOT NULL")
    if stops is not None:
        cand = cand.join(stops, ["file", "pos", "specifier"], "left").where("stop IS NULL OR prio <= stop").drop("stop")
    # few specifiers hold many references; adaptive execution splits such a key's rows
    hits = cand.join(keys, ["repo", "key"]).groupBy("file", "pos", "specifier").agg(F.min(F.struct("prio", "id")).alias("h")).select("file", "pos", "specifier", F.col("h.id").alias("target"))

    j = r.join(hits, ["file", "pos", "specifier"], "left")
    tops = python_packages(nodes).select("repo", F.substring_index("dir", "/", -1).alias("_top"), F.lit(True).alias("first_party")).distinct()
    j = j.withColumn("_top", F.when(F.col("python"), F.substring_index("specifier", ".", 1))).join(tops, ["repo", "_top"], "left")
    j = j.withColumn("package", F.when(F.col("python"), F.col("_top")).otherwise(C.package_name(spec)))
    if local_packages is not None:
        j = j.join(local_packages.select("repo", "package", F.lit(True).alias("local")).distinct(), ["repo", "package"], "left")
    else:
        j = j.withColumn("local", F.lit(None).cast("boolean"))
    j = j.withColumn("_path", F.when(~F.col("python") & spec.startswith("."), join_relative(base, spec)))
    if all_paths is not None:
        j = j.join(all_paths.select("repo", F.col("path").alias("_path"), F.lit(True).alias("on_disk")).distinct(), ["repo", "_path"], "left")
    else:
        j = j.withColumn("on_disk", F.lit(None).cast("boolean"))
    scoped = spec.rlike(r"^@[a-z0-9._-]+/[a-z0-9._-]+(/|$)")
    hit, dot = F.col("target").isNotNull(), spec.startswith(".")
    out = (
        F.when(F.col("python") & (spec == "__future__"), "ignored")
        .when(F.col("python"), F.when(hit, "resolved").when(dot | F.col("first_party"), "unresolved").otherwise("external"))
        .when(~dot & hit, "resolved")
        .when(dot & C.is_asset(spec), "asset")
        .when(~dot & F.coalesce("local", F.lit(False)), "unresolved")
        .when(C.is_external(spec) | scoped, "external")
        .when(hit, "resolved")
        .when(F.coalesce("on_disk", F.lit(False)), "excluded")
        .otherwise("unresolved")
    )
    j = j.withColumn("outcome", out)
    return j.select("repo", "file", "pos", "specifier", "outcome", F.when(F.col("outcome") == "resolved", F.col("target")).alias("target"), F.when(F.col("outcome") == "external", F.col("package")).alias("package"))


def resolved_edges(out: DataFrame) -> DataFrame:
    """Distinct edges ``repo, src, dst`` of resolved references, without loops."""
    return out.where("outcome = 'resolved' AND file <> target").select("repo", F.col("file").alias("src"), F.col("target").alias("dst")).distinct()


def rates(out: DataFrame) -> DataFrame:
    """Per repository: counts of all outcomes and the rate of hits among first-party attempts, 1 without any."""
    n = lambda v: F.sum((F.col("outcome") == v).cast("long"))
    g = out.groupBy("repo").agg(*[n(v).alias(v) for v in ("resolved", "unresolved", "external", "asset", "excluded")])
    return g.withColumn("rate", F.coalesce(F.try_divide(F.col("resolved"), F.col("resolved") + F.col("unresolved")), F.lit(1.0)))


def externals(out: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` packages referred to most in each repository: ``repo, rank, package, n``."""
    from filigree.operators.graph import top_per

    c = out.where("outcome = 'external'").groupBy("repo", "package").agg(F.count("*").alias("n"))
    return top_per(c, ["repo"], [F.desc("n"), F.asc("package")], k).select("repo", "rank", "package", "n")


def file_externals(out: DataFrame) -> DataFrame:
    """Packages of each file in the order of their first reference: ``file, packages``.

    The list of one file's references is bounded by the file.
    """
    first = out.where("outcome = 'external'").groupBy("file", "package").agg(F.min("pos").alias("pos"))
    return first.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("pos", "package"))).alias("p")).select("file", F.col("p.package").alias("packages"))


def nearest_scope(rels: DataFrame, scopes: DataFrame) -> DataFrame:
    """The deepest scope directory above each path: ``rel, scope``, '' if none.

    A prefix join: each path asks for its own directories only.
    """
    parts = F.split(dirname(F.col("rel")), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    asked = rels.select("repo", "rel", F.explode(above).alias("dir"))
    got = asked.join(scopes.select("repo", "dir").distinct(), ["repo", "dir"]).groupBy("repo", "rel").agg(F.max(F.struct(F.length("dir"), "dir")).alias("m"))
    return rels.select("repo", "rel").distinct().join(got, ["repo", "rel"], "left").select("repo", "rel", F.coalesce("m.dir", F.lit("")).alias("scope"))
