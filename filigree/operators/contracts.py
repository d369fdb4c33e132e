"""Couplings between two languages that imports do not show.

Tables: ``urls(repo, file, url)`` with contract paths, ``symbols(repo, file,
name, kind, exported, python)``, ``routes(repo, file, segments, view)`` of
Python files, ``includes(repo, file, segments, target)``, and of callers
``literals(repo, file, seq)`` with one array of segments per string literal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.functions.classify import stem_key
from filigree.session import cut

# Stems of names that every code base has.
COMMON_STEMS = "get set list find run init main call exec apply create update delete remove add handle load save new index test setup start stop open close read write send check make build parse format validate process use data info config utils helper".split()
#: A stem is rare while at most so many files of either side define it.
RARE = 3


def url_pairs(urls: DataFrame) -> DataFrame:
    """Pairs ``repo, lo, hi`` of a Python and another file that name the same contract path.

    ``urls`` has ``python`` too.  The two sides are joined with each other
    only, never a side with itself.
    """
    u = urls.where("url IS NOT NULL").select("repo", "file", "url", "python").distinct()
    a = u.where("python").select("repo", "url", F.col("file").alias("a"))
    b = u.where("NOT python").select("repo", "url", F.col("file").alias("b"))
    return a.join(b, ["repo", "url"]).select("repo", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()


def semantic_pairs(symbols: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs that share a rare callable name shape, without those in ``known``.

    A stem counts when 1 to 3 Python files and 1 to 3 others define it; of the
    others only exported symbols count.  Stems under three letters do not.
    """
    s = symbols.where(F.lower("kind").isin("function", "class", "method") & (F.col("python") | F.coalesce("exported", F.lit(False))))
    s = s.select("repo", "file", "python", stem_key(F.col("name")).alias("stem")).where((F.length("stem") >= 3) & ~F.col("stem").isin(*COMMON_STEMS)).distinct()
    sides = s.groupBy("repo", "stem").agg(F.sum(F.col("python").cast("int")).alias("py"), F.sum((~F.col("python")).cast("int")).alias("ts"))
    s = s.join(sides.where(F.col("py").between(1, RARE) & F.col("ts").between(1, RARE)), ["repo", "stem"], "left_semi")
    a = s.where("python").select("repo", "stem", F.col("file").alias("a"))
    b = s.where("NOT python").select("repo", "stem", F.col("file").alias("b"))
    p = a.join(b, ["repo", "stem"]).select("repo", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    return p.join(known, ["repo", "lo", "hi"], "left_anti")


def stitch(routes: DataFrame, includes: DataFrame) -> DataFrame:
    """Routes with those that an include brings: the target's own routes behind the include's prefix.

    One level; a file that includes itself brings nothing; originals stay.
    ``includes.target`` is the included file.
    """
    i = includes.where("file <> target").select("repo", "file", F.col("segments").alias("prefix"), "target")
    got = i.join(routes.select("repo", F.col("file").alias("target"), "segments", "view"), ["repo", "target"])
    return routes.select("repo", "file", "segments", "view").unionByName(got.select("repo", "file", F.concat("prefix", "segments").alias("segments"), "view"))


def mounts(routes: DataFrame) -> DataFrame:
    """``repo, mount``: first segments of more than one nested route and of more than half of them."""
    n = routes.where(F.size("segments") > 1).select("repo", F.col("segments")[0].alias("mount"))
    per = n.groupBy("repo", "mount").agg(F.count("*").alias("n"))
    every = n.groupBy("repo").agg(F.count("*").alias("nested"))
    return per.join(every, "repo").where((F.col("n") > 1) & (2 * F.col("n") > F.col("nested"))).select("repo", "mount")


def keyed(routes: DataFrame) -> DataFrame:
    """Routes with ``key``: the segments without a mount at their head; empty keys are dropped."""
    r = routes.where(F.size("segments") > 0).withColumn("_first", F.col("segments")[0])
    m = mounts(routes.where(F.size("segments") > 0)).select("repo", F.col("mount").alias("_first"), F.lit(True).alias("_m"))
    r = r.join(m, ["repo", "_first"], "left")
    key = F.when(F.col("_m"), F.slice("segments", 2, F.size("segments"))).otherwise(F.col("segments"))
    return r.withColumn("key", key).where(F.size("key") > 0).drop("_first", "_m")


def view_files(keys: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds ``view_file``: the one Python definition of the view, or the route's own file if it is one of several."""
    d = symbols.where(F.col("python") & F.lower("kind").isin("class", "function")).groupBy("repo", F.col("name").alias("view")).agg(F.count("*").alias("n"), F.min("file").alias("only"))
    own = symbols.where(F.col("python") & F.lower("kind").isin("class", "function")).select("repo", F.col("name").alias("view"), "file", F.lit(True).alias("own")).distinct()
    j = keys.join(d, ["repo", "view"]).join(own, ["repo", "view", "file"], "left")
    return j.withColumn("view_file", F.when(F.col("n") == 1, F.col("only")).when(F.col("own"), F.col("file"))).where("view_file IS NOT NULL").drop("n", "only", "own")


def http_files(sending: DataFrame, extends: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files that send requests, closed over base classes: ``repo, file``.

    A file joins when it extends a class that exactly one file defines and
    that file is in the set.  Frontier rounds until nothing is new.
    """
    owner = symbols.where(~F.col("python") & (F.lower("kind") == "class")).groupBy("repo", F.col("name").alias("base")).agg(F.count("*").alias("n"), F.min("file").alias("owner")).where("n = 1").select("repo", "base", "owner")
    link = cut(extends.select("repo", "file", "base").distinct().join(owner, ["repo", "base"]).select("repo", "file", "owner").distinct())
    seen = cut(sending.select("repo", "file").distinct())
    front = seen
    while not front.isEmpty():
        new = link.join(front.select("repo", F.col("file").alias("owner")), ["repo", "owner"]).select("repo", "file").distinct().join(seen, ["repo", "file"], "left_anti")
        front = cut(new)
        seen = seen.unionByName(front)
    return seen


def route_callers(keys: DataFrame, literals: DataFrame, callers: DataFrame) -> DataFrame:
    """``repo, key, caller``: files whose literals name every segment of a route key, and mean this route.

    A set-containment join by segment: a caller matches when it holds as many
    different segments of the key as the key has.  The key is shadowed in a
    file when some literal holds all of it and every such literal also holds a
    longer key that begins with it.  Keys are joined on their rarest segment's
    literals only after the counts agree, so no caller meets every key.
    """
    k = keys.select("repo", "key").distinct().withColumn("need", F.size(F.array_distinct("key")))
    lit = literals.join(callers.select("repo", "file").distinct(), ["repo", "file"], "left_semi").select("repo", "file", "seq").distinct()
    seg = lit.select("repo", "file", F.explode("seq").alias("s")).distinct()
    ks = k.select("repo", "key", "need", F.explode(F.array_distinct("key")).alias("s"))
    hit = ks.join(seg, ["repo", "s"]).groupBy("repo", "key", "need", "file").agg(F.count("*").alias("n")).where(F.col("n") == F.col("need"))
    hit = cut(hit.select("repo", "key", "file"))
    # longer keys beginning with the key
    long = k.select("repo", F.col("key").alias("longer"), F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("key") - 1, F.lit(1))), lambda n: F.slice("key", F.lit(1), n))).alias("key")).where(F.size("longer") > F.size("key"))
    holding = hit.join(lit, ["repo", "file"]).where(F.size(F.array_except("key", "seq")) == 0)
    longer = holding.join(long, ["repo", "key"]).where(F.size(F.array_except("longer", "seq")) == 0).select("repo", "key", "file", "seq").distinct().withColumn("longer", F.lit(True))
    shadow = holding.join(longer, ["repo", "key", "file", "seq"], "left").groupBy("repo", "key", "file").agg(F.min(F.coalesce("longer", F.lit(False))).alias("shadowed"))
    return hit.join(shadow.where("shadowed"), ["repo", "key", "file"], "left_anti").withColumnRenamed("file", "caller")


def route_links(routes: DataFrame, symbols: DataFrame, literals: DataFrame, callers: DataFrame) -> DataFrame:
    """Views with callers: ``repo, view, view_file, routes, callers`` (sorted arrays); without callers no row."""
    v = view_files(keyed(routes), symbols)
    c = route_callers(v, literals, callers)
    per = v.select("repo", "view", "view_file", "key").distinct().join(c, ["repo", "key"], "left")
    out = per.groupBy("repo", "view", "view_file").agg(F.array_sort(F.collect_set(F.array_join("key", "/"))).alias("routes"), F.array_sort(F.collect_set("caller")).alias("callers"))
    return out.where(F.size("callers") > 0)
