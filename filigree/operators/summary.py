"""What clusters are: their directories, symbols, terms, budgets, confidence, flows and names.

``members(repo, id, cluster)``, ``scores(id, score)``, ``nodes(repo, id, rel)``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filigree.functions.classify import SALIENCE
from filigree.functions.names import derive_summary, distinct_names, path_terms, split_identifier
from filigree.functions.paths import dirname
from filigree.operators.graph import top_per
from filigree.operators.skew import running_sum
from filigree.session import cut

# Weights of confidence, its bands, entries and externals shown, hops and flows, token budgets.
W_RESOLUTION, W_STABILITY, W_AGREEMENT, HIGH, MEDIUM = 0.45, 0.35, 0.20, 0.75, 0.45
SYMBOLS, ENTRIES, EXTERNALS, HOPS, FLOWS, BUDGET_LEAST, BUDGET_MOST = 8, 4, 5, 4, 3, 300, 1200


def dominant_dirs(members: DataFrame, nodes: DataFrame, scores: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` directories of each cluster with most score: ``repo, cluster, rank, dir, weight``."""
    j = members.join(nodes.select("id", dirname(F.col("rel")).alias("dir")), "id").join(scores.select("id", "score"), "id", "left")
    w = j.groupBy("repo", "cluster", "dir").agg(F.sum(F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0)) + 0.01).alias("weight"))
    w = w.withColumn("weight", F.round("weight", 9))
    return top_per(w, ["repo", "cluster"], [F.desc("weight"), F.asc("dir")], k)


def pick_symbols(members: DataFrame, symbols: DataFrame, scores: DataFrame, k: int = SYMBOLS) -> DataFrame:
    """The ``k`` names of each cluster that say most: ``repo, cluster, rank, name, weight``.

    Weight is twice the salience of the kind, 3 if exported, 5 times the
    file's score; a name counts once, with its best weight.
    """
    sal = F.coalesce(*[F.when(F.lower("kind") == n, F.lit(v)) for n, v in SALIENCE.items()], F.lit(0))
    j = members.join(symbols.select(F.col("file").alias("id"), "name", "kind", "exported"), "id").join(scores.select("id", "score"), "id", "left")
    w = 2.0 * sal + F.when(F.coalesce("exported", F.lit(False)), 3.0).otherwise(0.0) + 5.0 * F.coalesce("score", F.lit(0.0))
    best = j.groupBy("repo", "cluster", "name").agg(F.round(F.max(w), 9).alias("weight"))
    return top_per(best, ["repo", "cluster"], [F.desc("weight"), F.asc("name")], k)


def routing_terms(members: DataFrame, nodes: DataFrame, symbols: DataFrame | None = None, k: int = 8) -> DataFrame:
    """Words of paths (and symbols) that occur in one cluster of the repository only: ``repo, cluster, rank, term, n``."""

    def words(batches):
        for pdf in batches:
            yield pd.DataFrame({"repo": pdf.repo, "cluster": pdf.cluster, "terms": [path_terms(r) if p else split_identifier(r) for r, p in zip(pdf.text, pdf.path)]})

    t = members.join(nodes.select("id", F.col("rel").alias("text"), F.lit(True).alias("path")), "id").select("repo", "cluster", "text", "path")
    if symbols is not None:
        t = t.unionByName(members.join(symbols.select(F.col("file").alias("id"), F.col("name").alias("text"), F.lit(False).alias("path")), "id").select("repo", "cluster", "text", "path"))
    t = t.mapInPandas(words, "repo string, cluster long, terms array<string>").select("repo", "cluster", F.explode("terms").alias("term"))
    n = t.groupBy("repo", "cluster", "term").agg(F.count("*").alias("n"))
    one = n.groupBy("repo", "term").agg(F.count("*").alias("units")).where("units = 1").select("repo", "term")
    return top_per(n.join(one, ["repo", "term"], "left_semi"), ["repo", "cluster"], [F.desc("n"), F.asc("term")], k)


def budgets(members: DataFrame, churn: DataFrame) -> DataFrame:
    """Token budget per cluster by size and churn: ``repo, cluster, size, churn, budget``.

    The share of the pool (1,200 per cluster) by ``size * ln(2 + churn)``,
    truncated and clamped to 300..1,200.
    """
    g = members.join(churn.select("id", F.col("n").alias("c")), "id", "left").groupBy("repo", "cluster").agg(F.count("*").alias("size"), F.coalesce(F.sum("c"), F.lit(0)).alias("churn"))
    w = g.withColumn("w", F.col("size") * F.log1p(1.0 + F.col("churn")))
    tot = w.groupBy("repo").agg(F.greatest(F.sum("w"), F.lit(1.0)).alias("tot"), (F.count("*") * BUDGET_MOST).alias("pool"))
    share = F.floor(F.round(F.col("w") / F.col("tot") * F.col("pool"), 9))
    return w.join(tot, "repo").select("repo", "cluster", "size", "churn", F.greatest(F.lit(BUDGET_LEAST), F.least(F.lit(BUDGET_MOST), share)).cast("long").alias("budget"))


def confidence(members: DataFrame, edges: DataFrame, unresolved: DataFrame, stability: DataFrame, cochange: DataFrame | None, rates: DataFrame) -> DataFrame:
    """``repo, cluster, size, resolution, stability, agreement, score, band``.

    ``resolution``: resolved over attempted references of the members, the
    repository's rate where none was attempted.  ``agreement``: co-change pairs
    inside the cluster that are also imports; null without such pairs, and then
    left out of the score, which is not the same as 0.
    """
    size = members.groupBy("repo", "cluster").agg(F.count("*").alias("size"))
    stab = members.join(stability.select("id", "stability"), "id", "left").groupBy("repo", "cluster").agg(F.avg(F.coalesce("stability", F.lit(0.0))).alias("stability"))
    m = members.select("id", "cluster")
    hit = edges.join(m.withColumnRenamed("id", "src"), "src").groupBy("repo", "cluster").agg(F.count("*").alias("hit"))
    miss = unresolved.select("repo", F.col("file").alias("id")).join(m, "id").groupBy("repo", "cluster").agg(F.count("*").alias("miss"))
    out = size.join(stab, ["repo", "cluster"]).join(hit, ["repo", "cluster"], "left").join(miss, ["repo", "cluster"], "left").join(rates.select("repo", "rate"), "repo", "left")
    tried = F.coalesce("hit", F.lit(0)) + F.coalesce("miss", F.lit(0))
    out = out.withColumn("resolution", F.when(tried > 0, F.coalesce("hit", F.lit(0)) / tried).otherwise(F.coalesce("rate", F.lit(1.0))))
    if cochange is not None:
        pairs = cochange.select("repo", "lo", "hi").join(m.select(F.col("id").alias("lo"), "cluster"), "lo").join(m.select(F.col("id").alias("hi"), F.col("cluster").alias("c2")), "hi").where("cluster = c2")
        imp = edges.select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).distinct().withColumn("yes", F.lit(1.0))
        agr = pairs.join(imp, ["lo", "hi"], "left").groupBy("repo", "cluster").agg(F.avg(F.coalesce("yes", F.lit(0.0))).alias("agreement"))
        out = out.join(agr, ["repo", "cluster"], "left")
    else:
        out = out.withColumn("agreement", F.lit(None).cast("double"))
    base = W_RESOLUTION * F.col("resolution") + W_STABILITY * F.col("stability")
    score = F.when(F.col("agreement").isNull(), base / (W_RESOLUTION + W_STABILITY)).otherwise(base + W_AGREEMENT * F.col("agreement"))
    out = out.withColumn("score", F.round(score, 9))
    band = F.when(F.col("score") >= HIGH, "high").when(F.col("score") >= MEDIUM, "medium").otherwise("low")
    return out.select("repo", "cluster", "size", "resolution", "stability", "agreement", "score", band.alias("band"))


def global_confidence(conf: DataFrame) -> DataFrame:
    """Mean score weighted by size: ``repo, score``."""
    return conf.groupBy("repo").agg((F.sum(F.col("score") * F.col("size")) / F.sum("size")).alias("score"))


def ranked_clusters(members: DataFrame, scores: DataFrame) -> DataFrame:
    """Clusters by sum of scores, then size, then number: ``repo, cluster, place, importance, size``."""
    g = members.join(scores.select("id", "score"), "id", "left").groupBy("repo", "cluster").agg(F.round(F.sum(F.coalesce("score", F.lit(0.0))), 9).alias("importance"), F.count("*").alias("size"))
    w = Window.partitionBy("repo").orderBy(F.desc("importance"), F.desc("size"), "cluster")
    return g.withColumn("place", (F.row_number().over(w) - 1).cast("long"))


def quartile_floor(m: DataFrame) -> DataFrame:
    """``repo, cluster, floor``: the score that a quarter of a cluster's files are below, by place in ascending order.

    Equal scores are counted first and running counts span tasks, so that no
    cluster is sorted in one.
    """
    n = m.groupBy(F.struct("repo", "cluster").alias("key"), "score").agg(F.count("*").alias("n"))
    at = n.groupBy("key").agg(F.expr("sum(n) div 4").alias("at"))
    r = running_sum(n, "key", "score", "n").join(at, "key").where(F.col("running") > F.col("at"))
    return r.groupBy("key").agg(F.min("score").alias("floor")).select("key.repo", "key.cluster", "floor")


def flows(members: DataFrame, nodes: DataFrame, scores: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Chains from the best entries: ``repo, cluster, label, path, leaves``.

    ``entries(id, label)``; at most ``FLOWS`` per cluster, by score and path,
    are followed for ``HOPS`` hops inside their cluster, each by one join of
    the chains' ends with the edges.  A hop goes to the best file not on the
    chain, at or above the quarter floor of the cluster's scores.  From the
    second hop on, several candidates are a fan: the best that leads further
    is taken, and where none does the chain ends with their number as
    ``leaves``.  Chains of one file are dropped.
    """
    m = members.join(nodes.select("id", "rel"), "id").join(scores.select("id", "score"), "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    m = cut(m.select("repo", "cluster", "id", "rel", "score"))
    e = edges.join(m.select(F.col("id").alias("src"), "cluster"), "src").join(m.select(F.col("id").alias("dst"), F.col("cluster").alias("c2"), "score", "rel"), "dst").where("cluster = c2")
    e = cut(e.select("src", "dst", "score", "rel").distinct())
    first = entries.groupBy("id").agg(F.min("label").alias("label")).where("label IS NOT NULL")
    front = top_per(m.join(first, "id"), ["repo", "cluster"], [F.desc("score"), F.asc("rel")], FLOWS).join(quartile_floor(m), ["repo", "cluster"])
    front = cut(front.select("repo", "cluster", "label", F.col("id").alias("entry"), "floor", F.array("id").alias("path"), F.lit(0).alias("leaves"), F.lit(True).alias("open")))
    for hop in range(HOPS):
        c = front.where("open").select("entry", "path", "floor", F.element_at("path", -1).alias("src")).join(e, "src").where((F.col("score") >= F.col("floor")) & ~F.array_contains("path", F.col("dst")))
        on = c.select("entry", "path", "dst").join(e.select(F.col("src").alias("dst"), F.col("dst").alias("to")), "dst").where(~F.array_contains("path", F.col("to")))
        c = c.join(on.select("entry", "dst").distinct().withColumn("on", F.lit(True)), ["entry", "dst"], "left")
        best = F.struct((-F.col("score")).alias("s"), "rel", "dst")
        c = c.groupBy("entry").agg(F.count("*").alias("n"), F.min(best).alias("any"), F.min(F.when(F.col("on"), best)).alias("on"))
        to = F.when((F.col("n") == 1) | F.lit(hop == 0), F.col("any.dst")).otherwise(F.col("on.dst"))
        j = front.join(c.select("entry", "n", to.alias("to")), "entry", "left")
        path = F.when(F.col("to").isNotNull(), F.concat("path", F.array("to"))).otherwise(F.col("path"))
        leaves = F.when(F.col("to").isNull(), F.coalesce("n", "leaves")).otherwise(F.col("leaves")).cast("int")
        front = cut(j.select("repo", "cluster", "label", "entry", "floor", path.alias("path"), leaves.alias("leaves"), F.col("to").isNotNull().alias("open")))
    return front.where(F.size("path") > 1).select("repo", "cluster", "label", "path", "leaves")


def labels(ranked: DataFrame, dirs: DataFrame, symbols: DataFrame, externals: DataFrame) -> DataFrame:
    """Names and one-sentence summaries: ``repo, cluster, place, name, summary``.

    Names are given in order of ``place``, each different from those before;
    only the clusters of one repository, a few dozen rows, meet in a task.
    """
    d = dirs.groupBy("repo", "cluster").agg(F.array_sort(F.collect_list(F.struct("rank", "dir"))).alias("d"))
    s = symbols.groupBy("repo", "cluster").agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("s"))
    x = externals.groupBy("repo", "cluster").agg(F.array_sort(F.collect_list(F.struct("rank", "package"))).alias("x"))
    j = ranked.join(d, ["repo", "cluster"], "left").join(s, ["repo", "cluster"], "left").join(x, ["repo", "cluster"], "left")
    j = j.select("repo", "cluster", "place", "size", F.col("d.dir").alias("dirs"), F.col("s.name").alias("symbols"), F.col("x.package").alias("packages"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values("place"), []
        li = lambda v: list(v) if v is not None else []
        given = distinct_names([(li(d) or [None])[0] for d in pdf.dirs])
        for name, r in zip(given, pdf.itertuples()):
            out.append((r.repo, r.cluster, r.place, name, derive_summary(r.size, li(r.dirs), li(r.symbols), li(r.packages))))
        return pd.DataFrame(out, columns=["repo", "cluster", "place", "name", "summary"])

    return j.groupBy("repo").applyInPandas(run, "repo string, cluster long, place long, name string, summary string")


def cluster_externals(members: DataFrame, packages: DataFrame, k: int = EXTERNALS) -> DataFrame:
    """Packages that most files of a cluster use: ``repo, cluster, rank, package, n``.

    ``packages(file, package)``.
    """
    n = members.join(packages.select(F.col("file").alias("id"), "package").distinct(), "id").groupBy("repo", "cluster", "package").agg(F.count("*").alias("n"))
    return top_per(n, ["repo", "cluster"], [F.desc("n"), F.asc("package")], k)


def coarse_units(members: DataFrame, nodes: DataFrame, fused: DataFrame) -> DataFrame:
    """Clusters that have outside links as units of their own, the rest as buckets by top directory.

    ``repo, id, kind, unit``; ``unit`` is the cluster's number or the
    directory, ``(root)`` for files at the root.
    """
    c = members.select("id", "cluster")
    cross = fused.join(c.select(F.col("id").alias("lo"), F.col("cluster").alias("a")), "lo").join(c.select(F.col("id").alias("hi"), F.col("cluster").alias("b")), "hi").where("a <> b AND w > 0")
    full = cross.select("repo", F.col("a").alias("cluster")).unionByName(cross.select("repo", F.col("b").alias("cluster"))).distinct().withColumn("full", F.lit(True))
    j = members.join(full, ["repo", "cluster"], "left").join(nodes.select("id", "rel"), "id")
    top = F.when(F.col("rel").contains("/"), F.substring_index("rel", "/", 1)).otherwise("(root)")
    return j.select("repo", "id", F.when(F.col("full"), "full").otherwise("bucket").alias("kind"), F.when(F.col("full"), F.col("cluster").cast("string")).otherwise(top).alias("unit"))


def nest(members: DataFrame, units: DataFrame) -> DataFrame:
    """The unit that holds most files of each cluster: ``repo, cluster, kind, unit``; of equals the first by name."""
    n = members.join(units, ["repo", "id"]).groupBy("repo", "cluster", "kind", "unit").agg(F.count("*").alias("n"))
    w = Window.partitionBy("repo", "cluster").orderBy(F.desc("n"), "unit", "kind")
    return n.withColumn("k", F.row_number().over(w)).where("k = 1").select("repo", "cluster", "kind", "unit")
