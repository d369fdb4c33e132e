"""Lookups and measures on the import graph.

Tables: ``nodes(repo, id, rel)`` with one row per file, and directed
``edges(repo, src, dst)``, distinct and without loops; ``src`` imports ``dst``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filigree.functions.paths import dirname
from filigree.session import cut

# Weights of the signals in the fused graph, and the largest directory whose files count as neighbours.
W_IMPORT, W_COCHANGE, W_CONTRACT, W_SEMANTIC, W_DIRECTORY, DIRECTORY_MOST = 1.00, 0.55, 0.45, 0.30, 0.25, 30
#: Graphs of up to so many files and edges are done in one task (about 100 bytes each).
KERNEL_EDGES = 2_000_000
# The weights of importance, and PageRank's damping and rounds.
W_RANK, W_ENTRY, W_CHURN, W_FAN_IN, DAMPING, ROUNDS = 0.35, 0.25, 0.20, 0.20, 0.85, 40


def closure(edges: DataFrame, targets: DataFrame, depth: int | None = None, reverse: bool = True) -> DataFrame:
    """Everything that reaches a target (``reverse``), or that it reaches, with least hops.

    ``edges(src, dst)``, ``targets(target)``; output ``target, node, depth``.
    A target is never listed for itself, cycles end, ``depth`` caps the hops
    (0 gives nothing).  Each round joins the newest nodes to the edges and
    drops what was seen; the edge list is shuffled once and checkpointed, and
    so is every frontier, so a lost executor costs one round.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    step = edges.select(F.col(a).alias("node"), F.col(b).alias("next")).where("node IS NOT NULL AND next IS NOT NULL AND node <> next").distinct()
    step = cut(step.repartition("node"))
    front = targets.select("target", F.col("target").alias("node")).where("target IS NOT NULL").distinct()
    seen = front.withColumn("depth", F.lit(0))
    front, n = cut(front), 0
    while (depth is None or n < depth) and not front.isEmpty():
        n += 1
        # a hub's many rows are on the side of the steps, which adaptive execution splits
        new = front.join(step, "node").select("target", F.col("next").alias("node")).distinct()
        new = new.join(seen, ["target", "node"], "left_anti")
        front = cut(new)
        seen = seen.unionByName(front.withColumn("depth", F.lit(n)))
        if n % 8 == 0:
            seen = cut(seen)
    return seen.where("depth > 0")


def neighbours(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Direct dependencies ``src, dst`` of the given ``src`` rows."""
    return edges.join(sources.select("src").distinct(), "src", "left_semi").select("src", "dst").distinct()


def import_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The reverse index in rows: ``repo, target, importer``, each pair of paths once.

    Nothing is gathered per target, so a hub's importers stay spread.
    """
    rel = nodes.select("id", "rel")
    e = edges.join(rel.select(F.col("id").alias("dst"), F.col("rel").alias("target")), "dst")
    e = e.join(rel.select(F.col("id").alias("src"), F.col("rel").alias("importer")), "src")
    return e.select("repo", "target", "importer").distinct()


def import_index(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of the reverse index: ``repo, target, importers`` with sorted paths joined by ', '.

    The form of the text index, whose line for a hub is as long as its
    importers are many; ``import_pairs`` is the form for further work.
    """
    return import_pairs(nodes, edges).groupBy("repo", "target").agg(F.array_join(F.array_sort(F.collect_list("importer")), ", ").alias("importers"))


def top_per(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group; rows beyond ``k`` are dropped before the shuffle ends in one task.

    Each task first keeps its own best ``k`` per group, so a hot group sends
    at most k rows per task to its final task.
    """
    local = Window.partitionBy(*group, "_part").orderBy(*order)
    last = Window.partitionBy(*group).orderBy(*order)
    part = df.withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.lit(64)))
    kept = part.withColumn("_k", F.row_number().over(local)).where(F.col("_k") <= k)
    return kept.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).drop("_k", "_part")


def hubs(nodes: DataFrame, edges: DataFrame, k: int = 8) -> DataFrame:
    """The ``k`` files of each repository with most importers: ``repo, rank, rel, importers``."""
    n = edges.groupBy("repo", F.col("dst").alias("id")).agg(F.count("*").alias("importers"))
    n = n.join(nodes.select("id", "rel"), "id")
    return top_per(n, ["repo"], [F.desc("importers"), F.asc("rel")], k).select("repo", "rank", "rel", "importers")


def suggest(paths: DataFrame, query: str, k: int = 5) -> DataFrame:
    """First ``k`` paths per repository that hold the query in any case; none for an empty query."""
    hit = paths.select("repo", "path").distinct().where(F.lower("path").contains(query.lower()) & F.lit(query != ""))
    return top_per(hit, ["repo"], [F.asc("path")], k).select("repo", "rank", "path")


def directory_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs ``repo, lo, hi`` of files in one directory, for directories of 2 to 30 files."""
    f = nodes.select("repo", "id", dirname(F.col("rel")).alias("dir"))
    ok = f.groupBy("repo", "dir").agg(F.count("*").alias("n")).where(F.col("n").between(2, DIRECTORY_MOST)).select("repo", "dir")
    f = f.join(ok, ["repo", "dir"], "left_semi")
    g = f.groupBy("repo", "dir").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    pair = F.flatten(F.transform("ids", lambda x, i: F.transform(F.slice("ids", i + 2, F.lit(DIRECTORY_MOST)), lambda y: F.struct(x.alias("lo"), y.alias("hi")))))
    return g.select("repo", F.explode(pair).alias("p")).select("repo", "p.lo", "p.hi")


def fuse(edges: DataFrame, cochange: DataFrame, contracts: DataFrame, semantic: DataFrame, near: DataFrame) -> DataFrame:
    """The weighted undirected graph ``repo, lo, hi, w``: all signals of a pair added up.

    ``cochange`` has ``repo, lo, hi, w``, the others ``repo, lo, hi``; an
    import counts once per direction.
    """
    lohi = [F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")]
    parts = [edges.select("repo", *lohi, F.lit(W_IMPORT).alias("w")), cochange.select("repo", "lo", "hi", (F.col("w") * W_COCHANGE).alias("w"))]
    parts += [df.select("repo", "lo", "hi", F.lit(w).alias("w")) for df, w in ((contracts, W_CONTRACT), (semantic, W_SEMANTIC), (near, W_DIRECTORY))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("repo", "lo", "hi").agg(F.sum("w").alias("w"))


def directed(edges: DataFrame, contracts: DataFrame, semantic: DataFrame) -> DataFrame:
    """Imports and both directions of each contract pair, distinct."""
    both = contracts.select("repo", "lo", "hi").unionByName(semantic.select("repo", "lo", "hi"))
    out = edges.select("repo", "src", "dst")
    out = out.unionByName(both.select("repo", F.col("lo").alias("src"), F.col("hi").alias("dst"))).unionByName(both.select("repo", F.col("hi").alias("src"), F.col("lo").alias("dst")))
    return out.where("src <> dst").distinct()


def degrees(nodes: DataFrame, edges: DataFrame, fused: DataFrame) -> DataFrame:
    """``repo, id, fan_in, fan_out, degree``; files without edges have zeros."""
    i = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in"))
    o = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("fan_out"))
    ends = fused.select(F.col("lo").alias("id"), "w").unionByName(fused.select(F.col("hi").alias("id"), "w"))
    d = ends.groupBy("id").agg(F.sum("w").alias("degree"))
    out = nodes.select("repo", "id").join(i, "id", "left").join(o, "id", "left").join(d, "id", "left")
    return out.select("repo", "id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("fan_in", "fan_out")], F.coalesce("degree", F.lit(0.0)).alias("degree"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """PageRank of each repository's graph: ``repo, id, rank``, summing to 1 per repository.

    Synchronous rounds from 1/n; the rank of files without out-edges is spread
    evenly.  Repositories of at most ``KERNEL_EDGES`` files and edges are done
    in one task each, larger ones by rounds of joins.
    """
    size = nodes.groupBy("repo").agg(F.count("*").alias("n")).join(edges.groupBy("repo").agg(F.count("*").alias("m")), "repo", "left")
    size = cut(size.select("repo", ((F.col("n") <= KERNEL_EDGES) & (F.coalesce("m", F.lit(0)) <= KERNEL_EDGES)).alias("small")))
    small, big = size.where("small").select("repo"), size.where("NOT small").select("repo")
    out = pagerank_kernel(nodes.join(small, "repo", "left_semi"), edges.join(small, "repo", "left_semi"), rounds)
    if big.isEmpty():
        return out
    return out.unionByName(pagerank_rounds(nodes.join(big, "repo", "left_semi"), edges.join(big, "repo", "left_semi"), rounds))


def pagerank_kernel(nodes: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``pagerank`` of graphs that fit one task each."""

    def run(key, ns: pd.DataFrame, es: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(ns.id.to_numpy())
        n = len(ids)
        if n == 0:
            return pd.DataFrame({"repo": [], "id": [], "rank": []})
        src, dst = np.searchsorted(ids, es.src.to_numpy()), np.searchsorted(ids, es.dst.to_numpy())
        k = np.bincount(src, minlength=n).astype(float)
        rank = np.full(n, 1 / n)
        for _ in range(rounds):
            got = np.bincount(dst, rank[src] / k[src], minlength=n) if len(src) else np.zeros(n)
            rank = (1 - DAMPING) / n + DAMPING * (got + rank[k == 0].sum() / n)
        return pd.DataFrame({"repo": key[0], "id": ids, "rank": rank})

    e = edges.select(F.col("repo").alias("r"), "src", "dst")
    return nodes.select("repo", "id").groupBy("repo").cogroup(e.groupBy("r")).applyInPandas(run, "repo string, id long, rank double")


def pagerank_rounds(nodes: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``pagerank`` by joins.

    The edges carry their source's out-degree and are laid out by source once;
    a round is one join on that layout and one aggregation that adds up
    contributions before its shuffle.  Ranks are cut every few rounds.
    """
    out = edges.groupBy("src").agg(F.count("*").alias("k"))
    size = nodes.groupBy("repo").agg(F.count("*").alias("n"))
    links = cut(edges.select("src", "dst").join(out, "src").repartition("src"))
    base = cut(nodes.select("repo", "id").join(size, "repo").join(out.withColumnRenamed("src", "id"), "id", "left"))
    rank = base.withColumn("rank", 1 / F.col("n"))
    for r in range(rounds):
        into = links.join(rank.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("k")).alias("got"))
        lost = rank.groupBy("repo").agg(F.sum(F.when(F.col("k").isNull(), F.col("rank")).otherwise(0.0)).alias("lost"))
        rank = base.join(into, "id", "left").join(F.broadcast(lost) if r == 0 else lost, "repo").withColumn(
            "rank", (1 - DAMPING) / F.col("n") + DAMPING * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / F.col("n"))
        ).select(*base.columns, "rank")
        if r % 5 == 4 or r == rounds - 1:
            rank = cut(rank)
    return rank.select("repo", "id", "rank")


def importance(ranks: DataFrame, degree: DataFrame, churn: DataFrame, entries: DataFrame) -> DataFrame:
    """``repo, id, score``: rank, entry, churn and fan-in, each divided by its maximum in the repository.

    ``churn(id, n)`` and ``entries(id)`` may lack files; a maximum of 0 gives 0.
    """
    j = ranks.join(degree.select("id", "fan_in"), "id").join(churn.select("id", F.log1p("n").alias("churn")), "id", "left").join(entries.select("id", F.lit(1.0).alias("entry")).distinct(), "id", "left")
    j = j.withColumns({"churn": F.coalesce("churn", F.lit(0.0)), "entry": F.coalesce("entry", F.lit(0.0)), "fan_in": F.col("fan_in").cast("double")})
    top = j.groupBy("repo").agg(*[F.max(c).alias(f"max_{c}") for c in ("rank", "churn", "fan_in")])
    part = lambda c: F.when(F.col(f"max_{c}") > 0, F.col(c) / F.col(f"max_{c}")).otherwise(0.0)
    score = W_RANK * part("rank") + W_ENTRY * F.col("entry") + W_CHURN * part("churn") + W_FAN_IN * part("fan_in")
    return j.join(top, "repo").select("repo", "id", score.alias("score"))


def directory_partition(nodes: DataFrame) -> DataFrame:
    """Clusters by directory, numbered in path order: ``repo, id, cluster``.

    Distinct directories are numbered, not files, so the window holds one row
    per directory.
    """
    f = nodes.select("repo", "id", dirname(F.col("rel")).alias("dir"))
    dirs = f.select("repo", "dir").distinct().withColumn("cluster", F.row_number().over(Window.partitionBy("repo").orderBy("dir")) - 1)
    return f.join(dirs, ["repo", "dir"]).select("repo", "id", F.col("cluster").cast("long").alias("cluster"))


def cluster_edges(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct pairs of different clusters with an edge between them: ``repo, cluster, depends_on``."""
    a = members.select(F.col("id").alias("src"), F.col("cluster"))
    b = members.select(F.col("id").alias("dst"), F.col("cluster").alias("depends_on"))
    return edges.join(a, "src").join(b, "dst").where("cluster <> depends_on").select("repo", "cluster", "depends_on").distinct()


def match_clusters(one: DataFrame, other: DataFrame) -> DataFrame:
    """For each cluster of ``one`` the cluster of ``other`` it shares most files with.

    ``repo, cluster, matched, shared``; of equal overlaps the smaller number wins.
    """
    j = one.select("repo", "id", "cluster").join(other.select("repo", "id", F.col("cluster").alias("matched")), ["repo", "id"])
    n = j.groupBy("repo", "cluster", "matched").agg(F.count("*").alias("shared"))
    best = n.groupBy("repo", "cluster").agg(F.max(F.struct("shared", (-F.col("matched")).alias("m"))).alias("b"))
    return best.select("repo", "cluster", (-F.col("b.m")).alias("matched"), F.col("b.shared").alias("shared"))
