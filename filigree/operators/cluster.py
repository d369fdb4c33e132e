"""Community detection on the fused graph.

One scheme at every size.  A partition moves nodes in rounds: every node finds
the neighbouring community that gains most modularity, and those drawn by lot
move at once; rounds go on until no node wants to move.  Communities are then
split into connected parts, refined from single nodes inside each part, and
contracted for the next level.  Resolutions of a ladder are tried, clusters
under the least size folded, the best fit chosen, and reruns with other seeds
say how stable it is.

Weights are whole numbers and ties fall by node id, so the arrays of
``kernel`` (one task per repository) and the tables of ``distributed`` give the
same clusters, bit for bit; size only decides which of them does the work.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigree.session import cut

# Resolutions tried, largest share of one cluster, least size, runs of the stability test, default seed and cap.
LADDER, SHARE_MOST, LEAST_SIZE, STABILITY_RUNS, SEED, MAX_DOMAINS, COARSE_GAMMA = (0.5, 0.8, 1.0, 1.4, 2.0, 2.8, 4.0), 0.40, 3, 4, 0x5EED, 12, 0.5
#: Repositories of up to so many files and fused edges are clustered in one task (about 200 bytes an edge).
KERNEL_EDGES = 1_000_000
#: Weights are counted in units of 1 / SCALE; a move must gain more than LEAST_GAIN units.
SCALE, LEAST_GAIN = 1 << 20, 1e-6
#: Rounds of moves: half of the nodes that want to move do so for CALM rounds, then ever fewer, which ends any to and fro.
ROUNDS, CALM = 80, 20
#: Rounds of folding small clusters.
FOLDS = 10
# Fixed values of the lot: a prime modulus and two multipliers, small enough for 63 bits.
_P, _M1, _M2 = 2_147_483_647, 48_271, 16_807


def _share(r: int) -> int:
    """One in so many nodes may move in round ``r``."""
    return 2 if r < CALM else 2 + (r - CALM) // 4


def _salt(seed: int, level: int, phase: int, r: int) -> int:
    return (seed * 7919 + level * 104_729 + phase * 1_299_709 + r * 69_621) % _P


def _lot(ids, salt):
    """A number per node and round; the same expression on arrays and on columns."""
    mod = (lambda x, n: F.pmod(x, F.lit(n))) if isinstance(ids, Column) else (lambda x, n: x % n)
    return mod(mod(mod(ids, _P) * _M1 + salt, _P) * _M2 + mod(ids, 65_537), _P)


# -- arrays: one repository in one task ---------------------------------------------


@dataclass
class Graph:
    """Undirected graph: sorted ids, every edge in both directions by position, whole weights, strength of each node."""

    ids: np.ndarray
    src: np.ndarray
    dst: np.ndarray
    w: np.ndarray
    k: np.ndarray

    @classmethod
    def of(cls, ids: Sequence[int], lo: Sequence[int], hi: Sequence[int], w: Sequence[float]) -> Graph:
        ids = np.unique(np.asarray(ids, "int64"))
        a, b = np.asarray(lo, "int64"), np.asarray(hi, "int64")
        whole = np.floor(np.asarray(w, float) * SCALE + 0.5).astype("int64")
        ok = np.isin(a, ids) & np.isin(b, ids) & (a != b) & (whole > 0)
        x, y = np.searchsorted(ids, a[ok]), np.searchsorted(ids, b[ok])
        src, dst, both = np.concatenate([x, y]), np.concatenate([y, x]), np.tile(whole[ok], 2)
        src, dst, both = _summed(src, dst, both, len(ids))
        return cls(ids, src, dst, both, np.bincount(src, both, len(ids)).astype("int64"))

    def contract(self, part: np.ndarray) -> tuple[Graph, np.ndarray]:
        """The graph of the parts (named by their least node), and the place of each node's part."""
        names, place = np.unique(part, return_inverse=True)
        a, b = place[self.src], place[self.dst]
        out = a != b
        src, dst, w = _summed(a[out], b[out], self.w[out], len(names))
        return Graph(self.ids[names], src, dst, w, np.bincount(place, self.k, len(names)).astype("int64")), place

    def inside(self, label: np.ndarray) -> Graph:
        """The same nodes and strengths with the edges inside labels only."""
        ok = label[self.src] == label[self.dst]
        return Graph(self.ids, self.src[ok], self.dst[ok], self.w[ok], self.k)


def _summed(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parallel edges added up, in order of (a, b)."""
    key, place = np.unique(a * max(n, 1) + b, return_inverse=True)
    return key // max(n, 1), key % max(n, 1), np.bincount(place, w, len(key)).astype("int64")


def moved(g: Graph, label: np.ndarray, gamma: float, seed: int, level: int, phase: int) -> np.ndarray:
    """Labels after rounds of moves, until no node wants to move."""
    n, label, m2 = len(g.ids), label.copy(), float(g.k.sum())
    if not m2 or not len(g.src):
        return label
    for r in range(ROUNDS):
        tot = np.bincount(label, g.k, n)
        i, c, link = _summed(g.src, label[g.dst], g.w, n)
        own = np.zeros(n)
        stays = c == label[i]
        own[i[stays]] = link[stays]
        own -= gamma * g.k * (tot[label] - g.k) / m2
        i, c, link = i[~stays], c[~stays], link[~stays]
        gain = link - gamma * g.k[i] * tot[c] / m2
        # by node, then best gain, then least label: the first of each node is its choice
        order = np.lexsort((c, -gain, i))
        first = order[np.unique(i[order], return_index=True)[1]]
        first = first[gain[first] > own[i[first]] + LEAST_GAIN]
        if not len(first):
            break
        first = first[_lot(g.ids[i[first]], _salt(seed, level, phase, r)) // 512 % _share(r) == 0]
        label[i[first]] = c[first]
    return label


def parts(g: Graph, label: np.ndarray) -> np.ndarray:
    """Connected parts of the labels, each named by its least node."""
    e = g.inside(label)
    part = np.arange(len(g.ids))
    while True:
        low = part.copy()
        np.minimum.at(low, e.src, part[e.dst])
        low = low[low]
        if (low == part).all():
            return part
        part = low


def partition(g: Graph, gamma: float, seed: int, label: np.ndarray | None = None, depth: int = 0) -> np.ndarray:
    """Communities at one resolution, all connected, as the id of their least node.

    ``g`` may be a contracted level; then ``depth`` is its number and ``label``
    holds the labels to begin with.
    """
    level, place, label = g, np.arange(len(g.ids)), np.arange(len(g.ids)) if label is None else label
    while True:
        new = moved(level, label, gamma, seed, depth, 0)
        part = parts(level, new)
        result = level.ids[part[place]]
        if (new == label).all():
            return result
        fine = moved(level.inside(part), np.arange(len(level.ids)), gamma, seed, depth, 1)
        fine = parts(level, fine)
        small, at = level.contract(fine)
        if len(small.ids) == len(level.ids):
            return result
        label = np.zeros(len(small.ids), "int64")
        label[at] = np.searchsorted(small.ids, level.ids[part])
        level, place, depth = small, at[place], depth + 1


def _strongest(src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per source its heaviest neighbour, of equals the greatest."""
    order = np.lexsort((-dst, -w, src))
    first = order[np.unique(src[order], return_index=True)[1]]
    return src[first], dst[first]


def folded(g: Graph, member: np.ndarray, least: int = LEAST_SIZE) -> np.ndarray:
    """Clusters under ``least`` nodes joined to the neighbour that pulls most; isolated ones stay.

    All small clusters of a round join at once, and what hangs together
    becomes one cluster; a cluster's name is the id of its least node.
    """
    for _ in range(FOLDS):
        c, place = g.contract(np.searchsorted(g.ids, member))
        few = np.bincount(place, minlength=len(c.ids)) < least
        a, b = _strongest(*(x[few[c.src]] for x in (c.src, c.dst, c.w)))
        if not len(a):
            break
        tied = Graph(c.ids, np.concatenate([a, b]), np.concatenate([b, a]), np.ones(2 * len(a), "int64"), c.k)
        member = c.ids[parts(tied, np.zeros(len(c.ids), "int64"))[place]]
    return member


def capped(names: np.ndarray, size: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray, most: int) -> np.ndarray:
    """New names of clusters when the smallest is joined to its strongest neighbour until ``most`` are left.

    Works on the graph of the clusters, ``names`` in ascending order.  Clusters without a neighbour stay,
    so no link is invented, even if more than ``most`` remain.
    """
    near: dict[int, dict[int, int]] = {i: {} for i in range(len(names))}
    for a, b, x in zip(src.tolist(), dst.tolist(), w.tolist()):
        near[a][b] = x
    size, left = size.tolist(), len(names)
    to = list(range(len(names)))
    heap = [(n, i) for i, n in enumerate(size) if near[i]]
    heapq.heapify(heap)
    while left > most and heap:
        n, small = heapq.heappop(heap)
        if small not in near or n != size[small] or not near[small]:
            continue  # joined, grown or cut off since
        best = max(near[small], key=lambda j: (near[small][j], j))
        for j, x in near.pop(small).items():
            del near[j][small]
            if j != best:
                near[j][best] = near[best][j] = near[best].get(j, 0) + x
        to[small] = best
        size[best] += n
        heapq.heappush(heap, (size[best], best))
        left -= 1
    for i in range(len(to)):
        while to[to[i]] != to[i]:
            to[i] = to[to[i]]
    least = pd.Series(names).groupby(np.array(to, "int64")).min()
    return least.loc[to].to_numpy()


def targeting(g: Graph, most: int = MAX_DOMAINS, seed: int = SEED, ladder: Sequence[float] = LADDER) -> np.ndarray:
    """The partition of the ladder that fits the cap with the smallest largest cluster; else one joined to the cap."""
    tried = [folded(g, partition(g, gamma, seed)) for gamma in ladder]
    sizes = [np.unique(p, return_counts=True)[1] for p in tried]
    fit = [i for i, s in enumerate(sizes) if 1 < len(s) <= most]
    good = [i for i in fit if sizes[i].max() <= SHARE_MOST * len(g.ids)] or fit
    if good:
        return tried[min(good, key=lambda i: (sizes[i].max(), i))]
    p = tried[min(range(len(tried)), key=lambda i: (len(sizes[i]), i))]
    c, place = g.contract(np.searchsorted(g.ids, p))
    return capped(c.ids, np.bincount(place, minlength=len(c.ids)), c.src, c.dst, c.w, most)[place]


def stability(g: Graph, member: np.ndarray, most: int = MAX_DOMAINS, seed: int = SEED, ladder: Sequence[float] = LADDER, runs: int = STABILITY_RUNS) -> np.ndarray:
    """Share of the reruns with other seeds in which a node is in the cluster that shares most with its own."""
    stay = np.zeros(len(g.ids))
    if not len(g.src) or not runs:
        return stay
    for k in range(1, runs + 1):
        pairs = pd.DataFrame({"a": member, "b": targeting(g, most, seed ^ k, ladder)})
        n = pairs.value_counts().rename("n").reset_index().sort_values(["a", "n", "b"], ascending=[True, False, True]).drop_duplicates("a")
        stay += pairs.b.to_numpy() == n.set_index("a").b.loc[pairs.a].to_numpy()
    return stay / runs


def kernel(nodes: DataFrame, fused: DataFrame, most: int = MAX_DOMAINS, seed: int = SEED, ladder: Sequence[float] = LADDER, runs: int = STABILITY_RUNS) -> DataFrame:
    """``repo, id, cluster, stability`` with clusters named by their least id, one task per repository."""

    def run(key, ns: pd.DataFrame, es: pd.DataFrame) -> pd.DataFrame:
        g = Graph.of(ns.id, es.lo, es.hi, es.w)
        member = targeting(g, most, seed, ladder)
        return pd.DataFrame({"repo": key[0], "id": g.ids, "cluster": member, "stability": stability(g, member, most, seed, ladder, runs)})

    return nodes.select("repo", "id").groupBy("repo").cogroup(fused.select(F.col("repo").alias("r"), "lo", "hi", "w").groupBy("r")).applyInPandas(run, "repo string, id long, cluster long, stability double")


# -- tables: repositories of any size ------------------------------------------------
#
# ``run`` numbers the pairs of resolution and seed, which are all worked on at
# once.  Nodes have ``run, repo, gamma, seed, m2, id, k, c``, edges ``run, repo,
# src, dst, w`` in both directions.


def _moves(nodes: DataFrame, edges: DataFrame, level: int, phase: int) -> DataFrame:
    # salt and round are columns: with literals each round would have code of its own to compile and to keep
    nodes = nodes.withColumns({"salt": F.pmod(F.col("seed") * 7919 + _salt(0, level, phase, 0), F.lit(_P)), "round": F.lit(0)})
    for _ in range(ROUNDS):
        tot = nodes.groupBy("run", "c").agg(F.sum("k").alias("tot"))
        link = edges.join(nodes.select("run", F.col("id").alias("dst"), F.col("c").alias("to")), ["run", "dst"]).groupBy("run", F.col("src").alias("id"), "to").agg(F.sum("w").alias("link"))
        link = link.join(tot.select("run", F.col("c").alias("to"), F.col("tot").alias("there")), ["run", "to"])
        mine = nodes.join(tot, ["run", "c"])
        j = link.join(mine.select("run", "id", "gamma", "k", "m2", "c"), ["run", "id"])
        gain = F.when(F.col("to") != F.col("c"), F.struct((F.col("link") - F.col("gamma") * F.col("k") * F.col("there") / F.col("m2")).alias("gain"), (-F.col("to")).alias("to")))
        best = j.groupBy("run", "id").agg(F.max(gain).alias("best"), F.max(F.when(F.col("to") == F.col("c"), F.col("link"))).alias("own"))
        stays = F.coalesce("own", F.lit(0)) - F.col("gamma") * F.col("k") * (F.col("tot") - F.col("k")) / F.col("m2")
        wants = F.coalesce(F.col("best.gain") > stays + LEAST_GAIN, F.lit(False))
        share = F.when(F.col("round") < CALM, F.lit(2)).otherwise(F.expr(f"2 + (round - {CALM}) div 4"))
        goes = F.col("wants") & (F.pmod(F.expr("lot div 512"), share) == 0)
        new = mine.join(best, ["run", "id"], "left").withColumns({"wants": wants, "lot": _lot(F.col("id"), F.col("salt"))})
        after = F.pmod(F.col("salt") + 69_621, F.lit(_P)).alias("salt"), (F.col("round") + 1).alias("round")
        nodes = cut(new.select("run", "repo", "gamma", "seed", "m2", "id", "k", F.when(goes, -F.col("best.to")).otherwise(F.col("c")).alias("c"), *after, "wants"))
        if nodes.where("wants").isEmpty():
            break
        nodes = nodes.drop("wants")
    return nodes.drop("wants", "salt", "round")


def _parts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``run, id, part``: connected parts of the labels ``c``, named by their least node."""
    c = nodes.select("run", "id", "c")
    e = edges.join(c.select("run", F.col("id").alias("src"), F.col("c").alias("a")), ["run", "src"]).join(c.select("run", F.col("id").alias("dst"), F.col("c").alias("b")), ["run", "dst"])
    e = cut(e.where("a = b").select("run", "src", "dst"))
    part = c.select("run", "id", F.col("id").alias("part"), F.lit(True).alias("fresh"))
    while True:
        near = e.join(part.select("run", F.col("id").alias("dst"), "part"), ["run", "dst"]).groupBy("run", F.col("src").alias("id")).agg(F.min("part").alias("near"))
        low = part.join(near, ["run", "id"], "left").select("run", "id", "part", F.least("part", F.coalesce("near", "part")).alias("low"))
        jump = low.select("run", F.col("id").alias("low"), F.col("low").alias("to"))
        part = cut(low.join(jump, ["run", "low"]).select("run", "id", F.col("to").alias("part"), (F.col("to") != F.col("part")).alias("fresh")))
        if part.where("fresh").isEmpty():
            return part.drop("fresh")


def _contract(edges: DataFrame, part: DataFrame) -> DataFrame:
    a, b = part.select("run", F.col("id").alias("src"), F.col("part").alias("a")), part.select("run", F.col("id").alias("dst"), F.col("part").alias("b"))
    return edges.join(a, ["run", "src"]).join(b, ["run", "dst"]).where("a <> b").groupBy("run", "repo", F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w"))


def _inside(edges: DataFrame, part: DataFrame) -> DataFrame:
    a, b = part.select("run", F.col("id").alias("src"), F.col("part").alias("a")), part.select("run", F.col("id").alias("dst"), F.col("part").alias("b"))
    return edges.join(a, ["run", "src"]).join(b, ["run", "dst"]).where("a = b").select("run", "repo", "src", "dst", "w")


def _finished(nodes: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """``run, repo, at, c``: what ``partition`` makes of the graphs of a level, each in one task."""

    def run(key, ns: pd.DataFrame, es: pd.DataFrame) -> pd.DataFrame:
        ns, es = ns.sort_values("id"), es.sort_values(["src", "dst"])
        ids = ns.id.to_numpy()
        at = lambda v: np.searchsorted(ids, v.to_numpy())
        g = Graph(ids, at(es.src), at(es.dst), es.w.to_numpy(), ns.k.to_numpy())
        c = partition(g, ns.gamma.iloc[0], int(ns.seed.iloc[0]), at(ns.c), depth)
        return pd.DataFrame({"run": key[0], "repo": key[1], "at": ids, "c": c})

    es = edges.select(F.col("run").alias("r"), F.col("repo").alias("p"), "src", "dst", "w")
    return nodes.groupBy("run", "repo").cogroup(es.groupBy("r", "p")).applyInPandas(run, "run int, repo string, at long, c long")


def partitions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``run, repo, id, c`` of every run: ``partition`` on tables.

    A graph, contracted or not, that has come down to ``KERNEL_EDGES`` nodes
    and edges is finished in one task; what is larger goes on by joins.
    """
    place = cut(nodes.select("run", "repo", "id", F.col("id").alias("at")))  # the node of the level that each file is in
    done, depth = [], 0
    while True:
        size = nodes.groupBy("run", "repo").agg(F.count("*").alias("n")).join(edges.groupBy("run", "repo").agg(F.count("*").alias("m")), ["run", "repo"], "left")
        size = cut(size.select("run", "repo", ((F.col("n") <= KERNEL_EDGES) & (F.coalesce("m", F.lit(0)) <= 2 * KERNEL_EDGES)).alias("small")))
        kinds = {r.small for r in size.select("small").distinct().collect()}
        if True in kinds:
            small, large = size.where("small").select("run", "repo"), size.where("NOT small").select("run", "repo")
            of = lambda df, what: df.join(what, ["run", "repo"], "left_semi") if False in kinds else df
            ends = _finished(of(nodes, small), of(edges, small), depth)
            done.append(cut(place.join(ends, ["run", "repo", "at"]).select("run", "repo", "id", "c")))
            if False not in kinds:
                break
            nodes, edges, place = (cut(of(df, large)) for df in (nodes, edges, place))
        old = nodes.select("run", "id", F.col("c").alias("old"))
        new = _moves(nodes, edges, depth, 0)
        part = _parts(new, edges)
        result = cut(place.join(part.select("run", F.col("id").alias("at"), F.col("part").alias("c")), ["run", "at"]).select("run", "repo", "id", "c"))
        alone = part.select("run", F.col("id"), F.col("id").alias("c"))
        fine = _moves(nodes.drop("c").join(alone, ["run", "id"]).select(*nodes.columns), _inside(edges, part), depth, 1)
        fine = _parts(fine, edges)
        # a repository of a run goes on where nodes moved and some became one
        went = new.join(old, ["run", "id"]).where("c <> old").select("run", "repo").distinct()
        grew = fine.where("id <> part").join(new.select("run", "id", "repo"), ["run", "id"]).select("run", "repo").distinct()
        on = cut(went.join(grew, ["run", "repo"]))
        done.append(result.join(on, ["run", "repo"], "left_anti"))
        if on.isEmpty():
            break
        start = fine.join(part.withColumnRenamed("part", "c"), ["run", "id"]).where("id = part").select("run", "part", "c")
        nodes = new.drop("c").join(fine, ["run", "id"]).join(on, ["run", "repo"], "left_semi").groupBy("run", "repo", "gamma", "seed", "m2", "part").agg(F.sum("k").alias("k")).join(start, ["run", "part"])
        nodes = cut(nodes.select("run", "repo", "gamma", "seed", "m2", F.col("part").alias("id"), "k", "c"))
        edges = cut(_contract(edges, fine).join(nodes.select("run", F.col("id").alias("src")), ["run", "src"], "left_semi"))
        place = cut(place.join(fine.withColumnRenamed("id", "at"), ["run", "at"]).join(on, ["run", "repo"], "left_semi").select("run", "repo", "id", F.col("part").alias("at")))
        depth += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return cut(out)


def _folds(state: DataFrame, edges: DataFrame, least: int) -> DataFrame:
    """``folded`` on tables; every round works on the graph of the clusters."""
    pulls = first = cut(_contract(edges, state.select("run", "id", F.col("c").alias("part"))))
    names = cut(state.groupBy("run", "c").agg(F.count("*").alias("n")).select("run", "c", F.col("c").alias("now"), "n"))
    for _ in range(FOLDS):
        few = names.groupBy("run", "now").agg(F.sum("n").alias("n")).where(F.col("n") < least).select("run", F.col("now").alias("src"))
        best = cut(pulls.join(few, ["run", "src"], "left_semi").groupBy("run", "src").agg(F.max_by("dst", F.struct("w", "dst")).alias("dst")))
        if best.isEmpty():
            break
        tied = best.unionByName(best.select("run", F.col("dst").alias("src"), F.col("src").alias("dst")))
        ends = tied.select("run", F.col("src").alias("id")).distinct().withColumn("c", F.lit(0).cast("long"))
        to = _parts(ends, tied).withColumnRenamed("id", "now")
        names = cut(names.join(to, ["run", "now"], "left").select("run", "c", F.coalesce("part", "now").alias("now"), "n"))
        pulls = cut(_contract(first, names.select("run", F.col("c").alias("id"), F.col("now").alias("part"))))
    return cut(state.join(names.select("run", "c", "now"), ["run", "c"]).select("run", "repo", "id", F.col("now").alias("c")))


def _chosen(state: DataFrame, edges: DataFrame, most: int, rungs: int) -> DataFrame:
    """``try, repo, id, c``: ``targeting``'s choice among the runs of each try, ``rungs`` runs each."""
    size = cut(state.groupBy("run", "repo", "c").agg(F.count("*").alias("n")))
    s = size.groupBy("run", "repo").agg(F.count("*").alias("k"), F.max("n").alias("top"), F.sum("n").alias("all")).withColumn("try", F.expr(f"run div {rungs}"))
    fit = F.col("k").between(2, most)
    rank = F.when(fit & (F.col("top") <= SHARE_MOST * F.col("all")), F.struct(F.lit(0).alias("o"), F.col("top").alias("v"), "run")).when(fit, F.struct(F.lit(1).alias("o"), F.col("top").alias("v"), "run")).otherwise(F.struct(F.lit(2).alias("o"), F.col("k").alias("v"), "run"))
    best = cut(s.groupBy("try", "repo").agg(F.min(rank).alias("b")).select("try", "repo", F.col("b.run").alias("run"), (F.col("b.o") == 2).alias("over")))
    state = state.join(best, ["run", "repo"])
    over = best.where("over")
    if over.isEmpty():
        return cut(state.select("try", "repo", "id", "c"))
    pull = _contract(edges, state.where("over").select("run", "id", F.col("c").alias("part")))

    def cap(key, cs: pd.DataFrame, es: pd.DataFrame) -> pd.DataFrame:
        cs = cs.sort_values("c")
        names = cs.c.to_numpy()
        at = lambda v: np.searchsorted(names, v.to_numpy())
        return pd.DataFrame({"run": key[0], "repo": key[1], "c": names, "to": capped(names, cs.n.to_numpy(), at(es.src), at(es.dst), es.w.to_numpy(), most)})

    cs = size.join(over.select("run", "repo"), ["run", "repo"], "left_semi")
    es = pull.select(F.col("run").alias("r"), F.col("repo").alias("p"), "src", "dst", "w")
    # the graph of one repository's clusters meets in a task, not that of its files
    to = cs.groupBy("run", "repo").cogroup(es.groupBy("r", "p")).applyInPandas(cap, "run int, repo string, c long, to long")
    return cut(state.join(to, ["run", "repo", "c"], "left").select("try", "repo", "id", F.coalesce("to", "c").alias("c")))


def _tables(nodes: DataFrame, fused: DataFrame, ladder: Sequence[float], seeds: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all runs: resolutions within seeds."""
    n = nodes.select("repo", "id").distinct()
    e = fused.where("lo <> hi").select("repo", "lo", "hi", F.floor(F.col("w") * SCALE + 0.5).cast("long").alias("w")).where("w > 0")
    e = e.join(n.select("repo", F.col("id").alias("lo")), ["repo", "lo"], "left_semi").join(n.select("repo", F.col("id").alias("hi")), ["repo", "hi"], "left_semi")
    e = cut(e.select("repo", F.col("lo").alias("src"), F.col("hi").alias("dst"), "w").unionByName(e.select("repo", F.col("hi").alias("src"), F.col("lo").alias("dst"), "w")).groupBy("repo", "src", "dst").agg(F.sum("w").alias("w")))
    k, m2 = e.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")), e.groupBy("repo").agg(F.sum("w").cast("double").alias("m2"))
    runs = F.explode(F.array(*[F.struct(F.lit(i * len(ladder) + j).alias("run"), F.lit(float(g)).alias("gamma"), F.lit(s).cast("long").alias("seed")) for i, s in enumerate(seeds) for j, g in enumerate(ladder)]))
    n = n.join(k, "id", "left").join(m2, "repo", "left").select(runs.alias("r"), "repo", F.coalesce("m2", F.lit(1.0)).alias("m2"), "id", F.coalesce("k", F.lit(0)).alias("k"))
    runs_e = F.explode(F.sequence(F.lit(0), F.lit(len(seeds) * len(ladder) - 1)))
    return cut(n.select("r.run", "repo", "r.gamma", "r.seed", "m2", "id", "k", F.col("id").alias("c"))), e.select(runs_e.alias("run"), "repo", "src", "dst", "w")


def distributed(nodes: DataFrame, fused: DataFrame, most: int = MAX_DOMAINS, seed: int = SEED, ladder: Sequence[float] = LADDER, runs: int = STABILITY_RUNS) -> DataFrame:
    """The result of ``kernel`` for repositories of any size, by joins and aggregations until a level fits in a task.

    In one task are only levels of up to ``KERNEL_EDGES`` nodes and edges, and,
    where no resolution fits the cap, the graph of a repository's clusters.
    """
    state, edges = _tables(nodes, fused, ladder, [seed ^ k for k in range(runs + 1)])
    state = _folds(partitions(state, edges), edges, LEAST_SIZE)
    got = _chosen(state, edges, most, len(ladder))
    own = got.where("try = 0").select("repo", "id", F.col("c").alias("cluster"))
    both = own.join(got.where("try > 0").select("try", "repo", "id", F.col("c").alias("b")), ["repo", "id"])
    n = both.groupBy("try", "repo", "cluster", "b").agg(F.count("*").alias("n"))
    match = n.groupBy("try", "repo", "cluster").agg(F.max(F.struct("n", (-F.col("b")).alias("b"))).alias("m")).select("try", "repo", "cluster", (-F.col("m.b")).alias("b"))
    linked = edges.where("run = 0").select(F.col("src").alias("id")).distinct().join(own, "id").select("repo").distinct().withColumn("linked", F.lit(True))
    stay = both.join(match, ["try", "repo", "cluster", "b"]).groupBy("repo", "id").agg((F.count("*") / max(1, runs)).alias("stay")).join(linked, "repo")
    return own.join(stay, ["repo", "id"], "left").select("repo", "id", "cluster", F.coalesce("stay", F.lit(0.0)).alias("stability"))


# -- either way ---------------------------------------------------------------------


def clusters(nodes: DataFrame, fused: DataFrame, most: int = MAX_DOMAINS, seed: int = SEED, ladder: Sequence[float] = LADDER, runs: int = STABILITY_RUNS) -> DataFrame:
    """``repo, id, cluster, stability``: clusters of every repository, numbered by their first path.

    Repositories of up to ``KERNEL_EDGES`` files and fused edges are done in
    one task each, larger ones by joins; the result does not depend on it.
    Repositories without a fused edge are clustered by directory with
    stability 0.
    """
    size = nodes.groupBy("repo").agg(F.count("*").alias("n")).join(fused.groupBy("repo").agg(F.count("*").alias("m")), "repo", "left")
    size = cut(size.select("repo", F.col("m").isNotNull().alias("linked"), ((F.coalesce("m", F.lit(0)) <= KERNEL_EDGES) & (F.col("n") <= KERNEL_EDGES)).alias("small")))
    of = lambda df, what: df.join(size.where(what), "repo", "left_semi")
    out = kernel(of(nodes, "linked AND small"), of(fused, "small"), most, seed, ladder, runs)
    if not size.where("linked AND NOT small").isEmpty():
        out = out.unionByName(distributed(of(nodes, "linked AND NOT small"), of(fused, "NOT small"), most, seed, ladder, runs))
    out = cut(out)
    first = out.join(nodes.select("id", "rel"), "id").groupBy("repo", "cluster").agg(F.min("rel").alias("name"))
    top = F.when(F.col("rel").contains("/"), F.regexp_replace("rel", "/[^/]*$", "")).otherwise("")
    loose = of(nodes, "NOT linked").select("repo", "id", top.alias("name"))
    number = F.row_number().over(Window.partitionBy("repo").orderBy("name")) - 1
    named = out.join(first.select("repo", "cluster", number.cast("long").alias("place")), ["repo", "cluster"]).select("repo", "id", F.col("place").alias("cluster"), "stability")
    dirs = loose.select("repo", "name").distinct().select("repo", "name", number.cast("long").alias("cluster"))
    return named.unionByName(loose.join(dirs, ["repo", "name"]).select("repo", "id", "cluster", F.lit(0.0).alias("stability")))
