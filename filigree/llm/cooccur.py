"""Items that appear together more often than chance.

Exact pair counts per group (repository), judged against a fitted bipartite
configuration model: item i is in basket b with probability
``x_i * y_b / (1 + x_i * y_b)``, where x and y are fitted so that every item
keeps its expected frequency and every basket its expected size.  The number of
joint baskets of a pair is then Poisson-binomial.

Items and baskets are numbered once, in written tables, so that the pair
shuffle carries four integers and not two names; names come back last, for the
rows that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.operators.skew import running_sum
from filigree.session import staged

#: Sweeps of the fit; it stops as soon as no margin is off by more than FIT_ERROR of itself or a quarter of a count.
FIT_SWEEPS = 5000
FIT_ERROR = 1e-6
#: Cells (pairs x frequencies x basket sizes) of one array of the inversion: 16 bytes each.
CELLS = 1 << 20
#: Rows whose tails are taken at a time.
TAIL_ROWS = 2048


def baskets(commits: DataFrame, least: int = 1, most: int = 50) -> DataFrame:
    """One row ``grp, basket, items`` per commit, items distinct, sorted and without trailing white space.

    Rows of the same commit are united; null and blank entries are no items;
    commits with fewer than ``least`` or more than ``most`` items are left out.
    Copies of a row collapse before the shuffle, whatever their order.
    """
    clean = F.filter(F.transform("files", lambda x: F.rtrim(x, F.lit(" \t\n\x0b\f\r"))), lambda x: x.isNotNull() & (x != ""))
    rows = commits.where(F.col("files").isNotNull()).select(F.col("repo").alias("grp"), F.col("commit_id").alias("basket"), F.array_sort(F.array_distinct(clean)).alias("items"))
    one = rows.groupBy("grp", "basket").agg(F.collect_set("items").alias("sets"))
    items = F.when(F.size("sets") == 1, F.col("sets")[0]).otherwise(F.array_sort(F.array_distinct(F.flatten("sets"))))
    return one.select("grp", "basket", items.alias("items")).where(F.size("items").between(least, most))


def numbered(b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written tables of ``baskets`` and of their items: ``bid, grp, items`` and ``iid, grp, item, n``.

    The numbers are part of the written rows, so a recomputed task reads the
    same ones; ``n`` is the number of baskets that hold the item.
    """
    b = staged(b.select(F.monotonically_increasing_id().alias("bid"), "grp", "items"), "baskets")
    n = b.select("grp", F.explode("items").alias("item")).groupBy("grp", "item").agg(F.count("*").alias("n"))
    return b, staged(n.select(F.monotonically_increasing_id().alias("iid"), "grp", "item", "n"), "items")


def _pairs(items: Column) -> Column:
    after = lambda i: F.slice(items, i + 2, F.size(items))
    return F.flatten(F.transform(items, lambda x, i: F.transform(after(i), lambda y: F.struct(x.iid.alias("ia"), x.n.alias("na"), y.iid.alias("ib"), y.n.alias("nb")))))


def pair_counts(b: DataFrame, items: DataFrame, support: int) -> DataFrame:
    """Exact joint counts ``grp, ia, ib, na, nb, nab`` of the pairs in at least ``support`` baskets.

    ``ia`` and ``ib`` number the items, the first before the second by code
    points.  Items in fewer baskets than ``support`` cannot be in such a pair
    and are taken out first, which loses no pair.  A basket has at most 50
    items (see ``baskets``), so it yields at most 1,225 pairs; equal pairs are
    added up before the shuffle.  Null groups have no pairs.
    """
    keep = items.where(F.col("n") >= support).select("grp", "item", "iid", "n")
    inside = b.select("bid", "grp", F.posexplode("items").alias("pos", "item")).join(keep, ["grp", "item"])
    rows = inside.groupBy("bid", "grp").agg(F.array_sort(F.collect_list(F.struct("pos", "iid", "n"))).alias("items")).where(F.size("items") > 1)
    pairs = rows.select("grp", F.explode(_pairs(F.col("items"))).alias("p"))
    return pairs.groupBy("grp", "p.ia", "p.ib", "p.na", "p.nb").agg(F.count("*").alias("nab")).where(F.col("nab") >= support)


def named(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """``pairs`` with the names ``a`` and ``b`` in place of the numbers."""
    a, b = items.select(F.col("iid").alias("ia"), F.col("item").alias("a")), items.select(F.col("iid").alias("ib"), F.col("item").alias("b"))
    return pairs.join(a, "ia").join(b, "ib").drop("ia", "ib")


def fit_margins(item_n: np.ndarray, item_c: np.ndarray, size: np.ndarray, size_c: np.ndarray, sweeps: int = FIT_SWEEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Fit x per item frequency and y per basket size by fixed-point sweeps on the two histograms.

    Returns x, y, the fitted frequency of each item class, and whether all
    margins of both sides are met.
    """
    total = float((item_n * item_c).sum())
    x, y = item_n / np.sqrt(total), size / np.sqrt(total)
    full = item_n >= float(size_c.sum())  # in every basket: probability 1 has no finite x
    close = lambda got, due: bool(np.all(np.abs(got - due) <= np.minimum(FIT_ERROR * due + 1e-9, 0.25)))
    met, fitted = False, item_n
    for _ in range(sweeps):
        x = item_n / np.maximum((size_c * y / (1 + np.outer(x, y))).sum(1), 1e-300)
        x = np.where(full, 1e12, np.minimum(x, 1e12))
        y = np.minimum(size / np.maximum((item_c[:, None] * x[:, None] / (1 + np.outer(x, y))).sum(0), 1e-300), 1e12)
        p = np.outer(x, y)
        p /= 1 + p
        fitted = (p * size_c).sum(1)
        met = close(fitted, item_n) and close((p * item_c[:, None]).sum(0), size)
        if met:
            break
    return x, y, fitted, met


def null_model(b: DataFrame, items: DataFrame) -> DataFrame:
    """The fitted null of each group: ``grp, side, n, c, v, fitted, met``.

    ``side`` 0: items of frequency n, of which there are c, have x = v and
    under the null the frequency ``fitted``; side 1: c baskets of size n have
    y = v.  ``met`` is false for a group whose fit did not converge.  Only the
    histograms of frequencies and of sizes (at most 50 values) reach one task:
    a group with M incidences has at most sqrt(2 M) different frequencies.
    """
    hi = items.groupBy("grp", "n").agg(F.count("*").alias("c")).select("grp", F.lit(0).alias("side"), "n", "c")
    hb = b.groupBy("grp", F.size("items").cast("long").alias("n")).agg(F.count("*").alias("c")).select("grp", F.lit(1).alias("side"), "n", "c")

    def fit(t: pa.Table) -> pa.Table:
        side, n, c = (t[k].to_numpy() for k in ("side", "n", "c"))
        i, z = (np.flatnonzero(side == k) for k in (0, 1))
        x, y, fitted, met = fit_margins(*(v.astype(float) for v in (n[i], c[i], n[z], c[z])))
        t = t.take(pa.array(np.concatenate([i, z])))
        new = (np.concatenate([x, y]), np.concatenate([fitted, n[z]]), np.full(len(t), met))
        return pa.Table.from_arrays([*t.select(["grp", "side", "n", "c"]).columns, *map(pa.array, new)], names=["grp", "side", "n", "c", "v", "fitted", "met"])

    # a stated number of tasks: the histograms are few bytes but each group costs a fit
    both = hi.unionByName(hb).repartition(_tasks(b), "grp")
    return both.groupBy("grp").applyInArrow(fit, "grp string, side int, n long, c long, v double, fitted double, met boolean")


def _tasks(df: DataFrame) -> int:
    return 2 * df.sparkSession.sparkContext.defaultParallelism


def _tilts(odds: np.ndarray, m: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Per row the shift of all log odds that moves the mean of the sum to within a half of k."""
    shifted = lambda t, o: 1 / (1 + np.exp(-np.clip(o + t[:, None], -700, 700)))
    low, high, t = np.zeros(len(k)), np.ones(len(k)), np.zeros(len(k))
    while len(i := np.flatnonzero((shifted(high, odds) * m).sum(1) < k - 0.25)):
        low[i], high[i] = high[i], 2 * high[i]
    todo = np.arange(len(k))
    for _ in range(200):
        p = shifted(t[todo], odds[todo])
        off = (p * m[todo]).sum(1) - k[todo]
        far = np.abs(off) > 0.25
        if not far.any():
            break
        p, off, todo = p[far], off[far], todo[far]
        high[todo] = np.where(off > 0, t[todo], high[todo])
        low[todo] = np.where(off > 0, low[todo], t[todo])
        step = t[todo] - off / np.maximum((p * (1 - p) * m[todo]).sum(1), 1e-300)
        t[todo] = np.where((low[todo] < step) & (step < high[todo]), step, (low[todo] + high[todo]) / 2)
    return t


def poisson_binomial_tails(q: np.ndarray, m: np.ndarray, k: np.ndarray) -> np.ndarray:
    """P(X >= k) per row, for X a sum of Binomial(m_j, q_j), by Fourier inversion around k.

    ``q`` is rows x classes, ``m`` the number of trials per class, for all rows
    or for each.  Above the
    mean all log odds are first shifted by the same t, which puts the mean at k
    and multiplies P(X = x) by exp(t x) / M(t); so small tails keep their
    digits.  The window of the inversion follows from Bernstein's bound: less
    than 1e-30 of the shifted mass lies outside, on either side.
    """
    k = np.asarray(k, float) - ((q >= 1) * m).sum(1)
    use = (q > 0) & (q < 1)
    w = np.where(use, m, 0.0)
    q = np.where(use, q, 0.5)
    most = w.sum(1)
    out = np.where(k <= 0, 1.0, 0.0)
    at_most = (k > 0) & (k == most)
    out[at_most] = np.exp((w[at_most] * np.log(q[at_most])).sum(1))
    rows = np.flatnonzero((k > 0) & (k < most))
    if not len(rows):
        return out
    q, w, k = q[rows], w[rows], k[rows]
    above = k > (q * w).sum(1)
    t = np.zeros(len(rows))
    odds = np.log(q) - np.log1p(-q)
    t[above] = _tilts(odds[above], w[above], k[above])
    p = np.where(t[:, None] > 0, 1 / (1 + np.exp(-np.clip(odds + t[:, None], -700, 700))), q)
    mean, var = (p * w).sum(1), (p * (1 - p) * w).sum(1)
    bound = np.log(2e30)
    half = (bound / 3 + np.sqrt(bound * bound / 9 + 2 * bound * var)).astype("int64") + 2
    centre = np.rint(mean).astype("int64")
    sizes = np.left_shift(np.int64(1), np.ceil(np.log2(2 * half + 1)).astype("int64"))
    got = np.ones(len(rows))
    near = k > centre - half
    scale = (w * np.log1p(q * np.expm1(t)[:, None])).sum(1) - t * k
    for size in np.unique(sizes[near]):
        same = np.flatnonzero(near & (sizes == size))
        freq = 2 * np.pi * np.arange(size // 2 + 1) / size
        step = max(1, CELLS // (len(freq) * q.shape[1]))
        for i in np.array_split(same, -(-len(same) // step)):
            mass = _masses(p[i], w[i], mean[i], centre[i], freq, int(size))
            x = np.arange(size) - size // 2 + centre[i, None]
            inside = (x >= k[i, None]) & (x < (centre + half)[i, None])
            gap = np.where(inside, x - k[i, None], 0.0)
            got[i] = np.minimum(1.0, np.exp(scale[i]) * np.where(inside, mass * np.exp(-t[i, None] * gap), 0.0).sum(1))
    out[rows] = got
    return out


def _masses(p: np.ndarray, m: np.ndarray, mean: np.ndarray, centre: np.ndarray, freq: np.ndarray, size: int) -> np.ndarray:
    """P(X = centre - size/2 + j) per row, from the characteristic function at ``freq``, some frequencies at a time."""
    spectrum = []
    p, m = p[:, None, :], m[:, None, :]
    for f in np.array_split(freq, max(1, p.size * len(freq) // CELLS)):
        s, c, v = np.sin(f)[None, :, None], np.cos(f)[None, :, None], f[None, :, None]
        level = 0.5 * np.log(np.maximum(1 - 4 * p * (1 - p) * np.sin(v / 2) ** 2, 1e-300))
        # the angle less p w, so that large sums of it keep their digits
        angle = np.arctan2(p * s, 1 - p + p * c) - p * v
        spectrum.append(np.exp((level * m).sum(2) - 1j * ((angle * m).sum(2) + (mean - centre)[:, None] * f)))
    return np.maximum(np.fft.fftshift(np.fft.irfft(np.concatenate(spectrum, axis=1), size, axis=1), axes=1), 0.0)


def surprise(pairs: DataFrame, b: DataFrame, items: DataFrame) -> DataFrame:
    """``pairs`` with their null: adds ``n, expected, p_value, ma, mb, met``.

    ``n`` is the number of baskets of the group under the null, ``ma`` and
    ``mb`` the items' frequencies under the null, to the nearest integer;
    where a fit is not ``met``, they are the counted ones.  The null depends on
    (group, na, nb, nab) only, so it is computed once per such combination, of
    which there are far fewer than pairs.
    """
    null = staged(null_model(b, items), "null")
    side = null.where("side = 0").select("grp", "n", F.struct(F.col("v").alias("x"), F.when(F.col("met"), F.round("fitted").cast("long")).otherwise(F.col("n")).alias("m")).alias("s"))
    ys = null.where("side = 1").groupBy("grp").agg(F.collect_list(F.struct("c", "v")).alias("ys"), F.min("met").alias("met")).select("grp", F.col("ys.c").alias("m"), F.col("ys.v").alias("y"), "met")
    combos = pairs.select("grp", "na", "nb", "nab").distinct()
    job = combos.join(side.select("grp", F.col("n").alias("na"), F.col("s").alias("a")), ["grp", "na"]).join(side.select("grp", F.col("n").alias("nb"), F.col("s").alias("b")), ["grp", "nb"]).join(ys, "grp")
    job = job.select("grp", "na", "nb", "nab", F.col("a.x").alias("xa"), F.col("b.x").alias("xb"), F.col("a.m").alias("ma"), F.col("b.m").alias("mb"), "met", "m", "y")

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            width = np.diff(np.asarray(t["m"].offsets, "int64"))
            e, p, n = np.zeros(t.num_rows), np.zeros(t.num_rows), np.zeros(t.num_rows)
            order = np.argsort(width, kind="stable")
            # rows of about as many classes at a time, padded by classes without trials
            for i in np.array_split(order, -(-t.num_rows // TAIL_ROWS)) if t.num_rows else ():
                part = t.take(pa.array(i))
                inside = np.arange(width[i].max()) < width[i][:, None]
                m, y = np.zeros(inside.shape), np.zeros(inside.shape)
                m[inside], y[inside] = part["m"].flatten().to_numpy(), part["y"].flatten().to_numpy()
                qa, qb = part["xa"].to_numpy()[:, None] * y, part["xb"].to_numpy()[:, None] * y
                q = qa / (1 + qa) * (qb / (1 + qb))
                e[i], n[i], p[i] = (q * m).sum(1), m.sum(1), poisson_binomial_tails(q, m, part["nab"].to_numpy())
            kept = ["grp", "na", "nb", "nab", "ma", "mb", "met"]
            yield pa.RecordBatch.from_arrays([*(t[k] for k in kept), pa.array(np.rint(n).astype("int64")), pa.array(e), pa.array(p)], names=[*kept, "n", "expected", "p_value"])

    job = job.repartition(_tasks(b), "grp", "na", "nb", "nab")
    scored = job.mapInArrow(tails, "grp string, na long, nb long, nab long, ma long, mb long, met boolean, n long, expected double, p_value double")
    return pairs.join(scored, ["grp", "na", "nb", "nab"])


def false_discovery(scored: DataFrame, items: DataFrame, alpha: float) -> DataFrame:
    """Add ``significant`` by the Benjamini-Hochberg rule within each group.

    All pairs of the group's items count as tests; those never seen together
    have p-value 1.  A support above 1 takes pairs out of the ranks that may
    have small p-values, so ``scored`` should hold every pair that was seen.
    Equal p-values are counted first, and the running count runs over distinct
    values.
    """
    tests = items.groupBy("grp").agg((F.count("*") * (F.count("*") - 1) / 2).alias("tests"))
    by = running_sum(scored.groupBy("grp", "p_value").agg(F.count("*").alias("c")), "grp", "p_value", "c")
    cutoff = by.join(tests, "grp").where(F.col("p_value") <= alpha * F.col("running") / F.greatest("tests", F.lit(1.0))).groupBy("grp").agg(F.max("p_value").alias("cutoff"))
    return scored.join(cutoff, "grp", "left").withColumn("significant", F.coalesce(F.col("p_value") <= F.col("cutoff"), F.lit(False))).drop("cutoff")


def surprising_pairs(commits: DataFrame, alpha: float = 0.01) -> DataFrame:
    """The whole operator: every pair that was seen, with its null and its discovery.

    ``grp, a, b, nab, na, nb, n, ma, mb, expected, p_value, met, lift,
    significant`` with ``lift`` = nab * n / (ma * mb).  ``met`` is false where
    the null could not be fitted to FIT_ERROR; its p-values are then those of
    the last sweep.  Empty input gives an empty result.
    """
    b, items = numbered(baskets(commits))
    scored = staged(surprise(pair_counts(b, items, 1), b, items), "scored")
    return named(with_lift(false_discovery(scored, items, alpha)), items)


def with_lift(scored: DataFrame) -> DataFrame:
    return scored.withColumn("lift", F.col("nab") * F.col("n") / (F.col("ma") * F.col("mb")))


def lifted_pairs(commits: DataFrame, support: int, lift: int) -> DataFrame:
    """Scored pairs in at least ``support`` baskets and ``lift`` times as many as their null frequencies let expect.

    The comparison is in exact integers: frequencies and number of baskets are
    those of the fitted null.  Columns as in ``surprising_pairs`` without
    ``significant``, which needs the pairs of smaller support too.
    """
    b, items = numbered(baskets(commits))
    scored = with_lift(surprise(pair_counts(b, items, support), b, items))
    return named(scored.where(F.col("nab") * F.col("n") >= lift * F.col("ma") * F.col("mb")), items)


def agreement(scored: DataFrame, support: int, lift: int) -> DataFrame:
    """How far ``significant`` and the rule of ``lifted_pairs`` agree, per group.

    ``grp, ruled, discovered, both, recall, precision``; the rates are null
    where nothing is ruled or discovered.
    """
    rule = (F.col("nab") >= support) & (F.col("nab") * F.col("n") >= lift * F.col("ma") * F.col("mb"))
    count = lambda c: F.sum(c.cast("long"))
    g = scored.groupBy("grp").agg(count(rule).alias("ruled"), count(F.col("significant")).alias("discovered"), count(rule & F.col("significant")).alias("both"))
    part = lambda c: F.when(F.col(c) > 0, F.round(F.col("both") / F.col(c), 6))
    return g.withColumns({"recall": part("ruled"), "precision": part("discovered")})
