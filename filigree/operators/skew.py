"""Per-key results when a few keys hold most rows.

Nothing here brings the rows of one key together.  Counts are combined on the
map side; quantiles come from histograms of ever finer bins, of which only the
one bin that holds the wanted rank is looked into further.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filigree.operators.salted import hot_keys, hot_of, salted_join
from filigree.session import cut, staged

#: Bins of one refinement step.  One step moves at most this many rows per key and quantile.
BINS = 256


def key_counts(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """Number of distinct non-null values per non-null key: ``key, n``.

    Duplicates are removed by both columns first, so a hot key is spread over
    all tasks.  What remains is counted per key and bin of the value's hash,
    and the bins, at most ``BINS`` a key, are merged: the same mergeable
    histogram that the quantiles refine, here without need of a second round.
    """
    d = pairs.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(F.col(key).alias("key"), F.col(value).alias("value")).distinct()
    bins = d.groupBy("key", F.pmod(F.xxhash64("value"), F.lit(BINS)).alias("bin")).agg(F.count("*").alias("c"))
    return bins.groupBy("key").agg(F.sum("c").alias("n"))


def heavy_keys(counts: DataFrame, least: int, share: float) -> DataFrame:
    """Rows of ``key_counts`` with ``n`` at least ``least`` and at least ``share`` of the sum of all ``n``."""
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).where((F.col("n") >= least) & (F.col("n") >= F.col("total") * F.lit(share)))


def heavy_by_refinement(pairs: DataFrame, key: str, value: str, least: int, share: float, bins: int = BINS) -> DataFrame:
    """Keys with at least ``least`` and at least ``share`` of all distinct non-null (key, value) pairs: ``key, n``.

    Exact selection on the LONG key itself.  The live intervals of the key
    range are cut into ``bins`` bins whose counts are merged over all tasks; a
    bin below the threshold holds no such key and is dropped, one that holds a
    single key is resolved, the others are cut further.  So the counts of at
    most 1/``share`` intervals are looked at in a round, 64-bit keys need at
    most 8 rounds of 256 bins, and no key's rows ever meet.  Empty input gives
    no keys.
    """
    d = pairs.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(value).alias("value")).distinct()
    d = staged(d.select("key"), "keys")
    all_ = d.agg(F.count("*").alias("total"), F.min("key").alias("lo"), F.max("key").alias("hi")).first()
    floor = max(float(least), all_.total * share)
    live = [(all_.lo, all_.hi)] if all_.total >= floor else []
    done: list[tuple[int, int]] = []
    spark = pairs.sparkSession
    while live:
        # as many rows as intervals with a share each: fewer than 1/share + 1
        steps = spark.createDataFrame([(lo, hi, (hi - lo) // bins + 1) for lo, hi in live], "lo long, hi long, width long")
        inside = d.join(F.broadcast(steps), F.col("key").between(F.col("lo"), F.col("hi")))
        at = F.expr("CAST((CAST(key AS DECIMAL(20,0)) - lo) DIV width AS LONG)")
        found = inside.groupBy("lo", at.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).where(F.col("n") >= F.lit(floor)).collect()
        done += [(r.a, r.n) for r in found if r.a == r.b]
        live = [(r.a, r.b) for r in found if r.a < r.b]
    return spark.createDataFrame(done, "key long, n long")


def exact_quantiles(df: DataFrame, qs: Sequence[float], bins: int = BINS) -> DataFrame:
    """Exact nearest-rank quantiles of the LONG ``value`` of each ``key``.

    Output ``key, n, q, value``: for each q the value at rank ``max(1,
    ceil(q * n))`` of the key's non-null values, duplicates counted.  Keys
    without a value are absent.  Ties are equal values, so they need no rule.

    Equal (key, value) rows are added up first.  Each round histograms the
    live interval of each (key, q) in ``bins`` bins and keeps the bin holding
    the rank; an interval is at most 1/``bins`` of the one before, so 64-bit
    values need at most 8 rounds of 256 bins.  Rows are never grouped by key:
    a round shuffles (key, q, bin) sums only, and in the join with the
    intervals the rows of hot keys are spread by a salt.
    """
    rows = df.where(F.col("key").isNotNull() & F.col("value").isNotNull()).select("key", F.col("value").cast("long").alias("value"))
    rows = staged(rows.groupBy("key", "value").agg(F.count("*").alias("c")), "values")
    span = cut(rows.groupBy("key").agg(F.sum("c").alias("n"), F.count("*").alias("d"), F.min("value").alias("lo"), F.max("value").alias("hi")))
    hot = cut(hot_of(span, ["key"], "d"))
    want = F.array(*[F.lit(float(q)) for q in qs])
    live = span.select("key", "n", F.explode(want).alias("q"), "lo", "hi")
    live = cut(live.withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n"))).cast("long")))
    done = live.where("lo = hi").select("key", "n", "q", F.col("lo").alias("value"))
    live = live.where("lo < hi")
    while not live.isEmpty():
        # exact integers: hi - lo may need 65 bits
        live = live.withColumn("width", F.expr(f"CAST(((CAST(hi AS DECIMAL(20,0)) - lo) / {bins}) AS LONG) + 1L"))
        hit = salted_join(rows, live.select("key", "q", "lo", "hi", "width"), ["key"], "inner", hot).where("value BETWEEN lo AND hi")
        hist = hit.groupBy("key", "q", F.expr("CAST((CAST(value AS DECIMAL(20,0)) - lo) DIV width AS LONG)").alias("bin")).agg(
            F.sum("c").alias("c"), F.min("value").alias("vlo"), F.max("value").alias("vhi")
        )
        # at most `bins` + 1 rows per (key, q): a bounded group
        steps = hist.groupBy("key", "q").agg(F.array_sort(F.collect_list(F.struct("bin", "c", "vlo", "vhi"))).alias("steps"))
        found = steps.join(live.select("key", "n", "q", "rank"), ["key", "q"]).withColumn(
            "at",
            F.expr(
                "aggregate(steps, named_struct('rem', rank, 'lo', CAST(NULL AS BIGINT), 'hi', CAST(NULL AS BIGINT), 'rank', rank), (a, s) -> "
                "CASE WHEN a.lo IS NOT NULL THEN a WHEN a.rem <= s.c THEN named_struct('rem', a.rem, 'lo', s.vlo, 'hi', s.vhi, 'rank', a.rem) "
                "ELSE named_struct('rem', a.rem - s.c, 'lo', a.lo, 'hi', a.hi, 'rank', a.rank) END)"
            ),
        )
        live = cut(found.select("key", "n", "q", F.col("at.lo").alias("lo"), F.col("at.hi").alias("hi"), F.col("at.rank").alias("rank")))
        done = done.unionByName(live.where("lo = hi").select("key", "n", "q", F.col("lo").alias("value")))
        live = live.where("lo < hi")
    return done


def importer_counts(edges: DataFrame) -> DataFrame:
    """Files by number of distinct importers: ``key_kind, key, n`` with kind ``file``."""
    return key_counts(edges, "dst", "src").withColumn("key_kind", F.lit("file"))


def dependents(clusters: DataFrame) -> DataFrame:
    """One row ``cluster_id, dependent`` per listed dependent; null arrays and elements give none."""
    return clusters.select("cluster_id", F.explode("depended_on_by").alias("dependent"))


def dependent_counts(clusters: DataFrame) -> DataFrame:
    """Clusters by number of distinct dependents over all repositories (kind ``cluster``)."""
    return key_counts(dependents(clusters), "cluster_id", "dependent").withColumn("key_kind", F.lit("cluster"))


def weighted_prefix(rows: DataFrame, limits: DataFrame, bins: int = BINS) -> DataFrame:
    """Per key the greatest ``value`` up to which the weights sum to no more than ``limit``.

    ``rows`` has ``key, value`` (LONG) and ``weight`` (>= 0), ``limits`` has
    ``key, limit``; output ``key, cut, taken``: ``cut`` is null where not even
    the smallest value fits, ``taken`` the weight up to it.  Rows of equal
    value are taken together.  The histograms of weight are refined as in
    ``exact_quantiles``; only (key, bin) sums are shuffled.
    """
    rows = rows.where(F.col("key").isNotNull() & F.col("value").isNotNull()).select("key", "value", "weight")
    span = rows.groupBy("key").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("weight").alias("all"))
    hot = cut(hot_keys(rows, ["key"]))
    none = F.lit(None).cast("long")
    live = cut(span.join(limits, "key").select("key", "lo", "hi", "limit", none.alias("cut"), F.lit(0).cast("long").alias("taken"), "all"))
    done = live.where(F.col("all") <= F.col("limit")).select("key", F.col("hi").alias("cut"), F.col("all").cast("long").alias("taken"))
    live = live.where(F.col("all") > F.col("limit")).drop("all")
    while not live.isEmpty():
        wide = live.withColumn("width", F.expr(f"CAST(((CAST(hi AS DECIMAL(20,0)) - lo) / {bins}) AS LONG) + 1L"))
        hist = salted_join(rows, wide.select("key", "lo", "hi", "width"), ["key"], "inner", hot).where("value BETWEEN lo AND hi").groupBy("key", F.expr("CAST((CAST(value AS DECIMAL(20,0)) - lo) DIV width AS LONG)").alias("bin")).agg(
            F.sum("weight").cast("long").alias("w"), F.min("value").alias("vlo"), F.max("value").alias("vhi")
        )
        steps = hist.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("bin", "w", "vlo", "vhi"))).alias("steps"))
        found = steps.join(live, "key").withColumn(
            "at",
            F.expr(
                "aggregate(steps, named_struct('cut', cut, 'taken', taken, 'lo', CAST(NULL AS BIGINT), 'hi', CAST(NULL AS BIGINT)), (a, s) -> "
                "CASE WHEN a.lo IS NOT NULL THEN a WHEN a.taken + s.w <= limit THEN named_struct('cut', s.vhi, 'taken', a.taken + s.w, 'lo', a.lo, 'hi', a.hi) "
                "ELSE named_struct('cut', a.cut, 'taken', a.taken, 'lo', s.vlo, 'hi', s.vhi) END)"
            ),
        )
        live = cut(found.select("key", F.col("at.lo").alias("lo"), F.col("at.hi").alias("hi"), "limit", F.col("at.cut").alias("cut"), F.col("at.taken").alias("taken")))
        over = F.coalesce(F.col("lo") >= F.col("hi"), F.lit(True))
        done = done.unionByName(live.where(over).select("key", "cut", "taken"))
        live = live.where(~over)
    return done


def running_sum(df: DataFrame, group: str, order: str, weight: str) -> DataFrame:
    """``df`` with ``running``: the sum of ``weight`` of its group up to and with the row, by ``order``.

    ``order`` must be unique within a group.  Rows are laid out by ranges of
    (group, order); each range is summed by itself, and the sums of the ranges
    before it, at most one row per range and group, are added.  So no task
    holds a whole group.
    """
    laid = df.repartitionByRange(group, order).withColumn("_range", F.spark_partition_id())
    laid = staged(laid, "ranges")
    local = Window.partitionBy(group, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    per = laid.groupBy(group, "_range").agg(F.sum(weight).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    return laid.withColumn("_local", F.sum(weight).over(local)).join(per, [group, "_range"]).withColumn("running", F.col("_local") + F.col("_before")).drop("_local", "_before", "_range")
