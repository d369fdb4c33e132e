"""Whether an index still describes its sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.operators.graph import top_per

#: Changed paths shown; the count is exact.
SHOWN = 5


def diff(stored: DataFrame, now: DataFrame) -> DataFrame:
    """Paths that differ between two snapshots ``repo, path, mtime_ns, size``: ``repo, path, change``.

    ``added``, ``deleted`` or ``changed``; null values equal each other.
    """
    s = stored.select("repo", "path", F.struct("mtime_ns", "size").alias("was"), F.lit(True).alias("in_s")).dropDuplicates(["repo", "path"])
    n = now.select("repo", "path", F.struct("mtime_ns", "size").alias("is"), F.lit(True).alias("in_n")).dropDuplicates(["repo", "path"])
    j = s.join(n, ["repo", "path"], "full")
    change = F.when(F.col("in_s").isNull(), "added").when(F.col("in_n").isNull(), "deleted").when(~F.col("was").eqNullSafe(F.col("is")), "changed")
    return j.select("repo", "path", change.alias("change")).where("change IS NOT NULL")


def state(stored: DataFrame, now: DataFrame) -> DataFrame:
    """``repo, state, changed_count, changed``: unknown without a stored snapshot, fresh without changes, else stale.

    ``changed`` holds the first five paths, sorted.
    """
    d = diff(stored, now)
    n = d.groupBy("repo").agg(F.count("*").alias("changed_count"))
    first = top_per(d.select("repo", "path"), ["repo"], [F.asc("path")], SHOWN).groupBy("repo").agg(F.array_sort(F.collect_list("path")).alias("changed"))
    known = stored.select("repo").distinct().withColumn("known", F.lit(True))
    r = now.select("repo").distinct().join(known, "repo", "full").join(n, "repo", "left").join(first, "repo", "left")
    c = F.coalesce("changed_count", F.lit(0))
    s = F.when(F.col("known").isNull(), "unknown").when(c == 0, "fresh").otherwise("stale")
    return r.select("repo", s.alias("state"), F.when(F.col("known"), c).otherwise(0).alias("changed_count"), F.when(F.col("known"), F.coalesce("changed", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("changed"))


def fingerprint(files: DataFrame) -> DataFrame:
    """``repo, fingerprint``: SHA-256 over the sorted lines ``path:hash`` of a repository.

    The lines are hashed one by one and combined in 256 groups before the
    last step, so no task holds all lines.
    """
    line = F.concat_ws(":", "rel", F.coalesce("hash", F.lit("")))
    f = files.select("repo", F.sha2(line, 256).alias("h")).distinct()
    g = f.groupBy("repo", F.substring("h", 1, 3).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("g"))
    return g.groupBy("repo").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "g"))), lambda x: x["g"]), "\n"), 256).alias("fingerprint"))
