"""Equi-joins whose left side has hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than one part in so many of all rows, or in PARTS_PER_TASK times the shuffle partitions if those are more.
HOT_PARTS, PARTS_PER_TASK = 96, 4
#: No key with fewer rows than this is worth a salt.
HOT_ROWS = 20_000


def hot_parts(spark: SparkSession) -> int:
    """Parts that all rows are thought of in: no hot key leaves more than one of them to a task, and there are fewer hot keys than parts."""
    return max(HOT_PARTS, PARTS_PER_TASK * int(spark.conf.get("spark.sql.shuffle.partitions")))


def hot_of(counts: DataFrame, keys: Sequence[str], n: str) -> DataFrame:
    """``keys, _salts`` of the hot keys of a table of counts ``n`` per key."""
    parts = hot_parts(counts.sparkSession)
    total = counts.agg(F.sum(n).alias("_total"))
    hot = counts.crossJoin(F.broadcast(total)).where((F.col(n) * parts > F.col("_total")) & (F.col(n) > HOT_ROWS))
    return hot.select(*keys, F.ceil(F.col(n) * parts / F.col("_total")).cast("int").alias("_salts"))


def hot_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, _salts``: the hot keys of ``df`` and the tasks to spread each over; fewer rows than ``hot_parts``."""
    return hot_of(df.groupBy(*keys).agg(F.count("*").alias("_n")), keys, "_n")


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", hot: DataFrame | None = None, keep_salt: bool = False) -> DataFrame:
    """Join where one key may hold a large part of ``left`` and few rows of ``right``.

    Rows of hot keys (``hot_keys`` of ``left``, or those given) get a salt from
    a hash of all their columns, so a recomputed task gives the same salt;
    right rows of hot keys are repeated once per salt, all others stay single.
    A key is spread over as many salts as it holds parts of all rows, so what a
    task gets of it does not grow with its share.  The list of hot keys is
    broadcast: it has fewer than ``hot_parts`` rows by construction.
    ``keep_salt`` leaves the column ``_salt`` in the result, so that a following
    distinct over all columns needs no shuffle of its own.  ``how`` is inner,
    left, left_semi or left_anti.  Exact copies of one row share a salt; remove
    them before.  Null keys match nothing.
    """
    hot = F.broadcast(hot_keys(left, keys) if hot is None else hot.select(*keys, "_salts"))
    salt = F.coalesce(F.pmod(F.xxhash64(*left.columns), F.col("_salts")), F.lit(0)).cast("int")
    salts = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    lft = left.join(hot, list(keys), "left").withColumn("_salt", salt).drop("_salts")
    rgt = right.join(hot, list(keys), "left").withColumn("_salt", F.explode(salts)).drop("_salts")
    out = lft.join(rgt, [*keys, "_salt"], how)
    return out if keep_salt else out.drop("_salt")
