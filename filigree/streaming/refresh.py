"""Keeping a target up to date from a stream of file snapshots.

Our own idiom for continuous refresh: Structured Streaming delivers snapshot
files as micro-batches, and each batch is one run of the versioned target, so
a batch that is replayed after a failure finds its rows covered already.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from filigree.operators.incremental import VersionedTarget


def follow(spark: SparkSession, source: str, schema: StructType, target: VersionedTarget, process: Callable[[DataFrame], DataFrame], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Feed every new Parquet file under ``source`` through ``process`` into ``target``.

    Within a batch the row of a key with the greatest ``mtime_ns`` counts.
    """

    def one(batch: DataFrame, _id: int) -> None:
        rest = [c for c in batch.columns if c not in target.keys]
        newest = batch.groupBy(*target.keys).agg(F.max_by(F.struct(*rest), "mtime_ns").alias("_r")).select(*target.keys, "_r.*")
        target.run(newest, process, whole=False)

    w = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")).start()


def change_counts(spark: SparkSession, source: str, schema: StructType, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """A streaming table of files seen per repository and window of ``first_seen``.

    Rows later than the watermark are dropped by the engine.
    """
    s = spark.readStream.schema(schema).parquet(source).withWatermark("first_seen", late)
    return s.groupBy("repo", F.window("first_seen", window)).agg(F.count("*").alias("n"))
