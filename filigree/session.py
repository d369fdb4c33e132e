"""Session helpers: reading tables, the shared checkpoint folder, size checks."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest estimated build side, in bytes, that an operator may broadcast itself.
BROADCAST_BYTES = 64 << 20


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A session for tests and for the benchmark on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("filigree")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only where the setting is absent (tests, one machine) a folder of our own
    is made.  The checkpoint directory of the context is set as a side effect,
    so that ``DataFrame.checkpoint`` works afterwards.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if sc._jsc.sc().getCheckpointDir().isDefined():
            return sc._jsc.sc().getCheckpointDir().get()
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="filigree-")
        atexit.register(shutil.rmtree, named, True)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably in the shared folder and cut its lineage.

    It is held while the checkpoint is written, which would otherwise compute
    it a second time; the checkpoint keeps the partitioning, and outlives any
    executor.
    """
    shared_dir(df.sparkSession)
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return held.checkpoint(eager=True)
    finally:
        held.unpersist()


def staged(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Unlike a checkpoint the result stays columnar, so later readers prune columns.
    """
    path = f"{_stage_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _stage_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is removed when the driver's interpreter ends."""
    sc = spark.sparkContext
    path = f"{shared_dir(spark).rstrip('/')}/filigree-{sc.applicationId}"
    if getattr(sc, "_filigree_stage", None) != path:
        sc._filigree_stage = path
        atexit.register(clean, spark)
    return path


def clean(spark: SparkSession) -> None:
    """Remove what ``staged`` wrote; results that still read it must have been written before."""
    path = getattr(spark.sparkContext, "_filigree_stage", None)
    if path is None:
        return
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM is gone already; the folder carries the application's name
        return


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only where the counted ``rows`` prove that it fits."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def ship(spark: SparkSession) -> None:
    """Send this package to the workers where they would not find it by themselves.

    They do when its folder is in ``PYTHONPATH``, or, on one machine, when it
    is the working directory.  Once per context.
    """
    root = Path(__file__).resolve().parent.parent
    sc = spark.sparkContext
    known = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in known or sc.master.startswith("local[") and Path.cwd().resolve() == root or getattr(sc, "_filigree_shipped", False):
        return
    name = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="filigree-"), "filigree"), "zip", root, "filigree")
    sc.addPyFile(name)  # the context's own file server hands it to every executor, late ones too
    sc._filigree_shipped = True
