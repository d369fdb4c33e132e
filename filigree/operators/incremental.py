"""Processing only new or changed records.

The target is the state.  Each target row keeps the key and the version of the
source row it was made from; the next run anti-joins the source against the
rows of the last published target version.  A run that dies leaves no trace,
because a version counts only once its manifest is in place.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def latest_success(stored: DataFrame, runs: DataFrame, keys: Sequence[str], versions: Sequence[str]) -> DataFrame:
    """The version columns of each key as the last succeeded run left them.

    Rows of runs that are unknown or did not succeed are ignored, copies
    collapse, and where one run has several rows for a key the greatest wins.
    Output: ``keys``, ``run_id`` and ``versions``.
    """
    ok = runs.where(F.col("status") == "succeeded").select("run_id").distinct()
    rows = stored.select(*keys, "run_id", *versions).join(ok, "run_id", "left_semi")
    top = rows.groupBy(*keys).agg(F.max(F.struct("run_id", *versions)).alias("_top"))
    return top.select(*keys, *[F.col("_top")[c].alias(c) for c in ("run_id", *versions)])


def pending(source: DataFrame, state: DataFrame, keys: Sequence[str], covered: Callable[[str, str], Column]) -> DataFrame:
    """Distinct source rows that no state row covers (an anti join).

    ``covered(s, t)`` says, for the aliases of source and state, whether the
    versions agree; null counts as "no".  The test is kept out of the join
    keys so that the state's own partitioning by key is reused.  Key columns
    compare null-safely: a source row with a null key is pending unless the
    state has that null key too.
    """
    s, t = source.distinct().alias("s"), state.alias("t")
    on = F.coalesce(covered("s", "t"), F.lit(False))
    for k in keys:
        on = on & F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}"))
    return s.join(t, on, "left_anti")


def pending_files(files: DataFrame, stored: DataFrame, runs: DataFrame) -> DataFrame:
    """Files the walk finds now whose content or parse the last success lacks.

    Output ``repo, rel, hash``, one row per file; deleted files are not taken
    up, a null hash on either side counts as a change.  Empty inputs give an
    empty result; other columns are ignored.
    """
    now = files.where(F.col("deleted_at").isNull()).select("repo", "rel", "hash")
    state = latest_success(stored, runs, ["repo", "rel"], ["hash", "parse_hash"])
    return pending(
        now,
        state,
        ["repo", "rel"],
        lambda s, t: (F.col(f"{s}.hash") == F.col(f"{t}.hash")) & (F.col(f"{s}.hash") == F.col(f"{t}.parse_hash")),
    )


def pending_heads(status: DataFrame, stored_git: DataFrame, runs: DataFrame) -> DataFrame:
    """Repositories whose HEAD the last succeeded run did not read (``repo, head``)."""
    state = latest_success(stored_git, runs, ["repo"], ["head"])
    return pending(status.select("repo", "head"), state, ["repo"], lambda s, t: F.col(f"{s}.head") == F.col(f"{t}.head"))


def pending_work(files: DataFrame, stored: DataFrame, status: DataFrame, stored_git: DataFrame, runs: DataFrame) -> DataFrame:
    """All work of the next run as ``kind, repo, rel``; heads have an empty ``rel``."""
    f = pending_files(files, stored, runs).select(F.lit("file").alias("kind"), "repo", "rel").distinct()
    h = pending_heads(status, stored_git, runs).select(F.lit("head").alias("kind"), "repo", F.lit("").alias("rel")).distinct()
    return f.unionByName(h)


def stat_hits(files: DataFrame, stored: DataFrame, runs: DataFrame) -> DataFrame:
    """Present files whose time stamp and size are as the last success left them: ``repo, rel, hash, loc, reread``.

    A hit takes over the stored hash and line count; others are to be read
    again (``reread``, with null values).  Null stamps or sizes never hit.
    """
    now = files.where(F.col("deleted_at").isNull()).select("repo", "rel", "mtime_ns", F.col("bytes").alias("size")).distinct()
    was = latest_success(stored, runs, ["repo", "rel"], ["mtime_ns", "size", "hash", "loc"]).select("repo", "rel", F.struct("mtime_ns", "size").alias("was"), "hash", "loc")
    j = now.join(was, ["repo", "rel"], "left")
    hit = F.coalesce((F.col("was.mtime_ns") == F.col("mtime_ns")) & (F.col("was.size") == F.col("size")), F.lit(False))
    return j.select("repo", "rel", F.when(hit, F.col("hash")).alias("hash"), F.when(hit, F.col("loc")).alias("loc"), (~hit).alias("reread"))


def memo_pairs(stored_git: DataFrame, status: DataFrame, runs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Remembered co-change pairs of repositories whose HEAD has not moved, by present file ids.

    ``repo, lo, hi, w``; paths that are no present file drop out.
    """
    state = latest_success(stored_git, runs, ["repo"], ["head", "pairs"])
    same = state.join(status.select("repo", F.col("head").alias("now")).distinct(), "repo").where("head = now")
    p = same.select("repo", F.explode("pairs").alias("p")).select("repo", "p.a", "p.b", "p.w")
    ids = nodes.select("repo", "rel", "id")
    p = p.join(ids.select("repo", F.col("rel").alias("a"), F.col("id").alias("x")), ["repo", "a"]).join(ids.select("repo", F.col("rel").alias("b"), F.col("id").alias("y")), ["repo", "b"])
    return p.where("x <> y").select("repo", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"), "w").distinct()


class VersionedTarget:
    """A target table whose versions are published atomically.

    Layout below ``path``: ``data/<version>-<attempt>/`` Parquet parts and
    ``published/<version>.json`` manifests, each naming every part of its
    version.  A part holds the rows of one run, or, every ``compact`` runs, the
    whole table, so that a read never meets more than ``compact`` parts.  A
    manifest is written under a temporary name and put in place by a step that
    refuses where one is: of two concurrent runs one fails, and of a crashed
    run nothing is visible.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], version: str, order: Sequence[str] = (), compact: int = 8):
        """``order`` names columns that tell which of several source rows of a key is the newest; the version decides what they leave equal."""
        self.spark, self.path, self.keys, self.version, self.order, self.compact = spark, path.rstrip("/"), list(keys), version, list(order), max(1, compact)
        self._fs = self._p("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _p(self, rel: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{rel}")

    def versions(self) -> list[int]:
        """The published versions that are kept, oldest first."""
        if not self._fs.exists(self._p("published")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._p("published"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def current(self) -> int:
        """The number of the newest published version, 0 before the first."""
        return max(self.versions(), default=0)

    def parts(self, version: int | None = None) -> list[str]:
        """The data folders of a version, oldest first."""
        v = self.current() if version is None else version
        if not v:
            return []
        rows = self.spark.read.text(f"{self.path}/published/{v}.json").collect()
        return [r.value for r in rows if r.value]

    def _rows(self, version: int) -> DataFrame | None:
        """The newest row of each key of a version, with the columns ``_run`` and ``_gone``."""
        parts = self.parts(version)
        if not parts:
            return None
        df = self.spark.read.parquet(*[f"{self.path}/{p}" for p in parts])
        if len(parts) == 1:
            return df
        top = df.groupBy(*self.keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in self.keys]), F.col("_run")).alias("_r"))
        return top.select(*self.keys, "_r.*")

    def read(self, version: int | None = None) -> DataFrame | None:
        """The newest row of each key, or None before the first version."""
        rows = self._rows(self.current() if version is None else version)
        return None if rows is None else rows.where(~F.col("_gone")).drop("_gone")

    def newest(self, source: DataFrame) -> DataFrame:
        """One source row per key: the last by ``order``, then by version, then by a hash of the row; nulls come first."""
        rest = [c for c in source.columns if c not in self.keys]
        rank = F.struct(*self.order, self.version, F.xxhash64(*source.columns))
        return source.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), rank).alias("_r")).select(*self.keys, *[F.col("_r")[c].alias(c) for c in rest]).select(*source.columns)

    def run(self, source: DataFrame, process: Callable[[DataFrame], DataFrame], whole: bool = True) -> int:
        """Process what is new or changed and publish it; returns the version.

        ``process`` gets the pending source rows, one per key (``newest``), and
        must keep the key and version columns.  Keys that left a ``whole``
        source are recorded as gone; a batch that holds only part of the source
        removes nothing.  A run that finds its version published by another
        raises, and leaves an unnamed part that ``vacuum`` removes.
        """
        base = self.current()
        seen, source = self._rows(base), self.newest(source)
        todo, gone = source, None
        if seen is not None:
            there = seen.where(~F.col("_gone"))
            todo = pending(source, there.select(*self.keys, self.version), self.keys, lambda s, t: F.col(f"{s}.{self.version}") == F.col(f"{t}.{self.version}"))
            gone = there.join(source.select(*self.keys), self.keys, "left_anti") if whole else None
        out = process(todo).withColumn("_run", F.lit(base + 1)).withColumn("_gone", F.lit(False))
        if gone is not None:
            out = out.unionByName(gone.withColumn("_run", F.lit(base + 1)).withColumn("_gone", F.lit(True)))
        part = f"data/{base + 1}-{self.spark._jvm.java.util.UUID.randomUUID()}"
        out.write.parquet(f"{self.path}/{part}")
        parts = [*self.parts(base), part]
        if len(parts) > self.compact:
            parts = [self._compacted(base + 1, parts)]
        self._publish(base + 1, parts)
        return base + 1

    def replace(self, rows: DataFrame, version: int) -> None:
        """Publish ``rows``, which hold each key once, as the whole of ``version``; raises unless that is the next one."""
        if version != self.current() + 1:
            raise RuntimeError(f"version {version} does not follow {self.current()}")
        part = f"data/{version}-{self.spark._jvm.java.util.UUID.randomUUID()}"
        rows.withColumn("_run", F.lit(version)).withColumn("_gone", F.lit(False)).write.parquet(f"{self.path}/{part}")
        self._publish(version, [part])

    def _compacted(self, version: int, parts: list[str]) -> str:
        """All parts as one: the newest row of each key, without those that are gone."""
        df = self.spark.read.parquet(*[f"{self.path}/{p}" for p in parts])
        top = df.groupBy(*self.keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in self.keys]), F.col("_run")).alias("_r")).select(*self.keys, "_r.*")
        part = f"data/{version}-{self.spark._jvm.java.util.UUID.randomUUID()}"
        top.where(~F.col("_gone")).write.parquet(f"{self.path}/{part}")
        return part

    def _publish(self, version: int, parts: list[str]) -> None:
        tmp, final = self._p(f"published/.{version}-{self.spark._jvm.java.util.UUID.randomUUID()}"), self._p(f"published/{version}.json")
        self._fs.mkdirs(self._p("published"))
        stream = self._fs.create(tmp, False)
        stream.write(bytearray("\n".join(parts), "utf-8"))
        stream.close()
        try:
            self._place(tmp, final)
        except Py4JJavaError as e:
            self._fs.delete(tmp, False)
            raise RuntimeError(f"version {version} was published by another run") from e

    def _place(self, tmp, final) -> None:
        """Give a file its name unless that is taken, in one step of the file system."""
        jvm = self.spark._jvm
        if self._fs.getUri().getScheme() == "file":
            # a rename would replace the file of another run; a link refuses
            path = lambda p: jvm.java.nio.file.Path.of(p.toUri())
            full = lambda p: path(self._fs.makeQualified(p))
            jvm.java.nio.file.Files.createLink(full(final), full(tmp))
            self._fs.delete(tmp, False)
            return
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(tmp, final, none)  # refuses where the name is taken

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove all but the last ``keep`` versions, and the parts up to the current version that no kept one names.

        Parts of a run that is still going on have a later number and stay.
        """
        kept = self.versions()[-max(1, keep) :]
        named = {p for v in kept for p in self.parts(v)}
        for v in self.versions():
            if v not in kept:
                self._fs.delete(self._p(f"published/{v}.json"), False)
        found = [s.getPath().getName() for s in self._fs.listStatus(self._p("data"))] if kept and self._fs.exists(self._p("data")) else []
        old = [f"data/{n}" for n in found if f"data/{n}" not in named and int(n.split("-")[0]) <= kept[-1]]
        for p in old:
            self._fs.delete(self._p(p), True)
        return sorted(old)
