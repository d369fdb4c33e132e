"""References to records that do not exist, not any more, or not yet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.functions.paths import SCRIPT_SUFFIX, dirname, extension, join_relative, python_relative, served_keys
from filigree.operators.incremental import VersionedTarget
from filigree.operators.salted import hot_keys, salted_join
from filigree.session import staged

# Endings that a reference may have and its file lack; endings of files that are no code, whose references are never orphans.
SCRIPT_ENDS = (".js", ".jsx", ".mjs", ".cjs")
ASSET_SUFFIX = r"\.(css|scss|svg|png|json)$"


def existence_deltas(files: DataFrame, keys: Column) -> DataFrame:
    """Signed existence changes ``repo, key, at, d``: +1 where a file appears, -1 where it goes.

    ``keys`` is an array of the keys a file exists under.  Copies of a row are
    one record.  A null ``first_seen`` means "since ever".
    """
    f = files.select("repo", F.explode(keys).alias("key"), "id", F.coalesce("first_seen", F.lit("0001-01-01").cast("timestamp")).alias("born"), F.col("deleted_at").alias("died")).distinct()
    change = F.explode(F.array_compact(F.array(F.struct(F.col("born").alias("at"), F.lit(1).alias("d")), F.when(F.col("died").isNotNull(), F.struct(F.col("died").alias("at"), F.lit(-1).alias("d"))))))
    return f.select("repo", "key", change.alias("c")).select("repo", "key", "c.at", "c.d")


def _life() -> Column:
    """One file's life for a set: equal for copies of a row, different for two files."""
    born = F.coalesce("first_seen", F.lit("0001-01-01").cast("timestamp"))
    return F.named_struct(F.lit("id"), F.col("id"), F.lit("born"), born, F.lit("died"), F.col("deleted_at"))


def _history(lives: Column) -> Column:
    """A set of lives as signed deltas ``(at, d)``."""
    born = F.transform(lives, lambda x: F.struct(x["born"].alias("at"), F.lit(1).alias("d")))
    died = F.transform(F.filter(lives, lambda x: x["died"].isNotNull()), lambda x: F.struct(x["died"].alias("at"), F.lit(-1).alias("d")))
    return F.concat(born, died)


def exists_at(hist: Column, at: Column) -> Column:
    """Whether the signed count is positive at ``at``; with a null time, whether there is any row."""
    n = F.aggregate(hist, F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["at"] <= at, x["d"]).otherwise(F.lit(0)).cast("long"))
    return F.when(hist.isNull(), F.lit(False)).when(at.isNull(), F.lit(True)).otherwise(n > 0)


def id_history(files: DataFrame, shared: DataFrame) -> DataFrame:
    """``key`` (file id), ``hist`` and, for files of a repository, ``repo`` and ``rel``.

    Shared files exist since ever and have no repository.
    """
    one = files.select(F.col("id").alias("key"), F.struct("repo", "rel").alias("at"), _life().alias("life"))
    own = one.groupBy("key").agg(F.max("at").alias("at"), F.collect_set("life").alias("lives"))
    own = own.select("key", "at.repo", "at.rel", _history(F.col("lives")).alias("hist"))
    ever = F.array(F.struct(F.lit("0001-01-01").cast("timestamp").alias("at"), F.lit(1).alias("d")))
    none = F.lit(None).cast("string")
    return own.unionByName(shared.select(F.col("id").alias("key"), none.alias("repo"), none.alias("rel"), ever.alias("hist")).dropDuplicates(["key"]))


def path_history(files: DataFrame) -> DataFrame:
    """``repo, key, hist`` for every path a file answers to."""
    served = files.select("repo", F.explode(served_keys(F.col("rel"))).alias("key"), _life().alias("life"))
    return served.groupBy("repo", "key").agg(F.collect_set("life").alias("lives")).select("repo", "key", _history(F.col("lives")).alias("hist"))


def specifier_keys(refs: DataFrame) -> DataFrame:
    """Candidate paths of relative references: adds ``wanted``, an array (null: not judged).

    Needs ``rel`` of the importer and ``specifier``.  An empty array means
    that the specifier leaves the root, so that nothing can answer it.
    """
    base = dirname(F.col("rel"))
    spec = F.col("specifier")
    is_py = extension(F.col("rel")) == "py"
    path = F.when(is_py, python_relative(base, spec)).otherwise(join_relative(base, spec))
    bare = F.when(~is_py & F.col("_path").rlike(SCRIPT_SUFFIX), F.regexp_replace(F.col("_path"), SCRIPT_SUFFIX, ""))
    judged = spec.startswith(".") & F.col("rel").isNotNull() & (is_py | ~spec.rlike(ASSET_SUFFIX))
    return refs.withColumn("_path", path).withColumn("wanted", F.when(judged, F.array_compact(F.array(F.col("_path"), bare)))).drop("_path")


def orphan_edges(edges: DataFrame, files: DataFrame, shared: DataFrame) -> DataFrame:
    """Distinct edges with ``orphan``: an end is not there at ``seen_at``.

    Columns ``src, dst, seen_at, repo, orphan`` with the source's repository.
    Null ids are never there.  Copies are removed after the first join, whose
    partitioning serves the distinct as well.
    """
    hist = id_history(files, shared)
    e = edges.select("src", "dst", "seen_at")
    seen = F.col("seen_at")
    one = salted_join(e, hist.select(F.col("key").alias("src"), "repo", F.col("hist").alias("h")), ["src"], "left", hot_keys(edges, ["src"]), keep_salt=True)
    one = one.select("src", "dst", "seen_at", "repo", exists_at(F.col("h"), seen).alias("there"), "_salt").distinct().drop("_salt")
    two = salted_join(one, hist.select(F.col("key").alias("dst"), F.col("hist").alias("h")), ["dst"], "left", hot_keys(edges, ["dst"]))
    return two.select("src", "dst", "seen_at", "repo", (~(F.col("there") & exists_at(F.col("h"), seen))).alias("orphan"))


def orphan_refs(refs: DataFrame, files: DataFrame, shared: DataFrame) -> DataFrame:
    """Distinct references with ``orphan``, ``judged`` and the importer's ``repo``.

    Columns ``file, pos, specifier, seen_at, repo, judged, orphan``.  A
    reference is an orphan if its file is not there at ``seen_at``, or if it is
    relative and none of its candidate paths in the importer's repository is.
    ``judged`` says that the specifier took part.  Null specifiers are judged
    by their file alone.  Candidates are not enumerated per extension: each
    file offers the few keys it answers to, and a reference asks for one or two.
    """
    seen = F.col("seen_at")
    r = refs.select("file", "pos", "specifier", "seen_at")
    own = id_history(files, shared).withColumnRenamed("key", "file")
    r = salted_join(r, own, ["file"], "left", hot_keys(refs, ["file"]), keep_salt=True)
    r = r.select("file", "pos", "specifier", "seen_at", "repo", "rel", exists_at(F.col("hist"), seen).alias("file_there"), "_salt").distinct().drop("_salt")
    r = staged(specifier_keys(r).drop("rel"), "refs")
    ask = F.col("wanted").isNotNull() & F.col("file_there")
    plain = r.where(~ask).select("file", "pos", "specifier", "seen_at", "repo", F.col("wanted").isNotNull().alias("judged"), (~F.col("file_there")).alias("orphan"))
    # explode_outer keeps the references that nothing can answer
    want = r.where(ask).select("repo", F.explode_outer("wanted").alias("key"), "file", "pos", "specifier", "seen_at")
    hit = salted_join(want, path_history(files), ["repo", "key"], "left").select("file", "pos", "specifier", "seen_at", "repo", exists_at(F.col("hist"), seen).alias("ok"))
    judged = hit.groupBy("file", "pos", "specifier", "seen_at").agg(F.first("repo").alias("repo"), (~F.max("ok")).alias("orphan")).withColumn("judged", F.lit(True))
    return plain.unionByName(judged)


def orphan_rows(refs: DataFrame, edges: DataFrame, files: DataFrame, shared: DataFrame) -> DataFrame:
    """The orphan rows of both tables: ``tab, key_a, key_b``."""
    r = orphan_refs(refs, files, shared).where("orphan").select(F.lit("refs").alias("tab"), F.col("file").alias("key_a"), F.col("pos").cast("long").alias("key_b"))
    e = orphan_edges(edges, files, shared).where("orphan").select(F.lit("edges").alias("tab"), F.col("src").alias("key_a"), F.col("dst").alias("key_b"))
    return r.unionByName(e).distinct()


def orphan_report(refs: DataFrame, edges: DataFrame, files: DataFrame, shared: DataFrame) -> DataFrame:
    """Orphans by table, month of ``seen_at`` and repository.

    Columns ``tab, month, repo, n, orphans, resolution_rate``; month and repo
    are null where unknown.  The rate is the share of rows that are no orphans.
    """
    r = orphan_refs(refs, files, shared).select(F.lit("refs").alias("tab"), "seen_at", "repo", "orphan")
    e = orphan_edges(edges, files, shared).select(F.lit("edges").alias("tab"), "seen_at", "repo", "orphan")
    return (
        r.unionByName(e)
        .groupBy("tab", F.date_format("seen_at", "yyyy-MM").alias("month"), "repo")
        .agg(F.count("*").alias("n"), F.sum(F.col("orphan").cast("long")).alias("orphans"))
        .withColumn("resolution_rate", F.round(1 - F.col("orphans") / F.col("n"), 6))
    )


def reference_deltas(edges: DataFrame, refs: DataFrame, files: DataFrame, sign: int = 1) -> DataFrame:
    """Signed reference counts ``tab, repo, key, refs, present`` of a batch of rows.

    An edge counts for the id it points at (``tab`` edges, empty ``repo``), a
    relative reference for the path it means in the importer's repository
    (``tab`` refs).  ``files`` gives the importers' paths.  Copies
    within the batch are one row; with ``sign`` -1 the rows are taken back.
    """
    e = edges.where("dst IS NOT NULL").select("src", "dst").distinct().select(F.lit("edges").alias("tab"), F.lit("").alias("repo"), F.col("dst").cast("string").alias("key"))
    home = files.select(F.col("id").alias("file"), "repo", "rel").distinct()
    r = refs.select("file", "pos", "specifier").distinct().join(home, "file")
    # the first wanted path stands for all; one above the root is a key that no file has
    r = specifier_keys(r).where("wanted IS NOT NULL").select(F.lit("refs").alias("tab"), "repo", F.coalesce(F.get("wanted", F.lit(0)), F.concat(F.lit("/"), "specifier")).alias("key"))
    return e.unionByName(r).groupBy("tab", "repo", "key").agg((F.count("*") * sign).alias("refs")).withColumn("present", F.lit(0).cast("long"))


def presence_deltas(files: DataFrame, shared: DataFrame | None = None, sign: int = 1) -> DataFrame:
    """Signed existence counts ``tab, repo, key, refs, present`` of a batch of file rows, by id and by every path a file answers to.

    A row counts +1 for its appearance and -1 if it is gone; a batch that
    marks a known file as gone takes the old row back (``sign`` -1) and adds
    the new one.  Shared files are always there.
    """
    by_id = existence_deltas(files, F.array(F.col("id").cast("string"))).select(F.lit("edges").alias("tab"), F.lit("").alias("repo"), "key", "d")
    served = served_keys(F.col("rel"))
    # a script path is also answered by what answers it without its ending
    scripts = F.flatten(F.transform(served, lambda k: F.transform(F.array(*[F.lit(e) for e in SCRIPT_ENDS]), lambda e: F.concat(k, e))))
    by_path = existence_deltas(files, F.concat(served, scripts)).select(F.lit("refs").alias("tab"), "repo", "key", "d")
    every = by_id.unionByName(by_path)
    if shared is not None:
        every = every.unionByName(shared.select("id").distinct().select(F.lit("edges").alias("tab"), F.lit("").alias("repo"), F.col("id").cast("string").alias("key"), F.lit(1).alias("d")))
    return every.where("key IS NOT NULL AND repo IS NOT NULL").groupBy("tab", "repo", "key").agg((F.sum("d") * sign).cast("long").alias("present")).withColumn("refs", F.lit(0).cast("long")).select("tab", "repo", "key", "refs", "present")


class OrphanLedger:
    """Balances of references and existence per key, kept up by batches of deltas in a ``VersionedTarget``.

    Batches are numbered from 1; a batch that is applied already is passed
    over, so a run repeated after a failure counts nothing twice.
    """

    KEYS = ("tab", "repo", "key")

    def __init__(self, spark: SparkSession, path: str):
        self.target = VersionedTarget(spark, path, self.KEYS, "key")

    def apply(self, batch: int, *deltas: DataFrame) -> bool:
        """Add the deltas of a batch; False if it was there before."""
        if batch <= self.target.current():
            return False
        balance = self.target.read()
        parts = ([balance.drop("_run")] if balance is not None else []) + [d.select(*self.KEYS, "refs", "present") for d in deltas]
        total = parts[0]
        for p in parts[1:]:
            total = total.unionByName(p)
        self.target.replace(added(total, self.KEYS), batch)
        return True

    def orphans(self) -> DataFrame:
        """The current orphan report ``tab, repo, key, refs``: keys with references and no existence."""
        return current_orphans(self.target.read()).select(*self.KEYS, "refs")


def signed_balance(edges: DataFrame, files: DataFrame, shared: DataFrame) -> DataFrame:
    """Current state per file id from signed deltas: ``key, refs, present``.

    References add +1 to ``refs``, appearing and going files +1 and -1 to
    ``present``; both are sums, so deltas of any later batch just add up.
    Orphan keys are those with ``refs > 0 and present = 0``.
    """
    e = edges.select("src", "dst").distinct().select(F.col("dst").alias("key"), F.lit(1).alias("r"), F.lit(0).alias("p"))
    p = existence_deltas(files, F.array(F.col("id"))).select("key", F.lit(0).alias("r"), F.col("d").alias("p"))
    s = shared.select(F.col("id").alias("key"), F.lit(0).alias("r"), F.lit(1).alias("p")).distinct()
    return e.unionByName(p).unionByName(s).groupBy("key").agg(F.sum("r").alias("refs"), F.sum("p").alias("present"))


def added(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums of ``refs`` and ``present`` per key; keys at (0, 0) disappear."""
    both = rows.groupBy(*keys).agg(F.sum("refs").alias("refs"), F.sum("present").alias("present"))
    return both.where((F.col("refs") != 0) | (F.col("present") != 0))


def add_deltas(balance: DataFrame, deltas: DataFrame) -> DataFrame:
    """Merge a batch of ``key, refs, present`` deltas into a balance."""
    return added(balance.unionByName(deltas), ["key"])


def current_orphans(balance: DataFrame) -> DataFrame:
    """Keys with positive references and no existence."""
    return balance.where((F.col("refs") > 0) & (F.col("present") <= 0))
