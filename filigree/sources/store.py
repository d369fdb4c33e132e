"""Parsed facts kept between runs.

The store is a versioned target keyed by path, whose version is the content
hash: a run parses only files whose hash it does not hold, and facts are
stamped with the ids of the present inventory when they are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.operators.incremental import VersionedTarget
from filigree.sources import extract

#: Format of the stored facts; another number means another folder, so old facts are never read.
FORMAT = 1


class FactStore:
    """Facts of all files of one or more repositories under a shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.target = VersionedTarget(spark, f"{path.rstrip('/')}/facts-{FORMAT}", ["repo", "rel"], "hash")

    def trusted(self, repo: str, inventory: dict[str, list]) -> dict[str, list]:
        """The entries of a file inventory whose facts are stored, so that their text is not needed again."""
        stored = self.target.read()
        if stored is None:
            return {}
        have = {r.rel: r.hash for r in stored.where(F.col("repo") == repo).select("rel", "hash").collect()}
        return {rel: v for rel, v in inventory.items() if have.get(rel) == v[2]}

    def parse(self, files: DataFrame) -> DataFrame:
        """Facts of ``files(repo, id, rel, language, hash, text)`` as ``extract.parse`` gives them.

        New and changed files are parsed and published, files that left are
        dropped, all others are read back.  Files without a language or a hash
        are left out.
        """
        known = files.where("language IS NOT NULL AND hash IS NOT NULL").select("repo", "id", "rel", "language", "hash", "text").distinct()

        def process(todo: DataFrame) -> DataFrame:
            facts = extract.parse(todo).withColumnRenamed("file", "id")
            return todo.select("repo", "rel", "hash", "id").join(facts.drop("repo"), "id").drop("id")

        self.target.run(known, process)
        return self.target.read().join(known.select("repo", "rel", F.col("id").alias("file")), ["repo", "rel"]).drop("rel", "hash", "_run").select("repo", "file", *[c for c in ("refs", "symbols", "urls", "seqs", "extends", "members", "routes", "includes", "http", "partial")])
