"""Queries that parse the file texts; SQL has no parser, so they have none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.functions import classify as C
from filigree.session import table
from filigree.sources import extract


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files").select("id", "repo", "rel", "text").distinct()
    return extract.parse(f.withColumn("language", C.language(F.col("rel"))))


def parse_facts(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c: F.size(c).cast("long").alias(c)
    return _parsed(spark, d).select("repo", "file", n("refs"), n("symbols"), n("urls"), n("seqs"), n("extends"), n("members"), n("routes"), n("includes"), "http", "partial")


def parsed_refs(spark: SparkSession, d: str) -> DataFrame:
    return extract.child_tables(_parsed(spark, d))["refs"]


def parsed_symbols(spark: SparkSession, d: str) -> DataFrame:
    return extract.child_tables(_parsed(spark, d))["symbols"]


QUERIES = {f.__name__: f for f in (parse_facts, parsed_refs, parsed_symbols)}
SQL: dict[str, str] = {}
