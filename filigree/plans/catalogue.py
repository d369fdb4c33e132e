"""All queries of the core, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from filigree.plans import clusters, facts, general, graph, links, scalar

_MODULES = (general, graph, links, scalar, clusters, facts)


def queries() -> dict:
    return {k: q for m in _MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for m in _MODULES for k, q in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who imports these files, directly or not, and how far away."""
    return graph.importers_closure(spark, sf_dir)
