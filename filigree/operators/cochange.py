"""Files that change together: churn and decayed pair credit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Window and half-life in days, commits of more files count for churn only, least commits of a pair.
WINDOW_DAYS, HALF_LIFE, COMMIT_MOST, LEAST_COMMITS, DAY = 730, 180, 50, 2, 86400.0


def _pairs(items: Column) -> Column:
    return F.flatten(F.transform(items, lambda x, i: F.transform(F.slice(items, i + 2, F.size(items)), lambda y: F.struct(x.alias("a"), y.alias("b")))))


def touched(commits: DataFrame, nodes: DataFrame) -> DataFrame:
    """``repo, commit_id, age, id``: the known files of each commit within the window.

    A commit read twice is one; paths lose trailing white space.  Age counts in
    days from the repository's newest commit that touches a known file, never
    below 0.
    """
    c = commits.select("repo", "commit_id", "seconds", F.explode("files").alias("rel")).withColumn("rel", F.regexp_replace("rel", r"\s+$", ""))
    c = c.groupBy("repo", "commit_id", "rel").agg(F.max("seconds").alias("seconds"))
    t = c.join(nodes.select("repo", "rel", "id"), ["repo", "rel"])
    # one time per commit, even where its copies disagree
    when = t.groupBy("repo", "commit_id").agg(F.max("seconds").alias("at"))
    anchor = when.groupBy("repo").agg(F.max("at").alias("anchor"))
    when = when.join(anchor, "repo").withColumn("age", F.greatest(F.lit(0), F.col("anchor") - F.col("at")) / DAY).where(F.col("age") <= WINDOW_DAYS)
    return t.select("repo", "commit_id", "id").join(when.select("repo", "commit_id", "age"), ["repo", "commit_id"])


def churn(touch: DataFrame) -> DataFrame:
    """Commits per file: ``repo, id, n``."""
    return touch.groupBy("repo", "id").agg(F.countDistinct("commit_id").alias("n"))


def pairs(touch: DataFrame, nodes: DataFrame) -> DataFrame:
    """Credited pairs ``repo, lo, hi, w, commits``.

    A commit of n files (2 to 50) gives each pair ``0.5 ** (age / 180) / (n -
    1)``; pairs need two commits, and two tests make no pair (``nodes.test``).
    """
    t = touch.select("repo", "commit_id", "age", "id").distinct()
    g = t.groupBy("repo", "commit_id", "age").agg(F.count("*").alias("n"))
    t = t.join(g.where(F.col("n").between(2, COMMIT_MOST)), ["repo", "commit_id", "age"])
    b = t.groupBy("repo", "commit_id", "age", "n").agg(F.array_sort(F.collect_list("id")).alias("items"))
    credit = F.pow(F.lit(0.5), F.col("age") / HALF_LIFE) / (F.col("n") - 1)
    p = b.select("repo", credit.alias("credit"), F.explode(_pairs(F.col("items"))).alias("p"))
    p = p.groupBy("repo", F.col("p.a").alias("lo"), F.col("p.b").alias("hi")).agg(F.sum("credit").alias("w"), F.count("*").alias("commits")).where(F.col("commits") >= LEAST_COMMITS)
    tests = nodes.where("test").select("id")
    both = p.join(tests.withColumnRenamed("id", "lo"), "lo", "left_semi").join(tests.withColumnRenamed("id", "hi"), "hi", "left_semi").select("repo", "lo", "hi")
    return p.join(both, ["repo", "lo", "hi"], "left_anti")


def normalised(p: DataFrame) -> DataFrame:
    """Weights divided by the repository's 99th percentile (nearest rank), at most 1."""
    scale = p.groupBy("repo").agg(F.expr("percentile_disc(0.99) WITHIN GROUP (ORDER BY w)").alias("scale"))
    return p.join(scale, "repo").withColumn("w", F.when(F.col("scale") > 0, F.least(F.col("w") / F.col("scale"), F.lit(1.0))).otherwise(F.col("w"))).drop("scale")
