"""Measures of answers against truth, task building and gates, lexical search, resampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigree.operators import search
from filigree.operators.graph import top_per

# Words that do not count in search.
STOP = "a an the to of in at by and or for with from is this that".split()
# Words every summary has; admission limit of the gate; sizes and depth of a task's answer.
BOILERPLATE = "file under at the repository root key symbol use".split()
GATE_F1, ANSWER_LEAST, ANSWER_MOST, ANSWER_DEPTH = 0.35, 2, 20, 2


def set_f1(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """``task, predicted, expected, hit, f1`` of two tables ``task, item``.

    0 where a side is empty or nothing agrees.  Duplicates count once; counts
    and hits are added up without gathering sets.
    """
    p = predicted.select("task", "item").distinct().withColumns({"p": F.lit(1), "e": F.lit(0)})
    e = expected.select("task", "item").distinct().withColumns({"p": F.lit(0), "e": F.lit(1)})
    u = p.unionByName(e).groupBy("task", "item").agg(F.max("p").alias("p"), F.max("e").alias("e"))
    g = u.groupBy("task").agg(F.sum("p").cast("long").alias("predicted"), F.sum("e").cast("long").alias("expected"), F.sum(F.col("p") * F.col("e")).cast("long").alias("hit"))
    return g.withColumn("f1", F.when(F.col("hit") > 0, 2.0 * F.col("hit") / (F.col("predicted") + F.col("expected"))).otherwise(0.0))


def micro_score(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """One row ``tp, fp, fn, precision, recall`` over all tasks; 0 of 0 counts as 0."""
    s = set_f1(predicted, expected).agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.col("predicted") - F.col("hit")), F.lit(0)).alias("fp"), F.coalesce(F.sum(F.col("expected") - F.col("hit")), F.lit(0)).alias("fn"))
    return s.withColumns({"precision": F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), "recall": F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))})


def stem(word: Column) -> Column:
    long = F.length(word) > 3
    return F.when(long & word.endswith("ies"), F.concat(F.substr(word, F.lit(1), F.length(word) - 3), F.lit("y"))).when(
        long & word.endswith("s") & ~word.rlike("(ss|us|is)$"), F.substr(word, F.lit(1), F.length(word) - 1)
    ).otherwise(word)


def words(text: Column) -> Column:
    """Distinct stems of a text's words, camel case split, stop words out; null gives none."""
    low = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "([a-z0-9])([A-Z])", "$1 $2"))
    found = F.transform(F.array_distinct(F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0))), stem)
    return F.filter(F.array_distinct(found), lambda x: ~x.isin(*STOP))


def lexical_search(queries: DataFrame, texts: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` texts sharing most words with each query: ``query, rank, id, score``.

    ``queries(query, text)``, ``texts(id, text)`` with ids of type long; ties by
    id, null last.  Several texts of one id count as one.  Overlaps are counted
    by blocks of queries and texts (``search``), so pairs with a word in common
    are never rows.
    """

    def of(df: DataFrame, key: str) -> DataFrame:
        found = F.flatten(F.transform(F.collect_set("text"), words))
        return df.groupBy(key).agg(F.array_distinct(found).alias("words"))

    n = search.best_of_tasks(of(queries, "query"), of(texts, "id"), k)
    # each task has sent k rows a query at most
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return n.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "id", "score")


def label_quality(labels: DataFrame, allowed: DataFrame) -> DataFrame:
    """One row ``count, grounded, collisions``: shares of labels.

    ``labels(grp, id, name, summary)``; a label is grounded when all words of
    name and summary occur in ``allowed(grp, id, text)`` or are boilerplate, and
    collides when another label of its group has the same words.
    """
    ok = allowed.groupBy("grp", "id").agg(F.array_distinct(F.flatten(F.collect_set(words(F.col("text"))))).alias("ok"))
    name = F.array_join(F.array_sort(words(F.col("name"))), " ")
    j = labels.withColumn("key", name).join(ok, ["grp", "id"], "left")
    clash = labels.withColumn("key", name).groupBy("grp", "key").agg(F.count("*").alias("same"))
    content = words(F.concat_ws(" ", "name", "summary"))
    ground = F.size(F.array_except(content, F.concat(F.coalesce("ok", F.array().cast("array<string>")), F.array(*[F.lit(w) for w in BOILERPLATE])))) == 0
    j = j.join(clash, ["grp", "key"]).select(ground.cast("double").alias("g"), (F.col("same") > 1).cast("double").alias("c"))
    return j.agg(F.count("*").alias("count"), F.coalesce(F.avg("g"), F.lit(0.0)).alias("grounded"), F.coalesce(F.avg("c"), F.lit(0.0)).alias("collisions"))


def navigation_tasks(reached: DataFrame, nodes: DataFrame) -> DataFrame:
    """Targets whose importers make a fair question: ``target, answers, max_depth, directories``.

    2 to 20 importers, one at least two hops away.
    """
    from filigree.functions.paths import dirname

    j = reached.join(nodes.select(F.col("id").alias("node"), dirname(F.col("rel")).alias("dir")), "node")
    dirs = j.select("target", "dir").distinct().groupBy("target").agg(F.count("*").alias("directories"))
    g = j.groupBy("target").agg(F.count("*").alias("answers"), F.max("depth").alias("max_depth"))
    return g.where(F.col("answers").between(ANSWER_LEAST, ANSWER_MOST) & (F.col("max_depth") >= ANSWER_DEPTH)).join(dirs, "target")


def path_guess(tasks: DataFrame, nodes: DataFrame) -> DataFrame:
    """What path likeness alone would answer: ``target, item``.

    The ``answers`` files of the repository sharing most path words with the
    target; ``tasks(target, answers)``.
    """
    toks = F.filter(F.array_distinct(F.split(F.lower("rel"), r"[/\-_.]")), lambda x: (F.length(x) > 2) & ~x.isin(*STOP))
    n = nodes.select("repo", "id", "rel", F.explode(toks).alias("tok"))
    want = tasks.select(F.col("target").alias("id"), "answers").join(n, "id").select("repo", F.col("id").alias("target"), "answers", "tok")
    sc = n.join(want, ["repo", "tok"]).where("id <> target").groupBy("target", "answers", "id", "rel").agg(F.count("*").alias("score"))
    top = top_per(sc, ["target"], [F.desc("score"), F.asc("rel")], ANSWER_MOST)
    return top.where("rank <= answers").select("target", F.col("id").alias("item"))


def hub_guess(tasks: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What popularity alone would answer: ``target, item``, the most imported files of the repository.

    One more than the largest answer is enough of each repository's ranking.
    """
    n = nodes.select("repo", "id", "rel").join(edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("c")), "id", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    top = top_per(n, ["repo"], [F.desc("c"), F.asc("rel")], ANSWER_MOST + 1).select("repo", F.col("id").alias("item"), F.col("rank").alias("r"))
    t = tasks.select(F.col("target").alias("id"), "answers").join(nodes.select("id", "repo"), "id").select("repo", F.col("id").alias("target"), "answers")
    j = t.join(top, "repo").where("item <> target")
    return top_per(j, ["target"], [F.asc("r")], ANSWER_MOST).where("rank <= answers").select("target", "item")


def gate(tasks: DataFrame, expected: DataFrame, guesses: dict[str, DataFrame]) -> DataFrame:
    """Tasks with each adversary's F1 and ``admitted``: none of them above 0.35."""
    out = tasks.select("target")
    worst = F.lit(0.0)
    for name, g in guesses.items():
        f = set_f1(g.select(F.col("target").alias("task"), "item"), expected.select(F.col("target").alias("task"), F.col("node").alias("item"))).select(F.col("task").alias("target"), F.col("f1").alias(name))
        out = out.join(f, "target", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
        worst = F.greatest(worst, F.col(name))
    return out.withColumn("admitted", worst <= GATE_F1)


def summarize_arms(rows: DataFrame) -> DataFrame:
    """Per arm: ``arm, episodes, correct, accuracy, mean_f1, tokens``."""
    g = rows.groupBy("arm").agg(F.count("*").alias("episodes"), F.sum(F.col("correct").cast("long")).alias("correct"), F.avg("f1").alias("mean_f1"), F.sum("tokens").alias("tokens"))
    return g.withColumn("accuracy", F.col("correct") / F.col("episodes"))


#: Parts that the tasks of a bootstrap are divided into by hash, and weights drawn at a time.
BOOTSTRAP_PARTS, BOOTSTRAP_CELLS = 64, 1 << 20


def bootstrap(deltas: DataFrame, samples: int = 5000, seed: int = 0) -> DataFrame:
    """Percentile interval of the mean of ``d``: one row ``tasks, delta, low, high, better, worse``.

    Every sample draws as many tasks as there are, with replacement.  How many
    of its draws fall into each part of the tasks is one multinomial draw, which
    all parts make alike from the seed; each part then draws its own number
    from its own rows, and only sums per sample leave it.  Without rows the
    interval is null.
    """
    per = deltas.groupBy("task").agg(F.avg("d").alias("d")).withColumn("part", F.pmod(F.xxhash64("task"), F.lit(BOOTSTRAP_PARTS)).cast("int"))
    sizes = np.zeros(BOOTSTRAP_PARTS, "int64")
    for r in per.groupBy("part").count().collect():  # at most BOOTSTRAP_PARTS rows
        sizes[r["part"]] = r["count"]
    n = int(sizes.sum())

    def sums(key, pdf):
        part, d = int(key[0]), pdf.sort_values("task").d.to_numpy()
        draws = np.random.default_rng([seed, BOOTSTRAP_PARTS]).multinomial(n, sizes / n, samples)[:, part]
        rng, even = np.random.default_rng([seed, part]), np.full(len(d), 1 / len(d))
        s = [rng.multinomial(k, even) @ d for k in np.array_split(draws, max(1, samples * len(d) // BOOTSTRAP_CELLS))]
        return pd.DataFrame({"sample": np.arange(samples), "s": np.concatenate(s)})

    b = per.groupBy("part").applyInPandas(sums, "sample long, s double").groupBy("sample").agg((F.sum("s") / max(1, n)).alias("m"))
    ci = b.agg(F.expr("percentile_disc(0.025) WITHIN GROUP (ORDER BY m)").alias("low"), F.expr("percentile_disc(0.975) WITHIN GROUP (ORDER BY m)").alias("high"))
    t = per.agg(F.count("*").alias("tasks"), F.avg("d").alias("delta"), F.coalesce(F.sum((F.col("d") > 1e-9).cast("long")), F.lit(0)).alias("better"), F.coalesce(F.sum((F.col("d") < -1e-9).cast("long")), F.lit(0)).alias("worse"))
    return t.crossJoin(F.broadcast(ci))


def unexplained_cochange(pairs: DataFrame, one: DataFrame, other: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs together in one partition, not in the other, and without an import: ``repo, lo, hi``."""

    def together(m: DataFrame) -> DataFrame:
        a, b = m.select(F.col("id").alias("lo"), F.col("cluster").alias("a")), m.select(F.col("id").alias("hi"), F.col("cluster").alias("b"))
        return pairs.select("repo", "lo", "hi").join(a, "lo").join(b, "hi").where("a = b").select("repo", "lo", "hi")

    new = together(one).exceptAll(together(other))
    imp = edges.select("repo", F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).distinct()
    return new.join(imp, ["repo", "lo", "hi"], "left_anti")


def parity(one: DataFrame, other: DataFrame) -> DataFrame:
    """Rows only one of two answers has, with ``side``; empty if they agree, duplicates counted."""
    return one.exceptAll(other).withColumn("side", F.lit("left")).unionByName(other.exceptAll(one).withColumn("side", F.lit("right")))


def index_ceiling(answers: DataFrame, expected: DataFrame, least: float = 0.80) -> DataFrame:
    """How well an index alone answers: one row ``tasks, recall, f1, full, passed``.

    Means over the tasks with an expected answer; ``full`` counts those
    answered completely, ``passed`` says that the mean recall reaches ``least``.
    """
    s = set_f1(answers, expected).where("expected > 0").withColumn("r", F.col("hit") / F.col("expected"))
    g = s.agg(F.count("*").alias("tasks"), F.coalesce(F.avg("r"), F.lit(0.0)).alias("recall"), F.coalesce(F.avg("f1"), F.lit(0.0)).alias("f1"), F.coalesce(F.sum((F.col("r") == 1).cast("long")), F.lit(0)).alias("full"))
    return g.withColumn("passed", F.col("recall") >= least)


def first_match(urls: DataFrame, patterns: DataFrame) -> DataFrame:
    """The view of the first pattern, in order, that a URL matches: ``grp, url, view``; null without one.

    ``urls(grp, url)``, ``patterns(grp, place, regex, view)``.  A group's
    patterns are configuration; they travel as one array to its URLs, so each
    URL is tested in its own row and no pairs are made.
    """
    p = patterns.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("place", "regex", "view"))).alias("p"))
    hit = F.get(F.filter("p", lambda x: F.rlike(F.col("url"), x["regex"])), F.lit(0))
    return urls.select("grp", "url").distinct().join(p, "grp", "left").select("grp", "url", hit["view"].alias("view"))


def blind_order(items: DataFrame, seed: int = 0) -> DataFrame:
    """``items`` with ``place``, a seeded random key by ``id`` to order a blind review by; arms are not shown by it."""
    return items.withColumn("place", F.xxhash64(F.lit(seed), "id"))


def accept_rates(reviews: DataFrame) -> DataFrame:
    """Per arm of a review: ``arm, items, accepted, rate``; undecided (null) items do not count."""
    g = reviews.where("accepted IS NOT NULL").groupBy("arm").agg(F.count("*").alias("items"), F.sum(F.col("accepted").cast("long")).alias("accepted"))
    return g.withColumn("rate", F.col("accepted") / F.col("items"))
