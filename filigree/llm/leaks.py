"""Evaluation texts inside training texts: a prefix-filtered join of word windows.

A leak is a run of ``WINDOW`` consecutive words that a document and an item
share.  A window is the set of its ``WINDOW - SHINGLE + 1`` word shingles, all
of which a leaking document must contain; so one shingle per item window, the
rarest in the corpus, is a sufficient prefix.  Document positions of prefix
shingles give candidate windows, bounds on position and length discard those
that do not fit, and the words themselves are compared last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.llm.canon import canonical_sql, duckdb_map
from filigree.operators.salted import hot_keys, salted_join
from filigree.session import staged

WINDOW = 15
SHINGLE = 5
#: Distinct item shingles up to this number are sent to every task (8 bytes each); more are joined by shuffle.
SHIPPED = 4_000_000

#: Runs of letters and digits of the lower-cased canonical text, as a DuckDB expression of column ``text``.
WORDS_SQL = f"regexp_extract_all(lower({canonical_sql('text')}), '[\\p{{L}}\\p{{N}}]+')"


def _rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of all k-grams of a flat array of word hashes."""
    out = np.zeros(max(0, len(h) - k + 1), "uint64")
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)]
        out ^= out >> np.uint64(29)
    return out


def _keyed(df: DataFrame, key: str) -> DataFrame:
    """``key, th, text``: ids with a hash of the text, so that several texts of one id stay apart."""
    return df.where("text IS NOT NULL").select(key, F.xxhash64("text").alias("th"), "text").distinct()


def word_hashes(df: DataFrame, key: str) -> DataFrame:
    """``key, th, words``: 64-bit hashes of the words of ``text`` in order."""
    sql = f"SELECT {key}, th, list_transform({WORDS_SQL}, lambda w: CAST(hash(w) >> 1 AS BIGINT)) AS words FROM batch"
    return duckdb_map(df.select(key, "th", "text"), sql, f"{key} long, th long, words array<long>")


def shingles(df: DataFrame, key: str, only: np.ndarray | None = None) -> DataFrame:
    """``key, th, pos, shingle, n_words`` of every word shingle, or of those in the sorted array ``only``."""
    keep = df.sparkSession.sparkContext.broadcast(only) if only is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = keep.value if keep is not None else None
        for b in batches:
            lists = b.column(2)
            off = np.asarray(lists.offsets, "int64")
            flat = lists.values.to_numpy(zero_copy_only=False).astype("uint64")
            s = (_rolling(flat, SHINGLE) >> np.uint64(1)).astype("int64")
            row = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(s)]
            pos = np.arange(len(s)) - off[row] if len(s) else np.zeros(0, "int64")
            size = np.diff(off)
            ok = pos + SHINGLE <= size[row]
            if wanted is not None and len(s):
                at = np.minimum(np.searchsorted(wanted, s), max(0, len(wanted) - 1))
                ok &= (wanted[at] == s) if len(wanted) else False
            i = np.flatnonzero(ok)
            at = pa.array(row[i])
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(pos[i].astype("int32")), pa.array(s[i]), pa.array(size[row[i]].astype("int32"))], names=[key, "th", "pos", "shingle", "n_words"])

    return word_hashes(df, key).mapInArrow(run, f"{key} long, th long, pos int, shingle long, n_words int")


def prefixes(mine: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per item window that a document may hold: ``item_id, ith, start, shingle, offset, want``.

    ``shingle`` is the window's rarest in the corpus, ``offset`` its place in
    it, ``want`` all shingles of the window.  Windows with a shingle that no
    document has are in none and left out.
    """
    per = WINDOW - SHINGLE + 1
    df = hits.groupBy("shingle").agg(F.count("*").alias("df"))
    ranked = mine.join(df, "shingle", "left").select("item_id", F.col("th").alias("ith"), "n_words", "pos", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "shingle", "pos").alias("r"))
    starts = F.filter(F.sequence(F.col("pos") - (per - 1), F.col("pos")), lambda s: (s >= 0) & (s <= F.col("n_words") - WINDOW))
    w = ranked.withColumn("start", F.explode(starts)).groupBy("item_id", "ith", "start").agg(F.min("r").alias("r"), F.array_sort(F.collect_list(F.struct("pos", "r.shingle"))).alias("all"))
    return w.where("r.df > 0").select("item_id", "ith", "start", F.col("r.shingle").alias("shingle"), (F.col("r.pos") - F.col("start")).alias("offset"), F.col("all.shingle").alias("want"))


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs ``doc_id, item_id`` that share ``WINDOW`` or more consecutive words.

    Words are compared after ``canon``.  Null, empty and short texts leak
    nothing; copies of a row are one record; several texts under one id are
    searched each by itself.
    """
    docs, its = documents.select("doc_id", "text"), _keyed(items, "item_id")
    mine = staged(shingles(its, "item_id"), "item-shingles")
    distinct = mine.select("shingle").distinct()
    n = distinct.count()
    each = docs.where("text IS NOT NULL").withColumn("th", F.xxhash64("text"))
    if n <= SHIPPED:
        only = np.sort(distinct.toPandas()["shingle"].to_numpy("int64")) if n else np.zeros(0, "int64")
        hits = shingles(each, "doc_id", only)
    else:
        hits = shingles(each, "doc_id").join(distinct, "shingle", "left_semi")
    hits = staged(hits.distinct(), "hits")
    cand = salted_join(hits.withColumnRenamed("n_words", "doc_words"), prefixes(mine, hits), ["shingle"]).withColumn("doc_start", F.col("pos") - F.col("offset"))
    cand = cand.where((F.col("doc_start") >= 0) & (F.col("doc_start") + WINDOW <= F.col("doc_words")))
    # all shingles of the window must stand at their places before the texts are read again
    window = ["doc_id", "th", "item_id", "ith", "start", "doc_start"]
    need = cand.select(*window, F.posexplode("want").alias("k", "shingle")).withColumn("pos", (F.col("doc_start") + F.col("k")).cast("int"))
    full = need.join(hits.select("doc_id", "th", "pos", "shingle"), ["doc_id", "th", "pos", "shingle"])
    full = full.groupBy(*window).agg(F.count("*").alias("n")).where(F.col("n") == WINDOW - SHINGLE + 1)
    # the windows of a pair are compared word by word until one is the same
    pair = ["doc_id", "th", "item_id", "ith"]
    some = staged(full.groupBy(*pair).agg(F.collect_set(F.struct("doc_start", "start")).alias("w")), "leak-windows")
    dw = _words(_keyed(each.join(some.select("doc_id", "th").distinct(), ["doc_id", "th"], "left_semi"), "doc_id"), "doc_id").withColumnRenamed("words", "dw")
    iw = _words(its, "item_id").select("item_id", F.col("th").alias("ith"), F.col("words").alias("iw"))
    both = salted_join(some.join(dw, ["doc_id", "th"]), iw, ["item_id", "ith"], hot=hot_keys(some, ["item_id", "ith"]))
    same = F.exists("w", lambda x: F.slice("dw", x["doc_start"] + 1, F.lit(WINDOW)) == F.slice("iw", x["start"] + 1, F.lit(WINDOW)))
    return both.where(same).select("doc_id", "item_id").distinct()


def _words(df: DataFrame, key: str) -> DataFrame:
    return duckdb_map(df.select(key, "th", "text"), f"SELECT {key}, th, {WORDS_SQL} AS words FROM batch", f"{key} long, th long, words array<string>")


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Every item with the number of documents that leak it: ``item_id, task_set, n_documents``."""
    n = leaks(documents, items).groupBy("item_id").agg(F.count("*").alias("n"))
    return items.select("item_id", "task_set").distinct().join(n, "item_id", "left").select("item_id", "task_set", F.coalesce("n", F.lit(0)).cast("long").alias("n_documents"))
