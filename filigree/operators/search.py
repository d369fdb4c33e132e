"""Texts that share most words with a query, by blocks of both.

Nearly every text shares some word with nearly every query, so pairs are never
rows.  Queries and texts are packed in blocks; a pair of blocks is one product
of 0/1 matrices over the words that are frequent in both, plus an addition for
each match of any other word.  Counts in float32 are exact up to 2 ** 24 words.
A task goes through its blocks of texts for one block of queries and keeps the
best texts of each query; a text shorter than the worst of them is not tried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries and texts of a block; they choose the work of one product, never a result.
QUERIES, TEXTS = 512, 4096
#: A word is a column of the product if its matches are more than one in so many pairs.
RARE = 256
# Fixed value: stands for a null id, which comes last.
_NULL = np.iinfo("int64").max
_PACKED = "longest int, ids binary, sizes binary, codes binary, words string"


def packed(df: DataFrame, most: int) -> DataFrame:
    """Blocks of ``df(id long, words array<string>)``, the longest texts of a batch together; words are distinct and not empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False).astype("int32")
            order = np.argsort(-size, kind="stable")
            order = order[size[order] > 0]
            ids = b.column(0).fill_null(_NULL).to_numpy(zero_copy_only=False)
            for at in range(0, len(order), most):
                part = order[at : at + most]
                code = b.column(1).take(pa.array(part)).flatten().dictionary_encode()
                row = [int(size[part[0]]), ids[part].tobytes(), size[part].tobytes(), code.indices.to_numpy().astype("int32").tobytes(), " ".join(code.dictionary.to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.string()))], ["longest", "ids", "sizes", "codes", "words"])

    return df.mapInArrow(run, _PACKED)


@dataclass
class Block:
    """Ids, and each occurrence of a word as its row and the word's number."""

    ids: np.ndarray
    row: np.ndarray
    code: np.ndarray
    words: list[str]

    @classmethod
    def of(cls, ids: bytes, sizes: bytes, codes: bytes, words: str) -> Block:
        size = np.frombuffer(sizes, "int32")
        return cls(np.frombuffer(ids, "int64"), np.repeat(np.arange(len(size)), size), np.frombuffer(codes, "int32"), words.split(" "))


class Best:
    """The ``k`` best texts of each query of a block, of equal scores the least ids."""

    def __init__(self, q: Block, k: int):
        self.q, self.k, n = q, k, len(q.words)
        self.number = {w: i for i, w in enumerate(q.words)}
        self.freq = np.bincount(q.code, minlength=n)
        self.by_word, self.start = q.row[np.argsort(q.code, kind="stable")], np.cumsum(self.freq) - self.freq
        self.row, self.score, self.id = (np.zeros(0, "int64") for _ in range(3))
        self.need = np.ones(len(q.ids), "float32")  # the least score that can still be among the best

    def scores(self, t: Block, live: np.ndarray) -> np.ndarray:
        """Shared words of the queries ``live`` with each text."""
        q, m = self.q, len(t.ids)
        code = np.array([self.number.get(w, -1) for w in t.words], "int64")[t.code]
        row, code = t.row[code >= 0], code[code >= 0]
        many = self.freq * np.bincount(code, minlength=len(q.words)) * RARE > len(q.ids) * m
        column, place = np.cumsum(many) - 1, np.full(len(q.ids), -1)
        place[live] = np.arange(len(live))
        a, b = np.zeros((len(live), many.sum()), "float32"), np.zeros((m, many.sum()), "float32")
        of = many[q.code] & (place[q.row] >= 0)
        a[place[q.row[of]], column[q.code[of]]] = 1
        of = many[code]
        b[row[of], column[code[of]]] = 1
        s = a @ b.T
        row, code = row[~of], code[~of]
        n = self.freq[code]
        who = place[self.by_word[np.repeat(self.start[code] - np.cumsum(n) + n, n) + np.arange(n.sum())]]
        text = np.repeat(row, n)
        np.add.at(s, (who[who >= 0], text[who >= 0]), 1)
        return s

    def add(self, t: Block, longest: int) -> None:
        live = np.flatnonzero(self.need <= longest)
        if not len(live):
            return
        s, k, m = self.scores(t, live), self.k, len(t.ids)
        need = self.need[live]
        if m > k:
            loose = np.flatnonzero((s >= need[:, None]).sum(1) > 4 * k)
            need[loose] = np.maximum(need[loose], np.partition(s[loose], m - k, axis=1)[:, m - k])
        r, c = np.nonzero(s >= need[:, None])
        row, score, i = np.append(self.row, live[r]), np.append(self.score, s[r, c].astype("int64")), np.append(self.id, t.ids[c])
        order = np.lexsort((i, -score, row))
        row, score, i = row[order], score[order], i[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        last = rank == k - 1
        self.need[row[last]] = score[last]
        self.row, self.score, self.id = row[rank < k], score[rank < k], i[rank < k]

    def batch(self) -> pa.RecordBatch:
        back = lambda v: pa.array(v, pa.int64(), mask=v == _NULL)
        return pa.RecordBatch.from_arrays([back(self.q.ids[self.row]), back(self.id), pa.array(self.score, pa.int64())], ["query", "id", "score"])


def best_of_tasks(queries: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """``query, id, score``: at least the ``k`` best texts of each query, as each task found them.

    ``queries(query long, words)``, ``texts(id long, words)``, one row an id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, best = None, None
        for b in batches:
            for x in b.to_pylist():
                if best is None or (x["q_ids"], x["q_codes"]) != key:  # the blocks of one block of queries come together
                    if best is not None:
                        yield best.batch()
                    key, best = (x["q_ids"], x["q_codes"]), Best(Block.of(x["q_ids"], x["q_sizes"], x["q_codes"], x["q_words"]), k)
                best.add(Block.of(x["ids"], x["sizes"], x["codes"], x["words"]), x["longest"])
        if best is not None:
            yield best.batch()

    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    q = packed(queries, QUERIES).drop("longest")
    q = q.select(*[F.col(c).alias(f"q_{c}") for c in q.columns]).repartition(max(2, parts // 16))
    t = packed(texts, TEXTS).repartition(max(spark.sparkContext.defaultParallelism, parts // 8)).sortWithinPartitions(F.desc("longest"))
    # each block is shuffled once; a task reads one partition of either side, queries in the outer loop
    return q.hint("shuffle_replicate_nl").crossJoin(t).mapInArrow(run, "query long, id long, score long")
