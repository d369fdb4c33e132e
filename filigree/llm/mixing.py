"""Mixing sources to target shares of tokens, with capped repetition.

The tokens each source owes are fixed first.  The documents of a source stand
in a hash order with the running sum of their tokens; they are taken in whole
passes and one partial pass, which ends where the running sum reaches what is
left.  The same sum cuts the drawn documents into blocks of equal size, and a
splitting tree divides the block counts among the output shards by multivariate
hypergeometric draws: every shard is a fair sample of the mixture, every block
is in exactly one shard, and only counts per source pass the driver.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.operators.skew import running_sum
from filigree.session import staged

#: Ranks file of a public byte-level BPE; its path is a parameter of every function here.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Tokens of a block, the unit that is divided among shards, and of a shard where their number is not given.
BLOCK_TOKENS, SHARD_TOKENS, LEAST_SHARDS = 20_000, 1_000_000, 16
#: Nodes of the splitting tree that the driver makes; tasks go on from there.
TOP = 1024
# Fixed value: the pre-tokenizer pattern that belongs to those ranks.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODINGS: dict = {}


def encoding(path: str):
    """The tokenizer of a ranks file, built once per worker."""
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def source_name(c: Column) -> Column:
    """One spelling per source: trimmed, lower case, hyphens and spaces as underscores; blank is null."""
    name = F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")
    return F.when(name != "", name)


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, tokens``; null texts have 0 tokens, and of several rows of a document the longest counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(tokenizer)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "tokens"])

    rows = documents.select("doc_id", source_name(F.col("source")).alias("source"), "text")
    one = rows.mapInArrow(run, "doc_id long, source string, tokens long").groupBy("doc_id").agg(F.max(F.struct("tokens", "source")).alias("m"))
    return one.select("doc_id", "m.source", "m.tokens")


def plan(tokens: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """Quota of each source: ``source, target_share, max_repeats, documents, available, quota, passes, rest``.

    ``total`` is the wanted size in tokens, by default all tokens of sources
    with a target.  A source owes its share of the total but at most its
    tokens times ``max_repeats``: ``passes`` whole passes and ``rest`` tokens.
    Sources without documents have 0, sources without a target are absent.
    """
    t = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = tokens.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("available"))
    p = t.join(have, "source", "left").withColumns({"documents": F.coalesce("documents", F.lit(0)), "available": F.coalesce("available", F.lit(0))})
    size = F.lit(total).cast("double") if total is not None else None
    if size is None:
        p = p.crossJoin(F.broadcast(p.agg(F.sum("available").cast("double").alias("_total"))))
        size = F.col("_total")
    p = p.withColumn("quota", F.least(F.round(F.col("target_share") * size).cast("long"), F.col("available") * F.col("max_repeats")))
    passes = F.when(F.col("available") > 0, F.floor(F.col("quota") / F.col("available"))).otherwise(0).cast("long")
    return p.withColumn("passes", passes).withColumn("rest", F.col("quota") - F.col("passes") * F.col("available")).drop("_total")


def laid_out(tokens: DataFrame, seed: int = 7) -> DataFrame:
    """``doc_id, source, tokens, start`` of named sources: ``start`` is the sum of tokens before, in seeded hash order."""
    rows = tokens.where(F.col("source").isNotNull()).select("source", F.struct(F.xxhash64(F.lit(seed), "doc_id").alias("at"), "doc_id").alias("place"), "tokens")
    return running_sum(rows, "source", "place", "tokens").select("place.doc_id", "source", "tokens", (F.col("running") - F.col("tokens")).alias("start"))


def draw(laid: DataFrame, plan_: DataFrame) -> DataFrame:
    """The drawn documents, one row per use: ``doc_id, source, tokens, use, offset``.

    Every document is used ``passes`` times, and once more if its tokens, in
    the order of ``laid_out``, lie within the rest.  So a source misses its
    quota by less than one document, and no document exceeds its cap.
    ``offset`` is the place of the use in all drawn tokens of the source.
    """
    rows = laid.join(F.broadcast(plan_.select("source", "passes", "rest", "available")), "source")  # one row per source with a target
    n = F.col("passes") + (F.col("start") + F.col("tokens") <= F.col("rest")).cast("long") * (F.col("rest") > 0).cast("long")
    uses = rows.withColumn("n", n).where("n > 0").withColumn("use", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return uses.select("doc_id", "source", "tokens", "use", ((F.col("use") - 1) * F.col("available") + F.col("start")).alias("offset"))


def take(rng: np.random.Generator, k: np.ndarray, want: int) -> np.ndarray:
    """How many of each colour are among ``want`` balls drawn without replacement from ``k`` of each: exact at any size.

    Beyond numpy's range every ball is taken with probability want / sum(k); given
    how many came out, they are an even choice of that number, so drawing the
    difference back, or in addition, leaves an even choice of ``want``.  The
    difference is about the root of what it came from, so this ends fast.
    """
    total = int(k.sum())
    if want in (0, total):
        return k * bool(want)
    if total < 10**9:
        return rng.multivariate_hypergeometric(k, want, method="marginals")
    if want < 64:
        out = np.zeros_like(k)
        for _ in range(want):
            out[np.searchsorted(np.cumsum(k - out), rng.integers(int((k - out).sum())), side="right")] += 1
        return out
    got = rng.binomial(k, want / total)
    over = int(got.sum()) - want
    return got - take(rng, got, over) if over > 0 else got + take(rng, k - got, -over)


def split(node: tuple[int, int, np.ndarray, np.ndarray], most: int, seed: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """The nodes of at most ``most`` shards below a node ``(lo, hi, counts, first slots)``, in order.

    A node of several shards gives its left half the number of blocks that the
    half is due, and draws their sources without replacement.
    """
    out, todo = [], [node]
    while todo:
        lo, hi, k, at = todo.pop()
        if hi - lo <= most:
            out.append((lo, hi, k, at))
            continue
        mid = (lo + hi) // 2
        total = int(k.sum())
        want = (2 * total * (mid - lo) + hi - lo) // (2 * (hi - lo))
        left = take(np.random.default_rng([seed, lo, hi]), k, want)
        todo += [(mid, hi, k - left, at + left), (lo, mid, left, at)]
    return out


def splitting_tree(blocks: list[int], shards: int, seed: int = 7) -> np.ndarray:
    """Blocks of each source per shard (shards x sources): an exact random division.

    Shards differ by at most a few blocks in number, and columns sum to ``blocks``.
    """
    k = np.asarray(blocks, "int64")
    return np.array([c for _, _, c, _ in split((0, shards, k, k * 0), 1, seed)])


def mixture(documents: DataFrame, targets: DataFrame, total: int | None = None, shards: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 7, tokenizer: str = TOKENIZER) -> DataFrame:
    """The mixture: ``shard, place, doc_id, source, use, tokens``, one row per use of a document.

    Within a shard rows are in the order of ``place``, a seeded random key.
    The text is not carried along; join it by ``doc_id`` when writing shards.
    Without ``shards`` there are ``LEAST_SHARDS`` or, where those would exceed
    it, as many as hold ``SHARD_TOKENS`` each.
    """
    tokens = staged(token_counts(documents, tokenizer), "tokens")
    uses = draw(laid_out(tokens, seed), staged(plan(tokens, targets, total), "plan"))
    return arrange(uses, shards, block_tokens, seed)


def arrange(uses: DataFrame, shards: int | None, block_tokens: int, seed: int) -> DataFrame:
    """Divide drawn documents among shards by blocks, and shuffle within each shard.

    A block is ``block_tokens`` of a source's drawn tokens; a document belongs
    to the block in which it begins.  The slots that a shard gets of a source
    are consecutive places of a permutation of the source's blocks.
    """
    spark = uses.sparkSession
    # as many rows as sources with a target
    sizes = sorted((r.source, r.t // block_tokens + 1, r.s) for r in uses.groupBy("source").agg(F.max("offset").alias("t"), F.sum("tokens").alias("s")).collect())
    shards = shards or max(LEAST_SHARDS, -(-sum(s for _, _, s in sizes) // SHARD_TOKENS))
    k = np.array([n for _, n, _ in sizes], "int64")
    names = [s for s, _, _ in sizes]
    # the driver splits into at most TOP nodes, tasks split those further
    top = split((0, shards, k, k * 0), max(1, -(-shards // TOP)), seed) if names else []
    nodes = spark.createDataFrame([(lo, hi, c.tolist(), at.tolist()) for lo, hi, c, at in top], "lo int, hi int, counts array<long>, first array<long>").repartition(max(1, min(len(top), TOP // 8)))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, c, at in zip(*(x.to_pylist() for x in b.columns)):
                leaves = split((lo, hi, np.array(c, "int64"), np.array(at, "int64")), 1, seed)
                rows = [(s, n, int(f), int(f + m)) for n, _, cs, fs in leaves for s, m, f in zip(names, cs, fs) if m]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows) if rows else [[]] * 4, (pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["source", "shard", "lo", "hi"])

    slots = nodes.mapInArrow(spans, "source string, shard int, lo long, hi long").select("source", "shard", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("slot"))
    one = F.broadcast(spark.createDataFrame([(s, n, _step(n, seed)) for s, n, _ in sizes], "source string, k long, step long"))  # one row per source
    block = F.expr(f"offset div {block_tokens}L")
    placed = uses.join(one, "source").withColumn("slot", F.pmod(block * F.col("step") + F.lit(seed), F.col("k"))).join(slots, ["source", "slot"])
    out = placed.select("shard", F.xxhash64(F.lit(seed + 2), "doc_id", "use").alias("place"), "doc_id", "source", "use", "tokens")
    return out.repartition("shard").sortWithinPartitions("shard", "place", "doc_id", "use")


def _step(k: int, seed: int) -> int:
    """A number prime to k: multiplying by it permutes the residues of k.  Products with residues fit into 63 bits."""
    step = int(np.random.default_rng([seed, k]).integers(1, max(2, min(k, 2**62 // k - 200))))
    while np.gcd(step, k) != 1:
        step += 1
    return step


def mixture_report(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 7, tokenizer: str = TOKENIZER) -> DataFrame:
    """Reached shares next to the targets, one row per source with a target or with documents.

    ``status`` is ``met`` (within one document of the target), ``short`` (the
    cap on repeats binds), ``absent`` (no tokens) or ``no target`` (not drawn;
    the unnamed source has a null name).
    """
    tokens = staged(token_counts(documents, tokenizer), "tokens")
    p = staged(plan(tokens, targets, total), "plan")
    got = draw(laid_out(tokens, seed), p).groupBy("source").agg(F.count("*").alias("uses"), F.max("use").alias("most_repeats"), F.sum("tokens").alias("drawn"))
    have = tokens.groupBy(F.coalesce("source", F.lit("")).alias("s")).agg(F.count("*").alias("documents"), F.sum("tokens").alias("available"))
    r = p.select(F.col("source").alias("s"), "target_share", "max_repeats", "quota").join(have, "s", "full").join(got.withColumnRenamed("source", "s"), "s", "left")
    r = r.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("documents", "available", "uses", "most_repeats", "drawn")})
    r = r.crossJoin(F.broadcast(r.agg(F.sum("drawn").alias("_all"), F.sum("available").alias("_have"))))
    due = F.round(F.col("target_share") * (F.lit(total).cast("double") if total is not None else F.col("_due")))
    r = r.crossJoin(F.broadcast(p.agg(F.sum("available").cast("double").alias("_due"))))
    status = F.when(F.col("target_share").isNull(), "no target").when(F.col("available") == 0, "absent").when(F.col("quota") < due, "short").otherwise("met")
    return r.select(F.when(F.col("s") != "", F.col("s")).alias("source"), "target_share", "max_repeats", "documents", "available", "uses", "most_repeats", "drawn", F.round(F.col("drawn") / F.greatest("_all", F.lit(1)), 6).alias("actual_share"), status.alias("status"))
