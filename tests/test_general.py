"""The general data operators on small tables, against brute force, and on awkward input."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from filigree.operators import incremental, orphans, salted, skew

T = lambda d: dt.datetime(2024, 1, d)
FILES = "id long, repo string, rel string, hash string, first_seen timestamp, deleted_at timestamp"
STORED = "repo string, rel string, run_id long, hash string, parse_hash string"
REFS = "file long, pos int, specifier string, line int, seen_at timestamp"
EDGES = "src long, dst long, seen_at timestamp"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# -- new or changed records ------------------------------------------------------


def test_pending_files(spark):
    runs = spark.createDataFrame([(1, "succeeded"), (2, "failed"), (3, "succeeded")], "run_id long, status string")
    files = spark.createDataFrame(
        [(1, "r", "same", "h", T(1), None), (2, "r", "changed", "h2", T(1), None), (3, "r", "new", "h", T(1), None), (4, "r", "gone", "h", T(1), T(2)), (5, "r", "parse", "h", T(1), None), (6, "r", "nohash", None, T(1), None), (7, "r", "failedonly", "h", T(1), None), (8, "r", "older", "h1", T(1), None)] * 2,
        FILES,
    )
    stored = spark.createDataFrame(
        [("r", "same", 3, "h", "h"), ("r", "changed", 3, "h1", "h1"), ("r", "gone", 3, "x", "x"), ("r", "parse", 3, "h", None), ("r", "nohash", 3, None, None), ("r", "failedonly", 2, "h", "h"), ("r", "older", 1, "h1", "h1"), ("r", "older", 3, "h2", "h2"), ("r", "same", 2, "z", "z")] * 2,
        STORED,
    )
    got = rows(incremental.pending_files(files, stored, runs).select("rel"))
    assert got == [("changed",), ("failedonly",), ("new",), ("nohash",), ("older",), ("parse",)]
    none = stored.limit(0)
    assert incremental.pending_files(files, none, runs).count() == 7
    assert incremental.pending_files(files.limit(0), stored, runs).count() == 0


def test_versioned_target(spark, tmp_path):
    t = incremental.VersionedTarget(spark, str(tmp_path / "t"), ["k"], "v")
    seen = []

    def process(df):
        seen.append(sorted(r.k for r in df.collect()))
        return df.withColumn("out", F.concat("k", "v"))

    one = spark.createDataFrame([("a", "1"), ("b", "1")], "k string, v string")
    assert t.run(one, process) == 1
    assert t.run(one, process) == 2
    two = spark.createDataFrame([("a", "2"), ("c", "1")], "k string, v string")

    def dies(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        t.run(two, dies)
    assert t.current() == 2  # a failed run leaves nothing behind
    assert t.run(two, process) == 3
    assert seen == [["a", "b"], [], ["a", "c"]]
    assert rows(t.read().select("k", "v", "out")) == [("a", "2", "a2"), ("c", "1", "c1")]
    with pytest.raises(RuntimeError):
        t._publish(3, [])  # the same version cannot be published twice


def test_newest_source_row_wins(spark, tmp_path):
    t = incremental.VersionedTarget(spark, str(tmp_path / "t"), ["k"], "v", order=["at"])
    one = spark.createDataFrame([("a", "9", 1, "old"), ("a", "1", 3, "new"), ("a", "5", 2, "mid"), ("b", None, 1, "x"), ("b", "0", 1, "y"), ("b", "0", 1, "y")], "k string, v string, at int, x string")
    t.run(one, lambda df: df)
    assert rows(t.read().select("k", "v", "x")) == [("a", "1", "new"), ("b", "0", "y")]
    assert t.newest(one.limit(0)).count() == 0
    # a null version never counts as covered
    done = []
    t.run(spark.createDataFrame([("a", "1", 3, "new"), ("b", None, 9, "n")], one.schema), lambda df: done.append(sorted(r.k for r in df.collect())) or df)
    assert done == [["b"]]


def test_concurrent_runs_compaction_and_vacuum(spark, tmp_path):
    make = lambda: incremental.VersionedTarget(spark, str(tmp_path / "t"), ["k"], "v", compact=3)
    schema = "k string, v string"
    a, b = make(), make()
    a.run(spark.createDataFrame([("x", "0")], schema), lambda df: df)

    def slow(df):  # while b works, a publishes the version that b is after
        a.run(spark.createDataFrame([("x", "1")], schema), lambda d: d)
        return df

    with pytest.raises(RuntimeError):
        b.run(spark.createDataFrame([("x", "2")], schema), slow)
    assert rows(b.read().select("k", "v")) == [("x", "1")] and b.versions() == [1, 2]
    assert not [f for f in (tmp_path / "t/published").iterdir() if f.name.startswith(".2-")]
    for i in range(2, 8):
        b.run(spark.createDataFrame([("x", str(i)), (f"n{i}", "0")], schema), lambda df: df)
        assert len(b.parts()) <= 3
        assert rows(b.read().select("k", "v")) == [(f"n{i}", "0"), ("x", str(i))]
    before = rows(b.read(7).select("k", "v"))
    gone = b.vacuum(2)
    assert gone and b.versions() == [7, 8] and rows(b.read(7).select("k", "v")) == before
    assert rows(b.read().select("k", "v")) == [("n7", "0"), ("x", "7")]
    left = {f"data/{f.name}" for f in (tmp_path / "t/data").iterdir()}
    assert left == set(b.parts(7)) | set(b.parts(8)) and make().vacuum() == []
    assert incremental.VersionedTarget(spark, str(tmp_path / "none"), ["k"], "v").vacuum() == []


# -- orphans -------------------------------------------------------------------------


def _there(f, at):
    return at is None or (f[4] <= at and not (f[5] is not None and f[5] <= at))


def test_orphans(spark):
    files = [(1, "r", "a/b/x.ts", "", T(1), None), (2, "r", "a/util.js", "", T(5), T(9)), (3, "r", "a/b/pkg/__init__.py", "", T(1), None), (4, "r", "a/b/m.py", "", T(1), None), (5, "r", "index.ts", "", T(1), None), (6, "q", "a/other.ts", "", T(1), None)]
    refs = [
        (1, 0, "../util", 1, T(6)), (1, 1, "../util", 1, T(2)), (1, 2, "../util.js", 1, T(9)), (1, 3, "./x.css", 1, T(6)), (1, 4, "react", 1, T(6)), (1, 5, "../../../..", 1, T(6)), (1, 6, "../other", 1, T(6)), (1, 7, None, 1, T(6)),
        (4, 0, ".pkg", 1, T(6)), (4, 1, "..pkg", 1, T(6)), (4, 2, "......x", 1, T(6)), (4, 3, ".", 1, T(6)), (99, 0, "react", 1, T(6)), (7, 0, "./x", 1, None), (4, 4, ".pkg", 1, None), (1, 8, "./X", 1, T(6)), (1, 9, "../util.jsx", 1, T(6)),
    ]
    edges = [(1, 2, T(6)), (1, 2, T(9)), (1, 2, None), (1, 40, T(1)), (40, 77, None), (2, 1, T(2)), (None, 1, T(2))]
    f, shared = spark.createDataFrame(files * 2, FILES), spark.createDataFrame([(40, "core/log.ts")], "id long, rel string")
    got = rows(orphans.orphan_rows(spark.createDataFrame(refs * 2, REFS), spark.createDataFrame(edges * 2, EDGES), f, shared))
    bad_refs = {(1, 1), (1, 2), (1, 6), (4, 1), (4, 2), (4, 3), (99, 0), (7, 0), (1, 8)}
    assert {x[1:] for x in got if x[0] == "refs"} == bad_refs
    assert {x[1:] for x in got if x[0] == "edges"} == {(1, 2), (40, 77), (2, 1), (None, 1)}
    assert len(got) == len(set(got))
    assert orphans.orphan_rows(spark.createDataFrame([], REFS), spark.createDataFrame([], EDGES), f.limit(0), shared.limit(0)).count() == 0


def test_signed_balance_adds_up(spark):
    d = "key long, refs long, present long"
    a = spark.createDataFrame([(1, 2, 1), (2, 1, 0)], d)
    b = spark.createDataFrame([(2, 0, 1), (1, 0, -1), (3, 1, 0), (3, -1, 0)], d)
    both = orphans.add_deltas(a, b)
    assert rows(both) == [(1, 2, 0), (2, 1, 1)]
    assert rows(orphans.current_orphans(both)) == [(1, 2, 0)]


def test_ledger_is_kept_up_by_deltas(spark, tmp_path):
    mk = lambda r: spark.createDataFrame(r, FILES)
    one = [(1, "r", "src/a.ts", "h", T(1), None), (2, "r", "src/b.ts", "h", T(1), None), (3, "q", "m/x.py", "h", T(1), None)]
    shared = spark.createDataFrame([(90,)], "id long")
    edges = spark.createDataFrame([(1, 2, T(1)), (1, 2, T(1)), (3, 9, None), (1, 90, T(1)), (1, None, None)], EDGES)
    refs = spark.createDataFrame([(1, 0, "./b", 1, T(1)), (1, 1, "./late.js", 2, T(1)), (3, 0, ".gone", 1, None), (1, 2, "react", 1, None), (1, 3, None, 1, None)], REFS)
    led = orphans.OrphanLedger(spark, str(tmp_path / "l"))
    got = lambda: sorted((r.tab, r.repo, r.key, r.refs) for r in led.orphans().collect())
    assert led.apply(1, orphans.presence_deltas(mk(one), shared), orphans.reference_deltas(edges, refs, mk(one)))
    first = [("edges", "", "9", 1), ("refs", "q", "m/gone", 1), ("refs", "r", "src/late.js", 1)]
    assert got() == first
    assert not led.apply(1, orphans.presence_deltas(mk(one), shared)) and got() == first
    # b goes, late.ts and file 9 come
    gone, new = [one[1]], [(2, "r", "src/b.ts", "h", T(1), T(2)), (4, "r", "src/late.ts", "h", T(2), None), (9, "q", "m/gone.py", "h", T(2), None)]
    assert led.apply(2, orphans.presence_deltas(mk(gone), None, -1), orphans.presence_deltas(mk(new)))
    assert got() == [("edges", "", "2", 1), ("refs", "r", "src/b", 1)]
    # a reference is taken back; the balances are those of all batches at once
    assert led.apply(3, orphans.reference_deltas(edges.limit(0), refs.where("pos = 0 AND file = 1"), mk(one), -1))
    assert got() == [("edges", "", "2", 1)]
    whole = orphans.OrphanLedger(spark, str(tmp_path / "w"))
    whole.apply(1, orphans.presence_deltas(mk([one[0], one[2], *new]), shared), orphans.reference_deltas(edges, refs.where("NOT (pos = 0 AND file = 1)"), mk(one)))
    plain = lambda x: rows(x.target.read().drop("_run"))
    assert plain(whole) == plain(led)
    with pytest.raises(RuntimeError):
        led.apply(9, orphans.presence_deltas(mk(one)))
    empty = orphans.OrphanLedger(spark, str(tmp_path / "e"))
    assert empty.apply(1, orphans.presence_deltas(mk([])), orphans.reference_deltas(edges.limit(0), refs.limit(0), mk([]))) and empty.orphans().count() == 0


# -- hot keys ---------------------------------------------------------------------------


def test_exact_quantiles(spark):
    r = random.Random(3)
    data = [(1, r.randint(-(2**62), 2**62)) for _ in range(3000)] + [(2, 7)] * 50 + [(3, v) for v in (5, 5, 5, 9)] + [(4, -(2**63)), (4, 2**63 - 1), (5, None), (None, 3)]
    df = spark.createDataFrame(data, "key long, value long")
    got = {(x.key, x.q): (x.n, x.value) for x in skew.exact_quantiles(df, [0.0, 0.5, 0.99, 1.0]).collect()}
    for key in (1, 2, 3, 4):
        v = sorted(b for a, b in data if a == key)
        for q in (0.0, 0.5, 0.99, 1.0):
            assert got[key, q] == (len(v), v[max(1, math.ceil(q * len(v))) - 1])
    assert len(got) == 16
    assert skew.exact_quantiles(df.limit(0), [0.5]).count() == 0


def test_weighted_prefix(spark):
    r = random.Random(4)
    data = [("a", r.randint(-(2**62), 2**62), r.randint(0, 9)) for _ in range(500)]
    df = spark.createDataFrame([*data, ("b", 1, 5)], "key string, value long, weight long")
    limits = spark.createDataFrame([("a", 700), ("b", 4)], "key string, limit long")
    got = {x.key: (x.cut, x.taken) for x in skew.weighted_prefix(df, limits).collect()}
    total, cut = 0, None
    for _, v, w in sorted(data, key=lambda x: x[1]):
        if total + w > 700:
            break
        total, cut = total + w, v
    assert got == {"a": (cut, total), "b": (None, 0)}


def test_running_sum(spark):
    r = random.Random(5)
    data = [(r.choice("aab"), i, r.randint(0, 5)) for i in range(300)]
    want, at = {}, {}
    for g, o, w in data:
        at[g] = at.get(g, 0) + w
        want[g, o] = at[g]
    df = spark.createDataFrame(data, "g string, o long, w long").repartition(7)
    assert {(x.g, x.o): x.running for x in skew.running_sum(df, "g", "o", "w").collect()} == want


def test_heavy_keys_by_refinement(spark):
    r = random.Random(6)
    data = [(-(2**63), i) for i in range(40)] + [(2**63 - 1, i) for i in range(30)] + [(7, i) for i in range(25)] + [(8, i) for i in range(9)] + [(r.randrange(-(2**62), 2**62), i) for i in range(300)]
    data += data[:50] + [(None, 1), (7, None), (None, None)]
    df = spark.createDataFrame(data, "key long, value long")
    n = {k: len({v for a, v in data if a == k and v is not None}) for k, _ in data if k is not None}
    for least, share in ((10, 0.01), (26, 0.01), (1, 0.08), (500, 0.01)):
        want = {(k, c) for k, c in n.items() if c >= least and c >= share * sum(n.values())}
        for bins in (4, 256):
            assert {tuple(x) for x in skew.heavy_by_refinement(df, "key", "value", least, share, bins).collect()} == want
        assert {(x.key, x.n) for x in skew.heavy_keys(skew.key_counts(df, "key", "value"), least, share).collect()} == want
    assert skew.heavy_by_refinement(df.limit(0), "key", "value", 1, 0.01).count() == 0


def test_counts_and_heavy_keys(spark):
    e = spark.createDataFrame([(i, 1) for i in range(50)] * 2 + [(i, i + 100) for i in range(60)] + [(None, 1), (3, None)], "src long, dst long")
    c = skew.importer_counts(e)
    assert {r.key: r.n for r in c.collect()}[1] == 50
    assert [r.key for r in skew.heavy_keys(c, 10, 0.01).collect()] == [1]


def test_salted_join_equals_plain(spark, monkeypatch):
    monkeypatch.setattr(salted, "HOT_ROWS", 5)
    left = spark.createDataFrame([(1, i) for i in range(200)] + [(2, 1), (3, 1), (None, 1)], "k long, x long")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "k long, y string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(salted.salted_join(left, right, ["k"], how)) == rows(left.join(right, ["k"], how))
