"""Items that appear together: exact counts, the null and its tails, against brute force."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from filigree.llm import catalogue, cooccur


def _tail(q, m, k):
    return cooccur.poisson_binomial_tails(q[None, :], m, np.array([k]))[0]


def _commits(spark, n=120, seed=1):
    r = random.Random(seed)
    data = []
    for i in range(n):
        items = [f"f{int(abs(r.gauss(0, 4)))}" for _ in range(r.randint(1, 6))]
        if i % 4 == 0:
            items += ["x ", "y\t"]
        data.append((f"c{i}", "r1" if i % 3 else "r2", i, items))
    data += [("dup", "r1", 1, ["a", "b"]), ("dup", "r1", 2, ["b", "a", "a "]), ("null", "r1", 1, None), ("empty", "r1", 1, []), ("blank", "r1", 1, [" ", None]), ("sweep", "r1", 1, [f"s{i}" for i in range(60)])]
    return data, spark.createDataFrame(data, "commit_id string, repo string, seconds long, files array<string>")


def test_pairs_against_brute_force(spark):
    data, df = _commits(spark)
    basket: dict = {}
    for c, repo, _, fs in data:
        basket.setdefault((repo, c), set()).update(f.rstrip() for f in fs or () if f and f.rstrip())
    basket = {k: v for k, v in basket.items() if 0 < len(v) <= 50}
    want = Counter()
    for (repo, _), v in basket.items():
        want.update((repo, a, b) for a, b in itertools.combinations(sorted(v), 2))
    b, items = cooccur.numbered(cooccur.baskets(df))
    got = {(r.grp, r.a, r.b): r.nab for r in cooccur.named(cooccur.pair_counts(b, items, 3), items).collect()}
    assert got == {k: n for k, n in want.items() if n >= 3}


def test_surprise_finds_the_planted_pair(spark):
    _, df = _commits(spark)
    s = cooccur.surprising_pairs(df.withColumn("grp", F.lit("clash"))).where("significant AND nab >= 5").collect()
    assert ("x", "y") in {(r.a, r.b) for r in s}
    assert all(0 <= r.p_value <= 0.01 and r.nab > r.expected for r in s)
    assert cooccur.surprising_pairs(df.limit(0)).count() == 0


def test_registered_queries_keep_rare_pairs(spark, tmp_path):
    data = [(f"c{i}", "r", i, [f"f{i % 40}", f"g{i % 37}"]) for i in range(400)] + [(f"s{i}", "r", i, ["rare/a", "rare/b"]) for i in range(4)]
    spark.createDataFrame(data, "commit_id string, repo string, seconds long, files array<string>").write.parquet(str(tmp_path / "commits.parquet"))
    want = Counter(tuple(sorted(fs)) for _, _, _, fs in data)
    assert min(want.values()) == 1
    assert {(r.path_a, r.path_b): r.nab for r in catalogue.p3_pair_counts(spark, str(tmp_path)).collect()} == want
    got = {(r.path_a, r.path_b): r for r in catalogue.p3_surprise(spark, str(tmp_path)).collect()}
    assert set(got) == set(want)
    assert [k for k, r in got.items() if r.significant] == [("rare/a", "rare/b")]


def test_poisson_binomial_tail_is_exact():
    q, m = np.array([0.1, 0.4, 0.7]), np.array([3.0, 2.0, 2.0])
    p = [x for x, k in zip(q, m) for _ in range(int(k))]
    for k in range(9):
        exact = sum(math.prod(a if s else 1 - a for a, s in zip(p, c)) for c in itertools.product((0, 1), repeat=len(p)) if sum(c) >= k)
        assert abs(_tail(q, m, k) - exact) < 1e-12
    assert 0 < _tail(np.array([1e-4]), np.array([1000.0]), 8) < 1e-12


def test_poisson_binomial_tail_of_large_counts():
    def binomial(n, q, k):
        first, term, total = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(q) + (n - k) * math.log1p(-q)), 1.0, 0.0
        for j in range(k, n + 1):
            total += term
            term *= (n - j) / (j + 1) * q / (1 - q)
            if term < 1e-30:
                break
        return first * total

    for n, q, k in ((200_000, 0.5, 100_001), (200_000, 0.5, 101_300), (1_000_000, 0.1, 100_001), (1_000_000, 0.1, 101_680)):
        got = [_tail(np.full(c, q), np.full(c, n / c), k) for c in (1, 50)]
        assert np.allclose(got, binomial(n, q, k), rtol=1e-6, atol=0)
    assert abs(_tail(np.array([0.5]), np.array([200_000.0]), 100_000) - 0.5) < 1e-3


def test_fit_keeps_both_margins():
    n, c, z, m = np.array([1.0, 3, 9]), np.array([9.0, 5, 2]), np.array([1.0, 3, 6]), np.array([9.0, 3, 4])
    n[2] = ((z * m).sum() - (n[:2] * c[:2]).sum()) / c[2]
    x, y, fitted, met = cooccur.fit_margins(n, c, z, m)
    assert met and np.allclose(fitted, n, rtol=1e-5)
    assert not cooccur.fit_margins(n, c, z, m, sweeps=1)[3]
    p = np.outer(x, y) / (1 + np.outer(x, y))
    assert np.allclose((p * m).sum(1), n, rtol=1e-4) and np.allclose((p * c[:, None]).sum(0), z, rtol=1e-4)


def test_tails_of_many_rows_equal_those_of_one():
    rng = np.random.default_rng(3)
    m = rng.integers(1, 4000, 40).astype(float)
    q = rng.random((300, 40)) ** rng.integers(1, 9, (300, 1))
    q[0, :3], q[1, :3], q[2] = 1.0, 0.0, 0.0
    k = np.maximum(0, np.rint((q * m).sum(1) * rng.uniform(0.2, 3, 300))).astype(int)
    got = cooccur.poisson_binomial_tails(q, m, k)
    assert np.allclose(got, [_tail(a, m, b) for a, b in zip(q, k)], rtol=1e-9, atol=1e-300)
    assert ((0 <= got) & (got <= 1)).all()


def test_rule_is_judged_by_the_frequencies_of_the_null(spark):
    data, df = _commits(spark)
    got = cooccur.lifted_pairs(df, 5, 3).collect()
    assert got and all(r.met and r.ma == r.na and r.mb == r.nb and 0 < r.p_value < 1 for r in got)
    want = {(r.grp, r.a, r.b) for r in cooccur.surprising_pairs(df).collect() if r.nab >= 5 and r.nab * r.n >= 3 * r.na * r.nb}
    assert {(r.grp, r.a, r.b) for r in got} == want
    a = {r.grp: r for r in cooccur.agreement(cooccur.surprising_pairs(df), 5, 3).collect()}
    assert sum(r.ruled for r in a.values()) == len(want) and all(r.both <= min(r.ruled, r.discovered) for r in a.values())
