"""Canonical forms, leaks and mixing."""

from __future__ import annotations

import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from filigree.llm import canon, leaks, mixing

DOC = "doc_id long, text string, source string, clash int"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, None, 1) for i, t in texts], DOC)


SAME = [
    ("Dense sensor", "Ｄｅｎｓｅ ｓｅｎｓｏｒ"),
    ("résumé", "résumé"),
    ("This is", "Тһіѕ іѕ"),
    ("áb", "а́b"),
    ("a b", "a　b"),
    ("a b", "a b"),
    ("ab", "a​﻿b"),
    ("é", "e‍́"),
    ("Ëx", "Ёx"),
    ("ó", "ό"),
    ("NOT", "ΝΟΤ"),
    ("カ", "ｶ"),
]
DIFFERENT = [("n²", "n2"), ("a b", "a  b"), ("a", "A"), ("naïve", "naive"), ("a\nb", "a b"), ("ﬁ", "fi"), ("x", "х́"), ("и", "n"), ("1", "l"), ("a-b", "a b")]


def test_canonical_pairs(spark):
    texts = [t for p in SAME + DIFFERENT for t in p]
    got = {r.doc_id: r.canon for r in canon.canonical(docs(spark, enumerate(texts))).collect()}
    for n, (a, b) in enumerate(SAME):
        assert got[2 * n] == got[2 * n + 1], (a, b)
    for n, (a, b) in enumerate(DIFFERENT, len(SAME)):
        assert got[2 * n] != got[2 * n + 1], (a, b)


def test_lookalike_pairs(spark):
    t = [(1, "abc"), (2, "аbc"), (3, "abc"), (4, None), (5, ""), (6, " "), (7, "　"), (8, "ａbc"), (9, "abd"), (1, "abc")]
    got = sorted(tuple(r) for r in canon.lookalike_pairs(docs(spark, t)).collect())
    assert got == [(1, 2), (1, 8), (2, 3), (2, 8), (3, 8)]
    assert canon.lookalike_pairs(docs(spark, t).limit(0)).count() == 0
    c = {r.doc_id: r.spellings for r in canon.lookalike_classes(docs(spark, t)).collect()}
    assert c == {1: 3, 2: 3, 3: 3, 8: 3}
    classes = {r.doc_id: (r.documents, r.links) for r in canon.lookalike_classes(docs(spark, t)).collect()}
    assert classes == {1: (4, 2), 2: (4, 3), 3: (4, 2), 8: (4, 3)} and sum(n for _, n in classes.values()) == 2 * len(got)
    assert sorted(tuple(r) for r in canon.lookalike_links(docs(spark, t)).collect()) == [(2, 1), (8, 1)]


def _words(text):
    return re.findall(r"[^\W_]+", unicodedata.normalize("NFC", text or "").lower())


def test_leaks_against_brute_force(spark):
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([10, 15, 16, 40])))) for i in range(12)] + [(90, None), (91, ""), (0, "second text " * 9)]
    rows = [(100, None), (101, ""), (102, "w1 " * 5000)]
    for d in range(60):
        body = [r.choice(vocab) for _ in range(r.randint(0, 60))]
        _, text = r.choice(items[:12])
        w = text.split()
        a = r.randint(0, max(0, len(w) - 15))
        cut = w[a : a + r.choice([14, 15, 20])]
        rows.append((d, " ".join([*body[:20], *([x.upper() + "," for x in cut] if d % 2 else cut), *body[20:]]).replace(" ", "_" if d % 3 == 0 else " ")))
    want = set()
    for d, text in rows:
        w = _words(text)
        have = {tuple(w[i : i + 15]) for i in range(len(w) - 14)}
        for i, t in items:
            v = _words(t)
            if any(tuple(v[k : k + 15]) in have for k in range(len(v) - 14)):
                want.add((d, i))
    it = spark.createDataFrame([(i, t, "s") for i, t in items], "item_id long, text string, task_set string")
    assert want and {tuple(x) for x in leaks.leaks(docs(spark, rows + rows[:5]), it).collect()} == want
    assert leaks.leaks(docs(spark, rows), it.limit(0)).count() == 0 and leaks.leaks(docs(spark, rows).limit(0), it).count() == 0


def test_texts_of_one_id_do_not_hide_each_other(spark):
    a, b = [f"a{i}" for i in range(15)], [f"b{i}" for i in range(15)]
    # the two texts of document 1 hold the shingles of item 7's first window between them, neither all of it
    left = " ".join([*a[:9], *[f"u{i}" for i in range(9)]])
    right = " ".join([*[f"v{i}" for i in range(5)], *a[5:15], *b])
    d = docs(spark, [(1, left), (1, right), (2, left), (3, " ".join(a)), (3, left)])
    it = spark.createDataFrame([(7, " ".join(a + ["gap"] + b), "s"), (8, " ".join(a), "s"), (7, "other text", "s"), (7, None, "s")], "item_id long, text string, task_set string")
    assert sorted(tuple(x) for x in leaks.leaks(d, it).collect()) == [(1, 7), (3, 7), (3, 8)]


def test_leaks_by_shuffle_are_the_same(spark, monkeypatch):
    d = docs(spark, [(1, " ".join(f"a{i}" for i in range(30))), (2, " ".join(f"a{i}" for i in range(20, 34))), (3, "xx " + " ".join(f"a{i}" for i in range(5, 20)))])
    it = spark.createDataFrame([(7, " ".join(f"a{i}" for i in range(40)), "s")], "item_id long, text string, task_set string")
    monkeypatch.setattr(leaks, "SHIPPED", 0)
    assert sorted(tuple(x) for x in leaks.leaks(d, it).collect()) == [(1, 7), (3, 7)]


def test_splitting_tree_divides_exactly():
    k = [1000, 37, 0, 250]
    m = mixing.splitting_tree(k, 13, 3)
    assert m.sum(0).tolist() == k and (m >= 0).all()
    assert m.sum(1).max() - m.sum(1).min() <= 4
    assert (mixing.splitting_tree(k, 13, 3) == m).all() and not (mixing.splitting_tree(k, 13, 4) == m).all()
    assert np.abs(m[:, 0] - 1000 / 13).max() < 40
    for n in (1, 2, 7, 100):
        s = mixing._step(n, 5)
        assert sorted(i * s % n for i in range(n)) == list(range(n))


def test_splitting_tree_has_no_size_limit():
    k = [2_000_000_000, 10**12, 7, 0]
    m = mixing.splitting_tree(k, 48, 3)
    assert m.sum(0).tolist() == k and (m >= 0).all() and m.sum(1).max() - m.sum(1).min() <= 6
    due = 2e9 / 48
    assert 0 < np.abs(m[:, 0] - due).max() < 6 * np.sqrt(due)
    # the large draw is as even as numpy's own below its limit
    big, small = (np.array([mixing.take(np.random.default_rng(i), np.array([3 * n, n]), 2 * n)[0] for i in range(300)]) for n in (500_000_000, 200_000_000))
    for x, n in ((big, 500_000_000), (small, 200_000_000)):
        sd = np.sqrt(2 * n * 0.75 * 0.25 * (2 * n) / (4 * n - 1))
        assert abs(x.mean() - 1.5 * n) < 4 * sd / np.sqrt(300) and 0.8 < x.std() / sd < 1.2
    few = mixing.take(np.random.default_rng(1), np.array([10**12, 0, 10**12]), 50)
    assert few.sum() == 50 and few[1] == 0
    # a subtree split by a task gives what the driver would have
    whole = mixing.split((0, 48, np.array(k), np.zeros(4, "int64")), 1, 3)
    parts = [x for n in mixing.split((0, 48, np.array(k), np.zeros(4, "int64")), 5, 3) for x in mixing.split(n, 1, 3)]
    assert all(a[:2] == b[:2] and (a[2] == b[2]).all() and (a[3] == b[3]).all() for a, b in zip(whole, parts, strict=True))
    assert mixing._step(4 * 10**9, 7) * (4 * 10**9) < 2**63


def test_shards_hold_their_blocks_to_the_document(mixed, spark, monkeypatch):
    d, t = mixed
    for top in (1024, 2):
        monkeypatch.setattr(mixing, "TOP", top)
        m = mixing.mixture(d, t, total=600, shards=5, block_tokens=20).collect()
        drawn = {s: sum(r.tokens for r in m if r.source == s) for s in ("repo_docs", "small")}
        blocks = [-(-drawn[s] // 20) for s in ("repo_docs", "small")]
        tree = mixing.splitting_tree(blocks, 5, 7)
        for j, s in enumerate(("repo_docs", "small")):
            longest = max(r.tokens for r in m if r.source == s)
            for shard in range(5):
                got, n = sum(r.tokens for r in m if r.source == s and r.shard == shard), int(tree[shard, j])
                assert (n - 1) * (20 - longest) <= got <= n * (20 + longest)
    assert max(r.shard for r in mixing.mixture(d, t, total=600, block_tokens=2).collect()) == 15
    monkeypatch.setattr(mixing, "SHARD_TOKENS", 10)
    assert max(r.shard for r in mixing.mixture(d, t, total=600, block_tokens=2).collect()) > 15


@pytest.fixture
def mixed(spark):
    r = random.Random(2)
    rows = [(i, "token " * r.randint(1, 9), "Repo-Docs" if i % 2 else " repo_docs") for i in range(200)] + [(1000 + i, "hello world", "small") for i in range(5)] + [(2000, "lost", None), (2001, None, "small"), (2002, "", "")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    t = spark.createDataFrame([("repo_docs", 0.4, 1), ("small", 0.3, 3), ("absent", 0.3, 2)], "source string, target_share double, max_repeats int")
    return d, t


def test_mixture_meets_quotas_and_caps(mixed):
    d, t = mixed
    m = mixing.mixture(d, t, total=600, shards=4, block_tokens=20).collect()
    use: dict = {}
    for r in m:
        use[r.doc_id] = use.get(r.doc_id, 0) + 1
    assert len({(r.doc_id, r.use) for r in m}) == len(m)
    assert max(v for k, v in use.items() if k < 1000) == 1 and max(use.values()) == 3
    drawn = {s: sum(r.tokens for r in m if r.source == s) for s in ("repo_docs", "small")}
    longest = max(r.tokens for r in m if r.source == "repo_docs")
    assert 240 - longest < drawn["repo_docs"] <= 240
    assert drawn["small"] == 3 * 5 * 2  # too small: every document as often as allowed
    assert {r.shard for r in m} == {0, 1, 2, 3}
    rep = {r.source: r for r in mixing.mixture_report(d, t, total=600).collect()}
    assert rep["repo_docs"].status == "met" and rep["small"].status == "short" and rep["absent"].status == "absent" and rep[None].status == "no target"
    assert rep["repo_docs"].drawn == drawn["repo_docs"] and rep["small"].most_repeats == 3 and sum(r.actual_share for r in rep.values()) == pytest.approx(1, abs=1e-5)


def test_mixture_of_nothing(mixed):
    d, t = mixed
    assert mixing.mixture(d.limit(0), t).count() == 0
    assert mixing.mixture(d, t.limit(0)).count() == 0
    assert mixing.mixture_report(d.limit(0), t).where(F.col("status") != "absent").count() == 0
