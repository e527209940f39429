"""Exact top-k search, hard negatives and importance resampling against brute force, and on awkward rows."""
from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import hard_negatives, resampling, topk, vectors

NAN, INF = float("nan"), float("inf")
COLUMNS = "vec_id long, embedding array<float>, label int, id string, v string, q_block int, score string, rank int, c_ids int"


def table(spark, rows):
    """Vectors with further columns, some named as the operators' own."""
    return spark.createDataFrame([(i, v, lab, "x", "y", 1, "z", 2, 3) for i, v, lab in rows], COLUMNS)


def awkward(seed=3, n=150, width=6):
    rnd = random.Random(seed)
    rows = [(i, [float(np.float32(rnd.gauss(0, 1))) for _ in range(width)], rnd.randrange(3)) for i in range(n)]
    rows += [rows[20], rows[40], (None, [1.0] * width, 1), (500, None, 1), (501, [1.0, None], 1), (502, [1.0, NAN], 1),
             (503, [INF], 0), (520, [], 0), (540, [1.0, 2.0], 2), (560, [0.5] * 12, 2), (600, rows[0][1], None)]
    rows += [(1000 + i, [1.0] * width, i % 3) for i in range(60)]  # one vector that many rows have
    rows += [(2000, [0.25] * width, 1), (2000, [-0.25] * width, 1)]  # one id with two vectors
    return rows


def whole(rows, factor, labelled=False):
    out = {}
    for i, v, lab in rows:
        if i is None or v is None or (labelled and lab is None) or any(x is None or not math.isfinite(x) for x in v):
            continue
        out[(i, tuple(math.floor(factor * x) for x in v), lab if labelled else 0)] = None
    return list(out)


def long_of(x):
    return min(max(x, -2 ** 63), 2 ** 63 - 1)


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def best_of(rows, k, factor, asked):
    data, out = whole(rows, factor), []
    for q in {r[0] for r in data if r[0] % asked == 0}:
        scored = [(dot(v, w), j) for i, v, _ in data if i == q for j, w, _ in data if j != q]
        for rank, (s, j) in enumerate(sorted(scored, key=lambda x: (-x[0], x[1]))[:k], 1):
            out.append((q, rank, j, s))
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"query_rows": 3, "block_rows": 11, "segments": 3, "depth": 5}, {"segments": 9, "block_rows": 40}])
def test_top_k_equals_brute_force(spark, sizes):
    rows = awkward()
    e = table(spark, rows)
    got = topk.top_k(e, e.filter("vec_id % 20 = 0"), k=5, factor=64, **sizes)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == best_of(rows, 5, 64, 20)


def test_top_k_fewer_rows_than_k_and_empty_tables(spark):
    e = table(spark, [(0, [1.0], 1), (20, [-1.0], 1), (7, [2.0], 1)])
    got = sorted(map(tuple, topk.top_k(e, e.filter("vec_id % 20 = 0")).collect()))
    assert got == [(0, 1, 7, 64 * 128), (0, 2, 20, -4096), (20, 1, 0, -4096), (20, 2, 7, -64 * 128)]
    none = e.filter("false")
    assert topk.top_k(e, none).count() == 0 and topk.top_k(none, e).count() == 0
    one = e.filter("vec_id = 0")
    assert topk.top_k(one, one).count() == 0


def test_top_k_sends_few_entries_and_none_too_few(spark):
    """Far fewer entries than pairs pass the cutoff; the cutoff itself is a score that k candidates reach."""
    rnd = np.random.default_rng(5)
    q, c = (rnd.integers(-40, 40, (n, 64)) for n in (20, 4000))
    q_ids, c_ids = np.arange(20) * 20 + 10_000, np.arange(4000)
    row = {"q_block": 0, "c_block": 0, "q_ids": q_ids.tobytes(), "c_ids": c_ids.tobytes()}
    for side, x in (("q", q), ("c", c)):
        x = x.astype(np.int8)
        row |= {f"{side}_width": 64, f"{side}_size": 1, f"{side}_cells": x.tobytes()}
    lists = [topk._lists(80, 2)(row | {"segment": s})[2][0] for s in range(2)]
    known = topk._resolve(20)(row | {"places": lists})
    cutoffs = np.array([known[3][known[1] == i].min() for i in q_ids])
    sent = [topk._sufficient(2)(row | {"segment": s, "cutoffs": cutoffs.tobytes()})[2][0] for s in range(2)]
    assert sum(len(x) for x in sent) // 8 < 0.15 * 20 * 4000
    found = topk._resolve(20)(row | {"places": sent})
    scores = q @ c.T
    for n, i in enumerate(q_ids):
        assert sorted(found[3][found[1] == i].tolist()) == np.sort(scores[n])[-20:].tolist()


def test_huge_components_stay_exact_or_end_at_a_long(spark):
    rows = [(0, [1e15, 1.0], 0), (1, [1e15, 2.0], 0), (2, [-1e15, 3.0], 1), (3, [1e38, 0.0], 1), (4, [3.0, 1e15], 0)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {(r.query_id, r.vec_id): r.score for r in topk.top_k(e, e, factor=1, query_rows=2, block_rows=2).collect()}
    data = [(i, [long_of(x) for x in v]) for i, v, _ in whole(rows, 1)]
    assert got == {(i, j): long_of(dot(v, w)) for i, v in data for j, w in data if i != j}
    assert len(got) == 20


def test_four_russians_scores_equal_products():
    rnd = np.random.default_rng(2)
    for width, low, high in ((64, -150, 150), (7, 0, 9), (17, -2 ** 40, 2 ** 40), (3, -1, 0), (0, 0, 1), (9, -2 ** 31, 2 ** 31 - 1)):
        a, c = rnd.integers(low, high + 1, (5, width)), rnd.integers(low, high + 1, (33, width))
        want = c.astype(object) @ a.astype(object).T if width else np.zeros((33, 5), object)
        assert (hard_negatives.scores(a, c, rows=8).astype(object) == want).all()
    table = hard_negatives.subset_sums(np.array([[1, 2, 4, 8, 16, 32, 64, 128, 5]]), np.int64)
    assert table[0, :, 0].tolist() == list(range(256)) and table[1, 1, 0] == 5


def mined(rows, factor, positives, negatives, low, high, asked):
    data, out = whole(rows, factor, True), set()
    for a in {r[0] for r in data if r[0] % asked == 0}:
        pos, own = set(), [r for r in data if r[0] == a]
        for _, v, lab in own:
            pos |= {(-dot(v, w), j) for j, w, m in data if j != a and m == lab}
        for s, j in sorted(pos)[:positives]:
            neg = sorted({(-dot(v, w), i) for _, v, lab in own for i, w, m in data if m != lab
                          and low * -s <= 100 * dot(v, w) <= high * -s})[:negatives]
            out |= {(a, j, rank, i, -s, -t) for rank, (t, i) in enumerate(neg, 1)}
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"anchor_rows": 2, "block_rows": 13}])
def test_hard_negatives_equal_brute_force(spark, sizes):
    rows = [r for r in awkward(4) if r[0] != 2000]
    got = hard_negatives.mine(table(spark, rows), F.col("vec_id") % 10 == 0, F.col("label"), positives=3, negatives=4, factor=32, **sizes)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == mined(rows, 32, 3, 4, 30, 90, 10)


def test_hard_negatives_empty(spark):
    e = table(spark, awkward())
    label = F.col("label")
    assert hard_negatives.mine(e.filter("false"), F.col("vec_id") % 10 == 0, label).count() == 0
    assert hard_negatives.mine(e, F.lit(False), label).count() == 0
    assert hard_negatives.mine(e, F.lit(True), F.lit(1)).count() == 0  # one label: no negatives


def words_of(text):
    lower = "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def drawn(docs, target, per_cent, least, buckets, longest, seed):
    def features(text):
        w = words_of(text)
        return [" ".join(w[i:i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    def counts(texts):
        return Counter(crc32(f.encode()) % buckets for t in texts for f in features(t))
    s, t = counts(x for _, x in docs), counts(target)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        f = features(text)
        weight = sum(gain[crc32(x.encode()) % buckets] for x in f) // len(f) if f else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(f), weight, score, None, len(words_of(text))])
    able = sorted((r for r in rows if r[3] is not None and r[5] >= least), key=lambda r: (-r[3], r[0]))
    for rank, r in enumerate(able[:per_cent * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.mark.parametrize("longest,per_cent", [(1, 10), (2, 50), (1, 100), (1, 0)])
def test_resample_equals_brute_force(spark, longest, per_cent):
    rnd = random.Random(longest)
    vocabulary = ["Alpha", "beta", "gamma9", "Él", "ÀB", "naïve", "日本", "x", "y", "zz"]
    docs = [(i, " ".join(rnd.choices(vocabulary[:rnd.randrange(2, 11)], k=rnd.randrange(0, 40)))) for i in range(300)]
    docs += [(1000, None), (1001, ""), (1002, "-- \t"), (None, "alpha " * 30), (1003, "beta-" * 50_000), (5, docs[5][1])]
    docs += [(7777, "gamma9 " * 30)] * 90  # one row repeated
    target = ["alpha beta beta", None, "zz naïve"]
    columns = "doc_id long, text string, id string, score string, rank int, weight int, position int"
    d = spark.createDataFrame([(i, t, "a", "b", 1, 2, 3) for i, t in docs], columns)
    b = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(d, b, per_cent=per_cent, least_words=5, buckets=50, longest=longest, seed=9)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == drawn(docs, target, per_cent, 5, 50, longest, 9)


def test_resample_empty(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = d.filter("false")
    assert resampling.resample(none, d).count() == 0
    assert [tuple(r) for r in resampling.resample(d, none).select("doc_id", "n_features", "rank").collect()] == [(1, 3, None)]


def test_cutoff_key_discards_a_quarter_each_round(spark, monkeypatch):
    """Every place of a table with ties, and rounds in proportion to the logarithm."""
    rnd = random.Random(1)
    keys = [(rnd.randrange(40), i) for i in range(3000)] + [(7, 1)] * 500
    df = spark.createDataFrame(keys, "score long, id long").repartition(7)
    ordered, rounds = sorted(keys, key=lambda x: (-x[0], x[1])), []
    chosen = resampling.weighted_median
    monkeypatch.setattr(resampling, "weighted_median", lambda m: rounds.append(sum(s for s, _ in m)) or chosen(m))
    for place in (1, 2, 1750, 2890, 3200, 3500):
        rounds.clear()
        assert resampling.cutoff_key(df, place) == ordered[place - 1]
        assert all(b <= 0.75 * a + 7 for a, b in zip(rounds, rounds[1:]))
    assert resampling.cutoff_key(df, 0) is None


def test_blocks_hold_every_row_once(spark):
    v = spark.range(1000).select(F.col("id"), F.array(F.col("id"), -F.col("id")).alias("v"))
    out = vectors.blocks(v, 64, "test").collect()
    assert sorted(np.concatenate([vectors.numbers(r.ids) for r in out]).tolist()) == list(range(1000))
    assert len({r.block for r in out}) == len(out) and all(len(r.ids) // 8 < 128 for r in out)
