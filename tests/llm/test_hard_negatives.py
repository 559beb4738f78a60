"""Hard negatives against all products."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.llm import hard_negatives as hn
from textmill.llm import queries


def brute(rows, positives, negatives, low, high, step):
    """rows: (id, vector of ints, label); anchors have ids divisible by step."""
    rows = [r for r in rows if None not in r and None not in r[1]]
    out = []
    for i, (a, v, label) in enumerate(rows):
        if a % step:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), b, j, other) for j, (b, w, other) in enumerate(rows)
                  if j != i and len(w) == len(v)]
        scored.sort()
        for s, b, _, _ in [x for x in scored if x[3] == label][:positives]:
            fit = [x for x in scored if x[3] != label and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(a, b, n + 1, x[1], -s, -x[0]) for n, x in enumerate(fit)]
    return sorted(out)


def vectors(seed, n, dim, labels):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dim))
    scale = r.choice([0.2, 1, 1, 7], n)
    m = (centres[r.integers(0, 12, n)] + r.normal(size=(n, dim)) * 0.3) * scale[:, None]
    m[r.random(n) < 0.05] = 0
    m[n // 2] = m[n // 3]  # ties
    return [(i, np.floor(m[i] * 40).astype(int).tolist(), "l%d" % r.integers(0, labels)) for i in range(n)]


@pytest.mark.parametrize("n,dim,labels,block,slices", [(400, 8, 3, 2048, 16_384), (400, 3, 2, 16, 4), (300, 16, 40, 32, 3)])
def test_equals_all_products(spark, monkeypatch, n, dim, labels, block, slices):
    monkeypatch.setattr(hn, "BLOCK", block)
    monkeypatch.setattr(hn, "SLICE", slices)
    rows = vectors(n + dim, n, dim, labels)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<long>, label string").repartition(5)
    got = hn.hard_negatives(df, F.col("vec_id") % 20 == 0)
    want = brute(rows, 5, 3, 50, 95, 20)
    assert sorted(map(tuple, got.collect())) == want
    assert len(want) > 50


def test_ranges_keep_all_that_qualify():
    r = np.random.default_rng(4)
    v = np.floor(r.normal(size=(500, 6)) * r.choice([0, 5, 6], 500)[:, None] * 10).astype(np.int64)
    block = hn._Block(np.arange(500), np.arange(500), np.array(["a"] * 500, object), v)
    pruned = 0
    for q in np.floor(r.normal(size=(60, 6)) * 30).astype(np.int64):
        length = np.sqrt((q.astype(float) ** 2).sum())
        scores = v @ q
        for least in (-500, 0, 1, int(scores.max()) // 2, int(scores.max()), int(scores.max()) + 1):
            cosine = float(block.cosines(np.array([length]), np.array([float(least)]))[0])
            good = set(np.flatnonzero(scores >= least).tolist())
            some = block.candidates(q / length, cosine) if cosine <= 1 else np.empty(0, int)
            assert some is None or good <= set(some.tolist())
            pruned += some is not None and len(some) < 250
    assert pruned > 20


def test_large_numbers_stay_exact(spark):
    big = 1 << 30
    rows = [(0, [big, big - 1], "a"), (1, [big, big - 2], "a"), (2, [big, big // 2], "b"), (3, [big, big // 2 + 1], "b"),
            (4, [1 << 31, 1], "a"), (5, [0, 0], "b")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<long>, label string")
    got = hn.hard_negatives(df, F.col("vec_id") == 0).collect()
    assert sorted(map(tuple, got)) == [x for x in brute(rows[:4] + rows[5:], 5, 3, 50, 95, 9)]


def test_odd_rows(spark):
    rows = [(0, [10, 0], "a", 1), (0, [10, 1], "a", 2), (7, [9, 9], "a", 3), (8, [6, 0], "b", 4), (8, [6, 0], "b", 5),
            (9, [6, 0, 1], "b", 6), (10, [8], "a", 7), (None, [7, 0], "b", 8), (11, None, "b", 9), (12, [7, None], "b", 10),
            (13, [7, 0], None, 11), (20, [-5, 0], "b", 12), (40, [], "a", 13), (41, [], "b", 14)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<long>, label string, row int") \
        .withColumn("bucket", F.lit(1)).withColumn("g", F.lit("x"))
    got = hn.hard_negatives(df, F.col("vec_id") % 20 == 0)
    assert sorted(map(tuple, got.collect())) == brute([r[:3] for r in rows], 5, 3, 50, 95, 20)
    assert hn.hard_negatives(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_query_equals_brute_force(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)], r.randrange(4)) for i in range(300)]
    rows += [(350, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (351, [float("nan")] * 6, 1), (352, [float("inf")] * 6, 1), (353, None, 1),
             (354, [0.5] * 6, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int") \
        .write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.QUERIES["op12_hard_negatives"](spark, str(tmp_path))
    floors = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int).tolist(),
               (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows[:300]]
    assert sorted(map(tuple, got.collect())) == brute(floors, 5, 3, 50, 95, 50)
