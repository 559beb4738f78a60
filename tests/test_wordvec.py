"""Word vectors by factorised co-occurrence, against NumPy."""

import numpy as np

from textmill.operators import wordvec as W
from textmill.operators.embed import train_word_vectors


def texts(seed, n=80):
    r = np.random.default_rng(seed)
    topics = [[f"{t}{i}" for i in range(8)] for t in "abc"]
    return [(i, [str(x) for x in r.choice(topics[i % 3], r.integers(0, 30))] + ["all"]) for i in range(n)]


def plain_pairs(rows, window):
    n = {}
    for _, ids in rows:
        for i, x in enumerate(ids):
            for y in ids[i + 1:i + 1 + window]:
                n[min(x, y), max(x, y)] = n.get((min(x, y), max(x, y)), 0) + 1
    return n


def test_pairs_and_weights(spark):
    rows = [(1, [1, 2, 1, 3]), (1, [2]), (2, []), (3, None), (4, [5, 5]), (5, list(range(1, 30)) * 3)]
    df = spark.createDataFrame(rows, "doc_id long, ids array<long>")
    for window in (1, 5):
        pairs = W.cooccurrence(df, "ids", window).cache()
        want = plain_pairs([r for r in rows if r[1]], window)
        assert {(a, b): n for a, b, n in pairs.collect()} == want
    both = {**want, **{(b, a): n for (a, b), n in want.items()}}
    s = {}
    for (a, _), n in both.items():
        s[a] = s.get(a, 0) + n
    total = sum(s.values())
    m = {(a, b): np.log(n * total / s[a] / s[b]) for (a, b), n in both.items()}
    got = {(r.i, r.j): r.m for r in W.positive_pmi(pairs).collect()}
    assert got.keys() == {k for k, x in m.items() if x > 0}
    assert all(abs(x - m[k]) < 1e-9 for k, x in got.items())


def test_leading_vectors_equal_numpy(spark):
    r = np.random.default_rng(2)
    a = np.where(r.random((30, 30)) < 0.3, r.random((30, 30)), 0)
    a = a + a.T + np.diag([20.0, 15.0, 11.0] + [0.0] * 27)
    rows = [(i, j, float(a[i, j])) for i in range(30) for j in range(30) if a[i, j] > 0]
    got = W.leading_vectors(spark.createDataFrame(rows, "i long, j long, m double"), 3, steps=12)
    x = np.array([v for _, v in sorted((r.i, r.v) for r in got.collect())])
    values, vectors = np.linalg.eigh(a)
    best = np.argsort(-np.abs(values))[:3]
    want = vectors[:, best] * np.sqrt(np.abs(values[best]))
    assert np.allclose(np.abs(x), np.abs(want), atol=1e-4)


def test_vectors_do_not_depend_on_tasks(spark):
    rows = texts(1)
    df = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    one, many = ({r.token: np.array(r.vec) for r in train_word_vectors(df.repartition(n, "doc_id"), "tokens", dim=4, min_count=3).collect()}
                 for n in (1, 7))
    assert one.keys() == many.keys() and len(one) == 25
    assert all(np.allclose(one[t], many[t], atol=1e-5) for t in one)
    near = lambda a, b: one[a] @ one[b] / np.linalg.norm(one[a]) / np.linalg.norm(one[b])
    assert min(near("a1", "a2"), near("b3", "b4")) > max(near("a1", "b1"), near("b3", "c2"))


def test_small_and_odd_tables(spark):
    df = spark.createDataFrame([(1, ["x"]), (1, ["x"]), (None, None), (2, [])], "doc_id long, tokens array<string>")
    assert [tuple(r) for r in train_word_vectors(df, "tokens", dim=2, min_count=2).collect()] == [("x", [0.0, 0.0])]
    assert train_word_vectors(df.limit(0), "tokens", dim=2).count() == 0


def test_vectors_come_by_broadcast_a_few_columns_at_a_time(spark):
    """The product is the same with any room, and the small sums of words are no shuffle join."""
    r = np.random.default_rng(3)
    a = np.where(r.random((12, 12)) < 0.4, r.random((12, 12)), 0)
    table = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(12) for j in range(12) if a[i, j]], "i long, j long, m double").cache()
    x = r.random((12, 5))
    rows = spark.createDataFrame([(i, x[i].tolist()) for i in range(12)], "i long, v array<double>")
    counts = table.groupBy("j").count().withColumnRenamed("count", "n")
    for room in (0, 12 * 40, 12 * 48, 1 << 20):  # none, one, two and all columns
        got = {q.i: q.v for q in W._times(table, counts, table.count(), rows, 12, 5, room).collect()}
        assert all(np.allclose(v, (a @ x)[i]) for i, v in got.items()) and len(got) == (a.any(axis=1)).sum()
    pairs = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (2, 3, 1)], "a long, b long, n long")
    plan = W.positive_pmi(pairs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_pairs_cross_the_shuffle_as_arrays(spark, monkeypatch):
    """Counted where the texts are, also where a text is cut into pieces or an id is null."""
    r = np.random.default_rng(5)
    rows = [(i, [int(x) - 6 for x in r.integers(0, 12, r.integers(0, 40))]) for i in range(60)]
    rows += [(60, [1, None, 2]), (61, [None, None]), (62, [3])]
    df = spark.createDataFrame(rows, "doc_id long, ids array<long>").repartition(3)
    want = plain_pairs(rows[:60], 4)
    for a, b in ((1, 1), (1, 2), (2, 2)):  # a null is passed over
        want[a, b] = want.get((a, b), 0) + 1
    want[None, None] = 1
    for tokens, parts in ((1 << 19, 1 << 12), (7, 3)):
        monkeypatch.setattr(W, "PAIR_TOKENS", tokens)
        monkeypatch.setattr(W, "PAIR_PARTS", parts)
        pairs = W.cooccurrence(df, "ids", 4)
        got = [tuple(x) for x in pairs.collect()]
        assert len(got) == len(want) and {(a, b): n for a, b, n in got} == want
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" not in plan and "Generate explode" not in plan
