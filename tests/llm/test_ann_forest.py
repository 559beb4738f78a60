"""Nearest neighbours against brute force: recall, ties, copies, odd vectors."""

import numpy as np

from textmill.llm.ann_forest import nearest
from textmill.llm.queries import QUERIES

NAN, INF = float("nan"), float("inf")


def brute(rows, queries, k):
    ok = {i: np.array(v, np.float64) for i, v in rows if i is not None and v is not None and None not in v
          and np.isfinite(v).all() and np.any(v)}
    out = {}
    for q in queries:
        if q in ok:
            s = sorted((-np.dot(ok[q], v) / np.sqrt(np.dot(ok[q], ok[q]) * np.dot(v, v)), i) for i, v in ok.items() if i != q)
            out[q] = [(i, -x) for x, i in s[:k]]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_small_table_is_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).round(1).tolist()) for i in range(150)]
    rows += [(200 + i, [0.5, 0.5, -1.0, 2.0]) for i in range(40)]          # copies: ties by id
    rows += [(300, [1.0, 1.0, -2.0, 4.0]), (301, None), (302, [0.0] * 4), (303, [1.0, None, 0.0, 0.0]),
             (304, [NAN, 1.0, 1.0, 1.0]), (305, [INF, 1.0, 1.0, 1.0]), (None, [1.0, 0.0, 0.0, 0.0]), (306, [1e200, 0.0, 0.0, 1e200])]
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<double>, v string, ids int")
    got = result(nearest(df.repartition(5), df.where("vec_id % 5 = 0"), k=5, depth=3))
    want = brute([(i, v) for i, v in rows if i != 306], [i for i, _ in rows if i is not None and i % 5 == 0], 5)
    big = {q: [x for x in v if x[0] != 306] for q, v in got.items()}
    assert set(got) == set(want)
    for q, w in want.items():
        if len(big[q]) == 5:
            assert [i for i, _ in got[q]] == [i for i, _ in w], q
            assert np.allclose([s for _, s in got[q]], [s for _, s in w], rtol=0, atol=1e-12)


def test_few_rows_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0]), (7, [1.0, 1.0]), (9, [1.0])], schema)
    got = nearest(df, df.where("vec_id % 50 = 0")).select("query_id", "rank", "vec_id").collect()
    again = [(50, 1, 50), (50, 2, 7), (50, 3, 0)]  # two rows of one id: each a query, each the other's neighbour
    assert sorted(map(tuple, got)) == sorted([(0, 1, 7), (0, 2, 50), (0, 3, 50), *again, *again])
    assert nearest(df.limit(0), df).count() == 0 and nearest(df, df.limit(0)).count() == 0
    one = df.where("vec_id = 7")
    assert nearest(one, one).count() == 0


def test_no_query_is_lost(spark):
    """The table's vectors have three components, most queries have two."""
    rows = [(i, [float(i % 7), 1.0, float(i)]) for i in range(51, 91)] + [(50, [1.0, 1.0, 1.0])]
    rows += [(100, [1.0, 2.0]), (150, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = result(nearest(df, df.where("vec_id % 50 = 0")))
    assert [i for i, _ in got[50]] == [i for i, _ in brute(rows[:41], [50], 5)[50]] and set(got) == {50}


def test_rows_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1]), (3, [0.1, 1.0]), (0, [3.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest(df, df.where("vec_id = 1"), k=2).select("query_id", "rank", "vec_id").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 2), (1, 1, 3), (1, 2, 0), (1, 2, 0)]
    found = result(nearest(df, df.where("vec_id = 0"), k=4))
    assert [i for i, _ in found[0]] == [2, 3, 1, 1]


def test_scaling_changes_no_tie(spark):
    """Cosines that are equal in double precision stay equal, whatever the
    largest component: the smaller id wins."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(30, 5))
    rows = [(0, base[0].tolist())] + [(2 * i + c, (base[i] * f).tolist()) for i in range(1, 30) for c, f in ((1, 2.0 ** 40), (0, 2.0 ** -3))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = result(nearest(df, df.where("vec_id = 0"), k=20))[0]
    assert [i for i, _ in got] == [i for i, _ in brute(rows, [0], 20)[0]]
    assert all(a[1] == b[1] and a[0] + 1 == b[0] for a, b in zip(got[::2], got[1::2]))


def test_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows, [i for i, _ in rows if i % 50 == 0], 5)
    got = result(QUERIES["op7_ann_forest"](spark, sf))
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert all(abs(s - dict(want[q]).get(i, s)) < 1e-12 for q, v in got.items() for i, s in v)
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    less = result(nearest(df, df.where("vec_id % 50 = 0"), search=800, search_share=0.4))
    for name, found, least in (("full", got, 0.99), ("share", less, 0.85)):
        recall = np.mean([len({i for i, _ in found[q]} & {i for i, _ in w}) / 5 for q, w in want.items()])
        print(name, recall)
        assert recall >= least
