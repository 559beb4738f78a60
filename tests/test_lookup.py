"""Head and tail of a word look-up; encoders keep every row."""

import pytest
from pyspark.sql import functions as F

from textmill.operators import lookup as L
from textmill.operators import vocab as V
from textmill.session import row_bytes, small_enough


def rows_of(spark, n=4000):
    """Half of all tokens are one word; the others are many."""
    return spark.range(n).select(
        F.when(F.col("id") % 2 == 0, "the").when(F.col("id") % 11 == 0, None)
        .otherwise(F.concat(F.lit("w"), (F.col("id") % 700).cast("string"))).alias("token"), F.col("id").alias("n"))


def table_of(spark):
    words = [("the", 1), (None, 7)] + [(f"w{i}", i + 10) for i in range(0, 600, 3)] + [("x" * 5000, 5), ("unused", 6)]
    return spark.createDataFrame(words, "token string, id long")


@pytest.mark.parametrize("head", [0, 10, 100_000])
def test_rows_equal_a_plain_join(spark, head):
    rows, table = rows_of(spark), table_of(spark)
    want = rows.join(table, "token", "left")
    got = L.lookup(rows, "token", table, max_bytes=0, head_words=head)
    assert got.columns == want.columns
    order = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert order(got) == order(want) == order(L.lookup(rows, "token", table))
    assert L.lookup(rows.limit(0), "token", table, 0, head).count() == 0
    assert order(L.lookup(rows, "token", table.limit(0), 0, head)) == order(rows.withColumn("id", F.lit(None)))


def test_a_hot_word_is_spread(spark):
    confs = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        rows, table = rows_of(spark, 40_000), table_of(spark)

        def largest(head):
            got = L.lookup(rows, "token", table, max_bytes=0, head_words=head)
            n = sorted(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect())
            return n[-1] / n[len(n) // 2]

        assert largest(0) > 3
        assert largest(10) <= 2
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_bytes_are_bounded(spark):
    df = spark.createDataFrame([("a" * 1000, [1.0] * 50, ["b" * 200, None], None)],
                               "s string, v array<double>, w array<string>, n int")
    assert 1600 < df.agg(F.sum(row_bytes(df))).first()[0] < 1800
    assert small_enough(df, 1, 2000) and not small_enough(df, 1, 1000) and not small_enough(df, 0, 2000)
    assert small_enough(df.limit(0), 0, 0)


DOCS = [(1, ["a", "b"]), (1, ["c"]), (1, ["a", "b"]), (None, ["b"]), (None, []), (2, None), (None, ["z", "a"]), (1, [])]
IDS = {"a": 2, "b": 3, "c": 4}


@pytest.fixture(params=[None, 0])
def tables(spark, request, monkeypatch):
    if request.param == 0:  # the head and tail path
        monkeypatch.setattr(L, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(L, "HEAD_WORDS", 1)
    return (spark.createDataFrame(DOCS, "doc_id long, tokens array<string>"),
            spark.createDataFrame([(k, v) for k, v in IDS.items()], "token string, id long"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def want(f):
    return sorted(((d, *f(t or [])) for d, t in DOCS), key=str)


def test_encoders_keep_every_row(tables):
    docs, vocab = tables
    assert rows(V.encode_drop(docs, "tokens", vocab)) == want(lambda t: ([IDS[x] for x in t if x in IDS],))
    fixed = lambda t: [IDS.get(x, 1) for x in t] + [0] * (3 - len(t))
    assert rows(V.encode_fixed(docs, "tokens", vocab, n=3)) == want(lambda t: (fixed(t), len(t)))
    masked = lambda t: ([2] + [IDS.get(x, -1) + 2 if x in IDS else 1 for x in t] + [3] + [0] * (3 - len(t)),
                        [1] * (len(t) + 2) + [0] * (3 - len(t)))
    assert rows(V.encode_masked(docs, "tokens", vocab, n=5)) == want(masked)


def test_token_tables_keep_every_row(spark, tables):
    docs, _ = tables
    words = spark.createDataFrame([("B",), ("z",), ("z",)], "word string")
    assert rows(V.drop_tokens_join(docs, "tokens", words)) == want(lambda t: ([x for x in t if x != "z"],))
    assert rows(V.drop_tokens_join(docs, "tokens", words, case_sensitive=False)) == want(
        lambda t: ([x for x in t if x not in "bz"],))
    lemmas = spark.createDataFrame([("a", "A"), ("c", "C")], "token string, lemma string")
    assert rows(V.lemmatize(docs, "tokens", lemmas)) == want(lambda t: ([{"a": "A", "c": "C"}.get(x, x) for x in t],))


def test_tokens_of_a_text_stay_in_its_task(spark):
    """With a small table whole texts are dealt once; their tokens, one by one, are not."""
    from textmill.operators import vocab as V
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (1, []), (None, None), (2, ["b", None, "c"])], "doc_id long, tokens array<string>")
    words = spark.createDataFrame([("b",)], "word string")
    terms = spark.createDataFrame([("a", 0), ("b", 1)], "term string, id long")
    for got in (V.drop_tokens_join(docs, "tokens", words), V.bag_of_words(docs, "tokens", terms)):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, plan
    kept = V.drop_tokens_join(docs, "tokens", words).collect()
    assert sorted((r.doc_id or 0, r.tokens) for r in kept) == [(0, []), (1, []), (1, ["a", "a"]), (2, ["c"])]
    numbers = V.term_numbers(docs, "tokens").orderBy("id").collect()
    assert [tuple(r) for r in numbers] == [("a", 2, 1, 0), ("b", 2, 2, 1), ("c", 1, 1, 2)]
    assert [r.term for r in V.term_numbers(docs, "tokens", min_docs=2).collect()] == ["b"]


def test_small_tables_are_looked_up_where_the_rows_are(spark):
    """No shuffle of texts or tokens; odd rows and repeated keys as by the join."""
    docs = spark.createDataFrame([(1, ["a", "b", None, "a"]), (1, []), (None, None), (2, ["B", "x"])], "doc_id long, tokens array<string>").repartition(2)
    lemmas = spark.createDataFrame([("a", "A"), ("b", None), (None, "n")], "token string, lemma string")
    one = V.lemmatize(docs, "tokens", lemmas)
    assert "Exchange" not in one._jdf.queryExecution().optimizedPlan().toString() and "Generate" not in one._jdf.queryExecution().toString()
    want = sorted([(1, ["A", "b", "A"]), (1, []), (2, ["B", "x"]), (None, [])], key=str)
    assert sorted(map(tuple, one.collect()), key=str) == want
    twice = lemmas.unionByName(lemmas.where("token = 'b'"))  # a repeated key: one lemma a row of the table
    assert sorted(r.lemmas for r in V.lemmatize(docs, "tokens", twice).collect()) == [[], [], ["A", "b", "b", "A"], ["B", "x"]]
    ids = spark.createDataFrame([("a", 7), ("x", 3)], "token string, id long")
    got = V.encode_drop(docs, "tokens", ids)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, [7, 7]), (1, []), (2, [3]), (None, [])], key=str)
    assert "Generate" not in got._jdf.queryExecution().toString()


def test_mean_where_the_rows_are_equals_pool(spark):
    from textmill.operators.embed import pool, with_mean
    docs = spark.createDataFrame([(1, ["a", "B", None, "a"]), (1, []), (None, None), (2, ["b", "x"]), (3, ["y"] * 5 + ["a"] * 9)],
                                 "doc_id long, tokens array<string>")
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, -1.0]), ("B", [9.0, 9.0])], "token string, vec array<float>")
    for sensitive in (True, False):
        near = with_mean(docs, "tokens", vectors, ["doc_id"], "doc_vec", sensitive)
        got, want = (sorted(((r.doc_id, [round(x, 9) for x in r.doc_vec]) for r in df.collect()), key=str)
                     for df in (near, pool(docs, "tokens", vectors, case_sensitive=sensitive)))
        assert got == want
        assert "Exchange" not in near._jdf.queryExecution().toString()
    assert with_mean(docs, "tokens", vectors.limit(0), ["doc_id"], "doc_vec") is None
