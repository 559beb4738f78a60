"""Exact quantiles by value counts, holdout over gappy ids, row ids that do not
depend on file packing, encoders that keep empty documents."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.operators import sampling as B
from textmill.operators import stats as A
from textmill.operators import vocab as V
from textmill.sources import io


@pytest.mark.parametrize("values", [[5], [1, 1, 1, 9], list(range(100)), [2, 2, 7, 7, 7, 100, 3, None], [-5, 0, 12_345_678]])
def test_exact_quantiles(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x long").repartition(3)
    known = np.array([v for v in values if v is not None], float)
    for q in (0.0, 0.25, 0.9, 1.0):
        assert A.quantile(df, "x", q).first().q == pytest.approx(np.quantile(known, q))
    d = A.describe(df, "x").first()
    assert (d["count"], d["min"], d["max"]) == (len(known), known.min(), known.max())
    assert d["mean"] == pytest.approx(known.mean()) and d["p50"] == pytest.approx(np.median(known))
    assert (d["std"] is None) if len(known) == 1 else d["std"] == pytest.approx(known.std(ddof=1))


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x long")
    assert A.quantile(df, "x").first().q is None
    d = A.describe(df, "x").first()
    assert d["count"] == 0 and d["mean"] is None and d["p25"] is None


def test_holdout_with_gaps_and_an_outlier(spark):
    ids = [10 ** 12] + [i * i * 7 for i in range(999)]
    random.Random(1).shuffle(ids)
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long").repartition(6)
    got = {r.doc_id: r.split for r in B.holdout(df, 0.2).collect()}
    assert [got[i] for i in sorted(ids)] == ["train"] * 800 + ["val"] * 200


def test_row_ids_do_not_depend_on_packing(spark, tmp_path):
    for k in range(6):
        rows = "".join(f'"text {k} {i}\nline",{i % 5}\n' for i in range(7))
        (tmp_path / f"part{k}.csv").write_text("review_body,star_rating\n" + rows)
    seen = []
    for size in ("128m", "1"):
        spark.conf.set("spark.sql.files.openCostInBytes", size if size != "1" else "0")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m" if size != "1" else "64")
        try:
            seen.append({r.doc_id: r.review_body for r in io.read_reviews(spark, str(tmp_path)).collect()})
        finally:
            spark.conf.unset("spark.sql.files.openCostInBytes")
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1] and sorted(seen[0]) == list(range(42))


def test_word_joins_keep_empty_documents(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (3, []), (4, None)], "doc_id long, tokens array<string>")
    words = spark.createDataFrame([("b",), ("b",)], "word string")
    assert {r.doc_id: r.tokens for r in V.drop_tokens_join(docs, "tokens", words).collect()} == {
        1: ["a", "a"], 2: [], 3: [], 4: []}
    lemmas = spark.createDataFrame([("a", "A")], "token string, lemma string")
    assert {r.doc_id: r.lemmas for r in V.lemmatize(docs, "tokens", lemmas).collect()} == {
        1: ["A", "b", "A"], 2: ["b"], 3: [], 4: []}


def test_scans(spark, tmp_path):
    """One scan of the rows for the confusion table, the report and the leak."""
    path = str(tmp_path / "p")
    spark.range(60).select((F.col("id") % 3).alias("label"), (F.col("id") % 4).alias("pred"),
                           F.lit("train").alias("split")).write.parquet(path)
    from textmill.operators import evaluate as X
    df = spark.read.parquet(path)
    for out in (X.confusion(df), X.classification_report(df), A.split_leakage(df, "label", "pred")):
        assert "FileScan" not in out._jdf.queryExecution().executedPlan().toString()  # reads what one pass has written
    arrays = df.select(F.array(F.col("label").cast("string")).alias("labels"), F.array(F.col("pred").cast("string")).alias("result"))
    plan = X.multilabel_report(arrays, ["0", "1", "2"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 2
