"""Nothing is capped, cut or dropped: many classes, null predictions, documents
without known words, malformed vector lines."""

import pytest
from pyspark.sql import functions as F

from textmill.operators import embed as E
from textmill.operators import evaluate as X
from textmill.operators import labels as L
from textmill.operators import sampling as B
from textmill.sources import io


def test_two_hundred_thousand_labels(spark):
    n = 200_000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("c"), F.col("id")).alias("lab"))
    coded = L.label_codes(df, "lab", "first_seen")
    assert coded.where("code = doc_id").count() == n
    drawn = B.resample_to_class(df, "lab", "c7", 1)
    assert drawn.count() == n and drawn.select("lab").distinct().count() == n


def test_null_predictions_are_misses(spark):
    df = spark.createDataFrame([("a", "a"), ("a", None), ("b", "b")], "label string, pred string")
    assert X.accuracy(df).first()[0] == pytest.approx(2 / 3)
    rep = {r["class"]: r for r in X.classification_report(df).collect()}
    assert set(rep) == {"a", "b", "accuracy", "macro avg", "weighted avg"}
    assert rep["accuracy"].f1 == pytest.approx(2 / 3) and rep["a"].recall == 0.5 and rep["a"].support == 2
    assert rep["macro avg"].recall == pytest.approx(0.75)
    cells = {(r.row_class, r.col_class): r.n for r in X.confusion(df).collect()}
    assert cells == {("a", "a"): 1, ("a", "b"): 0, ("b", "a"): 0, ("b", "b"): 1, ("a", None): 1}
    assert {r.label: r.hits for r in X.accuracy_per_class(df).collect()} == {"a": 1, "b": 1}


def test_confusion_has_no_limit_of_classes(spark):
    df = spark.range(1200).select(F.col("id").alias("label"), F.col("id").alias("pred"))
    got = X.confusion(df)
    assert got.count() == 1200 * 1200 and got.agg(F.sum("n")).first()[0] == 1200


@pytest.mark.parametrize("how,width", [("avg", 2), ("max", 2), ("avg_max", 4)])
@pytest.mark.parametrize("oov", ["skip", "zero"])
@pytest.mark.parametrize("limit", [50_000, 1])
def test_documents_without_known_words_have_zero_vectors(spark, monkeypatch, how, width, oov, limit):
    monkeypatch.setattr(E, "MAX_BROADCAST_VECTORS", limit)
    docs = spark.createDataFrame([(1, ["x", "y", "x"]), (2, ["q"]), (3, []), (4, None)], "doc_id long, tokens array<string>")
    vectors = spark.createDataFrame([("x", [-1.0, 3.0]), ("y", [-4.0, 0.0])], "token string, vec array<float>")
    got = {r.doc_id: r.doc_vec for r in E.pool(docs, "tokens", vectors, how=how, oov=oov).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert all(got[d] == [0.0] * width for d in (2, 3, 4))
    if how != "max":
        assert got[1][:2] == [-2.0, 2.0]
    if how != "avg" and oov == "skip":
        assert got[1][-2:] == [-1.0, 3.0]


def test_malformed_vector_lines(spark):
    lines = spark.createDataFrame([("a 1 2",), ("b 1",), ("c 1 x",), ("",), ("d e 3 4",)], "value string")
    assert sorted(r.token for r in io.parse_word_vectors(lines, 2, on_bad="skip").collect()) == ["a", "d e"]
    marked = io.parse_word_vectors(lines, 2, on_bad="mark").where("vec IS NULL")
    assert sorted(r.token for r in marked.collect()) == ["b 1", "c 1 x"]
    with pytest.raises(Exception, match="no word vector"):
        io.parse_word_vectors(lines, 2).collect()
