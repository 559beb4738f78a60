"""Held-out accuracy, the held-out rule, and odd tables."""

import zlib

import numpy as np

from textmill.llm import rff_classifier as R
from textmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    got = QUERIES["op10_quality_classifier"](spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert len(got) == docs and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    accuracy = (held.predicted == held.quality).mean()
    good, bad = held[held.quality == 1].predicted.mean(), held[held.quality == 0].predicted.mean()
    print("held-out accuracy", accuracy, "kept good", good, "kept bad", bad)
    assert accuracy > 0.97 and good > 0.99 and bad < 0.1


def test_held_out_labels_are_not_learnt_from(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 3000").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("doc_id < 3000")
    a = R.fit_quality(docs, labels)
    b = R.fit_quality(docs, labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - quality, quality) quality"))
    assert np.array_equal(a.beta, b.beta) and np.array_equal(a.values, b.values)


def test_bounded_sample(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    m = R.fit_quality(docs, labels, sample_rows=800)
    got = R.score_quality(docs, m).join(labels, "doc_id") \
        .selectExpr("avg(if(if(score >= 0.3, 1, 0) = quality, 1.0, 0.0)) a").first().a
    assert got > 0.95


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "a b", 9), (3, "a b", 9), (None, "x " * 50_000, None)],
                                 "doc_id long, text string, y int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    m = R.fit_quality(docs, none)
    got = R.score_quality(docs, m)
    assert got.columns == ["doc_id", "text", "y", "score"] and [r.score for r in got.collect()] == [0.5] * 5
    one = spark.createDataFrame([(1, 1), (3, 1), (2, None), (None, 0)], "doc_id long, quality int")
    assert R.score_quality(docs, R.fit_quality(docs, one)).where("score = 1").count() == 5
    two = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1)], "doc_id long, quality int")
    assert R.score_quality(docs.limit(0), R.fit_quality(docs, two)).count() == 0


def test_isotonic():
    knots, values = R.isotonic(np.array([1., 2, 3, 4, 5]), np.array([0., 1, 0, 1, 1]))
    assert (np.diff(knots) > 0).all() and (np.diff(values) >= 0).all()


def test_ridge_equals_an_independent_solution(spark):
    """Weights from the summed normal equations against least squares on the
    stacked rows, and the wave's products against the Gaussian kernel."""
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()]
    model = R.fit_quality(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5),
                          spark.createDataFrame(labels, "doc_id long, quality int"))
    train = [(i, q) for i, q in labels if zlib.crc32(str(i).encode()) % 5 in (1, 2, 3)]
    x = np.array([R.statistics(docs[i]) for i, _ in train])
    y = np.array([float(q > 0) for _, q in train])
    scale = x.std(axis=0)
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, np.where(scale > 1e-9, scale, 1))
    z = np.clip((x - model.mean) / model.scale, -8, 8)
    waves = np.cos(z @ model.weights + model.phases) * np.sqrt(2 / len(model.phases))
    f = np.column_stack([waves, z / np.sqrt(z.shape[1]), np.ones(len(z))])
    width = f.shape[1]
    penalty = np.sqrt(R.RIDGE * len(y) / width + 1e-9)
    beta = np.linalg.lstsq(np.vstack([f, penalty * np.eye(width)]), np.concatenate([y, np.zeros(width)]), rcond=None)[0]
    assert np.allclose(f @ model.beta, f @ beta, atol=1e-6)
    some = z[:60]
    kernel = np.exp(-((some[:, None] - some[None]) ** 2).sum(axis=2) / (2 * R.WIDTH ** 2))
    assert np.abs(waves[:60] @ waves[:60].T - kernel).mean() < 3 / np.sqrt(len(model.phases))


def test_a_column_named_score_is_replaced(spark):
    docs = spark.createDataFrame([(1, "a b", 9), (2, None, None)], "doc_id long, text string, score int")
    model = R.fit_quality(docs, spark.createDataFrame([], "doc_id long, quality int"))
    got = R.score_quality(docs, model)
    assert got.columns == ["doc_id", "text", "score"] and [r.score for r in got.collect()] == [0.5, 0.5]
    assert R.score_quality(docs, model, "text", "text").columns == ["doc_id", "score", "text"]
