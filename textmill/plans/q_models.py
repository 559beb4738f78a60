"""Registered queries: training and scoring M1-M7, F2, F3/E4, S7, O4, ST1.

Predictions have no SQL oracle; what is deterministic around them has (split
members, equality of saved and streamed scores).  pytest checks accuracy on a
separable fixture (tests/test_models.py).  Training follows the reference's order:
split first, train on the training split, score the test split.
"""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from textmill.functions import text as T
from textmill.operators import models as M
from textmill.operators.clean import CleanText
from textmill.operators.evaluate import classification_report
from textmill.operators.sampling import random_split, stratified_split
from textmill.operators.embed import pool
from textmill.plans import sqlfrag as S
from textmill.operators.linear import sql_linear_svm
from textmill.operators.pipeline import main_pipeline, vector_stages
from textmill.plans.q_embed import FOLDED_SQL, ZERO_SQL, word_vectors
from textmill.plans.q_vocab import _lemma_table, _stops_sql
from textmill.functions.hashing import sql_hash, sql_uniform
from textmill.plans.q_sampling import SEED, _strat_sql
from textmill.plans.registry import query, table
from textmill.plans.sqlfrag import round6_sql as r6
from textmill.session import barrier, ensure_checkpoint_dir
from textmill.sources.io import load_model, save_model
from textmill.streaming.score import score_stream


def _scratch(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}_{uuid.uuid4().hex}"


def _emb_split(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    return stratified_split(e, "label", 0.2, SEED)


@query("m1_logreg_embeddings")
def q_m1_logreg(spark, sf):
    s = _emb_split(spark, sf)
    m = M.train_classifier(s.where(F.col("split") == "train"), "embedding", "label", kind="logreg", max_iter=30)
    return M.score(s.where(F.col("split") == "test"), m).select("doc_id", "label", F.col("prediction").cast("int"))


@query("m1_mlp_embeddings")
def q_m1_mlp(spark, sf):
    s = _emb_split(spark, sf)
    m = M.train_classifier(s.where(F.col("split") == "train"), "embedding", "label", kind="mlp", max_iter=30,
                           dim=64, n_classes=10)
    return M.score(s.where(F.col("split") == "test"), m).select("doc_id", "label", F.col("prediction").cast("int"))


def _docs_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", "lang")


@query("m5_text_pipeline_report")
def q_m5(spark, sf):
    """Clean -> tokenize -> averaged word vectors -> logistic regression,
    trained on the stratified training split, reported on the test split."""
    s = stratified_split(_docs_text(spark, sf), "lang", 0.25, SEED)
    model = M.fit_text_pipeline(s.where(F.col("split") == "train"), text="text", label="lang", dim=32)
    scored = M.score(s.where(F.col("split") == "test"), model, labels_from="label_idx")
    return classification_report(scored, "lang", "predicted_label").select(
        "class", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"),
        F.round("f1", 6).alias("f1"), "support")


def _tables(spark, sf):
    """The lemma and the vector table, written for the pipeline's look-ups."""
    lemmas, vectors = _scratch(spark, "lemmas"), _scratch(spark, "vectors")
    _lemma_table(spark, sf).write.parquet(lemmas)
    word_vectors(spark, sf).write.parquet(vectors)
    return lemmas, vectors


@query("m5_main_pipeline_vectors", sql=f"""
WITH wv AS {FOLDED_SQL},
toks AS (SELECT DISTINCT unnest({S.tokenize('text')}) AS token FROM documents),
lem AS (SELECT token, substr(token, 1, length(token) - 1) AS lemma FROM toks
        WHERE suffix(token, 's') AND length(token) > 3 AND substr(token, 1, length(token) - 1) IN (SELECT token FROM toks)),
t AS (SELECT doc_id, unnest(list_filter(list_transform({S.split_ws('text')},
        lambda t: regexp_replace(lower(t), '[^\\p{{L}}+]', '', 'g')), lambda t: t <> '' AND NOT list_contains({_stops_sql()}, t))) AS token
      FROM documents),
c AS (SELECT doc_id, lower(coalesce(lemma, token)) AS token, count(*) AS n FROM t LEFT JOIN lem USING (token) GROUP BY ALL),
u AS (SELECT c.doc_id, c.n, unnest(w.vec)::DOUBLE AS x, generate_subscripts(w.vec, 1) AS k FROM c JOIN wv w USING (token)),
a AS (SELECT doc_id, k, sum(n * x) / sum(n) AS m FROM u GROUP BY doc_id, k),
p AS (SELECT doc_id, list({r6('m')} ORDER BY k) AS doc_vec FROM a GROUP BY doc_id)
SELECT d.doc_id, coalesce(p.doc_vec, {ZERO_SQL}) AS doc_vec FROM documents d LEFT JOIN p USING (doc_id)""")
def q_main_vectors(spark, sf):
    """The main pipeline's document vectors, from its saved and loaded stages."""
    model = M.scoring_pipeline(vector_stages(*_tables(spark, sf)))
    path = _scratch(spark, "vector_stages")
    save_model(model, path)
    out = load_model(path).transform(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.transform("doc_vec", lambda x: F.round(x, 6)).alias("doc_vec"))


@query("m5_main_pipeline_report")
def q_main_report(spark, sf):
    """normalise -> stop words -> lemmas -> averaged vectors -> classifier:
    split first, fitted on the training split, reported on all test rows."""
    s = stratified_split(_docs_text(spark, sf), "lang", 0.25, SEED)
    model = main_pipeline(*_tables(spark, sf), label="lang").fit(s.where(F.col("split") == "train"))
    scored = M.score(s.where(F.col("split") == "test"), model, labels_from="label_idx")
    return classification_report(scored, "lang", "predicted_label").select(
        "class", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"),
        F.round("f1", 6).alias("f1"), "support")


@query("m6_m7_s7_save_load_score", sql=f"""
SELECT doc_id, TRUE AS same FROM {_strat_sql(0.25, cols='doc_id, lang')} WHERE split = 'test'""")
def q_m6(spark, sf):
    """Fit, save with overwrite, load back, rebuild a scoring pipeline around
    the loaded stages, score again: whether both models predict the same."""
    s = stratified_split(_docs_text(spark, sf), "lang", 0.25, SEED)
    model = M.fit_text_pipeline(s.where(F.col("split") == "train"), text="text", label="lang", dim=16)
    path = _scratch(spark, "model")
    save_model(model, path)
    loaded = load_model(path)
    rebuilt = M.scoring_pipeline(list(loaded.stages))
    test = s.where(F.col("split") == "test")
    a = M.score(test, model).select("doc_id", F.col("prediction").alias("pred_fitted"))
    b = M.score(test, rebuilt).select("doc_id", F.col("prediction").alias("pred_loaded"))
    return a.join(b, on="doc_id").select("doc_id", (F.col("pred_fitted") == F.col("pred_loaded")).alias("same"))


def _with_doc_vec(spark, sf, d):
    """Adds ``doc_vec``: the average of the text's word vectors."""
    tokens = d.select("doc_id", T.tokenize("text").alias("tokens"))
    vectors = pool(tokens, "tokens", word_vectors(spark, sf), how="avg")
    return barrier(d.drop("text").join(vectors, on="doc_id"))


@query("m2_sentiment_binary")
def q_m2(spark, sf):
    """Binary classifier (quality 0/1) on averaged word vectors."""
    d = table(spark, sf, "documents").select("doc_id", "text").join(
        table(spark, sf, "labels").select("doc_id", "quality"), on="doc_id")
    d = _with_doc_vec(spark, sf, d)
    s = stratified_split(d, "quality", 0.2, SEED)
    m = M.train_classifier(s.where(F.col("split") == "train"), "doc_vec", "quality", kind="binary", max_iter=20)
    return M.score(s.where(F.col("split") == "test"), m).select(
        "doc_id", "quality", F.col("prediction").cast("int").alias("prediction"),
        F.round(vector_to_array("probability")[1], 6).alias("p1"))


def _multilabel(spark, sf):
    """(doc_id, labels, doc_vec, split): a tenth held out."""
    lab = table(spark, sf, "labels")
    labels_arr = F.filter(F.array(F.when(F.col("quality") == 1, F.lit("quality")),
                                  F.when(F.col("toxic") == 1, F.lit("toxic"))), lambda x: x.isNotNull())
    d = table(spark, sf, "documents").select("doc_id", "text").join(
        lab.select("doc_id", labels_arr.alias("labels")), on="doc_id")
    return random_split(_with_doc_vec(spark, sf, d), 0.1, SEED, ["doc_id"])


@query("m3_multilabel")
def q_m3(spark, sf):
    """All labels (quality, toxic) in one fit, threshold 0.5; the held-out rows
    with their labels and predictions."""
    s = _multilabel(spark, sf)
    models = M.train_multilabel(s.where("split = 'train'"), "doc_vec", "labels", ["quality", "toxic"])
    return M.predict_multilabel(s.where("split = 'test'"), "doc_vec", models).select("doc_id", "labels", "result")


@query("m3_test_rows", sql=f"""
SELECT d.doc_id, list_filter([CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS labels
FROM documents d JOIN labels USING (doc_id) WHERE {sql_uniform(SEED, 'd.doc_id')} >= 0.9""")
def q_m3_rows(spark, sf):
    """Ids and labels of the rows that M3 is scored on."""
    return _multilabel(spark, sf).where("split = 'test'").select("doc_id", "labels")


@query("m3_multilabel_validation")
def q_m3_val(spark, sf):
    """M3 with a 0.1 validation share held out; X9 report on it."""
    lab = table(spark, sf, "labels")
    labels_arr = F.filter(F.array(F.when(F.col("quality") == 1, F.lit("quality")),
                                  F.when(F.col("toxic") == 1, F.lit("toxic"))), lambda x: x.isNotNull())
    d = table(spark, sf, "documents").select("doc_id", "text").join(
        lab.select("doc_id", labels_arr.alias("labels")), on="doc_id")
    d = _with_doc_vec(spark, sf, d)
    _, report = M.fit_multilabel_with_validation(d, "doc_vec", "labels", ["quality", "toxic"], 0.1)
    return report


def _unit_sql(src: str) -> str:
    """Examples of the linear SVM over a relation (doc_id, text)."""
    return f"""WITH c AS (SELECT doc_id AS row, term, count(*) AS n FROM (SELECT doc_id, unnest({S.tokenize('text')}) AS term FROM {src})
GROUP BY ALL) SELECT row, term, n / sqrt(CAST(sum(n * n) OVER (PARTITION BY row) AS DOUBLE)) AS x FROM c
UNION ALL SELECT doc_id, '', 1.0::DOUBLE FROM {src}"""


def _coded_sql(src: str) -> str:
    return f"SELECT doc_id AS row, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS y FROM {src}"


_SVM_TRAIN = f"(SELECT doc_id, text, lang FROM {_strat_sql(0.33, cols='doc_id, lang, text')} WHERE split = 'train')"
_SVM_TEST = f"(SELECT doc_id, text, lang FROM {_strat_sql(0.33, cols='doc_id, lang, text')} WHERE split = 'test')"
SVM_STEPS, SVM_CLASSES, SVM_REG = 8, 4, 0.001


@query("m4_bow_svm", sql=f"""
WITH {sql_linear_svm(_unit_sql(_SVM_TRAIN), _coded_sql(_SVM_TRAIN), SVM_CLASSES, SVM_STEPS, SVM_REG)},
te AS ({_unit_sql(_SVM_TEST)}),
mt AS (SELECT row, {', '.join(f'sum(x * coalesce(w{c}, 0)) AS s{c}' for c in range(SVM_CLASSES))}
       FROM te LEFT JOIN weights USING (term) GROUP BY row)
SELECT d.doc_id, d.lang, CAST(list_position([s0, s1, s2, s3], greatest(s0, s1, s2, s3)) - 1 AS INTEGER) AS prediction
FROM mt JOIN {_SVM_TEST} d ON d.doc_id = mt.row""")
def q_m4(spark, sf):
    s = stratified_split(_docs_text(spark, sf), "lang", 0.33, SEED).withColumn("tokens", T.tokenize("text"))
    m = M.train_svm(s.where(F.col("split") == "train"), "tokens", "lang", max_iter=SVM_STEPS, reg=SVM_REG)
    return M.score(s.where(F.col("split") == "test"), m).select("doc_id", "lang", F.col("prediction").cast("int"))


@query("o4_top_features", sql=f"""
WITH {sql_linear_svm(_unit_sql('documents'), _coded_sql('documents'), SVM_CLASSES, SVM_STEPS, SVM_REG)},
l AS ({' UNION ALL '.join(f'SELECT {c} AS class_index, term, w{c} AS weight FROM weights' for c in range(SVM_CLASSES))}),
k AS (SELECT DISTINCT lang AS label, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS class_index FROM documents)
SELECT class_index, label, term, {r6('weight')} AS weight,
       CAST(row_number() OVER (PARTITION BY class_index ORDER BY weight DESC, term) AS INTEGER) AS rank
FROM l JOIN k USING (class_index) WHERE term <> ''
QUALIFY row_number() OVER (PARTITION BY class_index ORDER BY weight DESC, term) <= 10""")
def q_o4(spark, sf):
    """The words that weigh most for each class in the linear SVMs."""
    d = _docs_text(spark, sf).withColumn("tokens", T.tokenize("text"))
    model = M.train_svm(d, "tokens", "lang", max_iter=SVM_STEPS, reg=SVM_REG)
    return M.top_features(model, spark, 10).withColumn("weight", F.round("weight", 6))


@query("f2_clean_text_stage", sql=f"SELECT doc_id, clean AS clean_text FROM {S.clean_cte('documents')}")
def q_f2(spark, sf):
    """The cleaning stage saved and loaded back, then applied."""
    stage = CleanText(inputCol="text", outputCol="clean_text")
    path = _scratch(spark, "clean_stage")
    stage.write().overwrite().save(path)
    loaded = CleanText.load(path)
    return loaded.transform(_docs_text(spark, sf)).select("doc_id", "clean_text")


@query("e4_encode_batch", sql=f"""
WITH w AS (SELECT doc_id, unnest({S.split_ws('lower(text)')}) AS w FROM documents),
c AS (SELECT doc_id, CAST({sql_hash(7, 'w')} % 64 AS INTEGER) AS b, count(*) AS n FROM w GROUP BY ALL),
m AS (SELECT doc_id, map_from_entries(list((b, n))) AS m, sqrt(sum(n * n)) AS norm FROM c GROUP BY doc_id)
SELECT d.doc_id, list_transform(range(64), lambda i: {r6('coalesce(m.m[CAST(i AS INTEGER)] / m.norm, 0.0)')}) AS doc_vec
FROM documents d LEFT JOIN m USING (doc_id)""")
def q_e4(spark, sf):
    d = M.hashed_vectors(_docs_text(spark, sf), "text", 64, 7)
    return d.select("doc_id", F.transform("doc_vec", lambda x: F.round(x, 6)).alias("doc_vec"))


@query("m1_m4_test_splits", sql=f"""
SELECT 'm1' AS model, vec_id AS doc_id, CAST(label AS VARCHAR) AS label FROM
  {_strat_sql(0.2, src='(SELECT vec_id, label FROM embeddings)', label='label', keys=('vec_id',), cols='vec_id, label')} WHERE split = 'test'
UNION ALL SELECT 'm4', doc_id, lang FROM {_strat_sql(0.33, cols='doc_id, lang')} WHERE split = 'test'
UNION ALL SELECT 'm5', doc_id, lang FROM {_strat_sql(0.25, cols='doc_id, lang')} WHERE split = 'test'""")
def q_splits(spark, sf):
    """Ids and labels of the rows that M1, M4 and M5 to M7 are scored on."""
    parts = []
    for name, df, label in (("m1", _emb_split(spark, sf), "label"),
                            ("m4", stratified_split(_docs_text(spark, sf), "lang", 0.33, SEED), "lang"),
                            ("m5", stratified_split(_docs_text(spark, sf), "lang", 0.25, SEED), "lang")):
        parts.append(df.where(F.col("split") == "test").select(
            F.lit(name).alias("model"), "doc_id", F.col(label).cast("string").alias("label")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("st1_score_stream", sql=f"""
SELECT doc_id, lang, TRUE AS same FROM {_strat_sql(0.25, cols='doc_id, lang')} WHERE split = 'test'""")
def q_st1(spark, sf):
    """Score the documents as a file stream with a saved pipeline, read the
    result back from the stream's parquet sink, and compare it with the batch."""
    s = stratified_split(_docs_text(spark, sf), "lang", 0.25, SEED)
    model = M.fit_text_pipeline(s.where(F.col("split") == "train"), text="text", label="lang", dim=16)
    mpath, src = _scratch(spark, "stream_model"), _scratch(spark, "stream_in")
    out, ckpt = _scratch(spark, "stream_out"), _scratch(spark, "stream_ckpt")
    save_model(model, mpath)
    test = s.where(F.col("split") == "test").select("doc_id", "text", "lang")
    test.repartition(4).write.parquet(src)
    q = score_stream(spark, src, test.schema, mpath, out, ckpt, keep=["doc_id", "lang", "prediction"],
                     max_files_per_trigger=2)
    q.awaitTermination()
    batch = M.score(spark.read.parquet(src), load_model(mpath)).select("doc_id", F.col("prediction").alias("batch"))
    return spark.read.parquet(out).join(batch, on="doc_id").select(
        "doc_id", "lang", (F.col("prediction") == F.col("batch")).alias("same"))
