"""Registered queries: evaluation X1-X10, W4, M8, S8.

Metrics need only a prediction table.  The deterministic stand-in (from
``documents``): label = sorted code of ``lang``; prediction = the label,
moved to the next class where a seeded hash of ``doc_id`` is 0 mod 5;
logits = seeded uniforms plus 2 on the predicted class.  Multi-label truth
comes from ``labels`` (quality, toxic).
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textmill.functions.hashing import seeded_hash, seeded_uniform, sql_hash, sql_uniform
from textmill.operators import evaluate as X
from textmill.operators.labels import label_codes
from textmill.operators.sampling import stratified_folds
from textmill.plans.q_sampling import SEED
from textmill.plans.registry import query, table
from textmill.plans.sqlfrag import round6_sql as r6
from textmill.session import ensure_checkpoint_dir
from textmill.sources.io import log_metrics, read_metrics

K = 4


def predictions(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    d = label_codes(d, "lang", by="sorted", out="label").drop("lang")
    flip = F.pmod(seeded_hash(7, "doc_id"), F.lit(5)) == 0
    d = d.withColumn("pred", F.when(flip, (F.col("label") + 1) % K).otherwise(F.col("label")).cast("int"))
    logits = F.transform(F.sequence(F.lit(0), F.lit(K - 1)),
                         lambda k: seeded_uniform(11, F.col("doc_id"), k)
                         + F.when(k == F.col("pred"), F.lit(2.0)).otherwise(F.lit(0.0)))
    return d.withColumn("logits", logits).withColumn("batch_id", (F.col("doc_id") / 8).cast("bigint"))


PRED_SQL = f"""(SELECT doc_id, label, pred, batch_id,
   list_transform(range({K}), lambda k: {sql_uniform(11, 'doc_id', 'k')} + CASE WHEN k = pred THEN 2.0 ELSE 0.0 END) AS logits
 FROM (SELECT doc_id, label, CAST(CASE WHEN {sql_hash(7, 'doc_id')} % 5 = 0 THEN (label + 1) % {K} ELSE label END AS INTEGER) AS pred,
              CAST(floor(doc_id / 8) AS BIGINT) AS batch_id
       FROM (SELECT d.doc_id, c.code AS label FROM documents d JOIN
             (SELECT lang, CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS code
              FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)) c USING (lang))))"""

# softmax of the logits, as SQL
PROBS_SQL = f"""(SELECT *, list_transform(ex, lambda x: x / list_sum(ex)) AS probs FROM
 (SELECT *, list_transform(logits, lambda x: exp(x - list_max(logits))) AS ex FROM {PRED_SQL}))"""


def _r6(c):
    return F.round(c, 6)


def _r6v(c):
    return F.transform(c, lambda x: F.round(x, 6))


@query("x1_accuracy", sql=f"SELECT {r6('avg(CAST(pred = label AS DOUBLE))')} AS accuracy FROM {PRED_SQL}")
def q_accuracy(spark, sf):
    return X.accuracy(predictions(spark, sf)).select(_r6("accuracy").alias("accuracy"))


@query("x2_accuracy_per_class", sql=f"""
SELECT label, CAST(sum(CAST(pred = label AS BIGINT)) AS BIGINT) AS hits, count(*) AS total,
       {r6('sum(CAST(pred = label AS BIGINT)) / count(*)')} AS accuracy
FROM {PRED_SQL} GROUP BY label""")
def q_accuracy_per_class(spark, sf):
    a = X.accuracy_per_class(predictions(spark, sf))
    return a.select("label", F.col("hits").cast("bigint").alias("hits"), "total", _r6("accuracy").alias("accuracy"))


def _report_sql(label: str = "label", pred: str = "pred", src: str = PRED_SQL, by: str = "") -> str:
    b = f"{by}, " if by else ""
    using = f"USING ({by + ', ' if by else ''}cls)"
    gb = f"GROUP BY {by}" if by else ""
    return f"""(WITH pc AS (SELECT {b}{label} AS label, {pred} AS pred, count(*) AS n FROM {src} GROUP BY ALL),
tn AS (SELECT {b}label AS cls, sum(n) AS support FROM pc GROUP BY ALL),
pn AS (SELECT {b}pred AS cls, sum(n) AS predicted FROM pc GROUP BY ALL),
tp AS (SELECT {b}label AS cls, sum(n) AS tp FROM pc WHERE label = pred GROUP BY ALL),
cl AS (SELECT {b}cls FROM tn UNION SELECT {b}cls FROM pn),
t AS (SELECT cl.*, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted, coalesce(tp, 0) AS tp
      FROM cl LEFT JOIN tn {using} LEFT JOIN pn {using} LEFT JOIN tp {using}),
m AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
              CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM t),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM m),
tot AS (SELECT {b}sum(tp) AS tp, sum(support) AS total, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
               sum(precision * support) / sum(support) AS wp, sum(recall * support) / sum(support) AS wr,
               sum(f1 * support) / sum(support) AS wf FROM f {gb})
SELECT {b}CAST(cls AS VARCHAR) AS class, {r6('precision')} AS precision, {r6('recall')} AS recall,
       {r6('f1')} AS f1, CAST(support AS BIGINT) AS support FROM f
UNION ALL SELECT {b}'accuracy', NULL, NULL, {r6('tp / total')}, CAST(total AS BIGINT) FROM tot
UNION ALL SELECT {b}'macro avg', {r6('mp')}, {r6('mr')}, {r6('mf')}, CAST(total AS BIGINT) FROM tot
UNION ALL SELECT {b}'weighted avg', {r6('wp')}, {r6('wr')}, {r6('wf')}, CAST(total AS BIGINT) FROM tot)"""


def _round_report(rep, by=()):
    return rep.select(*by, "class", _r6("precision").alias("precision"), _r6("recall").alias("recall"),
                      _r6("f1").alias("f1"), "support")


@query("x4_classification_report", sql=f"SELECT * FROM {_report_sql()}")
def q_report(spark, sf):
    return _round_report(X.classification_report(predictions(spark, sf)))


@query("x4_classification_report_swapped", sql=f"SELECT * FROM {_report_sql('pred', 'label')}")
def q_report_swapped(spark, sf):
    return _round_report(X.classification_report(predictions(spark, sf), swapped=True))


@query("x3_f1_weighted", sql=f"SELECT f1 AS f1_weighted FROM {_report_sql()} WHERE class = 'weighted avg'")
def q_f1(spark, sf):
    return X.f1_weighted(predictions(spark, sf)).select(_r6("f1_weighted").alias("f1_weighted"))


RUNS_SQL = f"""(SELECT 'noisy' AS run_id, label, pred FROM {PRED_SQL}
 UNION ALL SELECT 'exact' AS run_id, label, label AS pred FROM {PRED_SQL})"""


@query("x10_compare_runs", sql=f"SELECT * FROM {_report_sql(src=RUNS_SQL, by='run_id')}")
def q_compare_runs(spark, sf):
    p = predictions(spark, sf)
    runs = p.select(F.lit("noisy").alias("run_id"), "label", "pred").unionByName(
        p.select(F.lit("exact").alias("run_id"), "label", F.col("label").alias("pred")))
    return _round_report(X.compare_runs(runs), by=["run_id"])


def _confusion_sql(row: str, col: str) -> str:
    return f"""WITH p AS {PRED_SQL},
cl AS (SELECT label AS c FROM p UNION SELECT pred FROM p),
pc AS (SELECT {row} AS row_class, {col} AS col_class, count(*) AS n FROM p GROUP BY ALL)
SELECT a.c AS row_class, b.c AS col_class, coalesce(pc.n, 0) AS n
FROM cl a CROSS JOIN cl b LEFT JOIN pc ON pc.row_class = a.c AND pc.col_class = b.c"""


@query("x5_confusion", sql=_confusion_sql("label", "pred"))
def q_confusion(spark, sf):
    return X.confusion(predictions(spark, sf), rows="true")


@query("x5_confusion_cells", sql=f"""WITH p AS {PRED_SQL}
SELECT label AS row_class, pred AS col_class, count(*) AS n FROM p GROUP BY ALL""")
def q_confusion_cells(spark, sf):
    """Only the cells that occur."""
    return X.confusion(predictions(spark, sf), zeros=False)


@query("x5_confusion_pred_rows", sql=_confusion_sql("pred", "label"))
def q_confusion_pred(spark, sf):
    return X.confusion(predictions(spark, sf), rows="pred")


@query("m8_decode_scores", sql=f"""
SELECT doc_id, list_transform(probs, lambda x: {r6('x')}) AS probs,
       CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS pred FROM {PROBS_SQL}""")
def q_decode(spark, sf):
    p = predictions(spark, sf).select("doc_id", "logits")
    return X.decode_scores(p, "logits").select("doc_id", _r6v(F.col("probs")).alias("probs"), "pred")


def _loss_sql(agg: str) -> str:
    return f"""(SELECT *, -ln(greatest(probs[label + 1], 1e-15)) AS l FROM {PROBS_SQL})"""


@query("x6_log_loss", sql=f"SELECT {r6('avg(l)')} AS log_loss FROM {_loss_sql('')}")
def q_log_loss(spark, sf):
    p = X.decode_scores(predictions(spark, sf), "logits", pred="argmax")
    return X.log_loss(p).select(_r6("log_loss").alias("log_loss"))


@query("x6_log_loss_batch_mean",
       sql=f"SELECT {r6('avg(b)')} AS log_loss FROM (SELECT avg(l) AS b FROM {_loss_sql('')} GROUP BY batch_id)")
def q_log_loss_bm(spark, sf):
    p = X.decode_scores(predictions(spark, sf), "logits", pred="argmax")
    return X.log_loss(p, reduce="batch_mean").select(_r6("log_loss").alias("log_loss"))


@query("x6_log_loss_batch_sum",
       sql=f"SELECT {r6('avg(b)')} AS log_loss FROM (SELECT sum(l) AS b FROM {_loss_sql('')} GROUP BY batch_id)")
def q_log_loss_bs(spark, sf):
    p = X.decode_scores(predictions(spark, sf), "logits", pred="argmax")
    return X.log_loss(p, reduce="batch_sum").select(_r6("log_loss").alias("log_loss"))


def multilabel(spark, sf):
    lab = table(spark, sf, "labels")
    pq = F.when(F.pmod(seeded_hash(3, "doc_id"), F.lit(5)) == 0, 1 - F.col("quality")).otherwise(F.col("quality"))
    pt = F.when(F.pmod(seeded_hash(5, "doc_id"), F.lit(5)) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))
    return lab.select("doc_id", "quality", "toxic", pq.alias("pq"), pt.alias("pt"))


ML_SQL = f"""(SELECT doc_id, quality, toxic,
   CASE WHEN {sql_hash(3, 'doc_id')} % 5 = 0 THEN 1 - quality ELSE quality END AS pq,
   CASE WHEN {sql_hash(5, 'doc_id')} % 5 = 0 THEN 1 - toxic ELSE toxic END AS pt FROM labels)"""


@query("x6_binary_log_loss", sql=f"""
SELECT {r6('avg(l)')} AS binary_log_loss FROM (
  SELECT -(y * ln(greatest(p, 1e-15)) + (1 - y) * ln(greatest(1 - p, 1e-15))) AS l FROM (
    SELECT quality AS y, 0.1 + 0.8 * pq AS p FROM {ML_SQL}
    UNION ALL SELECT toxic AS y, 0.1 + 0.8 * pt AS p FROM {ML_SQL}))""")
def q_binary_log_loss(spark, sf):
    m = multilabel(spark, sf)
    d = m.select(F.array(0.1 + 0.8 * F.col("pq"), 0.1 + 0.8 * F.col("pt")).alias("probs"),
                 F.array(F.col("quality"), F.col("toxic")).alias("targets"))
    return X.binary_log_loss(d).select(_r6("binary_log_loss").alias("binary_log_loss"))


@query("x9_multilabel_report", sql=f"""
WITH m AS (SELECT doc_id,
    list_filter(['quality', 'toxic'], lambda x: (x = 'quality' AND quality = 1) OR (x = 'toxic' AND toxic = 1)) AS labels,
    list_filter(['quality', 'toxic'], lambda x: (x = 'quality' AND pq = 1) OR (x = 'toxic' AND pt = 1)) AS result
  FROM {ML_SQL}),
per AS (SELECT l.label, sum(CAST(list_contains(labels, l.label) AND list_contains(result, l.label) AS INTEGER)) AS tp,
               sum(CAST(list_contains(result, l.label) AS INTEGER)) AS predicted,
               sum(CAST(list_contains(labels, l.label) AS INTEGER)) AS actual
        FROM m, (VALUES ('quality'), ('toxic')) l(label) GROUP BY l.label)
SELECT label, CAST(tp AS BIGINT) AS tp, {r6('CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END')} AS precision,
       {r6('CASE WHEN actual > 0 THEN tp / actual ELSE 0.0 END')} AS recall FROM per
UNION ALL SELECT 'exact_match', NULL, {r6('avg(CAST(list_sort(labels) = list_sort(result) AS DOUBLE))')}, NULL FROM m""")
def q_multilabel(spark, sf):
    m = multilabel(spark, sf)
    arr = lambda q, t: F.filter(F.array(F.when(q == 1, F.lit("quality")), F.when(t == 1, F.lit("toxic"))),
                                lambda x: x.isNotNull())
    d = m.select(arr(F.col("quality"), F.col("toxic")).alias("labels"), arr(F.col("pq"), F.col("pt")).alias("result"))
    rep = X.multilabel_report(d, ["quality", "toxic"])
    return rep.select("label", "tp", _r6("precision").alias("precision"), _r6("recall").alias("recall"))


@query("x7_rmse", sql=f"SELECT {r6('sqrt(avg(pow(pred - label, 2)))')} AS rmse FROM {PRED_SQL}")
def q_rmse(spark, sf):
    return X.rmse(predictions(spark, sf)).select(_r6("rmse").alias("rmse"))


@query("x7_rmse_by_batch", sql=f"""
SELECT {r6('sum(r * n) / sum(n)')} AS rmse FROM
 (SELECT sqrt(avg(pow(pred - label, 2))) AS r, count(*) AS n FROM {PRED_SQL} GROUP BY batch_id)""")
def q_rmse_batch(spark, sf):
    return X.rmse(predictions(spark, sf), by_batch=True).select(_r6("rmse").alias("rmse"))


def step_log(spark, sf):
    """One training step per batch of 8 documents (in doc_id order)."""
    p = X.decode_scores(predictions(spark, sf), "logits", pred="argmax")
    return p.groupBy(F.col("batch_id").alias("step")).agg(
        F.avg(X.row_log_loss("probs", "label")).alias("loss"),
        F.sum((F.col("argmax") == F.col("label")).cast("bigint")).alias("n_correct"),
        F.count(F.lit(1)).alias("n_examples")).withColumn("run_id", F.lit("r1"))


@query("w4_running_metrics", sql=f"""
WITH s AS (SELECT batch_id AS step, avg(-ln(greatest(probs[label + 1], 1e-15))) AS loss,
                  sum(CAST(list_position(logits, list_max(logits)) - 1 = label AS BIGINT)) AS n_correct,
                  count(*) AS n_examples FROM {PROBS_SQL} GROUP BY batch_id),
r AS (SELECT step, avg(loss) OVER w AS loss_step, sum(n_correct) OVER w * 100.0 / sum(n_examples) OVER w AS accu_step
      FROM s WINDOW w AS (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT 'r1' AS run_id, step, {r6('loss_step')} AS loss_step, {r6('accu_step')} AS accu_step FROM r WHERE step % 10 = 0""")
def q_running(spark, sf):
    r = X.running_metrics(step_log(spark, sf), every=10)
    return r.select("run_id", "step", _r6("loss_step").alias("loss_step"), _r6("accu_step").alias("accu_step"))


def _metric_rows(spark, sf):
    """Per source (a run) and fold (an epoch): accuracy and loss."""
    p = X.decode_scores(predictions(spark, sf), "logits", pred="argmax")
    d = table(spark, sf, "documents").select("doc_id", "source", "lang")
    f = stratified_folds(d, "lang", 3, SEED).select("doc_id", "source", "fold")
    j = p.join(f, on="doc_id")
    g = j.groupBy(F.col("source").alias("run_id"), (F.col("fold") + 1).alias("epoch")).agg(
        F.avg((F.col("argmax") == F.col("label")).cast("double")).alias("accuracy"),
        F.avg(X.row_log_loss("probs", "label")).alias("loss"))
    return g.select("run_id", "epoch", F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value")) \
        .unionByName(g.select("run_id", "epoch", F.lit("loss").alias("metric"), F.col("loss").alias("value")))


METRIC_SQL = f"""(WITH p AS (SELECT *, list_position(logits, list_max(logits)) - 1 AS am,
                          -ln(greatest(probs[label + 1], 1e-15)) AS l FROM {PROBS_SQL}),
f AS (SELECT doc_id, source, CAST((row_number() OVER (PARTITION BY lang ORDER BY {sql_hash(SEED, 'doc_id')}, doc_id) - 1) % 3 AS INTEGER) AS fold
      FROM documents WHERE lang IS NOT NULL),
g AS (SELECT f.source AS run_id, CAST(f.fold + 1 AS INTEGER) AS epoch, avg(CAST(am = label AS DOUBLE)) AS accuracy, avg(l) AS loss
      FROM p JOIN f USING (doc_id) GROUP BY ALL)
SELECT run_id, epoch, 'accuracy' AS metric, accuracy AS value FROM g
UNION ALL SELECT run_id, epoch, 'loss', loss FROM g)"""


@query("s8_log_metrics", sql=f"SELECT run_id, epoch, metric, {r6('value')} AS value FROM {METRIC_SQL}")
def q_log_metrics(spark, sf):
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/metric_log_{uuid.uuid4().hex}"
    log_metrics(_metric_rows(spark, sf), path)
    return read_metrics(spark, path).select("run_id", "epoch", "metric", _r6("value").alias("value"))


@query("x8_history", sql=f"""
SELECT run_id, epoch, {r6('max(CASE WHEN metric = \'accuracy\' THEN value END)')} AS accuracy,
       {r6('max(CASE WHEN metric = \'loss\' THEN value END)')} AS loss FROM {METRIC_SQL} GROUP BY run_id, epoch""")
def q_history(spark, sf):
    h = X.history(_metric_rows(spark, sf), ["accuracy", "loss"])
    return h.select("run_id", F.col("epoch").cast("int").alias("epoch"), _r6("accuracy").alias("accuracy"),
                    _r6("loss").alias("loss"))
