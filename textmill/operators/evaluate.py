"""Evaluation.

Every metric is an aggregate over the prediction table, never a collect:
the per-row pass is one ``groupBy(label, pred).count()`` (K x K rows with
map-side combine); everything after works on that small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-15


def _hit(label: str, pred: str) -> Column:
    """Whether a prediction is right; a null prediction is a miss."""
    return F.coalesce(F.col(pred) == F.col(label), F.lit(False))


# X1
def accuracy(df: DataFrame, label: str = "label", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    hit = F.avg(_hit(label, pred).cast("double")).alias("accuracy")
    return df.groupBy(*by).agg(hit) if by else df.agg(hit)


# X2
def accuracy_per_class(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    return df.groupBy(label).agg(
        F.sum(_hit(label, pred).cast("bigint")).alias("hits"),
        F.count(F.lit(1)).alias("total")).withColumn("accuracy", F.col("hits") / F.col("total"))


def pair_counts(df: DataFrame, label: str = "label", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    by = by or []
    return df.groupBy(*by, F.col(label).alias("label"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n"))


# X5
def confusion(df: DataFrame, label: str = "label", pred: str = "pred", rows: str = "true", zeros: bool = True) -> DataFrame:
    """Long confusion table (row_class, col_class, n) over the union of true
    and predicted classes.  Without ``zeros`` only the cells that occur, by one
    aggregate (many classes).  With it zero cells are included; cells of null labels or
    predictions are there where they occur, so that the counts add up to the
    rows.  ``rows='true'`` puts true labels on rows (the other call order puts
    predictions there).

    One pass over the rows; the grid comes from numbering the classes and
    joining each class's run of numbers back, so neither the class list nor
    the cells meet on the driver or in one task."""
    from textmill.operators.rank import global_rank
    from textmill.session import barrier

    if not zeros:
        r, c = (label, pred) if rows == "true" else (pred, label)
        return df.groupBy(F.col(r).alias("row_class"), F.col(c).alias("col_class")).agg(F.count(F.lit(1)).alias("n"))
    pc = barrier(pair_counts(df, label, pred))
    classes = pc.select(F.col("label").alias("c")).union(pc.select(F.col("pred").alias("c"))) \
        .where("c IS NOT NULL").distinct()
    numbered = global_rank(classes, [F.asc("c")], out="i")  # its sorted table is written
    k = numbered.count()
    r, c = ("label", "pred") if rows == "true" else ("pred", "label")
    cnt = pc.select(F.col(r).alias("row_class"), F.col(c).alias("col_class"), "n")
    odd = cnt.where("row_class IS NULL OR col_class IS NULL")
    if not k:
        return odd
    cells = numbered.select(F.col("c").alias("row_class"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("j"))
    cells = cells.join(numbered.select(F.col("c").alias("col_class"), F.col("i").alias("j")), "j").drop("j")
    return (cells.join(cnt, on=["row_class", "col_class"], how="left")
            .select("row_class", "col_class", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"))
            .unionByName(odd))


def confusion_matrix(df: DataFrame, values: list, label: str = "label", pred: str = "pred",
                     rows: str = "true", prefix: str = "c_") -> DataFrame:
    """Wide form: one column per given class value (fixed schema)."""
    r, c = (label, pred) if rows == "true" else (pred, label)
    wide = df.groupBy(F.col(r).alias("row_class")).pivot(c, values).count().fillna(0)
    return wide.select("row_class", *[F.col(str(v)).cast("bigint").alias(f"{prefix}{v}") for v in values])


# X4
def classification_report(df: DataFrame, label: str = "label", pred: str = "pred", swapped: bool = False,
                          by: list[str] | None = None) -> DataFrame:
    """(class, precision, recall, f1, support) per class, then rows
    'accuracy', 'macro avg', 'weighted avg'.  Zero division gives 0.
    ``swapped=True`` reproduces a (predicted, true) argument order:
    precision and recall trade places and support counts predictions."""
    by = by or []
    if swapped:
        label, pred = pred, label
    from textmill.session import barrier

    # one pass over the rows; a null prediction is a miss of its class, no class
    pc = barrier(pair_counts(df, label, pred, by))
    true_n = pc.groupBy(*by, F.col("label").alias("cls")).agg(F.sum("n").alias("support"))
    pred_n = pc.groupBy(*by, F.col("pred").alias("cls")).agg(F.sum("n").alias("predicted"))
    tp = pc.where(F.col("label") == F.col("pred")).groupBy(*by, F.col("label").alias("cls")) \
        .agg(F.sum("n").alias("tp"))
    classes = true_n.select(*by, "cls").union(pred_n.select(*by, "cls")).where("cls IS NOT NULL").distinct()
    t = (classes.join(true_n, on=by + ["cls"], how="left").join(pred_n, on=by + ["cls"], how="left")
         .join(tp, on=by + ["cls"], how="left").fillna(0, subset=["support", "predicted", "tp"]))
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    t = t.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))) \
        .otherwise(F.lit(0.0))
    t = t.withColumn("f1", f1)
    per_class = t.select(*by, F.col("cls").cast("string").alias("class"), "precision", "recall", "f1",
                         F.col("support").cast("bigint").alias("support"))
    tot = t.groupBy(*by).agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("total"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"))
    acc = tot.select(*by, F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"), (F.col("tp") / F.col("total")).alias("f1"),
                     F.col("total").cast("bigint").alias("support"))
    macro = tot.select(*by, F.lit("macro avg").alias("class"), F.col("mp").alias("precision"),
                       F.col("mr").alias("recall"), F.col("mf").alias("f1"),
                       F.col("total").cast("bigint").alias("support"))
    weighted = tot.select(*by, F.lit("weighted avg").alias("class"), F.col("wp").alias("precision"),
                          F.col("wr").alias("recall"), F.col("wf").alias("f1"),
                          F.col("total").cast("bigint").alias("support"))
    return per_class.unionByName(acc).unionByName(macro).unionByName(weighted)


# X3
def f1_weighted(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    rep = classification_report(df, label, pred)
    return rep.where(F.col("class") == "weighted avg").select(F.col("f1").alias("f1_weighted"))


# X10
def compare_runs(df: DataFrame, run_col: str = "run_id", label: str = "label", pred: str = "pred") -> DataFrame:
    """X4 per run: every prediction keyed by its run."""
    return classification_report(df, label, pred, by=[run_col])


# M8
def softmax(c) -> Column:
    """Stable softmax.  The max and the sum are computed once per row and fed
    to ``zip_with`` as arrays: referenced inside a lambda they would be
    recomputed for every element."""
    arr = F.col(c) if isinstance(c, str) else c
    n = F.size(arr)
    e = F.zip_with(arr, F.array_repeat(F.array_max(arr), n), lambda x, m: F.exp(x - m))
    s = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.zip_with(e, F.array_repeat(s, n), lambda x, t: x / t)


def argmax(c) -> Column:
    """0-based position of the first maximum."""
    arr = F.col(c) if isinstance(c, str) else c
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def decode_scores(df: DataFrame, logits: str, probs: str = "probs", pred: str = "pred") -> DataFrame:
    return df.withColumn(probs, softmax(logits)).withColumn(pred, argmax(logits))


# X6
def row_log_loss(probs: str, label: str) -> Column:
    p = F.element_at(F.col(probs), F.col(label) + 1)
    return -F.ln(F.greatest(p, F.lit(EPS)))


def log_loss(df: DataFrame, probs: str = "probs", label: str = "label", reduce: str = "mean",
             batch_col: str = "batch_id") -> DataFrame:
    """Cross-entropy with a 1e-15 floor.  ``reduce``: 'mean' per example,
    'batch_mean' (mean per batch, then mean of batches) or 'batch_sum'
    (sum per batch, then mean over batches)."""
    loss = row_log_loss(probs, label)
    if reduce == "mean":
        return df.agg(F.avg(loss).alias("log_loss"))
    inner = F.avg(loss) if reduce == "batch_mean" else F.sum(loss)
    per_batch = df.groupBy(batch_col).agg(inner.alias("b"))
    return per_batch.agg(F.avg("b").alias("log_loss"))


def binary_log_loss(df: DataFrame, probs: str = "probs", targets: str = "targets") -> DataFrame:
    """Mean binary cross-entropy over examples and outputs (sigmoids)."""
    pairs = F.arrays_zip(F.col(probs).alias("p"), F.col(targets).alias("y"))
    per = F.transform(pairs, lambda z: -(z["y"] * F.ln(F.greatest(z["p"], F.lit(EPS)))
                                         + (1 - z["y"]) * F.ln(F.greatest(1 - z["p"], F.lit(EPS)))))
    from textmill.functions.text import explode_tokens
    return explode_tokens(df, per, "l").agg(F.avg("l").alias("binary_log_loss"))


# X7
def rmse(df: DataFrame, label: str = "label", pred: str = "pred", by_batch: bool = False,
         batch_col: str = "batch_id") -> DataFrame:
    """Global RMSE of class codes; ``by_batch`` reproduces the reference's
    batch RMSEs averaged by batch size."""
    sq = F.pow(F.col(pred).cast("double") - F.col(label).cast("double"), 2)
    if not by_batch:
        return df.agg(F.sqrt(F.avg(sq)).alias("rmse"))
    per = df.groupBy(batch_col).agg(F.sqrt(F.avg(sq)).alias("r"), F.count(F.lit(1)).alias("n"))
    return per.agg((F.sum(F.col("r") * F.col("n")) / F.sum("n")).alias("rmse"))


# W4
def running_metrics(steps: DataFrame, every: int = 5000, run_col: str = "run_id", step_col: str = "step",
                    loss: str = "loss", correct: str = "n_correct", examples: str = "n_examples") -> DataFrame:
    """Running mean of batch loss and running accuracy (%) at steps 0, every,
    2*every, ...  Prefix sums go through per-block totals (block = step div
    every), so no window holds a whole run's steps: the block table has one
    row per reported step, which is the output size anyway."""
    blk = (F.col(step_col) / F.lit(every)).cast("bigint")
    totals = steps.groupBy(run_col, blk.alias("blk")).agg(
        F.sum(loss).alias("s_loss"), F.count(F.lit(1)).alias("s_steps"),
        F.sum(correct).alias("s_corr"), F.sum(examples).alias("s_ex"))
    w = Window.partitionBy(run_col).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    prefix = totals.select(run_col, "blk", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias("p_" + c)
                                            for c in ("s_loss", "s_steps", "s_corr", "s_ex")])
    at = steps.where(F.col(step_col) % every == 0).withColumn("blk", blk)
    j = at.join(prefix, on=[run_col, "blk"], how="inner")
    return j.select(run_col, step_col,
                    ((F.col("p_s_loss") + F.col(loss)) / (F.col("p_s_steps") + 1)).alias("loss_step"),
                    ((F.col("p_s_corr") + F.col(correct)) * 100.0 / (F.col("p_s_ex") + F.col(examples)))
                    .alias("accu_step"))


# X8
def history(metrics: DataFrame, metrics_order: list[str]) -> DataFrame:
    """Metric log (run_id, epoch, metric, value) as one row per run and epoch."""
    return (metrics.groupBy("run_id", "epoch").pivot("metric", metrics_order)
            .agg(F.first("value")))


# X9
def multilabel_report(df: DataFrame, labels: list[str], true_col: str = "labels",
                      pred_col: str = "result") -> DataFrame:
    """Per label: true positives, precision, recall; plus the exact-match
    share of whole label sets."""
    aggs = [F.avg((F.array_sort(F.col(true_col)) == F.array_sort(F.col(pred_col))).cast("double")).alias("exact")]
    for lab in labels:
        t = F.array_contains(F.col(true_col), lab).cast("bigint")
        p = F.array_contains(F.col(pred_col), lab).cast("bigint")
        aggs += [F.struct(F.lit(lab).alias("label"), F.sum(t * p).alias("tp"), F.sum(p).alias("predicted"),
                          F.sum(t).alias("actual")).alias(f"l{len(aggs)}")]
    one = df.agg(*aggs)  # a single row
    out = one.select(F.explode(F.array(*[a for a in one.columns if a != "exact"])).alias("r")).select("r.*")
    out = out.select("label", F.col("tp").cast("bigint").alias("tp"),
                     F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0).alias("precision"),
                     F.when(F.col("actual") > 0, F.col("tp") / F.col("actual")).otherwise(0.0).alias("recall"))
    exact = one.select(F.lit("exact_match").alias("label"), F.lit(None).cast("bigint").alias("tp"),
                       F.col("exact").alias("precision"), F.lit(None).cast("double").alias("recall"))
    return out.unionByName(exact)
