"""A linear SVM over bags of words whose weights are a table.

Words and weights never meet on the driver.  Texts are packed once into blocks
that number their own words; terms are dealt by hash into shards that know which
blocks hold them.  In a training step every shard sends every block the weights
of its words, once for all texts of the block; the block adds up the margins and
the gradient of its texts and sends it back, and the shard takes the step.  So a
step moves the blocks' vocabularies, not an entry for every word of every text.
Classes are trained one against the rest, with squared hinge loss, all in the
same steps; steps are accelerated (Nesterov) and of a fixed size, which the unit
length of the examples allows, so the result does not depend on partitions
beyond the order of sums.

When texts are scored, terms that very many texts hold join by broadcast
(``join_split``).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import keyword_only
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.operators.headtail import join_split
from textmill.operators.labels import code_table
from textmill.operators.pipeline import _LookUp
from textmill.session import barrier, new_folder, small_batches

#: The term of the intercept: no token is empty.
BIAS = ""
#: Words times classes of a block of texts, and terms times classes that a shard
#: sends to the blocks together.
BLOCK_VALUES, SHARD_VALUES = 8_000_000, 1_000_000


def unit_examples(df: DataFrame, tokens_col: str, row_col: str) -> DataFrame:
    """(row, term, x): counts of each text divided by their length (2-norm),
    and 1 for the intercept; a text without tokens has only that."""
    counts = df.select(F.col(row_col).alias("row"), F.explode_outer(tokens_col).alias("term")) \
        .where(F.col("term").isNull() | (F.col("term") != BIAS)) \
        .groupBy("row", "term").agg(F.count(F.lit(1)).alias("n"))
    known = F.when(F.col("term").isNotNull(), F.struct("term", "n"))
    texts = counts.groupBy("row").agg(F.collect_list(known).alias("e"), F.sqrt(F.sum(
        F.when(F.col("term").isNotNull(), F.col("n") * F.col("n")).otherwise(0)).cast("double")).alias("norm"))
    entries = F.concat(F.array(F.struct(F.lit(BIAS).alias("term"), F.lit(1.0).alias("x"))),
                       F.zip_with("e", F.array_repeat("norm", F.size("e")),
                                  lambda a, b: F.struct(a["term"].alias("term"), (a["n"] / b).alias("x"))))
    return texts.select("row", F.explode(entries).alias("e")).select("row", "e.term", "e.x")


def _sums(value: str, k: int) -> list:
    """Sums of x times each component of an array column."""
    return [F.sum(F.col("x") * F.col(value)[c]).alias(f"s{c}") for c in range(k)]


def _gather(k: int):
    return F.array(*[F.col(f"s{c}") for c in range(k)])


def step_rates(max_iter: int, reg: float) -> tuple[float, list[float]]:
    """Step size and the momentum of each step.  A text has length 1 and an
    intercept of 1, so the mean loss has a curvature of 4 at most."""
    t, out = 1.0, []
    for _ in range(max_iter):
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        out.append((t - 1) / after)
        t = after
    return 1 / (4 + reg), out


def _packed(rows: DataFrame, tokens_col: str, k: int) -> DataFrame:
    """Blocks of the (tokens, y) rows of a task: the classes of their texts (y),
    words a text (length), and word by word its place in ``vocab`` and its
    count; ``vocab[0]`` is the intercept."""
    limit = max(BLOCK_VALUES // max(k, 1), 1)

    def block(columns, ys):
        lists, y = pa.concat_arrays(columns), np.concatenate(ys).astype(np.int32)
        row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        tokens = lists.flatten()
        there = pc.fill_null(pc.not_equal(tokens, BIAS), False)
        coded = tokens.filter(there).dictionary_encode()
        size = len(coded.dictionary) + 1
        key, n = np.unique(row[there.to_numpy(zero_copy_only=False)] * size + coded.indices.to_numpy() + 1, return_counts=True)
        words = pa.concat_arrays([pa.array([BIAS], coded.dictionary.type), coded.dictionary])
        length = np.bincount(key // size, minlength=len(y)).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array([len(y)], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (
                y, length, (key % size).astype(np.int32), n.astype(np.int32))),
             pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), words.cast(pa.string()))],
            names=["texts", "y", "length", "at", "n", "vocab"])

    def pack(batches):
        columns, ys, size = [], [], 0
        for b in batches:
            if b.num_rows:
                columns.append(b.column(0))
                ys.append(b.column(1).to_numpy(zero_copy_only=False))
                size += len(b.column(0).flatten()) + b.num_rows
                if size >= limit:
                    yield block(columns, ys)
                    columns, ys, size = [], [], 0
        if columns:
            yield block(columns, ys)

    blocks = rows.select(tokens_col, "y").mapInArrow(
        pack, "texts long, y binary, length binary, at binary, n binary, vocab array<string>")
    with small_batches(rows.sparkSession):
        return barrier(blocks.select(F.monotonically_increasing_id().alias("block"), "*"))


def _shards(blocks: DataFrame, k: int) -> DataFrame:
    """The terms, dealt by hash: (shard, terms, and for the blocks that hold some
    of them: block, size, place among the terms, place in the block's vocab)."""
    found = blocks.agg(F.sum(F.size("vocab"))).first()[0] or 0
    n = max(1, -(-found * max(k, 1) // SHARD_VALUES))

    def gather(table):
        table = table.combine_chunks().sort_by([("block", "ascending"), ("at", "ascending")])
        coded = table.column("term").combine_chunks().dictionary_encode()
        block, size = np.unique(table.column("block").to_numpy(), return_counts=True)
        return pa.table({
            "shard": table.column("shard")[:1],
            "terms": pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary.cast(pa.string())),
            **{name: pa.array([x.tobytes()], pa.binary()) for name, x in (
                ("block", block.astype(np.int64)), ("size", size.astype(np.int64)),
                ("place", coded.indices.to_numpy().astype(np.int32)), ("at", table.column("at").to_numpy().astype(np.int32)))}})

    words = blocks.select("block", F.posexplode("vocab").alias("at", "term"))
    return barrier(words.withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(n))).groupBy("shard").applyInArrow(
        gather, "shard long, terms array<string>, block binary, size binary, place binary, at binary"))


def fit_linear_svm(df: DataFrame, tokens_col: str, label_col: str, path: str, max_iter: int = 10, reg: float = 0.001) -> str:
    """Trains on the rows of ``df`` that have a label and writes two tables
    under ``path``: ``weights`` (term, w array<double>) and ``classes``
    (class, label), classes numbered from 0 by sorted label.  Rows may share
    ids; rows without tokens train the intercept."""
    spark = df.sparkSession
    rows = df.where(F.col(label_col).isNotNull()).select(tokens_col, label_col)
    classes = code_table(df, label_col, by="sorted", code="class").select("class", F.col(label_col).alias("label"))
    classes.write.mode("overwrite").parquet(f"{path}/classes")
    classes = spark.read.parquet(f"{path}/classes")
    k = classes.count()
    coded = rows.join(F.broadcast(classes), rows[label_col] == classes["label"]).select(tokens_col, F.col("class").alias("y"))
    blocks = _packed(coded, tokens_col, k)
    n = blocks.agg(F.sum("texts")).first()[0] or 0
    shards = _shards(blocks, k)
    blocks = blocks.drop("vocab")
    rate, momentum = step_rates(max_iter, reg)

    def column(table, name, kind=np.float64):
        return np.frombuffer(table.column(name)[0].as_py(), kind)

    def sent(batches):
        """To each block the weights of its words that a shard holds."""
        for batch in batches:
            for i in range(batch.num_rows):
                s = batch.slice(i, 1)
                v, place, at = column(s, "v").reshape(-1, k), column(s, "place", np.int32), column(s, "at", np.int32)
                block, size = column(s, "block", np.int64), column(s, "size", np.int64)
                cut = list(zip(np.cumsum(size) - size, np.cumsum(size)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(block), pa.array([s.column("shard")[0].as_py()] * len(block), pa.int64()),
                    pa.array([at[a:b].tobytes() for a, b in cut], pa.binary()),
                    pa.array([v[place[a:b]].tobytes() for a, b in cut], pa.binary())], names=["block", "shard", "at", "v"])

    def answered(block, sent_v):
        """The gradient of a block's texts, cut as the weights came."""
        y, length = column(block, "y", np.int32), column(block, "length", np.int32)
        at, count = column(block, "at", np.int32), column(block, "n", np.int32).astype(np.float64)
        row = np.repeat(np.arange(len(y)), length)
        x = count / np.sqrt(np.bincount(row, weights=count * count, minlength=len(y)))[row]
        places = [np.frombuffer(p, np.int32) for p in sent_v.column("at").to_pylist()]
        total = sum(map(len, places))
        v, g = np.zeros((total, k)), np.empty((total, k))
        for p, part in zip(places, sent_v.column("v").to_pylist()):
            v[p] = np.frombuffer(part).reshape(-1, k)
        for c in range(k):
            sign = np.where(y == c, 1.0, -1.0)
            mine = np.ascontiguousarray(v[:, c])
            margin = np.bincount(row, weights=x * mine[at], minlength=len(y)) + mine[0]
            missing = -2.0 * sign * np.maximum(0.0, 1.0 - sign * margin)
            g[:, c] = np.bincount(at, weights=x * missing[row], minlength=total)
            g[0, c] = missing.sum()
        return pa.table({"shard": sent_v.column("shard"), "block": sent_v.column("block"),
                         "g": pa.array([g[p].tobytes() for p in places], pa.binary())})

    def stepped(beta):
        def step(s, answers):
            w, v = column(s, "w").reshape(-1, k), column(s, "v").reshape(-1, k)
            place, block, size = column(s, "place", np.int32), column(s, "block", np.int64), column(s, "size", np.int64)
            g, end = np.zeros_like(v), dict(zip(block.tolist(), np.cumsum(size).tolist()))
            order = np.argsort(answers.column("block").to_numpy())
            parts = answers.column("g")
            for i in order.tolist():
                part = np.frombuffer(parts[i].as_py()).reshape(-1, k)
                last = end[answers.column("block")[i].as_py()]
                g[place[last - len(part):last]] += part
            new = v - rate * (g / n + reg * v)
            made = {"w": new, "v": new + beta * (new - w)}
            return pa.table({f: pa.array([made[f].tobytes()], pa.binary()) if f in made else s.column(f) for f in s.column_names})
        return step

    def named(terms, s):
        w = column(s, "w")
        return pa.table({"term": terms.column("terms").combine_chunks().flatten(), "w": pa.ListArray.from_arrays(
            pa.array(np.arange(len(w) // k + 1, dtype=np.int32) * k), pa.array(w))})

    zeros = F.expr(f"unhex(repeat('00', size(terms) * {8 * k}))")
    # v: where the gradient is taken; w: the weights
    state = shards.select("shard", "block", "size", "place", "at", zeros.alias("w"), zeros.alias("v"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema)
    with small_batches(spark):
        for beta in momentum:
            sent_v = state.select("shard", "block", "size", "place", "at", "v").mapInArrow(sent, "block long, shard long, at binary, v binary")
            answers = blocks.groupBy("block").cogroup(sent_v.groupBy("block")).applyInArrow(answered, "shard long, block long, g binary")
            state = barrier(state.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(stepped(beta), kinds))
        weights = shards.select("shard", "terms").groupBy("shard").cogroup(state.select("shard", "w").groupBy("shard"))
        weights.applyInArrow(named, "term string, w array<double>").write.mode("overwrite").parquet(f"{path}/weights")
    return path


def margins(df: DataFrame, tokens_col: str, weights: DataFrame, row_col: str, k: int) -> DataFrame:
    """(row, margins array<double>): one for each class."""
    examples = barrier(unit_examples(df, tokens_col, row_col))
    found = join_split(examples, weights.select("term", "w"), "term", how="left") \
        .withColumn("w", F.coalesce("w", F.array_repeat(F.lit(0.0), k)))
    return found.groupBy("row").agg(*_sums("w", k)).select("row", _gather(k).alias("margins"))


class LinearTextClassifier(_LookUp):
    """Tokens -> prediction (double, the class with the largest margin, ties to
    the smaller), predicted_label and margins, by the tables under ``path``."""

    labelCol = Param(Params._dummy(), "labelCol", "column of the predicted label", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, inputCol: str = "tokens", outputCol: str = "margins", path: str = "", idCol: str = "doc_id",
                 labelCol: str = "predicted_label"):
        super().__init__()
        self._setDefault(inputCol="tokens", outputCol="margins", path="", labelCol="predicted_label")
        self._set(**self._input_kwargs)

    def weights(self, spark) -> DataFrame:
        return spark.read.parquet(f"{self.getOrDefault(self.path)}/weights")

    def classes(self, spark) -> DataFrame:
        return spark.read.parquet(f"{self.getOrDefault(self.path)}/classes")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        spark = dataset.sparkSession
        classes = self.classes(spark)
        k, label = classes.count(), self.getOrDefault(self.labelCol)
        out = self._with_found(dataset.drop("prediction", label), lambda rows, key: margins(
            rows, self.getInputCol(), self.weights(spark), key, k).select(
                F.col("row").alias(key), F.col("margins").alias(self.getOutputCol())))
        best = F.array_position(self.getOutputCol(), F.array_max(self.getOutputCol())) - 1
        out = out.withColumn("prediction", best.cast("double"))
        names = classes.select(F.col("class").cast("double").alias("prediction"), F.col("label").alias(label))
        return out.join(names, "prediction").select(*[c for c in out.columns], label)


def top_terms(weights: DataFrame, classes: DataFrame, k: int = 10) -> DataFrame:
    """(class_index, label, term, weight, rank): the ``k`` terms of the largest
    weight of each class, ties by term.  Each task keeps ``k`` a class before
    anything is shuffled (a rank limit on the window)."""
    long = weights.where(F.col("term") != BIAS).select("term", F.posexplode("w").alias("class_index", "weight"))
    w = Window.partitionBy("class_index").orderBy(F.desc("weight"), F.asc("term"))
    top = long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.join(classes.select(F.col("class").alias("class_index"), "label"), "class_index").select(
        "class_index", "label", "term", "weight", "rank")


def sql_linear_svm(examples: str, labels: str, k: int, max_iter: int, reg: float) -> str:
    """The same training as one SQL statement, for tables of examples (row,
    term, x) and labels (row, y): common table expressions that end with
    ``weights`` (term, w0, w1, ...).  One set of expressions a step."""
    rate, momentum = step_rates(max_iter, reg)
    each = lambda f: ", ".join(f(c) for c in range(k))
    out = [f"ex AS MATERIALIZED ({examples})", f"lab AS MATERIALIZED ({labels})",
           f"st0 AS MATERIALIZED (SELECT term, {each(lambda c: f'0.0::DOUBLE AS w{c}, 0.0::DOUBLE AS v{c}')} FROM ex GROUP BY term)"]
    for i, beta in enumerate(momentum):
        sign = lambda c: f"(CASE WHEN y = {c} THEN 1.0::DOUBLE ELSE -1.0 END)"
        out += [
            f"m{i} AS MATERIALIZED (SELECT row, {each(lambda c: f'sum(x * v{c}) AS s{c}')} FROM ex JOIN st{i} USING (term) GROUP BY row)",
            f"r{i} AS MATERIALIZED (SELECT row, {each(lambda c: f'-2.0::DOUBLE * {sign(c)} * greatest(0.0, 1.0 - {sign(c)} * s{c}) AS r{c}')} "
            f"FROM m{i} JOIN lab USING (row))",
            f"g{i} AS MATERIALIZED (SELECT term, {each(lambda c: f'sum(x * r{c}) AS g{c}')} FROM ex JOIN r{i} USING (row) GROUP BY term)",
            f"n{i} AS MATERIALIZED (SELECT term, {each(lambda c: f'w{c} AS o{c}, v{c} - {rate!r}::DOUBLE * (g{c} / (SELECT count(*) FROM lab)::DOUBLE + {reg!r}::DOUBLE * v{c}) AS w{c}')} "
            f"FROM st{i} JOIN g{i} USING (term))",
            f"st{i + 1} AS MATERIALIZED (SELECT term, {each(lambda c: f'w{c}, w{c} + {beta!r}::DOUBLE * (w{c} - o{c}) AS v{c}')} FROM n{i})"]
    return ",\n".join(out) + f",\nweights AS (SELECT * FROM st{max_iter})"
