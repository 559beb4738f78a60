"""Balancing, sampling and splitting.

Every draw is a seeded md5 hash of (seed, key), never ``rand``: results do
not change with partitioning, retries or a repartition, and DuckDB can
reproduce them.  Exact per-class counts use the bucketed rank (H1), so a
class holding a third of the rows is still spread over many tasks.

Draws cannot equal numpy's generator; equality is to our seeded hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.functions.hashing import seeded_hash, seeded_uniform
from textmill.operators.rank import bucket_bits, bucketed_rank, global_rank, hash_bucket
from textmill.session import barrier, broadcast_if_small

MAX_BROADCAST = 1_000_000  # class tables up to this many rows are broadcast
DRAWS_PER_TASK = 2_000_000  # resampling draws generated per task, at most about this many


def class_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("class_n"))


def rank_in_class(df: DataFrame, label: str, seed, key_cols: list[str], out: str = "rank",
                  total: str | None = None) -> DataFrame:
    """Seeded random order inside each class, exact 1-based rank (H1); with
    ``total`` also the class size."""
    h = "__tm_h"
    with_h = df.withColumn(h, seeded_hash(seed, *key_cols))
    bits = bucket_bits(df.sparkSession)
    ranked = bucketed_rank(with_h, [label], [h] + key_cols, hash_bucket(h, bits), out=out, total=total)
    return ranked.drop(h)


# B3
def stratified_split(df: DataFrame, label: str, test_share: float, seed,
                     key_cols: list[str] | None = None, split_col: str = "split",
                     names: tuple[str, str] = ("train", "test")) -> DataFrame:
    """Per class, the first ``round(test_share * n)`` rows in seeded order go
    to the test split.  Rounding is per class (the reference's library
    balances remainders across classes: totals may differ by one)."""
    key_cols = key_cols or ["doc_id"]
    ranked = rank_in_class(df.where(F.col(label).isNotNull()), label, seed, key_cols, total="class_n")
    n_test = F.round(F.col("class_n") * F.lit(test_share))
    return (ranked.withColumn(split_col, F.when(F.col("rank") <= n_test, F.lit(names[1]))
                              .otherwise(F.lit(names[0])))
            .drop("rank", "class_n"))


# B2 / B4
def fraction_split(df: DataFrame, frac: float, seed, key_cols: list[str] | None = None,
                   split_col: str = "split", exact: bool = True,
                   names: tuple[str, str] = ("train", "test")) -> DataFrame:
    """First split gets a ``frac`` share.  ``exact`` takes exactly
    ``round(frac * n)`` rows by seeded rank (one count crosses to the driver);
    otherwise a hash threshold, no shuffle at all."""
    key_cols = key_cols or ["doc_id"]
    if not exact:
        u = seeded_uniform(seed, *key_cols)
        return df.withColumn(split_col, F.when(u < F.lit(frac), F.lit(names[0])).otherwise(F.lit(names[1])))
    n = df.count()
    h = "__tm_h"
    ranked = bucketed_rank(df.withColumn(h, seeded_hash(seed, *key_cols)), [], [h] + key_cols,
                           hash_bucket(h, bucket_bits(df.sparkSession)), out="__tm_r")
    k = int(round(frac * n))
    return (ranked.withColumn(split_col, F.when(F.col("__tm_r") <= k, F.lit(names[0]))
                              .otherwise(F.lit(names[1]))).drop(h, "__tm_r"))


def random_split(df: DataFrame, test_share: float, seed, key_cols: list[str] | None = None,
                 split_col: str = "split") -> DataFrame:
    """Partition-independent random split by hash threshold."""
    return fraction_split(df, 1.0 - test_share, seed, key_cols, split_col, exact=False)


# J2
def complement(df: DataFrame, sample: DataFrame, on: list[str] | None = None) -> DataFrame:
    return df.join(sample.select(*(on or ["doc_id"])), on=on or ["doc_id"], how="left_anti")


# B1
def resample_to_class(df: DataFrame, label: str, target, seed, key_cols: list[str] | None = None,
                      copy_col: str = "copy_no") -> DataFrame:
    """Every other class is drawn with replacement to exactly the size of
    class ``target`` (larger classes shrink); the target class is kept once.

    Draw ``j`` of class ``c`` picks the row of seeded rank
    ``hash(seed, c, j) mod n_c + 1``.  Draws are generated by ``spark.range``
    over all partitions (not exploded from one class row) and equi-joined to
    the ranked rows on (class, rank): keys are nearly unique, so no skew.
    Adds ``copy_col``: the draw number (0 for the target class).
    """
    key_cols = key_cols or ["doc_id"]
    spark = df.sparkSession
    base = df.where(F.col(label).isNotNull())
    sizes = barrier(class_sizes(base, label))
    found = sizes.where(F.col(label) == F.lit(target)).first()
    if found is None:
        raise ValueError(f"target class {target!r} not present")
    t = found["class_n"]
    # the other classes, numbered from 0: as many as there are
    classes = barrier(global_rank(sizes.where(F.col(label) != F.lit(target)), [F.asc(label)], out="__tm_r")
                      .select((F.col("__tm_r") - 1).alias("__tm_ci"), label, F.col("class_n").alias("__tm_n")))
    n_others = classes.count()
    ranked = rank_in_class(base, label, seed, key_cols)
    kept = base.where(F.col(label) == F.lit(target)).withColumn(copy_col, F.lit(0).cast("bigint"))
    if not n_others:
        return kept
    total = t * n_others
    parts = max(spark.sparkContext.defaultParallelism, total // DRAWS_PER_TASK + 1)
    draws = spark.range(0, total, numPartitions=parts).select(
        F.expr(f"id div {t}").alias("__tm_ci"), (F.col("id") % F.lit(t)).alias(copy_col))
    draws = draws.join(broadcast_if_small(classes, MAX_BROADCAST), on="__tm_ci", how="inner")
    draws = draws.select(label, copy_col, (F.pmod(seeded_hash(f"{seed}:draw", label, copy_col),
                                                  F.col("__tm_n")) + 1).alias("rank"))
    drawn = draws.join(ranked, on=[label, "rank"], how="inner").drop("rank")
    return kept.unionByName(drawn.select(*kept.columns))


# B5
def split_by_row(df: DataFrame, label: str, test_share: float, seed,
                 key_cols: list[str] | None = None, split_col: str = "split",
                 row_key: str = "doc_id", names: tuple[str, str] = ("train", "val")) -> DataFrame:
    """Split copies, then mark every copy of a row as ``val`` as soon as one
    copy is drawn for ``val`` (the duplicated-index assignment).  No row is in
    both splits; the val share exceeds ``test_share``.

    The per-row flag is a partial-aggregated group by ``row_key``; joining it
    back is skew-safe (AQE splits a hot row's copies).  The tagged copies
    feed both sides, so they are written once to the checkpoint folder
    instead of being drawn and ranked twice."""
    key_cols = key_cols or [row_key, "copy_no"]
    tagged = barrier(stratified_split(df, label, test_share, seed, key_cols, "__tm_s", names))
    flag = (tagged.groupBy(row_key)
            .agg(F.max((F.col("__tm_s") == F.lit(names[1])).cast("int")).alias("__tm_v")))
    return (tagged.join(flag, on=row_key, how="inner")
            .withColumn(split_col, F.when(F.col("__tm_v") == 1, F.lit(names[1])).otherwise(F.lit(names[0])))
            .drop("__tm_s", "__tm_v"))


# B6
def split_copies(df: DataFrame, label: str, target, test_share: float, seed,
                 split_col: str = "split") -> DataFrame:
    """Oversample (B1), then split copies independently: copies of one row can
    land in both splits (the leak the reference has; A3 reports it)."""
    over = resample_to_class(df, label, target, seed)
    return stratified_split(over, label, test_share, seed, ["doc_id", "copy_no"], split_col)


# B7
def holdout(df: DataFrame, share: float, order_col: str = "doc_id", split_col: str = "split",
            names: tuple[str, str] = ("train", "val")) -> DataFrame:
    """The last ``share`` of rows in ``order_col`` order is validation
    (train keeps the first ``int(n * (1 - share))``)."""
    # ranked by a sort over the cluster, whose ranges are sampled: gaps or an
    # outlier in the column move no rows together
    ranked = global_rank(df, [F.asc(order_col)], out="__tm_r")
    split_at = int(ranked.count() * (1 - share))
    return (ranked.withColumn(split_col, F.when(F.col("__tm_r") <= split_at, F.lit(names[0]))
                              .otherwise(F.lit(names[1]))).drop("__tm_r"))


# K1
def stratified_folds(df: DataFrame, label: str, k: int, seed, key_cols: list[str] | None = None,
                     fold_col: str = "fold") -> DataFrame:
    key_cols = key_cols or ["doc_id"]
    ranked = rank_in_class(df.where(F.col(label).isNotNull()), label, seed, key_cols)
    return ranked.withColumn(fold_col, ((F.col("rank") - 1) % k).cast("int")).drop("rank")
