"""H1: exact rank inside a class without putting a class on one task.

``row_number() over (partition by class order by key)`` sends every row of a
class to one task; with a class holding a third of 100 TB that task never
ends.  The bucketed rank instead:

1. gives each row a ``bucket`` that is monotone in the ordering key
   (high bits of a seeded hash, or a range of a bounded integer key),
2. counts rows per (class, bucket) -- a small table of classes x buckets,
3. turns those counts into offsets with a running sum over that small table,
4. numbers rows inside (class, bucket) -- each such group is ~1/buckets of
   its class, so a hot class spreads over many tasks,
5. adds the offset.

The result equals the plain window (same order key, same ties broken by the
same columns), which is also its oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions.hashing import HASH_BITS

DEFAULT_BUCKET_BITS = 12  # 4,096 buckets per class
BUCKET_BITS_CONF = "textmill.rank.bucketBits"


def bucket_bits(spark) -> int:
    """Buckets per class as a power of two, from the session conf
    ``textmill.rank.bucketBits`` (default 12).  Rows per window task are
    about class size / 2^bits: a 100 TB job with a 10^11-row class would set
    16 or more; the count table grows to classes x 2^bits rows."""
    return int(spark.conf.get(BUCKET_BITS_CONF, str(DEFAULT_BUCKET_BITS)))


def hash_bucket(hash_col: str, bits: int = DEFAULT_BUCKET_BITS):
    """Bucket = top ``bits`` bits of a 60-bit seeded hash (monotone in it)."""
    return F.shiftright(F.col(hash_col), HASH_BITS - bits)


def bucketed_rank(df: DataFrame, partition_cols: list[str], order_cols: list[str],
                  bucket, out: str = "rank", total: str | None = None) -> DataFrame:
    """Add ``out`` = 1-based rank of each row inside ``partition_cols`` by
    ``order_cols`` (ascending; must be unique inside a partition).

    ``bucket`` is a Column monotone in the first order column.  With
    ``total`` the partition's row count is added too, read off the same
    small count table (no second pass over the rows).
    """
    b = "__tm_bucket"
    with_b = df.withColumn(b, bucket)
    keys = partition_cols + [b]
    counts = with_b.groupBy(*keys).agg(F.count(F.lit(1)).alias("__tm_n"))
    running = Window.partitionBy(*partition_cols).orderBy(b).rowsBetween(
        Window.unboundedPreceding, Window.currentRow) if partition_cols else \
        Window.orderBy(b).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    extra = []
    if total:
        whole = Window.partitionBy(*partition_cols) if partition_cols else Window.partitionBy()
        extra = [F.sum("__tm_n").over(whole).alias(total)]
    offsets = counts.select(*keys, (F.sum("__tm_n").over(running) - F.col("__tm_n")).alias("__tm_off"), *extra)
    local = Window.partitionBy(*keys).orderBy(*order_cols)
    ranked = with_b.withColumn("__tm_local", F.row_number().over(local))
    return (ranked.join(offsets, on=keys, how="inner")
            .withColumn(out, (F.col("__tm_off") + F.col("__tm_local")).cast("bigint"))
            .drop(b, "__tm_local", "__tm_off"))


def plain_rank(df: DataFrame, partition_cols: list[str], order_cols: list[str], out: str = "rank") -> DataFrame:
    """The reference form of H1 (one window per class); tests compare to it."""
    w = Window.partitionBy(*partition_cols).orderBy(*order_cols)
    return df.withColumn(out, F.row_number().over(w).cast("bigint"))


def global_rank(df: DataFrame, order_cols: list, out: str = "rank") -> DataFrame:
    """Exact 1-based rank over the whole table by ``order_cols`` (unique).

    A distributed sort (range partitioning), then within each sorted
    partition the record number from ``monotonically_increasing_id`` (its
    low 33 bits), plus the row count of all earlier partitions.  The sorted
    table is written to the checkpoint folder first, so the partition
    bounds are fixed once and a retried task sees the same partitions.  The
    offset table has one row per partition (bounded), so it is broadcast.
    """
    from textmill.session import barrier

    mid = "__tm_mid"
    ordered = barrier(df.orderBy(*order_cols).withColumn(mid, F.monotonically_increasing_id()))
    pid = F.shiftright(F.col(mid), 33)
    counts = ordered.groupBy(pid.alias("__tm_pid")).agg(F.count(F.lit(1)).alias("__tm_n"))
    running = Window.orderBy("__tm_pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = counts.select("__tm_pid", (F.sum("__tm_n").over(running) - F.col("__tm_n")).alias("__tm_off"))
    local = F.col(mid).bitwiseAND(F.lit((1 << 33) - 1))
    return (ordered.withColumn("__tm_pid", pid)
            .join(F.broadcast(offsets), on="__tm_pid", how="inner")
            .withColumn(out, (F.col("__tm_off") + local + 1).cast("bigint"))
            .drop(mid, "__tm_pid", "__tm_off"))


def global_running_sum(df: DataFrame, order_cols: list, value: str, out: str = "upto") -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to and including each
    row by ``order_cols`` (unique): sorted over the cluster and written once,
    then a running sum inside each sorted partition plus the totals of the
    partitions before it."""
    from textmill.session import barrier

    mid = "__tm_mid"
    ordered = barrier(df.orderBy(*order_cols).withColumn(mid, F.monotonically_increasing_id()))
    with_pid = ordered.withColumn("__tm_pid", F.shiftright(mid, 33))
    totals = with_pid.groupBy("__tm_pid").agg(F.sum(value).alias("__tm_t"))
    running = Window.orderBy("__tm_pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each sorted partition
    offsets = totals.select("__tm_pid", F.coalesce(F.sum("__tm_t").over(running), F.lit(0)).alias("__tm_off"))
    inside = F.sum(value).over(Window.partitionBy("__tm_pid").orderBy(mid).rowsBetween(
        Window.unboundedPreceding, Window.currentRow))
    return (with_pid.withColumn("__tm_in", inside).join(F.broadcast(offsets), "__tm_pid")
            .withColumn(out, F.col("__tm_off") + F.col("__tm_in")).drop(mid, "__tm_pid", "__tm_in", "__tm_off"))
