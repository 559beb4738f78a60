"""Aggregations (A1-A13), sorts and top-k (O1-O5), set operations.

Aggregates with map-side partial aggregation.  What crosses to the driver is
bounded by parameters: histogram bounds, counts of the buckets that an exact
quantile narrows down by, and the points of the density curve.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.functions.hashing import seeded_hash


# A1 + O1
def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value, descending, ties by value."""
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc(col)))


# A2
def duplicate_texts(df: DataFrame, text: str, label: str) -> DataFrame:
    """Count of (non-null) labels per text, descending."""
    return (df.groupBy(text).agg(F.count(label).alias("n"))
            .orderBy(F.desc("n"), F.asc(text)))


# O2
def top_k(df: DataFrame, k: int, *order) -> DataFrame:
    """First ``k`` rows in the given order (TakeOrderedAndProject: a bounded
    per-partition heap, then one merge of k rows per partition)."""
    return df.orderBy(*order).limit(k)


# A3
def split_leakage(df: DataFrame, text: str, label: str, split: str = "split") -> DataFrame:
    """Rows per (text, label, split) with the number of splits that text is in;
    ``n_splits > 1`` marks a text leaked across splits.  Null texts leak nowhere.

    Rows are grouped and joined by 128-bit fingerprints; the texts, one for each
    fingerprint, come back last.  A fingerprint whose smallest and largest text
    differ would be two texts; 512 bits are used then."""
    from textmill.session import barrier

    mark = "__tm_print"
    marked = df.withColumn(mark, F.unhex(F.md5(F.col(text).cast("string"))))
    texts = barrier(marked.where(F.col(text).isNotNull()).groupBy(mark).agg(F.min(text).alias(text), F.max(text).alias("__tm_other")))
    if texts.where(F.col(text) != F.col("__tm_other")).take(1):  # two texts of one fingerprint: tell all apart by more
        marked = df.withColumn(mark, F.unhex(F.sha2(F.col(text).cast("string"), 512)))
        texts = barrier(marked.where(F.col(text).isNotNull()).groupBy(mark).agg(F.min(text).alias(text)))
    per = barrier(marked.groupBy(mark, label, split).agg(F.count(F.lit(1)).alias("n")))
    spread = per.groupBy(mark).agg(F.countDistinct(split).alias("n_splits"))
    return per.join(spread, on=mark).join(texts.select(mark, text), on=mark).select(text, label, split, "n", "n_splits")


# A4
def length_stats(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.max(col).alias("max_len"), F.min(col).alias("min_len"),
                  F.avg(col).alias("mean_len"))


def _value_ranks(df: DataFrame, col: str):
    """(v, n, upto) by distinct value in order, and the number of values: the
    rows are only ever counted, the distinct values sorted over the cluster."""
    from textmill.operators.rank import global_running_sum
    from textmill.session import barrier

    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("v")) \
        .agg(F.count(F.lit(1)).alias("n"))
    ranked = barrier(global_running_sum(counts, [F.asc("v")], "n"))
    return ranked, ranked.agg(F.sum("n")).first()[0] or 0


#: Buckets that the intervals of one scan are cut into, together.
BUCKETS = 1 << 16


def _at_ranks(df: DataFrame, col: str, low: float, high: float, ranks: list[int]) -> dict[int, float]:
    """The values at the given places (from 0) of the sorted column.  An interval
    that holds a place is cut into equal buckets, whose rows are counted in one
    scan; the bucket that holds the place is the next interval, until it has one
    value.  A scan serves all places; nothing is sorted, and ``BUCKETS`` counts
    at most reach the driver."""
    found: dict[int, float] = {}
    where = {r: (low, high, 0) for r in ranks}  # interval, and rows before it
    while where:
        for r, (a, z, _) in list(where.items()):
            if a == z:
                found[r] = a
                del where[r]
        spans = sorted({(a, z) for a, z, _ in where.values()})
        if not spans:
            break
        v, bucket, each = F.col("v"), F.lit(None).cast("long"), max(2, BUCKETS // len(spans))
        for i, (a, z) in enumerate(spans):
            share = (v / 2 - a / 2) / (z / 2 - a / 2)
            bucket = F.when((v >= a) & (v <= z), i * each + F.least(F.floor(share * each), F.lit(each - 1))).otherwise(bucket)
        # no filter here: pushed below, it would work the column out once more for each of its mentions
        counts = df.select(F.col(col).cast("double").alias("v")).select("v", bucket.alias("b")) \
            .groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("z"))
        rows = sorted(tuple(r) for r in counts.collect() if r.b is not None)
        for r, (a, z, before) in where.items():
            first = spans.index((a, z)) * each
            for b, n, x, y in rows:
                if first <= b < first + each:
                    if before + n > r:
                        where[r] = (x, y, before)
                        break
                    before += n
    return found


def _quantiles(df: DataFrame, col: str, total: int, low: float, high: float, qs: list[float]) -> list[float | None]:
    """Linear interpolation between the two values around place q (total - 1)."""
    if not total:
        return [None] * len(qs)
    places = [(int(q * (total - 1)), q * (total - 1) - int(q * (total - 1))) for q in qs]
    ranks = sorted({r for p, _ in places for r in (p, min(p + 1, total - 1))})
    if math.isfinite(low) and math.isfinite(high):
        at = _at_ranks(df, col, low, high, ranks)
    else:  # infinite or undefined values have no equal buckets
        ranked, _ = _value_ranks(df, col)
        at = {r: ranked.where((F.col("upto") > r) & (F.col("upto") - F.col("n") <= r)).first()["v"] for r in ranks}
    return [at[p] + (at[min(p + 1, total - 1)] - at[p]) * part for p, part in places]


# A5: exact quartiles with linear interpolation (``summary()`` is approximate).
def describe(df: DataFrame, col: str, exact: bool = True) -> DataFrame:
    """count, mean, sample std, min, quartiles, max.  Exact quartiles come from
    narrowing counts (one scan for the moments, one or two more for the usual
    column).  The column alone is written before that, so that a derived one is
    worked out once.  ``exact=False`` uses the bounded-memory sketch."""
    from textmill.session import barrier

    c = F.col(col)
    names = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
    moments = [F.count(c).alias("count"), F.avg(c).cast("double").alias("mean"), F.stddev_samp(c).alias("std"),
               F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")]
    if exact:
        df = barrier(df.select(c))
        r = df.agg(*moments).first()
        p25, p50, p75 = _quantiles(df, col, r["count"], r["min"], r["max"], [0.25, 0.5, 0.75])
        row = (r["count"], r["mean"], r["std"], r["min"], p25, p50, p75, r["max"])
        return df.sparkSession.createDataFrame([row], "count long, " + ", ".join(f"{n} double" for n in names[1:]))
    qs = [F.percentile_approx(c, F.lit(q), 10000).cast("double").alias(n) for q, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))]
    return df.agg(*moments, *qs).select(*names)


# A6
def quantile(df: DataFrame, col: str, q: float = 0.9, exact: bool = True) -> DataFrame:
    """Exact linear-interpolated quantile by narrowing counts over the written
    column; ``exact=False`` uses the bounded sketch (``percentile_approx``)."""
    from textmill.session import barrier

    if exact:
        df = barrier(df.select(col))
        r = df.agg(F.count(col).alias("n"), F.min(col).cast("double").alias("a"), F.max(col).cast("double").alias("z")).first()
        return df.sparkSession.createDataFrame([tuple(_quantiles(df, col, r.n, r.a, r.z, [q]))], "q double")
    return df.agg(F.percentile_approx(F.col(col), F.lit(q), 10000).cast("double").alias("q"))


def _bounds(df: DataFrame, col: str):
    r = df.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi")).first()
    return r.lo, r.hi


# A7
def histogram(df: DataFrame, col: str, bins: int = 100) -> DataFrame:
    """``bins`` equal-width bins between min and max; the max falls in the last
    bin; empty bins kept (left join from the ``bins``-row range)."""
    spark = df.sparkSession
    lo, hi = _bounds(df, col)
    if lo is None:
        return spark.createDataFrame([], "bin bigint, lower double, upper double, count bigint")
    width = (hi - lo) / bins
    if hi > lo:
        b = F.least(F.floor((F.col(col).cast("double") - F.lit(lo)) * F.lit(bins) / F.lit(hi - lo)),
                    F.lit(bins - 1))
    else:
        b = F.lit(0)
    counts = (df.where(F.col(col).isNotNull()).groupBy(b.cast("bigint").alias("bin"))
              .agg(F.count(F.lit(1)).alias("count")))
    grid = spark.range(bins).withColumnRenamed("id", "bin")
    return (grid.join(F.broadcast(counts), on="bin", how="left")
            .select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lower"),
                    (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("upper"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count")))


# A8
def density(df: DataFrame, col: str, grid: int = 1000) -> DataFrame:
    """Gaussian kernel density on ``grid`` points from min - range/2 to
    max + range/2, bandwidth by Scott's rule (sample std * n^(-1/5)).

    Work is per distinct value, not per row: a task adds its distinct values
    up in one array of ``grid`` sums, and these arrays are added.
    """
    spark = df.sparkSession
    s = df.agg(F.count(col).alias("n"), F.stddev_samp(col).alias("sd"),
               F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi")).first()
    if not s.n or s.sd is None or s.sd == 0:
        return spark.createDataFrame([], "point bigint, x double, density double")
    n, h = s.n, s.sd * s.n ** (-0.2)
    rng = s.hi - s.lo
    start, stop = s.lo - 0.5 * rng, s.hi + 0.5 * rng
    step = (stop - start) / (grid - 1)
    per_value = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("v")) \
        .agg(F.count(F.lit(1)).alias("w"))
    points = start + np.arange(grid) * step

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(grid)
        for b in batches:
            v, w = np.asarray(b.column(0), np.float64), np.asarray(b.column(1), np.float64)
            for i in range(0, len(v), 1024):
                z = (points[None, :] - v[i:i + 1024, None]) / h
                sums += w[i:i + 1024] @ np.exp(-0.5 * z * z)
        yield pa.RecordBatch.from_arrays([pa.array([sums])], names=["s"])

    added = per_value.mapInArrow(run, "s array<double>").agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("s")))).alias("s"))
    norm = 1.0 / (n * h * math.sqrt(2 * math.pi))
    rows = [(i, float(x), float(y) * norm) for i, (x, y) in enumerate(zip(points, added.first()["s"]))]  # ``grid`` numbers
    return spark.createDataFrame(rows, "point bigint, x double, density double")


# A9
def word_counts(df: DataFrame, tokens: str, out: str = "token") -> DataFrame:
    from textmill.functions.text import explode_tokens
    return explode_tokens(df, tokens, out).groupBy(out).agg(F.count(F.lit(1)).alias("freq"))


# A10
def min_count(counts: DataFrame, n: int = 2, freq: str = "freq") -> DataFrame:
    return counts.where(F.col(freq) >= n)


def min_count_report(counts: DataFrame, n: int = 2, freq: str = "freq") -> DataFrame:
    return counts.agg(F.count(F.lit(1)).alias("words_before"),
                      F.count_if(F.col(freq) >= n).alias("words_after"))


# A11
def distinct_labels(df: DataFrame, label: str, order_col: str = "doc_id") -> DataFrame:
    """Distinct labels with their first appearance, in order of appearance."""
    return (df.where(F.col(label).isNotNull()).groupBy(label)
            .agg(F.min(order_col).alias("first_seen")).orderBy("first_seen"))


# A12
def label_totals(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.agg(*[F.sum(c).cast("bigint").alias(c) for c in cols])


# A13
def row_count(df: DataFrame, by: str | None = None) -> DataFrame:
    if by is None:
        return df.agg(F.count(F.lit(1)).alias("rows"))
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("rows"))


# O5
def shuffle(df: DataFrame, seed: int, key: str = "doc_id", out: str = "order_key") -> DataFrame:
    """Deterministic shuffle order: independent of partitioning."""
    return df.withColumn(out, seeded_hash(seed, key)).orderBy(out, key)


# U1
def stack(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


# U2
def stop_list(spark, *lists) -> DataFrame:
    """Union of several word lists (Python lists or one-column DataFrames), distinct."""
    frames = [l if isinstance(l, DataFrame) else spark.createDataFrame([(w,) for w in l], "word string")
              for l in lists]
    frames = [f.toDF("word") for f in frames]
    return stack(*frames).distinct()
