"""Label codes.

The code table has one row per class and comes from the distributed global
rank, whatever its size.  It is joined: broadcast where it is measured small,
by a shuffle otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.operators.rank import global_rank
from textmill.operators.stats import distinct_labels
from textmill.session import broadcast_if_small

MAX_BROADCAST = 1_000_000  # code tables up to this many rows are broadcast


def code_table(df: DataFrame, label: str, by: str = "first_seen", order_col: str = "doc_id",
               code: str = "code") -> DataFrame:
    """``label -> code`` from 0: by first appearance (L1) or sorted value (L2).
    Works on the distinct-label table, never on the rows."""
    if by == "first_seen":
        keyed = distinct_labels(df, label, order_col)
        order = ["first_seen", label]
    elif by == "sorted":
        keyed = df.where(F.col(label).isNotNull()).select(label).distinct()
        order = [label]
    else:
        raise ValueError(by)
    g = global_rank(keyed, [F.asc(c) for c in order], out="__tm_r")
    return g.select(label, (F.col("__tm_r") - 1).cast("int").alias(code))


def apply_codes(df: DataFrame, codes: DataFrame, label: str, code: str = "code",
                out: str | None = None, unseen: str = "error") -> DataFrame:
    """Add ``out`` from the code table.  ``unseen='error'`` fails the job on a
    label missing from the table (L2), ``'null'`` leaves it null."""
    out = out or code
    order = df.columns + ([out] if out not in df.columns else [])
    side = broadcast_if_small(codes.select(F.col(label).alias("__tm_l"), F.col(code).alias("__tm_code")), MAX_BROADCAST)
    df = df.join(side, F.col(label) == F.col("__tm_l"), "left")
    v = F.col("__tm_code")
    if unseen == "error":
        v = F.coalesce(v, F.when(F.col(label).isNotNull(), F.raise_error(
            F.concat(F.lit("unseen label: "), F.col(label).cast("string")))))
    return df.withColumn(out, v.cast("int")).select(*order)


# L1 / L2
def label_codes(df: DataFrame, label: str, by: str = "first_seen", out: str = "code",
                order_col: str = "doc_id") -> DataFrame:
    return apply_codes(df, code_table(df, label, by, order_col), label, out=out)


# L4
def decode_label(df: DataFrame, codes: DataFrame, code_col: str, label: str = "label",
                 out: str = "label_name") -> DataFrame:
    """``out`` = the class name of a code; a column of that name is replaced."""
    inv = broadcast_if_small(codes.select(F.col("code").alias("__tm_c"), F.col(label).alias("__tm_l")), MAX_BROADCAST)
    order = df.columns + ([out] if out not in df.columns else [])
    return df.join(inv, df[code_col] == F.col("__tm_c"), "left").withColumn(out, F.col("__tm_l")).select(*order)


# L5
def one_hot(df: DataFrame, label: str, values: list, prefix: str = "is_") -> DataFrame:
    """One indicator column per given value (fixed schema)."""
    return df.select("*", *[(F.col(label) == F.lit(v)).cast("int").alias(f"{prefix}{v}") for v in values])
