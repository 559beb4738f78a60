"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# P1
def select_cols(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols)


# P2
def drop_nulls(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.dropna(how="any", subset=subset)


# The reference truncates floats on the cast; ANSI mode would raise on
# dirty values, so the tolerant form goes through double.
def cast_label(df: DataFrame, col: str, out: str | None = None, strict: bool = False) -> DataFrame:
    c = F.col(col).cast("int") if strict else F.col(col).try_cast("double").try_cast("int")
    return df.withColumn(out or col, c)


# P4
def rename_cols(df: DataFrame, names: list[str]) -> DataFrame:
    return df.toDF(*names)


# P5
def drop_cols(df: DataFrame, *cols: str) -> DataFrame:
    return df.drop(*cols)


# Length measured before cleaning, strictly longer than min_len - 1.
def min_length(df: DataFrame, col: str, min_len: int = 2) -> DataFrame:
    return df.where(F.length(col) >= min_len)


# P7
def of_class(df: DataFrame, col: str, value) -> DataFrame:
    return df.where(F.col(col) == F.lit(value))


# P8
def of_split(df: DataFrame, name: str, col: str = "split") -> DataFrame:
    return df.where(F.col(col) == F.lit(name))


# P9
def having(df: DataFrame, count_col: str = "n", greater_than: int = 4) -> DataFrame:
    return df.where(F.col(count_col) > greater_than)


# P10: a constant column, then conditional overwrites applied in order
# (later rules win, as successive assignments would).
def tag_split(df: DataFrame, rules: list[tuple[Column, str]], default: str = "not_set",
              col: str = "split") -> DataFrame:
    tag = F.lit(default)
    for cond, name in rules:
        tag = F.when(cond, F.lit(name)).otherwise(tag)
    return df.withColumn(col, tag)


# P11
def first_result(df: DataFrame, col: str, field: str = "result", out: str = "prediction") -> DataFrame:
    return df.withColumn(out, F.try_element_at(F.col(f"{col}.{field}"), F.lit(1)))


# A missing key fails the job, as the dictionary look-up does.
def map_label(df: DataFrame, col: str, mapping: dict, out: str | None = None) -> DataFrame:
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    v = F.try_element_at(m, F.col(col))
    checked = F.when(v.isNull() & F.col(col).isNotNull(),
                     F.raise_error(F.concat(F.lit("unmapped label: "), F.col(col).cast("string"))))
    return df.withColumn(out or col, F.coalesce(checked, v))


# J1
def zip_columns(a: DataFrame, b: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Column-wise concatenation aligned on the row key (``doc_id``, plus
    ``copy_no`` after oversampling): an inner equi-join.  When both sides
    come from one table, select the columns instead -- no join needed."""
    return a.join(b, on=on or ["doc_id"], how="inner")
