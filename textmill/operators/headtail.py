"""Equi-joins whose hot keys do not meet in one task.

The few keys that hold a stated share of the rows (the head) join by
broadcast; their number is bounded by that share, whatever the data.  The
others (the tail) join by shuffle, where no key is large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is in the head if it holds more than one in so many rows, so the head
#: has fewer keys than this.
HEAD_SHARE = 1000


def join_split(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame | None = None, total: int | None = None,
               how: str = "inner", share: int = HEAD_SHARE) -> DataFrame:
    """``rows`` joined with ``table`` (one row a key) on ``key``, inner or
    left; columns as ``rows.join(table, key)`` has them.

    ``counts`` is (key, n): the rows of each key, if the caller has it already,
    and ``total`` their sum.  ``rows`` and ``table`` are read more than once:
    give them written.  A null key matches nothing; with ``left`` its rows
    stay, wherever they are, without a shuffle."""
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left")
    there = rows.where(F.col(key).isNotNull())
    if counts is None:
        counts = there.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    if total is None:
        total = counts.agg(F.sum("n")).first()[0] or 0
    head = F.broadcast(counts.where(F.col("n") * share > total).select(key))  # fewer than ``share`` keys
    head_table = F.broadcast(table.join(head, key, "right" if how == "left" else "inner"))
    out = there.join(head_table, key).unionByName(there.join(head, key, "left_anti").join(table, key, how))
    if how == "left":
        more = [f for f in table.schema.fields if f.name != key]
        alone = rows.where(F.col(key).isNull())
        out = out.unionByName(alone.select(key, *[c for c in rows.columns if c != key],
                                           *[F.lit(None).cast(f.dataType).alias(f.name) for f in more]))
    return out
