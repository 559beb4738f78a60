"""Connected components as Spark jobs (alternating large-star / small-star).

Every round is a few shuffles over the edge table, whatever its shape, and
the number of rounds grows with the logarithm of the longest path.  A node
with very many edges is only ever aggregated (map-side combine) or joined
(AQE splits the skewed side); no node's edges meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.session import barrier


def _pairs(a, b) -> DataFrame:
    return F.least(a, b), F.greatest(a, b)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over (lo, hi) rows, lo < hi: every node's neighbours are
    pointed at the smallest node it sees (``large``: only its larger
    neighbours, seen from both ends; else only its smaller ones)."""
    if large:
        seen = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(
            edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        low = seen.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        moved = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).join(low, "u") \
            .select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        return moved.distinct()
    low = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    both = edges.join(low, "hi")
    moved = both.select(F.col("m").alias("a"), F.col("lo").alias("b")) \
        .unionByName(low.select(F.col("m").alias("a"), F.col("hi").alias("b")))
    return moved.where("a <> b").select(*[c.alias(n) for c, n in zip(_pairs(F.col("a"), F.col("b")), ("lo", "hi"))]) \
        .distinct()


def connected_components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` can
    reach.  Works on any orderable type; null ends and loops are no edges; a
    node without edges has no row.  Each round is cut by a reliable
    checkpoint, so a lost executor costs one round at most."""
    lo, hi = _pairs(F.col(a), F.col(b))
    now = barrier(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
                  .select(lo.alias("lo"), hi.alias("hi")).distinct())

    def mark(df):
        r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        return tuple(r)

    last = mark(now)
    for _ in range(rounds):
        if not last[0]:
            break
        now = barrier(_star(_star(now, True), False))
        this = mark(now)
        if this == last:
            break
        last = this
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    found = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return found.unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
