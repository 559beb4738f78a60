"""Seeded, partition-independent draws.

``rand(seed)`` depends on how rows fall into partitions, so a retry or a
repartition changes the draw.  These hashes depend only on the seed and the
row's own key, and have an exact DuckDB twin for the oracle:
``('0x' || substr(md5(key), 1, 15))::BIGINT``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60
HASH_SPAN = float(1 << HASH_BITS)


def _key(seed, *cols) -> Column:
    parts = [F.lit(str(seed))] + [F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
                                   for c in cols]
    return F.concat_ws(":", *parts)


def seeded_hash(seed, *cols) -> Column:
    """60-bit non-negative bigint from md5(seed:col1:col2...)."""
    return F.conv(F.substring(F.md5(_key(seed, *cols)), 1, 15), 16, 10).cast("bigint")


def seeded_uniform(seed, *cols) -> Column:
    """Uniform draw in (0, 1)."""
    return (seeded_hash(seed, *cols).cast("double") + F.lit(0.5)) / F.lit(HASH_SPAN)


def sql_hash(seed, *exprs: str) -> str:
    """DuckDB twin of :func:`seeded_hash` over SQL expressions."""
    parts = [f"'{seed}'"] + [f"CAST({e} AS VARCHAR)" for e in exprs]
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 15))::BIGINT"


def sql_uniform(seed, *exprs: str) -> str:
    return f"(({sql_hash(seed, *exprs)})::DOUBLE + 0.5) / {HASH_SPAN!r}"


def hex_uniform(h, start: int):
    """Uniform in (0, 1) from 15 hex digits of a digest starting at ``start``."""
    return (F.conv(F.substring(h, start, 15), 16, 10).cast("double") + F.lit(0.5)) / F.lit(HASH_SPAN)


def sql_normal_vector(seed, id_expr: str, dim: int, mean: float = 0.0, std: float = 1.0) -> str:
    """DuckDB twin of the normal fill in ``operators.embed.fill_table``: one md5 of
    (seed, key, j) per pair j, two uniforms from hex digits 1-15 and 16-30,
    Box-Muller cos and sin."""
    n_pairs = (dim + 1) // 2
    hexes = (f"list_transform(range({n_pairs}), lambda j: md5(concat_ws(':', '{seed}', "
             f"CAST({id_expr} AS VARCHAR), CAST(j AS VARCHAR))))")

    def u(start: int) -> str:
        return f"((('0x' || substr(h, {start}, 15))::BIGINT)::DOUBLE + 0.5) / {HASH_SPAN!r}"

    r = f"sqrt(-2.0 * ln({u(1)}))"
    th = f"({2.0 * math.pi!r} * {u(16)})"
    pair = f"[{mean!r} + {std!r} * {r} * cos({th}), {mean!r} + {std!r} * {r} * sin({th})]"
    return f"flatten(list_transform({hexes}, lambda h: {pair}))[1:{dim}]"
