"""Looking words up in a table of any size.

Word frequencies are steep: one word may be a third of all rows of an exploded
corpus.  A table that is measured small is broadcast whole.  Of a larger one,
the head - the words that a frequent-items sketch finds in one pass over the
rows - is broadcast, bounded in rows and bytes, and the tail is a shuffle join,
in which no word is large.  Both happen in one plan over the rows: rows of the
head carry no key into the shuffle, they are spread over it by a salt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types

from textmill.session import BROADCAST_BYTES, barrier, row_bytes

#: Words of the head at most, and items that the sketch tracks at a time: a
#: word that is more than about one in so many rows is found.
HEAD_WORDS, TRACKED = 2_000, 20_000


def frequent(rows: DataFrame, key: str, words: int, tracked: int = TRACKED) -> DataFrame:
    """(key): up to ``words`` of the most frequent values of ``key``, by a sketch
    of bounded size (one partial aggregate a task)."""
    there = rows.where(F.col(key).isNotNull())
    top = there.agg(F.expr(f"approx_top_k(`{key}`, {words}, {max(tracked, words)})").alias("top"))
    return top.select(F.explode("top").alias("x")).select(F.col("x.item").alias(key))


def prepared(table: DataFrame, key: str, max_bytes: int | None = None) -> tuple[DataFrame, bool]:
    """``table`` without null keys, written once and measured, and whether it
    is small enough to be broadcast."""
    kept = barrier(table.where(F.col(key).isNotNull()))
    return kept, (kept.agg(F.sum(row_bytes(kept))).first()[0] or 0) <= (BROADCAST_BYTES if max_bytes is None else max_bytes)


def lookup(rows: DataFrame, key: str, table: DataFrame, max_bytes: int | None = None,
           head_words: int | None = None) -> DataFrame:
    """``rows`` left-joined with ``table`` (unique ``key``, value columns whose
    names ``rows`` does not have) on ``key``.  A null key finds nothing.

    ``table`` is written once and measured; up to ``max_bytes`` it is broadcast,
    beyond that it is joined by head (``head_words`` at most) and tail."""
    return join_prepared(rows, key, *prepared(table, key, max_bytes), head_words)


def join_prepared(rows: DataFrame, key: str, kept: DataFrame, small: bool, head_words: int | None = None) -> DataFrame:
    """``lookup`` in what ``prepared`` returned."""
    head_words = HEAD_WORDS if head_words is None else head_words
    if small:
        return rows.join(F.broadcast(kept), key, "left")
    values = [c for c in kept.columns if c != key]
    if not head_words:
        return rows.join(kept, key, "left")

    # a word of the head without an entry is known to have none; rows that are too
    # long for the bound of the head stay in the tail
    few = F.broadcast(frequent(rows, key, head_words))
    head = few.join(kept, key, "left").withColumn("__tm_head", F.lit(True))
    head = head.where(row_bytes(head) <= max(1, BROADCAST_BYTES // head_words))
    head = head.select(key, "__tm_head", *[F.col(c).alias(f"__tm_h_{c}") for c in values])
    marked = rows.join(F.broadcast(head), key, "left")
    done = F.col("__tm_head").isNotNull() | F.col(key).isNull()
    # the salt of the tail is a function of its key: a constant would be taken out of the join's keys
    marked = marked.withColumn("__tm_salt", F.when(done, F.xxhash64(*rows.columns)).otherwise(F.xxhash64(key))) \
        .withColumn("__tm_key", F.when(~done, F.col(key)))
    tail = kept.select(F.col(key).alias("__tm_key"), F.xxhash64(key).alias("__tm_salt"),
                       *[F.col(c).alias(f"__tm_t_{c}") for c in values])
    found = marked.join(tail, ["__tm_key", "__tm_salt"], "left")
    return found.select(key, *[c for c in rows.columns if c != key],
                        *[F.coalesce(f"__tm_h_{c}", f"__tm_t_{c}").alias(c) for c in values])


def _plain(kind: types.DataType) -> bool:
    """A type that crosses to Python and back as it is."""
    if isinstance(kind, types.ArrayType):
        return _plain(kind.elementType)
    return isinstance(kind, (types.StringType, types.BinaryType, types.BooleanType, types.NumericType, types.DateType, types.TimestampType))


def in_place(df: DataFrame, tokens: Column, columns: list[str], kept: DataFrame, out: str, kind: types.DataType,
             build: Callable[[pa.Array, pa.Array], Callable[[pa.Array], pa.Array]]) -> DataFrame | None:
    """``columns`` of ``df`` and ``out``, made of each row's ``tokens`` by a table
    (key, value) that was measured small, where the rows are.  ``build`` takes the
    table's columns, once a task, and returns what makes ``out`` of a list column.
    None if a key is repeated or a column cannot be carried through Python."""
    if not all(_plain(df.schema[c].dataType) for c in columns) or kept.groupBy(kept.columns[0]).count().where("count > 1").head(1):
        return None
    table, to = kept.toArrow(), pa.BufferOutputStream()
    with pa.ipc.new_stream(to, table.schema) as stream:
        stream.write_table(table)
    sent = df.sparkSession.sparkContext.broadcast(to.getvalue().to_pybytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with pa.ipc.open_stream(sent.value) as stream:
            words, values = (pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in stream.read_all().columns)
        make = build(words, values)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], make(b.column(b.num_columns - 1))], names=[*columns, out])

    schema = types.StructType([*(df.schema[c] for c in columns), types.StructField(out, kind)])
    return df.select(*[F.col(f"`{c}`") for c in columns], tokens.alias("__tm_tokens")).mapInArrow(run, schema)
