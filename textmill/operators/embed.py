"""Embeddings.

With a vector table that is measured small, in bytes, pooling is a weighted
``Summarizer`` aggregate per row (one JVM aggregate, no explode of vector
dimensions) over (row, token, count), joined by broadcast.  With a larger one
it is a blocked product: the table is cut into blocks of bounded size, a text
sends each block that holds some of its words one row, and the partial sums of
a text, one vector a block, are added up.  No word is a join key there, so a
word that every text has costs no more than another.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.functions.fixed import (
    EMB_FILL_MEAN,
    EMB_FILL_STD,
    EMB_FILL_UNIFORM_HIGH,
    EMB_FILL_UNIFORM_LOW,
)
from textmill.functions.hashing import hex_uniform, seeded_uniform
from textmill.functions.text import capitalize
from textmill.operators.lookup import in_place
from textmill.session import BROADCAST_BYTES, barrier, broadcast_if_small, row_bytes, small_batches

# Word-vector tables up to this many rows and bytes are broadcast.
MAX_BROADCAST_VECTORS, MAX_BROADCAST_BYTES = 200_000, BROADCAST_BYTES
# Beyond: bytes of a block of the table, and rows of texts that meet one copy of it.
BLOCK_BYTES, SLICE_ROWS = 32 << 20, 100_000
# Tokens, and texts at most, that a task of the blocked product works on at a time.
PIECE_TOKENS, PIECE_ROWS = 50_000, 2_000
_LOWEST = -1e300


def fill_table(keys: DataFrame, kind: str, seed, id_col: str, dim: int,
               keep_col: str | None = None) -> DataFrame:
    """Seeded fill vectors for the ids in ``keys``, as (keys..., vec).  With
    ``keep_col`` rows whose ``keep_col`` is set keep that vector and draw
    nothing.

    Row-wise: one (id, pair) row per Box-Muller pair (or per dimension for
    'uniform'), computed by small generated expressions, then regrouped per
    id in position order.  The explode and the partial ``collect_list`` run
    in the same task, so one row per id crosses the shuffle.  (A ``dim``-wide
    expression or a lambda would be interpreted or too large to compile.)"""
    cols = [c for c in keys.columns if c != keep_col]
    kept = F.col(keep_col) if keep_col else F.lit(None).cast("array<float>")
    if kind == "zeros":
        return keys.select(*cols, F.coalesce(kept, F.array_repeat(F.lit(0.0).cast("float"), dim)).alias("vec"))
    key = F.col(id_col).cast("string")
    n = (dim + 1) // 2 if kind == "normal" else dim
    if kind not in ("normal", "uniform"):
        raise ValueError(kind)
    steps = F.when(kept.isNull(), F.sequence(F.lit(0), F.lit(n - 1)))
    p = keys.select(*cols, kept.alias("__kept"), F.explode_outer(steps).alias("__j"))
    if kind == "normal":
        h = F.md5(F.concat_ws(":", F.lit(str(seed)), key, F.col("__j").cast("string")))
        p = p.withColumn("__h", F.when(F.col("__j").isNotNull(), h))
        r = F.sqrt(F.lit(-2.0) * F.ln(hex_uniform(F.col("__h"), 1)))
        th = F.lit(2.0 * math.pi) * hex_uniform(F.col("__h"), 16)
        p = p.select(*cols, "__kept", "__j", r.alias("__r"), th.alias("__t"))
        a = (F.lit(EMB_FILL_MEAN) + F.lit(EMB_FILL_STD) * F.col("__r") * F.cos("__t")).cast("float")
        b = (F.lit(EMB_FILL_MEAN) + F.lit(EMB_FILL_STD) * F.col("__r") * F.sin("__t")).cast("float")
        item = F.when(F.col("__j").isNotNull(), F.struct(F.col("__j"), a.alias("a"), b.alias("b")))
        g = p.groupBy(*cols).agg(F.first("__kept", ignorenulls=True).alias("__kept"),
                                 F.sort_array(F.collect_list(item)).alias("__z"))
        drawn = F.slice(F.flatten(F.transform("__z", lambda z: F.array(z["a"], z["b"]))), 1, dim)
    else:
        span = EMB_FILL_UNIFORM_HIGH - EMB_FILL_UNIFORM_LOW
        u = seeded_uniform(seed, F.col(id_col), F.col("__j"))
        a = (F.lit(EMB_FILL_UNIFORM_LOW) + F.lit(span) * u).cast("float")
        item = F.when(F.col("__j").isNotNull(), F.struct(F.col("__j"), a.alias("a")))
        g = p.groupBy(*cols).agg(F.first("__kept", ignorenulls=True).alias("__kept"),
                                 F.sort_array(F.collect_list(item)).alias("__z"))
        drawn = F.transform("__z", lambda z: z["a"])
    return g.select(*cols, F.coalesce(F.col("__kept"), drawn).alias("vec"))


# E1 (+ J5, J6)
def embedding_table(vocab: DataFrame, vectors: DataFrame, dim: int, fill: str = "normal",
                    try_capitalized: bool = True, seed=42, cap: int | None = None,
                    special_rows: bool = False, first_row: bool = False) -> DataFrame:
    """(id, token, vec) for every vocabulary word below ``cap``: the word's own
    vector, else (``try_capitalized``) the capitalised word's, else a seeded
    fill (drawn only for the words that have neither).  ``special_rows`` sets
    row 0 to zeros and row 1 to a uniform draw (padding and unknown of the
    min-count vocabulary); ``first_row`` adds row 0 with the table's own fill
    (the frequency vocabulary, whose ids begin at 1)."""
    v = vocab.select("token", F.col("id").cast("bigint").alias("id"))
    if cap is not None:
        v = v.where(F.col("id") < cap)
    vec = broadcast_if_small(vectors.select("token", F.col("vec").cast("array<float>").alias("vec")),
                             MAX_BROADCAST_VECTORS)
    out = v.join(vec.withColumnRenamed("vec", "__v1"), on="token", how="left")
    cols = [F.col("__v1")]
    if try_capitalized:
        cap_vec = vec.select(F.col("token").alias("__ct"), F.col("vec").alias("__v2"))
        out = out.join(cap_vec, capitalize(out["token"]) == cap_vec["__ct"], "left").drop("__ct")
        cols.append(F.col("__v2"))
    found_vec = F.coalesce(*cols)
    res = fill_table(out.select("id", "token", found_vec.alias("__found")), fill, seed, "id", dim,
                     keep_col="__found").select("id", "token", "vec")
    spark = vocab.sparkSession
    if first_row:
        zeroth = spark.createDataFrame([(0, "")], "id bigint, token string")
        res = fill_table(zeroth, fill, seed, "id", dim).select("id", "token", "vec").unionByName(res)
    if special_rows:
        extra = spark.createDataFrame([(0, ""), (1, "UNK")], "id bigint, token string")
        res = (fill_table(extra.where("id = 0"), "zeros", seed, "id", dim)
               .unionByName(fill_table(extra.where("id = 1"), "uniform", seed, "id", dim))
               .select("id", "token", "vec").unionByName(res))
    return res


def folded_vectors(vectors: DataFrame) -> DataFrame:
    """(token, vec) with lower-cased tokens, one row each: of several spellings
    the lower-case one counts, else the first by code points (of equal
    spellings the smallest vector)."""
    low = F.lower("token")
    best = F.min(F.struct((F.col("token") != low).alias("o"), F.col("token").alias("t"), F.col("vec").alias("v")))
    return vectors.where(F.col("token").isNotNull()).groupBy(low.alias("token")).agg(best.alias("b")).select("token", "b.v") \
        .withColumnRenamed("v", "vec")


_ROW = "__tm_row"


def _pool_joined(rows: DataFrame, tokens_col: str, vec: DataFrame, doc_col: str, dim: int) -> DataFrame:
    """(row, doc, known, tokens, sum, max) with the vector table broadcast."""
    zero = F.lit(0.0)
    side = F.broadcast(vec.select("token", array_to_vector(F.col("vec")).alias("__vec")))
    # texts are dealt by row, so that all groupings by row below happen where they are
    counts = rows.repartition(_ROW).select(_ROW, doc_col, F.explode_outer(tokens_col).alias("token")) \
        .groupBy(_ROW, doc_col, "token").agg(F.count(F.lit(1)).cast("double").alias("__n"))
    joined = counts.join(side, on="token", how="left")
    known = F.col("__vec").isNotNull()
    nothing = array_to_vector(F.array_repeat(zero, dim))
    lowest = array_to_vector(F.array_repeat(F.lit(_LOWEST), dim))
    return joined.groupBy(_ROW, doc_col).agg(
        F.sum(F.when(known, F.col("__n")).otherwise(zero)).alias("__known"),
        F.sum(F.when(F.col("token").isNotNull(), F.col("__n")).otherwise(zero)).alias("__tokens"),
        Summarizer.sum(F.coalesce("__vec", nothing), F.col("__n")).alias("__sum"),
        Summarizer.max(F.coalesce("__vec", lowest)).alias("__max"))


def _sliced(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``PIECE_TOKENS`` items of a list column, and
    of ``PIECE_ROWS`` rows at most; a longer list is a piece of its own."""
    sizes = np.nan_to_num(pc.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.float64))
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = int(np.searchsorted(ends, before + PIECE_TOKENS, "right"))
        stop = min(max(stop, at + 1), at + PIECE_ROWS, batch.num_rows)
        yield batch.slice(at, stop - at)
        at = stop


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row of each item, items) of a list column; null items are left out."""
    row = np.repeat(np.arange(len(lists)), np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64))
    items = lists.flatten()
    there = items.is_valid()
    return row[there.to_numpy(zero_copy_only=False)], items.filter(there)


def _rows_of(x: np.ndarray) -> pa.Array:
    """A matrix as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _pool_blocked(rows: DataFrame, tokens_col: str, vec: DataFrame, doc_col: str, dim: int, size: int, how: str) -> DataFrame:
    """The same by a blocked product; ``size`` is the table's bytes.  A task
    holds one block of the table and a small batch of texts at a time; the
    result is written here, since only what runs gets small batches."""
    blocks = max(1, -(-size // BLOCK_BYTES))
    slices = max(1, -(-rows.count() // SLICE_ROWS))
    doc_type = rows.schema[doc_col].dataType.simpleString()
    fields = f"block int, slice int, kind int, {_ROW} long, doc {doc_type}, tokens array<string>, n array<double>, vec array<double>"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _sliced(whole, 2):
                number = b.column(0).to_numpy(zero_copy_only=False)
                at, items = _flat(b.column(2))
                coded = items.dictionary_encode()
                words = coded.dictionary
                # one entry for each word of a text, and its number there
                pair, n = np.unique(at * max(1, len(words)) + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
                at, code = np.divmod(pair, max(1, len(words)))
                place = np.array([zlib.crc32(w.encode()) % blocks for w in words.to_pylist()], np.int64)
                block = place[code] if len(code) else np.empty(0, np.int64)
                order = np.lexsort((block, at))
                at, code, n, block = at[order], code[order], n[order], block[order]
                first = np.flatnonzero(np.diff(at * blocks + block, prepend=-1))  # of each text and block
                empty = np.setdiff1d(np.arange(b.num_rows), at)
                row = np.concatenate([at[first], empty])
                to = np.concatenate([block[first], number[empty] % blocks])
                offsets = pa.array(np.concatenate([first, np.full(len(empty) + 1, len(code))]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to, pa.int32()), pa.array(number[row] % slices, pa.int32()), pa.array(np.ones(len(row), np.int32)),
                     pa.array(number[row]), b.column(1).take(pa.array(row)),
                     pa.ListArray.from_arrays(offsets, words.take(pa.array(code))),
                     pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.float64))), pa.nulls(len(row), pa.list_(pa.float64()))],
                    names=["block", "slice", "kind", _ROW, "doc", "tokens", "n", "vec"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index, held, matrix = None, {}, [], None

        def fitted(x: list) -> np.ndarray:
            return np.array(x[:dim] + [0.0] * (dim - len(x)), np.float64)

        def pooled(b: pa.RecordBatch) -> pa.RecordBatch:
            lists = b.column(b.schema.get_field_index("tokens"))
            at, items = _flat(lists)
            n = b.column(b.schema.get_field_index("n")).flatten().to_numpy(zero_copy_only=False)
            coded = items.dictionary_encode()
            where = np.array([index.get(w, -1) for w in coded.dictionary.to_pylist()], np.int64)
            where = where[coded.indices.to_numpy(zero_copy_only=False)] if len(items) else np.empty(0, np.int64)
            total = np.bincount(at, n, b.num_rows).astype(np.float64)  # of no words: whole zeros
            at, n, where = at[where >= 0], n[where >= 0], where[where >= 0]
            first = np.flatnonzero(np.diff(at, prepend=-1))
            some = matrix[where]
            sums = most = pa.nulls(b.num_rows, pa.list_(pa.float64()))
            if how != "avg":
                top = np.full((b.num_rows, dim), _LOWEST)
                if len(first):
                    top[at[first]] = np.maximum.reduceat(some, first, axis=0)
                most = _rows_of(top)
            if how != "max":
                added = np.zeros((b.num_rows, dim))
                if len(first):
                    some *= n[:, None]
                    added[at[first]] = np.add.reduceat(some, first, axis=0)
                sums = _rows_of(added)
            return pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index(_ROW)), b.column(b.schema.get_field_index("doc")),
                 pa.array(np.bincount(at, n, b.num_rows).astype(np.float64)), pa.array(total), sums, most],
                names=[_ROW, "doc", "known", "tokens", "sum", "max"])

        for whole in batches:
            for b in _sliced(whole, whole.schema.get_field_index("tokens")):
                keys = np.column_stack([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("block", "slice", "kind")])
                cuts = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1).tolist(), len(keys)]
                for start, stop in zip(cuts, cuts[1:]):
                    block, part, kind = keys[start].tolist()
                    some = b.slice(start, stop - start)
                    if (block, part) != now:
                        now, index, held, matrix = (block, part), {}, [], None
                    if kind == 0:
                        for w, v in zip(some.column(some.schema.get_field_index("tokens")).to_pylist(),
                                        some.column(some.schema.get_field_index("vec")).to_pylist()):
                            index[w[0]] = len(held)
                            held.append(fitted(v))
                        continue
                    if matrix is None:
                        matrix, held = np.array(held, np.float64).reshape(-1, dim), []
                    yield pooled(some)

    sent = rows.select(_ROW, doc_col, tokens_col).mapInArrow(pieces, fields)
    placed = vec.select(F.pmod(F.crc32("token"), F.lit(blocks)).cast("int").alias("block"),
                        F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("kind"),
                        F.lit(None).cast("long").alias(_ROW), F.lit(None).cast(doc_type).alias("doc"), F.array("token").alias("tokens"),
                        F.lit(None).cast("array<double>").alias("n"), F.col("vec").cast("array<double>").alias("vec"))
    done = sent.unionByName(placed).repartition("block", "slice").sortWithinPartitions("block", "slice", "kind").mapInArrow(
        partial, f"{_ROW} long, doc {doc_type}, known double, tokens double, sum array<double>, max array<double>")
    # a text has one row a block
    sums = [F.sum("known").alias("__known"), F.sum("tokens").alias("__tokens")]
    if how != "max":
        sums.append(Summarizer.sum(array_to_vector(F.col("sum"))).alias("__sum"))
    if how != "avg":
        sums.append(Summarizer.max(array_to_vector(F.col("max"))).alias("__max"))
    whole = done.groupBy(_ROW, F.col("doc").alias(doc_col)).agg(*sums)
    with small_batches(rows.sparkSession):
        return barrier(whole)


# E2 / E3
def pool(df: DataFrame, tokens_col: str, vectors: DataFrame, how: str = "avg", doc_col: str = "doc_id",
         oov: str = "skip", out: str = "doc_vec", case_sensitive: bool = True, max_bytes: int | None = None) -> DataFrame:
    """Document vector from its tokens' vectors: 'avg', 'max' or 'avg_max'
    (concatenation).  ``oov='skip'`` averages over tokens with a vector,
    ``'zero'`` counts unknown tokens as zero vectors.  Without
    ``case_sensitive`` tokens and table meet in lower case
    (``folded_vectors``).  Up to ``max_bytes`` the table is broadcast.  One row per row of ``df``, also where rows share an
    id or have none: a row without any known token has a zero vector.  Rows are
    numbered by their place: give input that is read in the same order again."""
    vec = vectors.where(F.col("token").isNotNull()).select("token", "vec")
    vec = barrier(vec if case_sensitive else folded_vectors(vec))
    dim, n, size = vec.agg(F.max(F.size("vec")), F.count(F.lit(1)), F.sum(row_bytes(vec))).first()
    if not dim:  # no vectors: every mean has no components
        return df.select(doc_col, F.array().cast("array<double>").alias(out))
    tokens = F.col(tokens_col) if case_sensitive else F.transform(tokens_col, lambda t: F.lower(t))
    rows = df.select(F.monotonically_increasing_id().alias(_ROW), doc_col, tokens.alias("__tm_tokens"))
    if n <= MAX_BROADCAST_VECTORS and size <= (MAX_BROADCAST_BYTES if max_bytes is None else max_bytes):
        pooled = _pool_joined(rows, "__tm_tokens", vec, doc_col, dim)
    else:
        pooled = _pool_blocked(rows, "__tm_tokens", vec, doc_col, dim, size, how)
    zero = F.lit(0.0)
    parts = []
    if how in ("avg", "avg_max"):
        # the total is zipped in: inside a lambda it would be looked up for every element
        total = F.array_repeat(F.col("__known" if oov == "skip" else "__tokens"), dim)
        parts.append(F.zip_with(vector_to_array(F.col("__sum")), total, lambda x, t: F.when(t > 0, x / t).otherwise(zero)))
    if how in ("max", "avg_max"):
        parts.append(F.transform(vector_to_array(F.col("__max")), lambda x: F.when(x <= _LOWEST, zero).otherwise(x)))
    return pooled.select(doc_col, (F.concat(*parts) if len(parts) > 1 else parts[0]).alias(out))


def with_mean(df: DataFrame, tokens_col: str, vectors: DataFrame, columns: list[str], out: str, case_sensitive: bool = True,
              oov: str = "skip", size: int | None = None) -> DataFrame | None:
    """``columns`` of ``df`` and the mean of each row's token vectors, as ``pool``
    has it, where the rows are.  None if the vectors are too many to be
    broadcast, differ in length or are none (``size`` is then the length of the
    zero vectors), or ``in_place`` does not hold."""
    vec = vectors.where(F.col("token").isNotNull()).select("token", "vec")
    vec = barrier(vec if case_sensitive else folded_vectors(vec))
    dim, least, missing, n, room = vec.agg(F.max(F.size("vec")), F.min(F.size("vec")), F.sum(F.when(
        F.col("vec").isNull() | F.exists("vec", lambda x: x.isNull()), 1).otherwise(0)), F.count(F.lit(1)), F.sum(row_bytes(vec))).first()
    if not n and size:
        dim, least, missing, room = size, size, 0, 0
    if not dim or least != dim or missing or n > MAX_BROADCAST_VECTORS or room > MAX_BROADCAST_BYTES:
        return None

    def build(words: pa.Array, values: pa.Array):
        matrix = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)

        def mean(lists: pa.Array) -> pa.Array:
            at, items = _flat(lists)
            coded = items.dictionary_encode()
            where = pc.fill_null(pc.index_in(coded.dictionary, value_set=words.cast(coded.dictionary.type)), -1).to_numpy(zero_copy_only=False)
            where = where[coded.indices.to_numpy(zero_copy_only=False)] if len(items) else np.empty(0, np.int64)
            tokens = np.bincount(at, minlength=len(lists))
            at, where = at[where >= 0], where[where >= 0].astype(np.int64)
            pair, n = np.unique(at * max(1, len(matrix)) + where, return_counts=True)
            at, where = np.divmod(pair, max(1, len(matrix)))
            first = np.flatnonzero(np.diff(at, prepend=-1))
            sums = np.zeros((len(lists), dim))
            if len(first):
                sums[at[first]] = np.add.reduceat(matrix[where] * n[:, None], first, axis=0)
            total = (np.bincount(at, n, len(lists)) if oov == "skip" else tokens)[:, None]
            return _rows_of(np.divide(sums, total, out=sums, where=total > 0))

        def all_of(lists: pa.Array) -> pa.Array:
            whole = pa.RecordBatch.from_arrays([lists], names=["t"])
            done = [mean(b.column(0)) for b in _sliced(whole, 0)]
            return pa.concat_arrays(done) if done else _rows_of(np.zeros((0, dim)))
        return all_of

    tokens = F.col(f"`{tokens_col}`")
    return in_place(df, tokens if case_sensitive else F.transform(tokens, lambda t: F.lower(t)), columns, vec, out,
                    T.ArrayType(T.DoubleType()), build)


# E5
def train_word_vectors(df: DataFrame, tokens_col: str, dim: int = 100, min_count: int = 5,
                       seed: int = 42, max_iter: int = 4, window: int = 5, doc_col: str = "doc_id") -> DataFrame:
    """Trained word vectors, standing in for the downloaded ones: (token, vec
    array<float>), by factorised co-occurrence (``wordvec``); ``max_iter`` is
    its number of power steps."""
    from textmill.operators.wordvec import word_vectors
    return word_vectors(df, tokens_col, dim, min_count, window, max_iter, seed, doc_col)
