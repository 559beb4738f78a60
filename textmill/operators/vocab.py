"""Vocabularies and sequence encoding.

Shape of every encoder: ``posexplode`` the document's tokens (W5: the
position is the array index, no window), cut to the positions that can
survive before any join, join the vocabulary on ``token``, regroup per
document ordered by position.  A group is one document, bounded by its own
length, never by the data size.

Rows are told apart by a number taken before the explode, so rows that share
an id (copies) or have none stay rows of their own.  The number is the row's
place in its partition: give input that is read in the same order again
(files, tables, checkpoints), or write it first.

The vocabulary join is ``lookup``: a table measured small, in bytes, is
broadcast; of a larger one the frequent words are broadcast and the others
joined by shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types

from textmill.functions import text as T
from textmill.functions.fixed import PAD_ID, UNK_ID
from textmill.operators.lookup import in_place, join_prepared, lookup, prepared
from textmill.operators.rank import global_rank

TOPK_MAX = 10_000  # vocabulary caps up to this use a top-k, larger ones a global rank


def positions(df: DataFrame, tokens_col: str, doc_col: str = "doc_id", max_pos: int | None = None,
              keep_empty: bool = False) -> DataFrame:
    """(doc, pos, token) rows; ``max_pos`` cuts before anything else.  With
    ``keep_empty`` a document without tokens keeps one row with null
    ``pos``/``token`` (so it survives to the regroup without a join back)."""
    if keep_empty:
        out = df.select(doc_col, F.posexplode_outer(tokens_col).alias("pos", "token"))
        return out.where(F.col("pos").isNull() | (F.col("pos") < max_pos)) if max_pos is not None else out
    out = T.explode_tokens(df, tokens_col, "token", keep=[doc_col], with_pos=True)
    return out.where(F.col("pos") < max_pos) if max_pos is not None else out


def first_key(doc_col: str = "doc_id", pos_col: str = "pos"):
    """(doc, pos) packed into one decimal(38,0), ``doc * 2^31 + pos``: same
    order as the pair (positions are array indexes, below 2^31; negative
    doc ids keep their order too).  ``min`` over it stays a hash aggregate;
    ``min(struct(doc, pos))`` falls back to a sort aggregate."""
    return F.col(doc_col).cast("decimal(38,0)") * F.lit(1 << 31) + F.col(pos_col)


def _first_seen_counts(df: DataFrame, tokens_col: str, doc_col: str) -> DataFrame:
    return (positions(df, tokens_col, doc_col).groupBy("token")
            .agg(F.count(F.lit(1)).alias("freq"), F.min(first_key(doc_col)).alias("first")))


# V1 + W1
def freq_vocab(df: DataFrame, tokens_col: str, doc_col: str = "doc_id", cap: int | None = None) -> DataFrame:
    """(token, freq, id): ids from 1 by falling count, ties by first
    appearance (doc order, then position).  With ``cap`` only ids below it
    are kept.  A small cap is a top-k (bounded heaps, one merge of
    ``cap`` rows per partition) plus a window over those rows; above
    ``TOPK_MAX`` that merge would pull cap x partitions rows into one task,
    so the distributed global rank is filtered instead."""
    counts = _first_seen_counts(df, tokens_col, doc_col)
    order = [F.desc("freq"), F.asc("first")]
    if cap is not None and cap <= TOPK_MAX:
        top = counts.orderBy(*order).limit(cap - 1)
        w = Window.orderBy(*order)
        return top.select("token", "freq", F.row_number().over(w).cast("bigint").alias("id"))
    ranked = global_rank(counts, order, out="id").select("token", "freq", "id")
    return ranked.where(F.col("id") < cap) if cap is not None else ranked


# V2
def first_seen_vocab(df: DataFrame, tokens_col: str, doc_col: str = "doc_id", min_count: int = 2) -> DataFrame:
    """(token, freq, id): words seen at least ``min_count`` times, ids from 2
    in order of first appearance (0 = padding, 1 = unknown)."""
    counts = _first_seen_counts(df, tokens_col, doc_col).where(F.col("freq") >= min_count)
    ranked = global_rank(counts, [F.asc("first")], out="rank")
    return ranked.select("token", "freq", (F.col("rank") + 1).alias("id"))


_ROW = "__tm_row"


def _row_positions(df: DataFrame, tokens_col: str, doc_col: str, max_pos: int | None = None,
                   together: bool = True) -> DataFrame:
    """(row, doc, pos, token): ``positions`` with the number of the row, and
    one row with null pos and token for a text without tokens.  ``together``
    deals whole texts by row: what is then joined by broadcast is regrouped
    where it is, and texts cross a shuffle, not their tokens one by one."""
    tokens = F.col(tokens_col) if max_pos is None else F.slice(tokens_col, 1, max_pos)
    numbered = df.select(F.monotonically_increasing_id().alias(_ROW), doc_col, tokens.alias("__tm_tokens"))
    if together:
        numbered = numbered.repartition(_ROW)
    return numbered.select(_ROW, doc_col, F.posexplode_outer("__tm_tokens").alias("pos", "token"))


def _looked_up(df: DataFrame, tokens_col: str, doc_col: str, table: DataFrame, key: str = "token", by=None,
               max_pos: int | None = None) -> DataFrame:
    """``_row_positions`` with the values of ``table`` by ``key`` (a name, with
    ``by`` its expression over a token)."""
    kept, small = prepared(table, key)
    rows = _row_positions(df, tokens_col, doc_col, max_pos, together=small)
    return join_prepared(rows if by is None else rows.withColumn(key, by), key, kept, small)


def _mapped(df: DataFrame, tokens: Column, columns: list[str], table: DataFrame, value: str, out: str, keep: bool = False) -> DataFrame | None:
    """``columns`` and ``out``: the tokens of each row replaced by ``value`` of a
    small table (token, value), where the rows are: no token becomes a row and
    no text crosses a shuffle.  A token without a value vanishes or, with
    ``keep``, stays.  None if ``in_place`` does not hold."""
    def build(words: pa.Array, values: pa.Array):
        def found(lists: pa.Array) -> pa.Array:
            coded = lists.flatten().dictionary_encode()
            there = values.take(pc.index_in(coded.dictionary, value_set=words.cast(coded.dictionary.type)))
            if keep:
                there = pc.coalesce(there, coded.dictionary.cast(there.type))
            there = there.take(coded.indices)
            row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            left = np.bincount(row[there.is_valid().to_numpy(zero_copy_only=False)], minlength=len(lists))
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(left)]).astype(np.int32)), there.drop_null())
        return found

    kept, small = prepared(table.select("token", value), "token")
    return in_place(df, tokens, columns, kept, out, types.ArrayType(kept.schema[value].dataType), build) if small else None


def _vocab_side(vocab: DataFrame, cap: int | None = None) -> DataFrame:
    """The (token, id) side of an encoding join."""
    v = vocab.select("token", F.col("id").cast("bigint").alias("id"))
    return v.where(F.col("id") < cap) if cap is not None else v


def _regroup(pos_items: DataFrame, doc_col: str, item: str, out: str, keep=None) -> DataFrame:
    """``item`` per row of the input, in position order; null items (and those
    for which ``keep`` does not hold) contribute nothing, so a text without any
    gets an empty array.  ``collect_list`` skips the nulls."""
    there = F.col(item).isNotNull() & F.col("pos").isNotNull()
    one = F.when(there if keep is None else there & keep, F.struct("pos", item))
    return pos_items.groupBy(_ROW, doc_col).agg(
        F.transform(F.sort_array(F.collect_list(one)), lambda s: s[item]).alias(out)).drop(_ROW)


# V3 + J4
def encode_drop(df: DataFrame, tokens_col: str, vocab: DataFrame, cap: int | None = None,
                doc_col: str = "doc_id", out: str = "ids") -> DataFrame:
    """Token ids in order; unknown tokens (and ids >= ``cap``) vanish.  A text
    with no known word keeps an empty array."""
    side = _vocab_side(vocab, cap)
    near = _mapped(df, F.col(tokens_col), [doc_col], side, "id", out)
    if near is not None:
        return near
    return _regroup(_looked_up(df, tokens_col, doc_col, side), doc_col, "id", out)


# V5
def pad(c, n: int, padding: str = "pre", truncating: str = "pre", value: int = PAD_ID):
    """Cut to ``n`` (``truncating='pre'`` drops the front), then pad with
    ``value`` in front (``padding='pre'``) or behind."""
    arr = F.col(c) if isinstance(c, str) else c
    size = F.size(arr)
    if truncating == "pre":
        cut = F.when(size > n, F.slice(arr, size - F.lit(n) + 1, n)).otherwise(arr)
    else:
        cut = F.slice(arr, 1, n)
    fill = F.array_repeat(F.lit(value).cast("bigint"), F.lit(n) - F.size(cut))
    return F.concat(fill, cut) if padding == "pre" else F.concat(cut, fill)


# V4 + J3
def encode_fixed(df: DataFrame, tokens_col: str, vocab: DataFrame, n: int = 70,
                 doc_col: str = "doc_id", out: str = "encoded", len_col: str = "length") -> DataFrame:
    """First ``n`` tokens as ids (unknown -> 1), zeros behind, and the true
    length ``min(n, tokens)``.  Positions >= n are cut before the join."""
    ids = _looked_up(df, tokens_col, doc_col, _vocab_side(vocab), max_pos=n) \
        .withColumn("id", F.coalesce(F.col("id"), F.lit(UNK_ID).cast("bigint")))
    enc = _regroup(ids, doc_col, "id", out)
    return enc.select(doc_col, pad(out, n, padding="post", truncating="post").alias(out),
                      F.size(out).cast("int").alias(len_col))


# V6
def encode_masked(df: DataFrame, tokens_col: str, vocab: DataFrame, n: int = 128, cls_id: int = 2,
                  sep_id: int = 3, id_offset: int = 2, doc_col: str = "doc_id") -> DataFrame:
    """[cls] ids [sep], cut so the whole fits ``n``, zeros behind, and an
    attention mask of 1 on real positions.  Word ids are shifted by
    ``id_offset`` to make room for the two special ids (unknown stays 1)."""
    v = _vocab_side(vocab.select("token", (F.col("id") + id_offset).alias("id")))
    ids = _looked_up(df, tokens_col, doc_col, v, max_pos=n - 2) \
        .withColumn("id", F.coalesce(F.col("id"), F.lit(UNK_ID).cast("bigint")))
    enc = _regroup(ids, doc_col, "id", "ids")
    body = F.concat(F.array(F.lit(cls_id).cast("bigint")), F.col("ids"), F.array(F.lit(sep_id).cast("bigint")))
    real = F.size(body)
    return enc.select(doc_col, pad(body, n, padding="post", truncating="post").alias("input_ids"),
                      F.concat(F.array_repeat(F.lit(1), real),
                               F.array_repeat(F.lit(0), F.lit(n) - real)).alias("attention_mask"))


# V7
def term_counts(df: DataFrame, tokens_col: str, doc_col: str = "doc_id") -> DataFrame:
    """Long bag of words: (doc, term, n)."""
    return (T.explode_tokens(df, tokens_col, "term", keep=[doc_col])
            .groupBy(doc_col, "term").agg(F.count(F.lit(1)).alias("n")))


def term_numbers(df: DataFrame, tokens_col: str, min_docs: int = 1) -> DataFrame:
    """(term, n, docs, id): every term of at least ``min_docs`` texts, numbered
    from 0 by falling count, ties by term.  A distributed table of any size."""
    # in a sorted text the first of equal words counts the text, so no text has to be regrouped
    ordered = df.select(F.sort_array(tokens_col).alias("s"))
    each = ordered.select(F.explode(F.arrays_zip(F.col("s").alias("term"), F.concat(
        F.array(F.lit(None).cast("string")), F.col("s")).alias("before"))).alias("e")).select("e.term", "e.before").where(F.col("term").isNotNull())
    counts = each.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("term").eqNullSafe(F.col("before")), 1)).alias("docs")) \
        .where(F.col("docs") >= min_docs)
    ranked = global_rank(counts, [F.desc("n"), F.asc("term")], out="id")
    return ranked.select("term", "n", "docs", (F.col("id") - 1).alias("id"))


def bag_of_words(df: DataFrame, tokens_col: str, terms: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """Sparse vectors over the numbers of ``terms`` (term, id; ids from 0):
    (doc, size, indices array<long> ascending, values array<double>), one row
    per row of ``df``.  Terms without a number add nothing; a text without any
    has empty arrays.  ``size`` is the number of terms."""
    terms = terms.select(F.col("term").alias("token"), "id")
    size = terms.agg(F.max("id")).first()[0]
    each = _row_positions(df, tokens_col, doc_col).groupBy(_ROW, doc_col, "token").agg(
        F.count(F.lit(1)).cast("double").alias("n"))
    found = lookup(each, "token", terms)
    entry = F.when(F.col("id").isNotNull(), F.struct("id", "n"))
    got = found.groupBy(_ROW, doc_col).agg(F.sort_array(F.collect_list(entry)).alias("e"))
    return got.select(doc_col, F.lit(0 if size is None else size + 1).cast("long").alias("size"),
                      F.transform("e", lambda x: x["id"]).alias("indices"), F.transform("e", lambda x: x["n"]).alias("values"))


# J8
def drop_tokens_join(df: DataFrame, tokens_col: str, words: DataFrame, doc_col: str = "doc_id",
                     out: str = "tokens", case_sensitive: bool = True) -> DataFrame:
    """Remove tokens found in a word table (any size), keeping order and
    duplicates.  One pass over ``df``: a text without tokens, or with none
    left, keeps an empty array."""
    key = F.col("token") if case_sensitive else F.lower("token")
    w = words.select((F.col("word") if case_sensitive else F.lower("word")).alias("__tm_w")).distinct() \
        .withColumn("__tm_in", F.lit(True))
    hit = _looked_up(df, tokens_col, doc_col, w, "__tm_w", by=key)
    return _regroup(hit, doc_col, "token", out, keep=F.col("__tm_in").isNull())


# J9 / T13
def lemmatize(df: DataFrame, tokens_col: str, lemmas: DataFrame, doc_col: str = "doc_id",
              out: str = "lemmas") -> DataFrame:
    """Replace each token by its lemma from a (token, lemma) table; unknown
    tokens keep themselves."""
    near = with_lemmas(df, tokens_col, lemmas, [doc_col], out)
    if near is not None:
        return near
    lem = _looked_up(df, tokens_col, doc_col, lemmas.select("token", "lemma")) \
        .withColumn("lemma", F.coalesce(F.col("lemma"), F.col("token")))
    return _regroup(lem, doc_col, "lemma", out)


def with_lemmas(df: DataFrame, tokens_col: str, lemmas: DataFrame, columns: list[str], out: str) -> DataFrame | None:
    """``columns`` of ``df`` and the lemmas, where the rows are (``_mapped``)."""
    return _mapped(df, F.col(f"`{tokens_col}`"), columns, lemmas, "lemma", out, keep=True)


def vocab_tokens(df: DataFrame, text_col: str, out: str = "tokens") -> DataFrame:
    """Tokens for V1 (the frequency tokenizer's rules)."""
    return df.withColumn(out, T.vocab_words(text_col))
