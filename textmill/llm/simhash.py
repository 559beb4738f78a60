"""SimHash near duplicates by an inverted index over positional bytes.

Two 64-bit fingerprints that differ in b bits differ in b bytes at most, so
they share 8 - b positional bytes: (position, value).  The index lists
fingerprints under combinations of three positional bytes, 20 of the 56, chosen
so that any four shared bytes hold one of them.  Within a list, the shared
positional bytes of each pair are tallied; pairs that reach the guaranteed
number are verified bit by bit.  A pair is looked at in the first of its common
lists alone, so nothing has to be made distinct.

Lists longer than ``LIST`` are refined: their pairs share one more byte, so the
members are listed again under each fourth byte.  Lists that are still long are
dealt out as pairs of blocks of bounded size, each pair of blocks a task of its
own.  Equal fingerprints are one entry, and tasks return spanning forests of
their links, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.components import connected_components
from textmill.operators.headtail import join_split
from textmill.session import barrier, broadcast_if_small

#: Words of a shingle, seed of its hash, bits in which linked ones may differ.
SIZE, SEED, BITS = 4, 42, 4
#: Fingerprints of a list that are compared as they stand; of a block.
LIST, BLOCK = 1024, 1024
#: Rows of long lists that are broadcast at most.
HOT_LISTS = 100_000
#: Hashes whose bits are laid out at a time.
_PIECE = 65_536
_LOW = np.uint64(0x0101010101010101)
_GATHER = np.uint64(0x0102040810204080)


def fingerprint(text: bytes, size: int = SIZE, seed: int = SEED) -> int:
    """The fingerprint of one text, unsigned: a bit is 1 if it is set in over
    half of the hashes of its shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    k = min(size, len(words))
    starts = np.concatenate([[0], stops[:len(words) - k]]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:z], seed) for a, z in zip(starts, (stops[k - 1:] - 1).tolist())], "<u8")
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _PIECE):
        bits = np.unpackbits(hashes[i:i + _PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", size: int = SIZE, seed: int = SEED,
                 keep: list[str] | None = None, out: str = "fingerprint") -> DataFrame:
    """``docs`` with a long column ``out``, the 64 bits of the fingerprint.
    A text without words, or a null one, has 0.  ``keep`` names the columns to
    return (all by default); one named ``out`` is replaced."""
    names = [c for c in (docs.columns if keep is None else keep) if c != out]
    source = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").cast("string").alias("__text_of_hash"))
    schema = docs.select(*[F.col(f"`{c}`") for c in names], F.lit(0).cast("long").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(names)).cast(pa.binary())
            made = np.fromiter((fingerprint(t.as_py() or b"", size, seed) for t in texts), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:len(names)], pa.array(made.view(np.int64))], names=[*names, out])

    return source.mapInArrow(run, schema)


def index_keys(shared: int) -> list[tuple[int, ...]]:
    """Position sets such that any ``shared`` of the 8 positions hold one of
    them: for four or more, the triples that lie in one of three groups of
    positions or have two in a group and one in the next."""
    if shared < 4:
        return list(combinations(range(8), shared))
    group = [0, 0, 0, 1, 1, 1, 2, 2]
    out = []
    for t in combinations(range(8), 3):
        at = sorted(group[p] for p in t)
        if at[0] == at[2] or tuple(at) in ((0, 0, 1), (1, 1, 2), (0, 2, 2)):
            out.append(t)
    return out


def _byte(p: int) -> Column:
    return F.shiftrightunsigned("f", 8 * p).bitwiseAND(F.lit(255))


def _first_keys(keys: list[tuple[int, ...]]) -> np.ndarray:
    """Number of the first key within each set of shared positions (a mask)."""
    out = np.full(256, -1, np.int64)
    for mask in range(256):
        out[mask] = next((i for i, k in enumerate(keys) if all(mask >> p & 1 for p in k)), -1)
    return out


def _links(shared: int, bits: int, keys: list[tuple[int, ...]], refined: bool):
    """A function for mapInArrow over rows sorted by list: (a, b), links that
    connect whatever the links of the list connect."""
    first = _first_keys(keys)
    fourth = np.array([[next((p for p in range(8) if mask >> p & 1 and p not in k), -1) for k in keys]
                       for mask in range(256)], np.int64)

    def compare(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """table: columns key, fingerprint and, where refined, lo, hi, block."""
        f = table[:, 1].view(np.uint64)
        change = (table[1:, [0, 2, 3] if refined else [0]] != table[:-1, [0, 2, 3] if refined else [0]]).any(axis=1)
        ends = np.concatenate([np.flatnonzero(change) + 1, [len(table)]])
        end = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
        number = table[:, 0] >> (35 if refined else 24)
        at = np.arange(len(table))
        label = at.copy()
        found: list[tuple[int, int]] = []
        step = 0
        while len(at):
            step += 1
            at = at[at + step < end[at]]
            x = f[at] ^ f[at + step]
            z = x | x >> np.uint64(4)
            z |= z >> np.uint64(2)
            z |= z >> np.uint64(1)
            z &= _LOW
            near = (np.bitwise_count(z) <= 8 - shared) & (np.bitwise_count(x) <= bits)
            if not near.any():
                continue
            i, z = at[near], z[near]
            mask = 255 - (z * _GATHER >> np.uint64(56)).astype(np.int64)
            own = first[mask] == number[i]
            if refined:
                own &= (fourth[mask, number[i]] == table[i, 0] >> 32 & 7) | (shared < 4)
                own &= (table[i, 2] == table[i, 3]) | (table[i, 4] != table[i + step, 4])
            i = i[own & (label[i] != label[i + step])]
            if not len(i):
                continue
            for x, y in zip(i.tolist(), (i + step).tolist()):
                a, b = x, y
                while label[a] != a:
                    a = label[a]
                while label[b] != b:
                    b = label[b]
                if a != b:
                    label[max(a, b)] = min(a, b)
                    found.append((x, y))
            while (label[label] != label).any():
                label = label[label]
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return table[pairs[:, 0], 1], table[pairs[:, 1], 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 5 if refined else 2), np.int64)
        for b in batches:
            if b.num_rows:
                held = np.concatenate([held, np.stack([np.asarray(c, np.int64) for c in b.columns], axis=1)])
                same = (held[:, 0] == held[-1, 0]) if not refined else (held[:, [0, 2, 3]] == held[-1, [0, 2, 3]]).all(axis=1)
                cut = len(held) - int(same[::-1].argmin()) if not same.all() else 0  # the last list may go on
                if cut:
                    a, z = compare(held[:cut])
                    held = held[cut:]
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(z)], names=["a", "b"])
        if len(held):
            a, z = compare(held)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(z)], names=["a", "b"])

    return run


def near_fingerprints(prints: DataFrame, bits: int = BITS, lists: int = LIST, block: int = BLOCK) -> DataFrame:
    """(a, b) over the distinct longs ``f`` of ``prints`` (written, since it is
    read more than once): links between fingerprints that differ in ``bits``
    bits or fewer, enough of them to connect all that such links connect."""
    if not 0 <= bits <= 7:
        raise ValueError("bits is 0 to 7: fingerprints that differ in 8 bits may share no byte")
    shared = 8 - bits
    keys = index_keys(shared)

    def key(i: int, k: tuple[int, ...]) -> Column:
        out = F.lit(i << 24).cast("long")
        for at, p in enumerate(k):
            out = out.bitwiseOR(F.shiftleft(_byte(p), 8 * at))
        return out

    listed = prints.select("f", F.explode(F.array(*[key(i, k) for i, k in enumerate(keys)])).alias("key"))
    long = barrier(listed.groupBy("key").count().where(F.col("count") > lists).select("key", F.col("count").alias("n")))
    short = listed.join(broadcast_if_small(long.select("key"), HOT_LISTS), "key", "left_anti").select("key", "f")
    links = short.repartition("key").sortWithinPartitions("key").mapInArrow(
        _links(shared, bits, keys, False), "a long, b long")
    if not long.take(1):
        return links

    hot = listed.join(broadcast_if_small(long, HOT_LISTS), "key")
    number = F.shiftright("key", 24)
    if shared >= 4:  # any pair of the list shares one of the five other positions
        rest = F.array(*[F.array(*[F.lit(p) for p in range(8) if p not in k]) for k in keys])
        hot = hot.withColumn("p", F.explode(rest[number.cast("int")]))
        more = F.shiftrightunsigned("f", 0).bitwiseAND(F.lit(255))
        for p in range(1, 8):
            more = F.when(F.col("p") == p, _byte(p)).otherwise(more)
        # number of the key, fourth position, its byte, the three bytes
        finer = F.shiftleft(number, 35).bitwiseOR(F.shiftleft(F.col("p").cast("long"), 32)) \
            .bitwiseOR(F.shiftleft(more, 24)).bitwiseOR(F.col("key").bitwiseAND(F.lit((1 << 24) - 1)))
    else:
        finer = F.shiftleft(number, 35).bitwiseOR(F.col("key").bitwiseAND(F.lit((1 << 24) - 1)))
    hot = barrier(hot.select(finer.alias("key"), "f"))
    sizes = hot.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    blocks = sizes.where(F.col("n") > block).select("key", F.ceil(F.col("n") / block).cast("int").alias("nb"))
    hot = join_split(hot, blocks, "key", sizes, how="left").withColumn("nb", F.coalesce("nb", F.lit(1)))
    hot = hot.withColumn("b", F.pmod(F.xxhash64("f"), F.col("nb")).cast("int")) \
        .withColumn("c", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    hot = hot.select("key", "f", F.least("b", "c").alias("lo"), F.greatest("b", "c").alias("hi"), "b")
    finer_links = hot.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(
        _links(shared, bits, keys, True), "a long, b long")
    return links.unionByName(finer_links)


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE,
                    bits: int = BITS, seed: int = SEED) -> DataFrame:
    """(``id_col``, fingerprint long, component_id): one row for each row of
    ``docs``.  Rows link when their fingerprints differ in ``bits`` bits or
    fewer; component_id is the smallest id reachable by links, itself included.

    Null and empty texts have fingerprint 0 and link like any other; equal
    fingerprints (repeated rows, copies) are one node.  A null id reaches and
    connects others but is no smallest id; a class of null ids alone has a null
    component_id.  Other columns are ignored; an empty table gives an empty one."""
    marks = barrier(fingerprints(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")),
                                 "text", size, seed, keep=["id"], out="f"))
    prints = barrier(marks.groupBy("f").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")))
    found = connected_components(near_fingerprints(prints.select("f"), bits), "a", "b")
    linked = prints.join(found.select(F.col("node").alias("f"), "component"), "f", "left") \
        .withColumn("component", F.coalesce("component", "f"))
    linked = barrier(linked.select("f", "first", "component"))
    # a class of thousands of fingerprints, or a fingerprint of a third of all rows, is no task of its own
    smallest = linked.groupBy("component").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = join_split(linked, smallest.drop("n"), "component", smallest.select("component", "n"))
    out = join_split(marks, named.select("f", "component_id"), "f", prints.select("f", "n"))
    return out.select(F.col("id").alias(id_col), F.col("f").alias("fingerprint"), "component_id")
