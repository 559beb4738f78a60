"""Token-id files: patched frame-of-reference blocks.

Documents are sorted by id over the cluster (range partitioning); each task
encodes its range and writes it as frames.  A frame holds the ids of whole
documents in blocks of 1,024 values: the block's minimum is subtracted, the
differences are packed at the width that a given percentile of them needs,
and those that need more go to the block's list of exceptions.  An index of
block starts lets a reader decode any block alone.

The files are Parquet files with one frame a row, so that Spark's commit
protocol covers them on any shared storage and a retried task leaves no
half-written frame.  Columns: ``part`` and ``seq`` (order of the frames),
``before`` (ids of the part before the frame), ``doc_ids``, ``n_tokens`` (ids
of each document) and ``payload`` (the packed blocks, see ``pack``).
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm.chunks import ChunkTable
from textmill.session import ensure_checkpoint_dir

BLOCK = 1024
LANES = 32
FRAME_IDS = 1 << 19
SLICE_CHARS = 24_000_000
#: Distinct chunks of text that a worker keeps encoded for its next slices; with
#: more, those used once go, and all but the most used half of this number.
KEPT_CHUNKS = 1_000_000
MAGIC = b"PFR1"
#: Share of a block's values, in percent, that its width must hold.
PERCENTILE = 95


def _widths(x: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def pack(ids: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    """Layout, little-endian: magic, number of ids (u8), of blocks (u4); per
    block minimum (u4), width (u1), number of exceptions (u2); byte offset of
    each block and of the end (u8); then the blocks: ``width`` words (u4) for
    each of 32 lanes, value i of a block being row i // 32 of lane i % 32,
    then the exceptions' positions (u2) and differences (u4)."""
    n = len(ids)
    nb = -(-n // BLOCK)
    full = np.empty((nb, BLOCK), np.uint32)
    full.ravel()[:n] = ids
    if n:
        full.ravel()[n:] = ids[-1]
    low = full.min(axis=1) if nb else np.empty(0, np.uint32)
    diff = full - low[:, None]
    rank = min(BLOCK - 1, -(-BLOCK * percentile // 100) - 1)
    width = _widths(np.partition(diff, rank, axis=1)[:, rank]) if nb else np.empty(0, np.int64)
    over = diff >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    extras = over.sum(axis=1)
    bodies: list[bytes] = [b""] * nb
    for w in np.unique(width).tolist():
        which = np.flatnonzero(width == w)
        rows = diff[which].reshape(-1, LANES, LANES).astype(np.uint64) & np.uint64((1 << w) - 1)
        words = np.zeros((len(which), w + 1, LANES), np.uint64)
        for i in range(LANES):
            at, shift = divmod(i * w, 32)
            if w:
                words[:, at] |= rows[:, i] << np.uint64(shift)
                if shift + w > 32:
                    words[:, at + 1] |= rows[:, i] >> np.uint64(32 - shift)
        words = words[:, :w].astype("<u4")
        for k, b in enumerate(which.tolist()):
            pos = np.flatnonzero(over[b]) if extras[b] else None
            tail = b"" if pos is None else pos.astype("<u2").tobytes() + diff[b, pos].astype("<u4").tobytes()
            bodies[b] = words[k].tobytes() + tail
    starts = np.concatenate([[0], np.cumsum([len(x) for x in bodies])]).astype("<u8")
    return b"".join([MAGIC, struct.pack("<QI", n, nb), low.astype("<u4").tobytes(), width.astype("u1").tobytes(),
                     extras.astype("<u2").tobytes(), starts.tobytes(), *bodies])


def unpack(data: bytes) -> np.ndarray:
    """The ids (uint32) of ``pack``."""
    if data[:4] != MAGIC:
        raise ValueError("not a frame of token ids")
    n, nb = struct.unpack_from("<QI", data, 4)
    at = 16
    low = np.frombuffer(data, "<u4", nb, at)
    width = np.frombuffer(data, "u1", nb, at + 4 * nb)
    extras = np.frombuffer(data, "<u2", nb, at + 5 * nb)
    starts = np.frombuffer(data, "<u8", nb + 1, at + 7 * nb).astype(np.int64) + at + 15 * nb + 8
    out = np.zeros((nb, BLOCK), np.uint64)
    raw = np.frombuffer(data, np.uint8)
    for w in np.unique(width).tolist():
        which = np.flatnonzero(width == w)
        if w:
            size = w * LANES * 4
            words = raw[starts[which][:, None] + np.arange(size)].view("<u4").reshape(-1, w, LANES).astype(np.uint64)
            rows = np.empty((len(which), LANES, LANES), np.uint64)
            for i in range(LANES):
                a, shift = divmod(i * w, 32)
                rows[:, i] = words[:, a] >> np.uint64(shift)
                if shift + w > 32:
                    rows[:, i] |= words[:, a + 1] << np.uint64(32 - shift)
            out[which] = rows.reshape(-1, BLOCK) & np.uint64((1 << w) - 1)
    for b in np.flatnonzero(extras).tolist():
        k, p = int(extras[b]), int(starts[b]) + int(width[b]) * LANES * 4
        out[b, np.frombuffer(data, "<u2", k, p)] = np.frombuffer(data, "<u4", k, p + 2 * k)
    return (out + low[:, None]).astype(np.uint32).ravel()[:n]


def splits_at_spaces(tokenizer_json: str) -> bool:
    """True where a text may be encoded chunk by chunk: byte-level BPE with
    its own pattern, no normalizer, no prefix space, and special tokens taken
    as ordinary text."""
    t = json.loads(tokenizer_json)
    pre = t.get("pre_tokenizer") or {}
    return (t.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
            and not pre.get("add_prefix_space") and (t.get("model") or {}).get("type") == "BPE"
            and not any(not x["special"] for x in t.get("added_tokens") or []))


class _Encoder:
    """Encodes texts by their distinct chunks, each once while it is kept."""

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        self.model, self.chunked = model, splits_at_spaces(model)
        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.encode_special_tokens = True
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        self.forget()

    def forget(self) -> None:
        self.table, self.coded = ChunkTable(), []
        self.uses = np.zeros(0, np.int64)

    def count(self, rows: list[np.ndarray]) -> None:
        """Add to the uses of the chunks."""
        uses = np.bincount(np.concatenate(rows), minlength=len(self.coded)) if rows else np.zeros(len(self.coded), np.int64)
        uses[:len(self.uses)] += self.uses
        self.uses = uses

    def thin(self, most: int) -> None:
        """Keep the chunks that were used more than once, ``most`` at most;
        their uses count half from now on."""
        keep = np.flatnonzero(self.uses > 1)
        if len(keep) > most:
            keep = np.sort(keep[np.argsort(-self.uses[keep], kind="stable")[:most]])
        names, coded, uses = list(self.table.index), self.coded, self.uses
        self.forget()
        for i in keep.tolist():
            self.table.index[names[i]]  # takes the next number
            self.coded.append(coded[i])
        self.uses = uses[keep] // 2

    def whole(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(texts), 10_000):
            coded = self.tokenizer.encode_batch_fast(texts[i:i + 10_000], add_special_tokens=False)
            out += [np.array(x.ids, "<u4").tobytes() for x in coded]
        return out

    def lines(self, words: list[str]) -> list[bytes]:
        """Ids of words of the form space, then non-spaces: encoded as lines
        of few long texts, since a line break between two of them is always a
        token of its own."""
        out: list[bytes] = []
        for i in range(0, len(words), 2000):
            some = words[i:i + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == self.line)
            raw = ids.tobytes()
            out += [raw[4 * a:4 * b] for a, b in zip([0, *(ends + 1).tolist()], [*ends.tolist(), len(ids)])]
            if len(out) != i + len(some):
                raise AssertionError("a word holds a line break")
        return out

    def update(self) -> None:
        """Encode the chunks that came since the last call."""
        fresh = self.table.chunks(len(self.coded))
        plain = [x[:1] == " " and x[1:].split() == [x[1:]] for x in fresh] if self.line is not None else [False] * len(fresh)
        lines = iter(self.lines([x for x, p in zip(fresh, plain) if p]))
        others = iter(self.whole([x for x, p in zip(fresh, plain) if not p]))
        self.coded += [next(lines) if p else next(others) for p in plain]


_ENCODERS: list[_Encoder] = []  # of this worker: one


def _encoder(model: str) -> _Encoder:
    if not _ENCODERS or _ENCODERS[0].model != model:
        _ENCODERS[:] = [_Encoder(model)]
    return _ENCODERS[0]


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 0,
                      id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode every text (null: empty) with the tokenizer at
    ``tokenizer_path`` (read once, on the driver), special tokens neither
    added nor recognised, append ``end_id`` to each document, and write the
    ids in ascending id order (null ids first, equal ids by text) under
    ``path``.  Only the two named columns are read."""
    with open(tokenizer_path, encoding="utf-8") as f:
        model = f.read()
    model = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    plain = plain.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    tail = b"" if end_id is None else struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _encoder(model.value)
        part = TaskContext.get().partitionId()
        seq = before = 0

        def frames(ids: list[int | None], rows: list[bytes]):
            nonlocal seq, before
            start = size = 0
            for i, row in enumerate(rows):
                size += len(row) // 4
                if size >= FRAME_IDS or i == len(rows) - 1:
                    data = pack(np.frombuffer(b"".join(rows[start:i + 1]), "<u4"))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()),
                         pa.array([ids[start:i + 1]], pa.list_(pa.int64())),
                         pa.array([[len(r) // 4 for r in rows[start:i + 1]]], pa.list_(pa.int64())),
                         pa.array([data], pa.binary())],
                        names=["part", "seq", "before", "doc_ids", "n_tokens", "payload"])
                    seq, before = seq + 1, before + size
                    start, size = i + 1, 0

        def slice_of(ids: list, rows: list):
            if encoder.chunked:
                encoder.update()
                encoder.count(rows)
                coded = encoder.coded
                rows = [b"".join([coded[i] for i in row.tolist()]) + tail for row in rows]
                if len(coded) > KEPT_CHUNKS:
                    del coded
                    encoder.thin(KEPT_CHUNKS // 2)
            else:
                rows = [x + tail for x in encoder.whole(rows)]
            yield from frames(ids, rows)

        encoder.update()  # a task that ended early may have left chunks
        ids, rows, chars = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                ids.append(i)
                rows.append(encoder.table.add(text) if encoder.chunked else text)
                chars += len(text)
                if chars >= SLICE_CHARS:
                    yield from slice_of(ids, rows)
                    ids, rows, chars = [], [], 0
        if ids:
            yield from slice_of(ids, rows)

    frames = plain.mapInArrow(run, "part int, seq int, before long, doc_ids array<long>, n_tokens array<long>, "
                                   "payload binary")
    frames.write.option("compression", "none").parquet(path)
    return path


def read_token_files(spark, path: str) -> DataFrame:
    """The documents of ``write_token_files`` back, decoded from the files:
    (doc_id, start, n_tokens, ids): ``start`` counts the ids of all documents
    before, ``ids`` is binary (little-endian unsigned 32-bit)."""
    files = spark.read.parquet(path)
    totals = files.select("part", "before", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")) \
        .groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("total"))
    running = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each writing task: as small as the list of files
    offsets = totals.select("part", F.coalesce(F.sum("total").over(running), F.lit(0)).alias("offset"))
    placed = files.join(F.broadcast(offsets), "part").select(
        (F.col("before") + F.col("offset")).alias("start"), "doc_ids", "n_tokens", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, ids, sizes, data in zip(*(batch.column(i) for i in range(4))):
                flat = unpack(data.as_py())
                n = np.array(sizes.as_py(), np.int64)
                ends = np.cumsum(n)
                raw = flat.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [ids.values, pa.array(start.as_py() + ends - n), pa.array(n),
                     pa.array([raw[4 * a:4 * b] for a, b in zip((ends - n).tolist(), ends.tolist())], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def new_folder(spark) -> str:
    """A fresh path in the folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"


