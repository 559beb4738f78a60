"""Byte-level BPE by corpus-level merge replay, and its inverse.

A task does not encode text by text.  It numbers the distinct words of a
whole slice of the corpus, lays all of them out as one array of symbols, and
replays the merges over that array: an inverted index from rank (of a token
pair) to word positions is taken in rank order, every position of the rank is
merged at once - of pairs that overlap, as in a run of equal symbols, every
other one - and only the touched neighbours get new pairs.  Each text is
then the join of its words' ids.  A slice holds a bounded amount of text, so
memory does not grow with the input; no shuffle is needed.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.chunks import ChunkTable

#: Characters of text that a task holds at a time; words that are replayed
#: together; replayed words that a task keeps for its next slices.
SLICE_CHARS = 6_000_000
REPLAY_WORDS = 100_000
KEPT_WORDS = 200_000
#: Rows of a batch that goes back to Spark.
OUT_ROWS = 1000
_NONE = np.iinfo(np.int32).max


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, of a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


class MergeTable:
    """Ranks of all token pairs whose joined bytes are a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order]
        self.values = np.array(values, np.int32)[order]
        # tokens that some pair joins to a token of a lower rank than their own
        self.early = np.zeros(max(ranks.values()) + 1, bool)
        for side in (self.keys >> 32, self.keys & 0xFFFFFFFF):
            self.early[side[self.values < side]] = True
        self.kept: dict[str, bytes] = {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        if not len(self.keys):
            return np.full(len(key), _NONE, np.int32)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], _NONE)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian uint32 bytes) of each word.  A word that is a
        token is that token; the others are merged lowest rank first, at equal
        ranks leftmost first."""
        whole = [self.ranks.get(w) for w in words]
        rest = [i for i, r in enumerate(whole) if r is None and words[i]]
        out = [b"" if r is None else r.to_bytes(4, "little") for r in whole]
        if rest:
            for i, ids in zip(rest, self._merge([words[i] for i in rest])):
                out[i] = ids
        return out

    def encode(self, words: dict[str, int]) -> list[bytes]:
        """``replay`` of the keys, in order; some results are kept."""
        fresh = [w for w in words if w not in self.kept]
        if len(self.kept) + len(fresh) > KEPT_WORDS:
            self.kept.clear()
            fresh = list(words)
        for i in range(0, len(fresh), REPLAY_WORDS):
            some = fresh[i:i + REPLAY_WORDS]
            self.kept.update(zip(some, self.replay([w.encode() for w in some])))
        return [self.kept[w] for w in words]

    def _merge(self, words: list[bytes]) -> list[bytes]:
        sizes = np.array([len(w) for w in words])
        ends = np.cumsum(sizes)
        sym = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        n = len(sym)
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        right = np.arange(1, n + 1, dtype=np.int32)
        right[ends - 1] = -1
        left = np.arange(-1, n - 1, dtype=np.int32)
        left[np.concatenate([[0], ends[:-1]])] = -1
        rank = np.full(n, _NONE, np.int32)  # of the pair that begins here
        has = np.flatnonzero(right >= 0).astype(np.int32)
        rank[has] = self.rank(sym[has], sym[right[has]])
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def put(positions: np.ndarray) -> None:
            ranks = rank[positions]
            if (found := ranks != _NONE).any():
                positions, ranks = positions[found], ranks[found]
                order = np.argsort(ranks, kind="stable")
                positions, ranks = positions[order], ranks[order]
                starts = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]]))
                for r, p in zip(ranks[starts].tolist(), np.split(positions, starts[1:])):
                    if r in index:
                        index[r].append(p)
                    else:
                        index[r] = [p]
                        heapq.heappush(queue, r)

        def together(r: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Of the positions of rank ``r``: those to merge now, and those
            to look at again."""
            same = word[at[1:]] == word[at[:-1]]
            if not same.any():
                return at, at[:0]
            # leftmost first: of a chain of overlapping pairs every other one is merged
            place = np.arange(len(at))
            begins = np.concatenate([[True], right[at[:-1]] != at[1:]])
            whole, at = at, at[(place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0]
            if not self.early[r]:
                return at, at[:0]
            # a pair that a merge makes must not come before the merges that are left
            after, before = right[right[at]], left[at]
            joined = np.concatenate([[False], after[:-1] == at[1:]])
            made = np.full(len(at), _NONE, np.int32)
            some = np.flatnonzero(after >= 0)
            made[some] = self.rank(np.full(len(some), r, np.int32), sym[after[some]])
            some = np.flatnonzero(before >= 0)
            made[some] = np.minimum(made[some], self.rank(np.where(joined[some], r, sym[before[some]]).astype(np.int32),
                                                          np.full(len(some), r, np.int32)))
            if not (made < r).any():
                return at, at[:0]
            first = np.concatenate([[True], ~same])
            odd = word[at[made < r]]
            slow = np.isin(word[whole], odd)
            return np.sort(np.concatenate([at[~np.isin(word[at], odd)], whole[slow & first]])), whole[slow & ~first]

        put(has)
        while queue:
            r = heapq.heappop(queue)
            at = np.unique(np.concatenate(index.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            at, later = together(r, at)
            gone = right[at]
            after = right[gone]
            sym[at] = r
            alive[gone] = False
            rank[gone] = _NONE
            right[at] = after
            inner = after >= 0
            left[after[inner]] = at[inner]
            rank[at] = _NONE
            rank[at[inner]] = self.rank(sym[at[inner]], sym[after[inner]])
            before = left[at]
            before = before[before >= 0]
            rank[before] = self.rank(sym[before], sym[right[before]])
            put(np.concatenate([at[inner], before]))
            if len(later):
                put(later)
        kept = sym[alive].astype("<u4")
        count = np.bincount(word[alive], minlength=len(words))
        stop = np.cumsum(count) * 4
        data = kept.tobytes()
        return [data[a:b] for a, b in zip(np.concatenate([[0], stop[:-1]]).tolist(), stop.tolist())]


_TABLES: dict[int, MergeTable] = {}  # of this worker


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text",
               out: str = "ids") -> DataFrame:
    """``docs`` with a binary column ``out``: the ids of the text as
    little-endian unsigned 32-bit integers, every match of ``pattern`` encoded
    on its own, without special tokens.  A null or empty text has no ids.  A
    column named ``out`` is replaced.  Rows are encoded one by one, so repeated
    rows give repeated results and an empty table an empty one.
    ``pattern`` must begin a new match at a space before a non-space, as the
    usual byte-level patterns do.  The file at ``ranks_path`` is read once, on
    the driver."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    others = [c for c in docs.columns if c != out]
    names = [*others, *([text_col] if text_col == out else [])]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    schema = docs.select(*[F.col(f"`{c}`") for c in others], F.lit(b"").alias(out)).schema
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ranks.value
        merges = _TABLES.get(id(found))
        if merges is None or merges.ranks is not found:
            _TABLES.clear()
            merges = _TABLES[id(found)] = MergeTable(found)
        split = regex.compile(pattern).findall
        held: list[tuple[pa.RecordBatch, list[np.ndarray]]] = []
        chunks, chars = ChunkTable(), 0

        def flush():
            texts = chunks.chunks()
            pieces: dict[str, int] = {}
            made = [[pieces.setdefault(p, len(pieces)) for p in split(c)] for c in texts]
            ids = merges.encode(pieces)
            coded = [b"".join([ids[i] for i in m]) for m in made]
            del pieces, made, ids, texts  # before the rows are built
            for batch, rows in held:
                for i in range(0, len(rows), OUT_ROWS):
                    some = rows[i:i + OUT_ROWS]
                    got = [b"".join([coded[c] for c in row.tolist()]) for row in some]
                    yield pa.RecordBatch.from_arrays(
                        [*batch.slice(i, len(some)).columns[:len(others)], pa.array(got, pa.binary())], names=[*others, out])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                rows, start = [], at
                while at < batch.num_rows and chars < SLICE_CHARS:
                    text = batch.column(place)[at].as_py() or ""
                    rows.append(chunks.add(text))
                    chars += len(text)
                    at += 1
                held.append((batch.slice(start, at - start), rows))
                if chars >= SLICE_CHARS:
                    yield from flush()
                    held, chunks, chars = [], ChunkTable(), 0
        yield from flush()
        merges.kept.clear()  # the worker may idle for long

    return docs.mapInArrow(run, schema)


def bpe_decode(coded: DataFrame, ranks_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``coded`` with a binary column ``out``: the bytes that its ids stand
    for.  Null ids give no bytes; an id without a token is an error.  A column
    named ``out`` is replaced; an empty table gives an empty one."""
    ranks = coded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    others = [c for c in coded.columns if c != out]
    names = [*others, *([ids_col] if ids_col == out else [])]
    coded = coded.select(*[F.col(f"`{c}`") for c in names])
    schema = coded.select(*[F.col(f"`{c}`") for c in others], F.lit(b"").alias(out)).schema
    place = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {r: t for t, r in ranks.value.items()}.__getitem__
        for whole in batches:
            for i in range(0, whole.num_rows, OUT_ROWS):
                batch = whole.slice(i, OUT_ROWS)
                got = [b"".join(map(token, np.frombuffer(x.as_py() or b"", "<u4").tolist()))
                       for x in batch.column(place)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:len(others)], pa.array(got, pa.binary())],
                                                 names=[*others, out])

    return coded.mapInArrow(run, schema)
