"""Periodic runs of words, by Kruskal's algorithm over suffix classes.

A run is a stretch of words with a smallest period that no neighbouring word
extends.  The suffixes of a text are sorted by prefix doubling; neighbours in
that order, taken by decreasing length of their longest common prefix (LCP),
unite the classes of suffixes that begin alike.  Each class is an ordered set
of positions, the smaller of two is put into the larger, and two positions
that become neighbours in it at a distance within the LCP are the seed of a
run: if the words at ``i`` and ``j`` agree for exactly ``l`` words, then
``j - i`` is a period of the ``j - i + l`` words from ``i`` on, and it is the
smallest one, because a smaller one would have put a position between the two
at a larger LCP.  Every run is the seed of its first two periods, so each is
found once.

A text is one row and stays in one task, whole; texts are laid side by side
until they hold a bounded number of words, and all of these are sorted at once.
"""

from __future__ import annotations

from bisect import bisect, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that are sorted together, about; a longer text is sorted alone.
SLICE_WORDS = 300_000
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])


def _levels(codes: np.ndarray, doc: np.ndarray, end: np.ndarray, base: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks of the suffixes by their first 1, 2, 4, ... words, within each
    text, until no two of a text are equal; and the positions that are still
    equal to another at level ``base``, in their final order.  A rank is the
    place of the first of its equals."""
    n = len(codes)
    rank = np.empty(n, np.int64)
    group = doc.astype(np.int64) * (int(codes.max()) + 1) + codes
    active = np.arange(n)
    old = np.zeros(n, np.int64)  # rank of the group that each active position comes from
    levels: list[np.ndarray] = []
    alike = np.empty(0, np.int64)
    width = 1
    while True:
        order = np.argsort(group)
        active, old, group = active[order], old[order], group[order]
        place = np.arange(len(active))
        fresh = np.concatenate([[True], group[1:] != group[:-1]])
        parted = np.concatenate([[True], old[1:] != old[:-1]])
        first = np.maximum.accumulate(np.where(fresh, place, 0))
        rank[active] = old + first - np.maximum.accumulate(np.where(parted, place, 0))
        levels.append(rank.astype(np.int32))
        active = active[~(fresh & np.concatenate([fresh[1:], [True]]))]
        if len(levels) == base + 1:
            alike = active
        if not len(active):
            break
        old, after = rank[active], active + width
        inside = after < end[active]
        group = old * (n + 1) + np.where(inside, rank[np.where(inside, after, 0)] + 1, 0)
        width *= 2
    return levels, alike[np.argsort(rank[alike])]


def _lcp(levels: list[np.ndarray], end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that the suffixes at ``a`` and ``b`` have in common."""
    out = np.zeros(len(a), np.int64)
    for t in range(len(levels) - 1, -1, -1):
        x, y = a + out, b + out
        inside = np.maximum(x, y) + (1 << t) <= end[a]
        x, y = np.where(inside, x, 0), np.where(inside, y, 0)
        out += (inside & (levels[t][x] == levels[t][y])).astype(np.int64) << t
    return out


def _kruskal(a: list[int], b: list[int], lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """Unites the classes of ``a`` and ``b``, whose LCPs decrease: (i, j, l) of
    all positions i < j that become neighbours in a class, at LCP l."""
    root: dict[int, int] = {}
    places: dict[int, list[int]] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for x, y, l in zip(a, b, lcp):
        x, y = find(x), find(y)
        many, few = places.pop(x, None) or [x], places.pop(y, None) or [y]
        if len(many) < len(few):
            x, y, many, few = y, x, few, many
        root[y] = x
        for k, p in enumerate(few):
            at = bisect(many, p)
            if at and (k == 0 or few[k - 1] < many[at - 1]):
                yield many[at - 1], p, l
            if at < len(many) and (k + 1 == len(few) or few[k + 1] > many[at]):
                yield p, many[at], l
        if len(few) * 8 < len(many):
            for p in few:
                insort(many, p)
        else:
            many = sorted(many + few)  # two sorted pieces: merged in one pass
        places[x] = many


def find_runs(texts: list[np.ndarray], min_length: int, min_exponent: int) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text (an array of word
    numbers), by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    if not sizes.sum():
        return out
    codes = np.concatenate(texts).astype(np.int64)
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(texts)), sizes)
    end = ends[doc]
    # a run is its period longer than the LCP of its first two periods
    least = min_length - min_length // min_exponent
    base = least.bit_length() - 1
    levels, order = _levels(codes, doc, end, base)
    a, b = order[:-1], order[1:]
    alike = levels[base][a] == levels[base][b] if len(a) else np.empty(0, bool)
    a, b = a[alike], b[alike]
    lcp = _lcp(levels, end, a, b)
    by = np.argsort(-lcp, kind="stable")
    by = by[lcp[by] >= least]
    for i, j, l in _kruskal(a[by].tolist(), b[by].tolist(), lcp[by].tolist()):
        period = j - i
        if l >= (min_exponent - 1) * period and l + period >= min_length:
            d = int(doc[i])
            start = int(ends[d] - sizes[d])
            if i == start or codes[i - 1] != codes[j - 1]:
                out[d].append((i - start, l + period, period))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period:start + length] = False
        words = [words[i] for i in np.flatnonzero(keep).tolist()]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, text_col: str = "text", min_length: int = 24, min_exponent: int = 3,
                  keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the runs of its texts: n_words (long), runs (array of
    start, length, period, by start, then period) and collapsed (string: the
    words left when every run gives up all but its first period, joined by one
    space).

    Words are runs of characters other than the six ASCII white spaces, and
    are numbered from 0.  A run has at least ``min_length`` words and
    ``min_exponent`` (2 or more) times its smallest period.  A null or empty text has 0
    words, no runs and an empty collapsed text.  Rows are judged one by one:
    repeated rows and null or repeated ids in other columns change nothing, an
    empty table gives an empty one.  ``keep`` names the columns of ``docs`` to
    return (all by default); one named like a result is replaced by it.
    A text of n words needs about n * log2(its longest repeat) * 4 bytes.
    """
    if min_exponent < 2 or min_length < 2:
        raise ValueError("a run has two words and two periods at least")
    made = ["n_words", "runs", "collapsed"]
    names = [c for c in (docs.columns if keep is None else keep) if c not in made]
    source = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").cast("string").alias("__text_of_runs"))
    schema = docs.select(*[F.col(f"`{c}`") for c in names], F.lit(0).cast("long").alias("n_words"),
                         F.lit(None).cast(RUNS).alias("runs"), F.lit("").alias("collapsed")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(names)).cast(pa.binary())
            at = 0
            while at < batch.num_rows:
                start, held, number = at, 0, defaultdict()
                number.default_factory = number.__len__
                words: list[list[bytes]] = []
                while at < batch.num_rows and held < SLICE_WORDS:
                    words.append((texts[at].as_py() or b"").split())
                    held += len(words[-1])
                    at += 1
                found = find_runs([np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in words],
                                  min_length, min_exponent)
                flat = [r for rows in found for r in rows]
                runs = pa.StructArray.from_arrays(
                    [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)], fields=list(_RUN))
                stops = np.concatenate([[0], np.cumsum([len(r) for r in found])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(start, at - start).columns[:len(names)],
                     pa.array([len(w) for w in words], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(stops), runs),
                     pa.array([_collapsed(w, r) for w, r in zip(words, found)], pa.binary()).cast(pa.string())],
                    names=[*names, *made])

    return source.mapInArrow(run, schema)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly (ties: the
    smallest start, then period); null without runs."""
    def better(x, y):
        left, right = x["length"] * y["period"], y["length"] * x["period"]
        return (left > right) | ((left == right) & ((x["start"] < y["start"]) | (
            (x["start"] == y["start"]) & (x["period"] < y["period"]))))

    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, x: F.when(better(x, best), x).otherwise(best))


def runs_digest(runs: Column) -> Column:
    """Every run as a line ``start,length,period``, in order."""
    line = F.transform(runs, lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"),
                                                   r["period"].cast("string")))
    return F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "")
