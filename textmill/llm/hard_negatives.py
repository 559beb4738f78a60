"""Hard negatives by inner product, with coordinate pruning.

Vectors lie in buckets of like length (the shortest of a bucket has 0.9 of the
longest, or more), and buckets in blocks of bounded size.  An anchor that looks
for scores of ``t`` or more skips every block whose longest vector is too short
for ``t``.  In the others, a vector must have a cosine of t / (length of anchor
x longest of the block) at least, which bounds each of its coordinates: the cap
of directions that near to the anchor's covers only a range of values on each
axis.  Each block keeps a sorted list of values for every coordinate; the
ranges of the anchor's focus coordinates (the largest ones) cut pieces from
these lists, the smallest piece is intersected with the others, and what is
left is verified by exact integer products.  Where the smallest piece is most of
the block, the block is verified as it stands.

The thresholds come from a first round over one block an anchor, the fullest of
its kind: the k-th best score there is a lower bound of the k-th best of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.operators.headtail import join_split
from textmill.session import barrier

#: Rows of a block, about; anchors that meet one copy of a block, about.
BLOCK, SLICE = 2048, 16_384
#: Shortest to longest of a bucket.
RATIO = 0.9
#: Coordinates of an anchor whose ranges are looked up.
FOCUS = 4
#: A piece of more than this share of a block is not worth a list of its own.
WHOLE = 0.5
#: Anchors whose products with a block are held at a time.
_CHUNK = 256
#: Beyond all scores: squared lengths stay below it.
_FAR = 1 << 62
_SLACK = 1e-9


def _rows(table: DataFrame, id_col: str, vec_col: str, label_col: str, anchor: Column) -> DataFrame:
    """(row, id, label, v, dim, bucket, anchor): what takes part, with a number
    for each row, since ids may repeat."""
    v = F.transform(F.col(f"`{vec_col}`"), lambda x: x.cast("long"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    length = F.sqrt("square")
    # whole numbers, so a length is 0, or 1 or more
    bucket = F.when(F.col("square") < 1, -1).otherwise(F.floor(F.log(length) / -float(np.log(RATIO)))).cast("int")
    got = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"),
                       v.alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor")) \
        .where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL)") \
        .withColumn("square", square).where(F.col("square") < float(_FAR))
    return barrier(got.select(F.monotonically_increasing_id().alias("row"), "id", "label", "v",
                              F.size("v").alias("dim"), bucket.alias("bucket"), "anchor"))


class _Block:
    """Vectors of one block with the sorted lists of their coordinates."""

    def __init__(self, row: np.ndarray, ids: np.ndarray, label: np.ndarray, v: np.ndarray):
        self.row, self.ids, self.label, self.v = row, ids, label, v
        self.length = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
        self.longest, self.shortest = (self.length.max(), self.length.min()) if len(v) else (0.0, 0.0)
        unit = v / np.where(self.length > 0, self.length, 1)[:, None]
        self.order = np.argsort(unit, axis=0)
        self.lists = np.ascontiguousarray(np.take_along_axis(unit, self.order, axis=0).T)
        self.order = np.ascontiguousarray(self.order.T)
        self.unit = unit

    def cosines(self, length: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The cosine that a vector of the block needs for a score of ``least``
        with an anchor of ``length``: over 1 if none can have it, -1 if all do."""
        high = least > 0
        reach = length * np.where(high, self.longest, self.shortest)
        share = least / np.where(reach > 0, reach, 1)
        return np.where(high, np.where(reach > 0, share, 2.0), np.where(reach > 0, np.maximum(share, -1), -1.0)) - _SLACK

    def candidates(self, direction: np.ndarray, cosine: float) -> np.ndarray | None:
        """Rows of the block within the feasible ranges of the focus
        coordinates; None for all of them."""
        if cosine <= -1 or not direction.any():
            return None
        angle = np.arccos(min(1.0, cosine))
        focus = np.argsort(-np.abs(direction), kind="stable")[:FOCUS]
        own = np.arccos(np.clip(direction[focus], -1, 1))
        low = np.cos(np.minimum(np.pi, own + angle)) - _SLACK
        high = np.cos(np.maximum(0, own - angle)) + _SLACK
        cut = [(int(np.searchsorted(self.lists[f], a)), int(np.searchsorted(self.lists[f], z, "right")))
               for f, a, z in zip(focus, low, high)]
        best = min(range(len(focus)), key=lambda i: cut[i][1] - cut[i][0])
        a, z = cut[best]
        if z - a > WHOLE * len(self.ids):
            return None
        some = self.order[focus[best], a:z]
        for i, f in enumerate(focus):
            if i != best and cut[i][1] - cut[i][0] < len(self.ids):
                x = self.unit[some, f]
                some = some[(x >= low[i]) & (x <= high[i])]
        return np.sort(some)

    def products(self, anchors: np.ndarray, some: np.ndarray | None = None) -> np.ndarray:
        """Exact products (anchors x rows)."""
        v = self.v if some is None else self.v[some]
        far = np.sqrt((anchors.astype(np.float64) ** 2).sum(axis=1).max(initial=0)) * self.longest
        if far < float(1 << 52):  # all sums are whole numbers that doubles hold
            return (anchors.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
        return anchors @ v.T


def _best(block: _Block, some: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Numbers within ``some`` of the k highest scores, ties by id, then row."""
    at = np.arange(len(some))
    if len(at) > k:
        at = at[scores >= np.partition(scores, len(at) - k)[len(at) - k]]
    return at[np.lexsort((block.row[some[at]], block.ids[some[at]], -scores[at]))[:k]]


def _search(k: int, other_label: bool):
    """A function for mapInArrow over rows sorted by block, its rows first:
    for each window (w, lo, hi) of each anchor the ``k`` best rows of the block
    with lo <= score <= hi, of another label or not the anchor itself."""
    place = ["dim", "kind_label", "bucket", "part", "slice"]

    def matrix(col: pa.ListArray, dim: int) -> np.ndarray:
        return np.asarray(col.flatten(), np.int64).reshape(len(col), dim)

    def answer(block: _Block, b: pa.RecordBatch, dim: int) -> Iterator[tuple]:
        anchors = matrix(b.column("v"), dim)
        rows, labels, windows = np.asarray(b.column("row")), b.column("label").to_pylist(), b.column("windows").to_pylist()
        length = np.sqrt((anchors.astype(np.float64) ** 2).sum(axis=1))
        least = np.array([min((w["lo"] for w in ws), default=_FAR) for ws in windows], np.float64)
        cosine = block.cosines(length, least)
        meet = np.flatnonzero(cosine <= 1)
        parts = {i: block.candidates(anchors[i] / max(length[i], 1e-300), float(cosine[i])) for i in meet.tolist()}
        whole = [i for i in meet.tolist() if parts[i] is None]
        table = block.products(anchors[whole]) if whole else None
        at = {i: n for n, i in enumerate(whole)}
        everything = np.arange(len(block.ids))
        for i in meet.tolist():
            some = everything if parts[i] is None else parts[i]
            if not len(some):
                continue
            scores = table[at[i]] if parts[i] is None else block.products(anchors[i:i + 1], some)[0]
            fit = block.label[some] != labels[i] if other_label else block.row[some] != rows[i]
            for w in windows[i]:
                good = np.flatnonzero(fit & (scores >= w["lo"]) & (scores <= w["hi"]))
                if len(good):
                    best = good[_best(block, some[good], scores[good], k)]
                    for j, score in zip(some[best].tolist(), scores[best].tolist()):
                        yield int(rows[i]), w["w"], score, int(block.ids[j]), int(block.row[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            keys = [b.column(p).dictionary_encode().indices.to_numpy(zero_copy_only=False) for p in place]
            kind = np.asarray(b.column("kind"))
            change = np.zeros(b.num_rows, bool)
            for c in [*keys, kind]:
                change[1:] |= c[1:] != c[:-1]
            starts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
            for a, z in zip(starts, starts[1:]):
                key = tuple(b.column(p)[a].as_py() for p in place)
                if key != now:
                    now, held, block = key, [], None
                if kind[a] == 0:
                    held.append(b.slice(a, z - a))
                    continue
                if not held:
                    continue
                if block is None:
                    block = _Block(np.concatenate([np.asarray(h.column("row")) for h in held]),
                                   np.concatenate([np.asarray(h.column("id")) for h in held]),
                                   np.concatenate([np.array(h.column("label").to_pylist(), object) for h in held]),
                                   np.concatenate([matrix(h.column("v"), now[0]) for h in held]))
                for i in range(a, z, _CHUNK):
                    found = list(answer(block, b.slice(i, min(_CHUNK, z - i)), now[0]))
                    if found:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int32(), *[pa.int64()] * 3))],
                            names=["anchor_row", "w", "score", "id", "row"])

    return run


def _meet(rows: DataFrame, anchors: DataFrame, k: int, by_label: bool, first: bool) -> DataFrame:
    """(anchor_row, w, rank, score, id, row): the ``k`` best rows for every
    window of the anchors - (row, label, v, dim, windows) - among the rows of
    their label (``by_label``) or those of other labels.  ``first``: only the
    fullest block of their kind is searched."""
    group = F.struct("dim", (F.col("label") if by_label else F.lit("")).alias("kind_label"))
    rows, anchors = rows.withColumn("g", group), anchors.withColumn("g", group)
    counts = rows.groupBy("g", "bucket").agg(F.count(F.lit(1)).alias("n"))
    # a group has as many buckets as lengths have powers of 0.9: about 400 at most
    buckets = counts.groupBy("g").agg(F.sum("n").alias("n"), F.collect_list(F.struct(
        "n", "bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))).alias("buckets"))
    asked = anchors.groupBy("g").agg(F.count(F.lit(1)).alias("q"))
    groups = barrier(buckets.join(asked, "g").withColumn("slices", F.ceil(F.col("q") / SLICE).cast("int"))
                     .withColumn("fullest", F.array_max("buckets")))
    here = groups.select("g", "slices", "fullest", F.map_from_entries(
        F.transform("buckets", lambda b: F.struct(b["bucket"], b["parts"]))).alias("parts"))
    placed = join_split(rows, here, "g", groups.select("g", "n"))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")[F.col("bucket")]).cast("int"))
    there = groups.select("g", "slices", F.array(F.struct(F.col("fullest.bucket").alias("bucket"), F.lit(1).alias("parts")))
                          .alias("to") if first else F.col("buckets").alias("to"))
    sent = join_split(anchors, there, "g", groups.select("g", F.col("q").alias("n")))
    sent = sent.withColumn("slice", F.pmod(F.xxhash64("row"), F.col("slices")).cast("int")) \
        .withColumn("to", F.explode("to")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("to.parts") - 1)))
    if first:
        placed = placed.where((F.col("bucket") == F.col("fullest.bucket")) & (F.col("part") == 0))
    windows = "array<struct<w:int,lo:bigint,hi:bigint>>"
    placed = placed.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select(
        "g.dim", "g.kind_label", "bucket", "part", "slice", F.lit(0).alias("kind"), "row", "id", "label", "v",
        F.lit(None).cast(windows).alias("windows"))
    sent = sent.select("g.dim", "g.kind_label", "to.bucket", "part", "slice", F.lit(1).alias("kind"), "row", "id", "label",
                       "v", F.col("windows").cast(windows).alias("windows"))
    key = ["dim", "kind_label", "bucket", "part", "slice"]
    found = placed.unionByName(sent).repartition(*key).sortWithinPartitions(*key, "kind") \
        .mapInArrow(_search(k, not by_label), "anchor_row long, w int, score long, id long, row long")
    order = Window.partitionBy("anchor_row", "w").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(table: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score): for each row of ``table`` for which ``anchor`` holds, its
    ``positives`` best other rows of the same label, and for each of these the
    ``negatives`` best rows of other labels whose score is ``low`` to ``high``
    percent of the positive's.  Scores are inner products of vectors of whole
    numbers; higher ones come first, ties by smaller id.

    Rows with a null id, label or vector, a null component or a squared length
    of 2^62 or more take no part (scores are longs).  Vectors of another length
    than the anchor's have no product with it.  Rows are told apart by place,
    not by id: each of several with one id counts, and the others of an
    anchor's own id are other rows.  An anchor without positives, or a positive
    without negatives in its range, has no row; so has any negative positive
    score.  Other columns are ignored; an empty table gives an empty one."""
    rows = _rows(table, id_col, vec_col, label_col, anchor)
    anchors = rows.where("anchor").select("row", "id", "label", "v", "dim")

    def raised(asked: DataFrame, seen: DataFrame, k: int) -> DataFrame:
        """Windows whose lower end is the k-th best score seen, where there is one."""
        kth = seen.where(F.col("rank") == k).groupBy("anchor_row").agg(
            F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("kth")).withColumnRenamed("anchor_row", "row")
        return asked.join(kth, "row", "left").withColumn("windows", F.transform("windows", lambda w: F.struct(
            w["w"].alias("w"), F.coalesce(F.col("kth")[w["w"]], w["lo"]).alias("lo"), w["hi"].alias("hi")))).drop("kth")

    # one window, of all scores, among the rows of the label
    asked = anchors.withColumn("windows", F.array(F.struct(
        F.lit(0).alias("w"), F.lit(-_FAR).alias("lo"), F.lit(_FAR).alias("hi"))))
    asked = barrier(raised(asked, _meet(rows, asked, positives, True, True), positives))
    near = barrier(_meet(rows, asked, positives, True, False))

    # a window for each positive, among the rows of other labels
    part = F.col("score").cast("decimal(30,0)")
    window = F.struct(F.col("rank").cast("int").alias("w"), F.ceil(part * low / 100).cast("long").alias("lo"),
                      F.floor(part * high / 100).cast("long").alias("hi"))
    wanted = near.groupBy("anchor_row").agg(F.filter(F.collect_list(window), lambda w: w["lo"] <= w["hi"]).alias("windows"))
    asked = barrier(anchors.join(wanted.where(F.size("windows") > 0).withColumnRenamed("anchor_row", "row"), "row"))
    asked = barrier(raised(asked, _meet(rows, asked, negatives, False, True), negatives))
    far = _meet(rows, asked, negatives, False, False)
    found = far.select("anchor_row", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")) \
        .join(near.select("anchor_row", F.col("rank").alias("w"), F.col("id").alias("positive_id"),
                          F.col("score").alias("positive_score")), ["anchor_row", "w"]) \
        .join(anchors.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id")), "anchor_row")
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
                        "positive_score", "negative_score")
