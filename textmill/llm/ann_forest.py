"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample: each node splits its points at the
median of their projections on a random direction, drawn as the difference of
two of them.  Every vector of the table is then routed to one leaf of each
tree.  A query walks all trees through one shared priority queue - always the
branch whose cell is nearest by the margins on its way - until the leaves it has
reached hold enough vectors; those are scored exactly, in double precision.

Equal vectors are one point of the index with their smallest ids, so that a
vector that a third of all rows share costs no more than another.  Leaves are
stored in blocks of bounded size, dealt over the cluster by tree, leaf and
block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.session import barrier

#: Trees, levels of each, and points of the sample at most.
TREES, DEPTH, SAMPLE_ROWS = 10, 9, 20_000
#: A query's search ends when its leaves, over all trees, hold so many vectors
#: and this share of the index.  The share is what vectors without any
#: clusters need for a recall over 0.9; clustered ones do with far less.
SEARCH, SEARCH_SHARE = 6_000, 0.6
#: Vectors of a leaf that one block holds, about.
BLOCK = 2048
#: Pieces in which the ids of one much repeated vector are gathered first.
SALTS = 256
SEED = 11


@dataclass
class Forest:
    """Directions (tree, node, dim) and thresholds (tree, node); nodes are
    numbered as in a heap, leaves from 0."""

    directions: np.ndarray
    thresholds: np.ndarray

    @property
    def depth(self) -> int:
        return int(np.log2(self.thresholds.shape[1] + 1))

    def route(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each unit vector in each tree: (trees, rows)."""
        out = np.empty((len(self.directions), len(x)), np.int32)
        for t, (d, h) in enumerate(zip(self.directions, self.thresholds)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", x, d[node]) > h[node]
                node = 2 * node + 1 + side
            out[t] = node - len(h)
        return out

    def leaves(self, x: np.ndarray, sizes: np.ndarray, enough: int) -> list[tuple[int, int]]:
        """(tree, leaf) pairs for one unit vector, by one priority queue over
        all trees, until they hold ``enough`` vectors (or all are reached).
        ``sizes`` counts vectors by tree and leaf."""
        margins = self.directions @ x - self.thresholds
        inner = margins.shape[1]
        queue = [(0.0, t, 0) for t in range(len(margins))]
        out, have = [], 0
        while queue and have < enough:
            far, t, node = heapq.heappop(queue)
            m = margins[t]
            while node < inner:
                d = float(m[node])
                heapq.heappush(queue, (far + d * d, t, 2 * node + 1 + (d <= 0)))
                node = 2 * node + 1 + (d > 0)
            if n := int(sizes[t, node - inner]):
                out.append((t, node - inner))
                have += n
        return out


def fit_forest(sample: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> Forest:
    """Trees over the unit vectors ``sample``; a node with fewer than two
    different points splits along a random direction."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    inner = (1 << depth) - 1
    directions = np.zeros((trees, inner, dim), np.float32)
    thresholds = np.zeros((trees, inner), np.float32)
    for t in range(trees):
        rows: list[np.ndarray] = [np.arange(len(sample))] + [np.empty(0, np.int64)] * (2 * inner)
        for node in range(inner):
            mine = rows[node]
            d = np.zeros(dim)
            if len(mine) >= 2:
                a, b = rng.choice(len(mine), 2, replace=False)
                d = sample[mine[a]].astype(np.float64) - sample[mine[b]]
            if not d.any():
                d = rng.normal(size=dim)
            directions[t, node] = d / np.linalg.norm(d)
            if len(mine):
                p = sample[mine] @ directions[t, node]
                thresholds[t, node] = np.median(p)
                side = p > thresholds[t, node]
                rows[2 * node + 1], rows[2 * node + 2] = mine[~side], mine[side]
                rows[node] = np.empty(0, np.int64)
    return Forest(directions, thresholds)


def _vector(x) -> np.ndarray:
    return np.asarray(x, np.float64)


def _scaled(m: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component near 1: very
    large components stay finite, and no bit of a cosine changes."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True))[1])


def valid_vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): ids and vectors that take part - none null, no null or
    non-finite component, some component not 0."""
    v = F.col(vec_col).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"), good.alias("ok")) \
        .where("vec_id IS NOT NULL AND v IS NOT NULL AND ok").drop("ok")


def common_length(rows: DataFrame) -> int:
    """The vector length that most rows have (the smaller of two as frequent)."""
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return common["n"] if common else 0


def _points(rows: DataFrame, ids: int) -> DataFrame:
    """(rep, v, ids): equal vectors as one, with their ``ids`` smallest ids (an
    id as often as rows have it); rep numbers them."""
    def few(c):
        return F.slice(F.array_sort(c), 1, ids)

    # a task first keeps the smallest ids of each vector that it sees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best: dict[bytes, list[int]] = {}
            row: dict[bytes, int] = {}
            for i, (n, v) in enumerate(zip(b.column(0).to_pylist(), b.column(1))):
                key = np.asarray(v.values).tobytes()
                row.setdefault(key, i)
                best.setdefault(key, []).append(n)
            yield pa.RecordBatch.from_arrays(
                [b.column(1).take(pa.array(list(row.values()), pa.int64())),
                 pa.array([sorted(x)[:ids] for x in best.values()], pa.list_(pa.int64()))], names=["v", "ids"])

    kind = rows.schema["v"].dataType.simpleString()
    part = rows.select("vec_id", "v").mapInArrow(run, f"v {kind}, ids array<long>")
    part = part.groupBy("v", F.pmod(F.xxhash64("ids"), F.lit(SALTS)).alias("salt")) \
        .agg(few(F.flatten(F.collect_list("ids"))).alias("ids"))
    part = part.groupBy("v").agg(few(F.flatten(F.collect_list("ids"))).alias("ids"))
    return part.select(F.monotonically_increasing_id().alias("rep"), "v", "ids")


def nearest(table: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
            trees: int = TREES, depth: int = DEPTH, sample_rows: int = SAMPLE_ROWS, search: int = SEARCH,
            search_share: float = SEARCH_SHARE, seed: int = SEED) -> DataFrame:
    """The ``k`` nearest rows of ``table`` by cosine for each row of
    ``queries`` (same columns): (query_id, rank, vec_id, score), nearest first,
    ties to the smaller id.  A query that is itself a row of ``table`` (same id
    and vector) is not its own neighbour.

    Null vectors and ids, zero vectors and vectors with a null or non-finite
    component take no part on either side; nor do vectors of another length
    than most of ``table`` have.  Rows may share an id: each is found, and each
    such query has its own ``k`` rows.  A query has fewer than ``k`` rows only
    where the table has fewer others.  Other columns are ignored; empty tables
    give no rows.
    """
    spark = table.sparkSession
    valid = valid_vectors(table, id_col, vec_col)
    dim = common_length(valid)
    points = barrier(_points(valid.where(F.size("v") == dim), k + 1))
    there = points.count()
    share = min(1.0, sample_rows / max(1, there))
    sample = points if share == 1 else points.where(
        F.pmod(F.xxhash64("rep", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))
    schema = "query_id long, rank int, vec_id long, score double"
    rows = sorted((r["rep"], r["v"]) for r in sample.select("rep", "v").collect())  # sample_rows at most, about
    if not rows:
        return spark.createDataFrame([], schema)
    x = np.array([v for _, v in rows], np.float64)
    unit = lambda m: (lambda y: y / np.linalg.norm(y, axis=1, keepdims=True))(_scaled(m))
    forest = fit_forest(unit(x).astype(np.float32), trees, depth, seed)
    shared = spark.sparkContext.broadcast(forest)  # its size is fixed by trees, depth and dim

    def matrix(col) -> np.ndarray:
        return np.asarray(col.flatten(), np.float64).reshape(-1, dim)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaf = shared.value.route(unit(matrix(b.column(1))).astype(np.float32))
                for t, at in enumerate(leaf):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), t, np.int32)), pa.array(at), b.column(0), b.column(1), b.column(2)],
                        names=["tree", "leaf", "rep", "v", "ids"])

    kind = points.schema["v"].dataType.simpleString()
    placed = points.mapInArrow(index, f"tree int, leaf int, rep long, v {kind}, ids array<long>")
    placed = barrier(placed)
    sizes = np.zeros((trees, 1 << depth), np.int64)
    for r in placed.groupBy("tree", "leaf").count().collect():  # trees x leaves at most
        sizes[r["tree"], r["leaf"]] = r["count"]
    parts = -(-sizes // BLOCK)
    enough = max(search, int(search_share * there))
    state = spark.sparkContext.broadcast((sizes, parts))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, leaf, rep = (np.asarray(b.column(i)) for i in range(3))
            part = (rep * 0x9E3779B1 >> 7) % np.maximum(state.value[1][t, leaf], 1)
            at = ((t.astype(np.int64) << depth | leaf) << 32) | part
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.zeros(len(at), np.int32)), b.column(2), b.column(3),
                                              b.column(4)], names=["key", "kind", "row", "v", "ids"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, parts = state.value
        for b in batches:
            for i in range(0, b.num_rows, 200):
                some = b.slice(i, 200)
                at, row = [], []
                for j, u in enumerate(unit(matrix(some.column(2))).astype(np.float32)):
                    for t, leaf in shared.value.leaves(u, sizes, enough):
                        for part in range(int(parts[t, leaf])):
                            at.append((t << depth | leaf) << 32 | part)
                            row.append(j)
                if at:
                    row = pa.array(row, pa.int64())
                    n = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(at, pa.int64()), pa.array(np.ones(n, np.int32)), some.column(0).take(row),
                         some.column(2).take(row), pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32),
                                                                            some.column(1).take(row))],
                        names=["key", "kind", "row", "v", "ids"])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, ids, reps = None, [], [], []
        m = norms = None
        for b in batches:
            keys, kinds, row = (b.column(i).to_pylist() for i in range(3))
            vectors, lists = matrix(b.column(3)), b.column(4).to_pylist()
            found: tuple[list, ...] = ([], [], [], [], [])
            i = 0
            while i < len(keys):
                if keys[i] != now:
                    now, block, ids, reps, m = keys[i], [], [], [], None
                if kinds[i] == 0:
                    block.append(vectors[i])
                    ids.append(lists[i])
                    reps.append(row[i])
                    i += 1
                    continue
                z = i
                while z < len(keys) and keys[z] == now and z - i < 512:
                    z += 1
                if block and m is None:
                    m = _scaled(np.array(block))
                    norms = np.sqrt(np.einsum("ij,ij->i", m, m))
                if m is not None:
                    near = vectors[i:z] @ (m / norms[:, None]).T
                    few = min(len(m), k + 1)
                    best = np.argpartition(-near, few - 1, axis=1)[:, :few]
                    for q in range(i, z):
                        v = _scaled(vectors[q:q + 1])[0]
                        norm = np.sqrt(np.dot(v, v))
                        (own,) = lists[q]
                        got = []
                        # whatever ties with the last of the best may win by its id
                        to = near[q - i]
                        last = to[best[q - i]].min()
                        for j in np.flatnonzero(to >= last - 1e-12 * (1 + abs(last))):
                            some = ids[j]
                            if own in some and np.array_equal(block[j], vectors[q]):
                                some = list(some)
                                some.remove(own)  # the query's own row
                            if some:
                                got.append((-float(np.dot(v, m[j]) / (norm * norms[j])), some, reps[j]))
                        for s, some, rep in sorted(got)[:k]:
                            for c, x in zip(found, (row[q], own, rep, -s, some)):
                                c.append(x)
                i = z
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, kinds)],
                                             names=["row", "query_id", "rep", "score", "ids"])

    out = f"key long, kind int, row long, v {kind}, ids array<long>"
    asked = barrier(valid_vectors(queries, id_col, vec_col).where(F.size("v") == dim).select(
        F.monotonically_increasing_id().alias("row"), "vec_id", "v"))
    both = placed.mapInArrow(key, out).unionByName(asked.mapInArrow(probe, out))
    scored = both.repartition("key").sortWithinPartitions("key", "kind") \
        .mapInArrow(rank, "row long, query_id long, rep long, score double, ids array<long>")
    # several trees find the same vectors
    scored = scored.groupBy("row", "query_id", "rep").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    # a query has k vectors a block at most, each with k + 1 ids at most
    w = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("vec_id", F.explode("ids")).withColumn("rank", F.row_number().over(w)) \
        .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
