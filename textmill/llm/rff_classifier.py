"""Quality classifier: random Fourier features, ridge, isotonic calibration.

Statistics of a whole text become a standardised vector; random Fourier
features approximate a Gaussian kernel over it; the ridge solution comes from
normal equations that each partition sums and the driver adds (a few hundred
numbers squared, whatever the input); a fold that the ridge has not seen
calibrates its output by isotonic regression.  The fit uses at most about
``sample_rows`` labelled rows; scoring is one pass without a shuffle.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.session import barrier

#: Labelled rows that a fit uses at most (chosen by a hash of their id).
SAMPLE_ROWS = 40_000
FIT_PARTITIONS = 16
#: Rows of a batch that goes back to Spark.
OUT_ROWS = 1000
#: Features of the kernel, width of the kernel in standardised units, ridge.
FOURIER, WIDTH, RIDGE, SEED = 256, 3.0, 1e-3, 20_240

_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789",
    "space": b" \t\n\r\x0b\x0c", "stop": b".,;:?'\"()-", "bang": b"!", "bar": b"|", "markup": b"#*$%&<>@=_~^+\\/{}[]`",
}
_OF = np.full(256, len(_CLASSES), np.int64)
for _i, _chars in enumerate(_CLASSES.values()):
    _OF[list(_chars)] = _i
FEATURES = [*[f"share_{k}" for k in _CLASSES], "share_other", "log_words", "mean_word", "distinct_words", "top_word",
            "stutter", "repeated_pairs", "repeated_lines", "line_words", "marked_words", "capital_words"]


def statistics(text: str | None) -> list[float]:
    """The features of one whole text; a null or empty text has all zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    shares = np.bincount(_OF[np.frombuffer(raw, np.uint8)], minlength=len(_CLASSES) + 1) / len(raw)
    n = len(words)
    counts = Counter(words)
    pairs = set(zip(words, words[1:]))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    last = [w[-1:] for w in counts]
    marked = sum(c for (w, c), e in zip(counts.items(), last) if e in b"#*$%&|!" and e)
    capital = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    return [*shares.tolist(), float(np.log(n)), sum(len(w) * c for w, c in counts.items()) / n / 10,
            len(counts) / n ** 0.9, max(counts.values()) / n, sum(map(operator.eq, words, words[1:])) / n,
            1 - len(pairs) / max(1, n - 1), 1 - len(set(lines)) / len(lines), float(np.log(n / len(lines))),
            marked / n, capital / n]


@dataclass
class QualityModel:
    """What scoring needs; its size does not depend on the input."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phases: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    values: np.ndarray
    prior: float

    def fourier(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        wave = np.cos(z @ self.weights + self.phases) * np.sqrt(2 / len(self.phases))
        return np.concatenate([wave, z / np.sqrt(z.shape[1]), np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(x), self.prior)
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and non-decreasing values.  Each pool's
    value counts one more row that is half of either label, so that a pool of
    a few rows is no certainty."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum of y, rows, sum of x
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        pools.append([b, 1, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    knots = np.array([p[2] / p[1] for p in pools])
    return knots, np.maximum.accumulate([(p[0] + 0.5) / (p[1] + 1) for p in pools])


def _vectors(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t.as_py()) for t in b.column(b.schema.get_field_index(text_col))]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(b.schema.get_field_index(k)) for k in keep], pa.array(x, pa.list_(pa.float64()))],
                names=[*keep, "x"])

    schema = df.select(*keep, F.array(F.lit(0.0)).alias("x")).schema
    return df.mapInArrow(run, schema)


def _summed(df: DataFrame, function) -> np.ndarray | None:
    """The sum over all rows of what ``function(x, y)`` returns for a matrix
    and labels: ``FIT_PARTITIONS`` arrays at most come to the driver, however
    many partitions the rows have, and are added in their order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for b in batches:
            if b.num_rows:
                x = np.array(b.column(0).to_pylist(), np.float64)
                got = function(x, np.array(b.column(1).to_pylist(), np.float64))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()),
                                              pa.array([total.tobytes()], pa.binary())], names=["part", "total"])

    rows = sorted(df.select("x", "y").coalesce(FIT_PARTITIONS).mapInArrow(run, "part int, total binary").collect())
    return sum(np.frombuffer(r.total) for r in rows) if rows else None


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
                text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """Learn from rows whose crc32(id) mod 5 is 1 to 4: the ridge from 1 to 3,
    the calibration from 4.  Null labels and ids are passed over.  Without
    rows of both labels the model gives every text the share of label 1 (0.5
    without any label)."""
    fold = F.crc32(F.col(id_col).cast("string")) % 5
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()) \
        .select(F.col(id_col).alias("__id"), (F.col(label_col) > 0).cast("double").alias("y"), fold.alias("fold")) \
        .where("fold <> 0")
    there = known.count()
    share = min(1.0, sample_rows / max(1, there))
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("__id", F.lit(SEED)), F.lit(1_000_000)) < int(share * 1_000_000))
    # bounded by sample_rows, so every task may hold it
    sample = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")) \
        .join(F.broadcast(known), "__id")
    rows = _vectors(sample, "__text", ["__id", "y", "fold"])
    rows = barrier(rows.repartition(FIT_PARTITIONS, "__id").sortWithinPartitions("__id", "x", "y"))
    d = len(FEATURES)
    train, check = rows.where("fold < 4"), rows.where("fold = 4")
    sums = _summed(train, lambda x, y: np.concatenate([[len(y), y.sum()], x.sum(0), (x * x).sum(0)]))
    rng = np.random.default_rng(SEED)
    weights = rng.normal(size=(d, FOURIER)) / WIDTH
    phases = rng.uniform(0, 2 * np.pi, FOURIER)
    nothing = np.empty(0)
    if sums is None or not 0 < sums[1] < sums[0]:
        prior = 0.5 if sums is None else float(sums[1] / sums[0])
        return QualityModel(np.zeros(d), np.ones(d), weights, phases, nothing, nothing, nothing, prior)
    n = sums[0]
    mean = sums[2:2 + d] / n
    scale = np.sqrt(np.maximum(sums[2 + d:] / n - mean ** 2, 0))
    scale = np.where(scale > 1e-9, scale, 1.0)
    model = QualityModel(mean, scale, weights, phases, nothing, nothing, nothing, float(sums[1] / n))
    width = FOURIER + d + 1

    def equations(x, y):
        f = model.fourier(x)
        return np.concatenate([(f.T @ f).ravel(), f.T @ y])

    total = _summed(train, equations)
    gram = total[:width * width].reshape(width, width)
    model.beta = np.linalg.solve(gram + RIDGE * n * np.eye(width) / width + 1e-9 * np.eye(width), total[width * width:])
    held = check.select("x", "y", "__id").collect() or train.select("x", "y", "__id").collect()
    held.sort(key=lambda r: (r["__id"], r.x, r.y))
    model.knots, model.values = isotonic(model.raw(np.array([r.x for r in held])), np.array([r.y for r in held]))
    return model


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a double column ``out`` (0 to 1) from the whole text and
    nothing else; null and empty texts are scored as texts without words.  A
    column named ``out`` is replaced; repeated rows score alike, an empty table
    gives an empty one."""
    others = [c for c in docs.columns if c != out]
    names = [*others, *([text_col] if text_col == out else [])]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    schema = docs.select(*[F.col(f"`{c}`") for c in others], F.lit(0.0).alias(out)).schema
    place = names.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, OUT_ROWS):
                b = whole.slice(i, OUT_ROWS)
                x = np.array([statistics(t.as_py()) for t in b.column(place)], np.float64).reshape(-1, len(FEATURES))
                got = shared.value.score(x)
                yield pa.RecordBatch.from_arrays([*b.columns[:len(others)], pa.array(got, pa.float64())], names=[*others, out])

    return docs.mapInArrow(run, schema)
