"""Pooling of word vectors: every row, case, and tables of any size."""

import numpy as np
import pytest

from textmill.operators import embed as E

VECTORS = [("a", [1.0, 2.0]), ("B", [3.0, -4.0]), ("b2", [0.5, 0.5]), ("C", [7.0, 7.0]), ("c", [-1.0, 0.0]), ("Dd", [2.0, 2.0]),
           ("DD", [9.0, 9.0]), (None, [5.0, 5.0])]
DOCS = [(1, ["a", "B", "a"]), (1, ["c"]), (1, ["a", "B", "a"]), (None, ["b", "dd", "x"]), (None, []), (2, None), (3, ["x", "y"]),
        (4, ["a", None, "C", "c", "x"])]


def want(how, oov, case):
    table = {}
    for t, v in VECTORS:
        if t is not None:
            key = t if case else t.lower()
            rank = (t != t.lower(), t)
            if key not in table or rank < table[key][0]:
                table[key] = (rank, np.array(v))
    out = []
    for d, tokens in DOCS:
        tokens = [t if case else t.lower() for t in tokens or [] if t is not None]
        found = [table[t][1] for t in tokens if t in table]
        n = len(found) if oov == "skip" else len(tokens)
        avg = sum(found) / n if found else np.zeros(2)
        most = np.max(found, axis=0) if found else np.zeros(2)
        out.append((d, {"avg": avg, "max": most, "avg_max": np.concatenate([avg, most])}[how].tolist()))
    return sorted(out, key=str)


@pytest.mark.parametrize("blocked", [False, True])
@pytest.mark.parametrize("how,oov,case", [("avg", "skip", True), ("avg", "zero", False), ("max", "skip", False), ("avg_max", "zero", True)])
def test_every_row_has_its_vector(spark, monkeypatch, blocked, how, oov, case):
    if blocked:
        monkeypatch.setattr(E, "MAX_BROADCAST_BYTES", 0)
        monkeypatch.setattr(E, "BLOCK_BYTES", 100)  # several blocks and slices
        monkeypatch.setattr(E, "SLICE_ROWS", 3)
    docs = spark.createDataFrame(DOCS, "doc_id long, tokens array<string>")
    table = spark.createDataFrame(VECTORS, "token string, vec array<float>")
    got = E.pool(docs, "tokens", table, how=how, oov=oov, case_sensitive=case)
    assert [(r.doc_id, [round(x, 9) for x in r.doc_vec]) for r in sorted(got.collect(), key=lambda r: str(tuple(r)))] == [
        (d, [round(x, 9) for x in v]) for d, v in want(how, oov, case)]
    assert E.pool(docs.limit(0), "tokens", table, how=how, oov=oov).count() == 0
    assert [r.doc_vec for r in E.pool(docs, "tokens", table.limit(0), how=how, oov=oov).collect()] == [[]] * len(DOCS)


def test_tasks_work_on_bounded_pieces():
    """A batch is not unpacked whole, however many tokens its texts have."""
    import pyarrow as pa
    lists = [["a"] * 30_000, None, ["b"] * 30_000, [], ["c"] * 120_000] + [["d"]] * 5_000
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lists))), pa.array(lists, pa.list_(pa.string()))], names=["row", "tokens"])
    got = list(E._sliced(batch, 1))
    assert [x for p in got for x in p.column(0).to_pylist()] == list(range(len(lists)))
    for p in got:
        assert p.num_rows <= E.PIECE_ROWS
        assert p.num_rows == 1 or sum(len(x or []) for x in p.column(1).to_pylist()) <= E.PIECE_TOKENS


def test_blocked_product_gets_small_batches(spark, monkeypatch):
    """No worker is handed ten thousand texts at once."""
    seen = spark.sparkContext.accumulator(0)
    sliced = E._sliced

    def counted(batch, column):
        if batch.nbytes > 4 << 20:
            seen.add(1)
        return sliced(batch, column)

    monkeypatch.setattr(E, "_sliced", counted)
    docs = spark.range(0, 3_000, 1, 1).selectExpr("id AS doc_id", "array_repeat('a', 1000) AS tokens")
    table = spark.createDataFrame(VECTORS[:2], "token string, vec array<float>")
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    got = E.pool(docs, "tokens", table, max_bytes=0).collect()
    assert len(got) == 3_000 and {tuple(r.doc_vec) for r in got} == {(1.0, 2.0)}
    assert seen.value == 0
    assert spark.conf.get(key, None) == before
