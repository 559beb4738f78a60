"""Periodic runs against a plain search for every period."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from textmill.llm import queries
from textmill.llm.periodic_runs import find_runs, periodic_runs


def brute(w, least, times):
    """All maximal stretches with period q, if no smaller period holds them."""
    n, found = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, times * q):
                found.setdefault((i, length), q)  # the first is the smallest
            i = j + 1
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return [w for i, w in enumerate(words) if i not in gone]


def texts(seed):
    r = random.Random(seed)
    out = []
    for _ in range(60):
        w = [r.randrange(r.choice([1, 2, 3, 50])) for _ in range(r.choice([0, 1, 5, 30, 80, 200]))]
        for _ in range(r.randint(0, 4)):
            unit = [r.randrange(r.choice([2, 4, 9])) for _ in range(r.choice([1, 2, 3, 7, 20]))]
            if r.random() < 0.4:
                unit = unit * 3 + unit[:1]  # runs within the period of a run
            at = r.randint(0, len(w))
            w[at:at] = (unit * 9)[:r.randint(1, 9 * len(unit))]
        out.append(w)
    return out


@pytest.mark.parametrize("least,times", [(24, 3), (2, 2), (7, 2), (10, 4), (16, 3)])
def test_equals_every_period(least, times):
    for seed in range(6):
        some = texts(seed * 10 + times)
        got = find_runs([np.array(w, np.int64) for w in some], least, times)
        assert got == [brute(w, least, times) for w in some]


def test_long_texts_end():
    one = np.zeros(200_000, np.int64)
    wide = 1 + np.arange(200_000) % 40_000
    assert find_runs([one, np.concatenate([wide, one])], 24, 3) == [
        [(0, 200_000, 1)], [(0, 200_000, 40_000), (200_000, 200_000, 1)]]


def test_rows_and_columns(spark):
    again = "go on " * 20
    rows = [(1, None, "a", 5), (1, "", "b", 5), (None, " \t\n\x0b\x0c\r", "c", 5), (2, again, "d", 5), (2, again, "d", 5),
            (3, " x y " * 24, None, None), (4, "z " * 30, "f", 5), (5, "word " * 23, "g", 5)]
    docs = spark.createDataFrame(rows, "id long, text string, runs string, n_words int")
    got = periodic_runs(docs.repartition(3))
    assert got.columns == ["id", "text", "n_words", "runs", "collapsed"]
    seen = sorted(((r["id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got.collect()))
    assert seen == [(0, 0, [], ""), (1, 0, [], ""), (1, 0, [], ""), (2, 40, [(0, 40, 2)], "go on"), (2, 40, [(0, 40, 2)], "go on"),
                    (3, 24, [(0, 24, 1)], " x y"), (4, 1, [], "z " * 30), (5, 23, [], " ".join(["word"] * 23))]
    assert periodic_runs(docs.limit(0)).count() == 0
    assert periodic_runs(docs.withColumnRenamed("text", "collapsed"), "collapsed", keep=["id"]).columns == [
        "id", "n_words", "runs", "collapsed"]
    with pytest.raises(ValueError):
        periodic_runs(docs, min_exponent=1)


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words, 24, 3)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return (doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
            sha("".join("%d,%d,%d\n" % r for r in runs).encode()), sha(b" ".join(collapsed(words, runs))))


def test_query_equals_brute_force(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, " ".join("w%d" % x for x in w)) for i, w in enumerate(t for seed in range(8) for t in texts(seed))]
    rows += [(9_000 + i, " ".join("w%d" % r.randrange(40) for _ in range(400))) for i in range(40)]
    rows += [(9_900, None), (9_901, ""), (9_902, "\n"), (9_903, "one"), (9_904, "a\tb\nc  " * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    seen = sorted(map(tuple, got.select(*names).collect()))
    assert seen == sorted(expected(*x) for x in rows)
    assert sum(x[1] > 0 for x in seen) > 100


def test_query_takes_null_ids(spark, tmp_path):
    spark.createDataFrame([(None, "a " * 30, "x"), (None, None, None)], "doc_id long, text string, runs string") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).select("doc_id", "n_runs", "period").collect()
    assert sorted(map(tuple, got), key=str) == [(None, 0, None), (None, 1, 1)]
