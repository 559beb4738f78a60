"""Targets against brute force, words near them, reruns, odd tables."""

import random
import re

import pytest

from textmill.llm import mixing
from textmill.llm.mixing import mix, mixed
from textmill.llm.queries import QUERIES


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def targets(size):
    """Share by weight, stop at 3 times, share the excess again."""
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + ([None] if None in size else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = sum(size.values()), set()
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(3 * size[s] for s in full)
        now = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if now[s] > 3 * size[s]}
        if not over:
            return now | {s: 3.0 * size[s] for s in full}
        full |= over


def check(rows, got):
    size = {}
    for d, t, s in rows:
        size[s] = size.get(s, 0) + words(t)
    want = targets(size)
    assert len(got) == len(rows)
    source = {d: s for d, _, s in rows}
    taken = dict.fromkeys(size, 0)
    largest = dict.fromkeys(size, 0)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(want[s], rel=1e-9)
        assert 0 <= r.copies <= 3
        taken[s] += r.copies * r.size
        largest[s] = max(largest[s], r.size)
    for s in size:
        assert abs(taken[s] - want[s]) <= max(1, largest[s]), (s, taken[s], want[s])


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_words(spark, seed):
    r = random.Random(seed)
    rows = []
    for i in range(900):
        s = r.choice(["a"] * 30 + ["b", "B", "é", "z", None, "", "c", "d"])
        rows.append((i, " ".join(["w"] * int(r.paretovariate(0.7) * 3 % 4000)) or r.choice([None, "", " \n"]), s))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(df).collect()
    check(rows, got)
    again = mix(df.repartition(11)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    out = mixed(df.withColumn("size", df.doc_id).withColumn("copies", df.doc_id))
    assert out.columns == ["doc_id", "text", "source", "size", "copies"]
    times = {x["doc_id"]: x["count"] for x in out.groupBy("doc_id").count().collect()}
    assert times == {x.doc_id: x.copies for x in got if x.copies}


def test_inclusion_follows_the_odds(spark):
    """Over seeds, a document is taken about as often as it is wanted."""
    rows = [(i, " ".join(["w"] * (4 if i % 2 else 64)), "a" if i < 400 else "b") for i in range(460)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    short = long = 0
    for seed in range(6):
        got = mix(df, seed=seed).where("doc_id < 400").collect()
        short += sum(r.copies for r in got if r.size == 4)
        long += sum(r.copies for r in got if r.size == 64)
    # both short and long, wanted in the ratio 16 ** 0.25 = 2
    assert 1.6 < short / long < 2.5


def test_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(none).count() == 0 and mixed(none).columns == none.columns and mixed(none).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (None, "", None)], none.schema)
    assert sorted(map(tuple, mix(blank).fillna(-1).collect())) == [(-1, 0, 0, 0.0, 0), (1, 0, 0, 0.0, 0)]
    one = spark.createDataFrame([(1, "a b c", "s"), (1, "a b c", "s"), (None, "x y z", "s")], none.schema)
    assert [r.copies for r in mix(one).collect()] == [1, 1, 1]


def test_many_sources_are_joined(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SMALL_SOURCES", 3)
    rows = [(i, "w " * (i % 50), f"s{i % 40}") for i in range(600)]
    check(rows, mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op2_source_mix"](spark, sf).collect()
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + words(t)
    want, source, taken = targets(size), {d: s for d, _, s in rows}, dict.fromkeys(size, 0)
    for r in got:
        assert r.size == words(rows[r.doc_id][1]) if rows[r.doc_id][0] == r.doc_id else True
        assert r.target == pytest.approx(want[source[r.doc_id]]) and r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) < 0.1 * want[s] for s in size)
    print({s: round(taken[s] / want[s] - 1, 4) for s in size})


def test_ranks_and_cut_equal_brute_force(spark):
    """Copies of every document from the formulas: certain copies, places in the
    rank of odds ratios, the prefix that fits, the document that fills the gap."""
    from pyspark.sql import functions as F
    r = random.Random(12)
    rows = [(i, " ".join(["w"] * int(r.paretovariate(0.8) * 4 % 900)), r.choice("aaaabcde")) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(mixing.SEED)), F.lit(1 << 52))
    u = {x.doc_id: (x.d + 0.5) / 2.0 ** 52 for x in df.select("doc_id", draw.alias("d")).collect()}
    got = {x.doc_id: x.copies for x in mix(df).collect()}
    total = {s: sum(words(t) for _, t, x in rows if x == s) for s in "abcde"}
    partly = 0
    for s, target in targets(total).items():
        docs = [(d, words(t)) for d, t, x in rows if x == s]
        wanted = lambda c: {d: min(3.0, c * n ** -0.25) if n else 0.0 for d, n in docs}
        low, high = 0.0, 1e12
        for _ in range(300):  # the scale at which the wanted copies hold the target
            c = (low + high) / 2
            low, high = (c, high) if sum(k * n for k, (_, n) in zip(wanted(c).values(), docs)) < target else (low, c)
        want = wanted(high)
        copies = {d: int(want[d] + 1e-12) for d, _ in docs}
        need = target - sum(copies[d] * n for d, n in docs)
        rank = []
        for d, n in docs:
            p = want[d] - copies[d]
            if p > 1e-9:
                v = u[d] * (1 - p) / (u[d] * (1 - p) + (1 - u[d]) * p)
                rank.append((min(int(v * 2.0 ** 48), 2 ** 48 - 1), d, n))
        rank.sort()
        before, at = 0, 0
        while at < len(rank) and before + rank[at][2] <= need:
            before += rank[at][2]
            copies[rank[at][1]] += 1
            at += 1
        if at < len(rank):
            gap = need - before
            fill = min(((abs(n - gap), k, d, n) for k, d, n in rank[at:] if abs(n - gap) < gap), default=None)
            if fill:
                copies[fill[2]] += 1
        partly += 0 < at < len(rank)
        assert copies == {d: got[d] for d, _ in docs}, s
    assert partly
