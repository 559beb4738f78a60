"""SimHash classes against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from textmill.llm import queries
from textmill.llm.simhash import fingerprint, index_keys, near_fingerprints, simhash_classes


def plain(text, size=4):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i:i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints, bits):
    """Smallest index of each fingerprint's class, by all pairs."""
    f = np.array(prints, np.uint64)
    label = list(range(len(f)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[:i] ^ f[i]) <= bits).tolist():
            a, b = find(i), find(j)
            label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(f))]


def numbers(seed, n):
    """Families of close numbers, chains of them, and numbers that share half
    of their bytes."""
    r = random.Random(seed)
    out = []
    while len(out) < n:
        x = r.getrandbits(64)
        kind = r.random()
        if kind < 0.3:
            for _ in range(r.randint(1, 12)):  # a chain
                for b in r.sample(range(64), r.randint(1, 6)):
                    x ^= 1 << b
                out.append(x)
        elif kind < 0.7:
            out += [x ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 6))) for _ in range(r.randint(1, 20))]
        else:
            out += [(x & 0xFFFFFFFF00000000) | r.getrandbits(32) for _ in range(r.randint(1, 30))]
    return sorted(set(out[:n]))


def test_any_four_positions_hold_a_key():
    from itertools import combinations
    keys = index_keys(4)
    assert len(keys) == 20
    assert all(any(set(k) <= set(four) for k in keys) for four in combinations(range(8), 4))


def test_fingerprints_of_texts():
    r = random.Random(3)
    for n in (0, 1, 2, 3, 4, 5, 40, 300):
        text = " \n".join(r.choice(["A", "bB", "ccc", "Été", "d,"]) for _ in range(n))
        assert fingerprint(text.encode()) == plain(text)
    long = " ".join("w%d" % r.randrange(99) for _ in range(70_000))  # more than one piece
    assert fingerprint(long.encode()) == plain(long)


@pytest.mark.parametrize("bits,lists,block", [(4, 1024, 1024), (4, 3, 4), (4, 0, 1), (3, 2, 2), (0, 8, 8), (5, 4, 4), (7, 2, 8)])
def test_links_equal_all_pairs(spark, bits, lists, block):
    f = numbers(bits * 100 + lists, 500)
    signed = [x - (1 << 64) if x >> 63 else x for x in f]
    prints = spark.createDataFrame([(x,) for x in signed], "f long").repartition(3)
    got = [(a, b) for a, b in near_fingerprints(prints, bits, lists, block).collect()]
    at = {x: i for i, x in enumerate(signed)}
    label = list(range(len(f)))
    for a, b in got:
        assert bin(f[at[a]] ^ f[at[b]]).count("1") <= bits
    for _ in range(len(f)):
        before = list(label)
        for a, b in got:
            label[at[a]] = label[at[b]] = min(label[at[a]], label[at[b]])
        if label == before:
            break
    assert label == classes(f, bits)


def documents(n):
    r = random.Random(n)
    rows = []
    for i in range(n):
        w = ["w%d" % r.randrange(300) for _ in range(r.choice([1, 3, 8, 60, 200]))]
        if rows and r.random() < 0.6:
            w = (r.choice(rows)[1] or "").split(" ")
            for _ in range(r.randint(0, 2)):
                w[r.randrange(len(w))] = "n%d" % r.randrange(9)
        rows.append((i * 3 % 1009, " ".join(w)))
    return rows + [(2000, None), (2001, ""), (2002, "\t"), (2003, "W1 w2"), (2004, "w1\nW2 ")]


def test_query_equals_brute_force(spark, tmp_path):
    rows = documents(300)
    spark.createDataFrame([(*x, "s") for x in rows], "doc_id long, text string, f string") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.QUERIES["op13_simhash"](spark, str(tmp_path)).collect()))
    prints = [plain(t) for _, t in rows]
    label = classes(prints, 4)
    low = {}
    for (d, _), c in zip(rows, label):
        low[c] = min(low.get(c, d), d)
    assert got == sorted((d, "%016x" % p, low[c]) for (d, _), p, c in zip(rows, prints, label))
    assert len({c for *_, c in got}) < 250


def test_odd_rows(spark):
    text = "one two three four five six seven"
    rows = [(None, text), (None, "alone here"), (7, text), (7, text), (3, text.upper()), (9, None), (8, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS f", "2 AS component", "3 AS n")
    got = simhash_classes(docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    seen = sorted(((d or -1, c or -1) for d, _, c in got.collect()))
    assert seen == [(-1, -1), (-1, 3), (3, 3), (7, 3), (7, 3), (8, 8), (9, 8)]
    assert simhash_classes(docs.limit(0)).count() == 0
