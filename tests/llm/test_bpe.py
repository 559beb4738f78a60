"""BPE replay and token files against the public libraries, and round trips."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from textmill.llm import bpe_replay, token_files
from textmill.llm.queries import QUERIES

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
ODD = [None, "", " ", "  ", "\n", " a", "a ", "a  b", "a \n b", "\n\n a", "don't we'll 'S", "x" * 3000, "aaaa aaaa " * 50,
       "\x00a b\x00 \x00", "é ü ñ ß 漢字 🙂🙂 é", "a b  c \x1cd", "<|endoftext|> <|endoftext|>", "1234 56.7,8!!  ??",
       "ab" * 4000, "\t\tx\r\ny", " " * 50 + "z" + " " * 50, "!!!!!!????  ....", "a" * 257]


def texts(seed, n):
    r = random.Random(seed)
    alphabet = "aaabcdeé ü  \n\t.,'12!漢🙂 "
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 200))) for _ in range(n)]


def table(spark):
    rows = [(i * 3, t, "x") for i, t in enumerate(ODD + texts(1, 150))]
    rows += [(5, "again  and again", "y"), (5, "again  and again", "y"), (None, "no id", "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, part string").repartition(5), rows


def tiktoken_encoding():
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_replay_equals_tiktoken_and_decodes(spark, monkeypatch):
    monkeypatch.setattr(bpe_replay, "SLICE_CHARS", 2000)
    df, rows = table(spark)
    enc = tiktoken_encoding()
    got = bpe_replay.bpe_decode(bpe_replay.bpe_encode(df, RANKS, P.PATTERN), RANKS)
    assert got.columns == ["doc_id", "text", "part", "ids", "decoded"]
    got = got.collect()
    assert len(got) == len(rows)
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()


@pytest.mark.parametrize("seed", range(3))
def test_merges_of_random_bytes(seed):
    enc, merges = tiktoken_encoding(), bpe_replay.MergeTable(bpe_replay.read_ranks(RANKS))
    r = random.Random(seed)
    words = [bytes(r.choice(b"aeinst the") for _ in range(r.randint(1, 60))) for _ in range(500)]
    for w, ids in zip(words, merges.replay(words)):
        assert np.frombuffer(ids, "<u4").tolist() == enc._encode_single_piece(w)


def plain_merges(ranks, word):
    """Lowest rank first, leftmost first, one pair at a time."""
    if word in ranks:
        return [ranks[word]]
    parts = [word[i:i + 1] for i in range(len(word))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("seed", range(8))
def test_merges_by_any_ranks(seed):
    """Tables in which a merge may make a pair of a lower rank, too."""
    r = random.Random(seed)
    tokens = [bytes([i]) for i in range(256)]
    tokens += list({bytes(r.choice(b"ab") for _ in range(r.randint(2, 6))) for _ in range(r.choice([5, 20, 60]))})
    numbers = list(range(len(tokens)))
    r.shuffle(numbers)
    ranks = dict(zip(tokens, numbers))
    words = [bytes(r.choice(b"aab") for _ in range(r.randint(1, 40))) for _ in range(200)] + [b"a" * n for n in range(1, 30)]
    for w, ids in zip(words, bpe_replay.MergeTable(ranks).replay(words)):
        assert np.frombuffer(ids, "<u4").tolist() == plain_merges(ranks, w), w


def test_long_runs_end(spark):
    n = 1_000_000
    long = ["-" * n, " " * n, "a" * n, "ab" * (n // 2), "\n" * n]
    got = bpe_replay.bpe_encode(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string"), RANKS, P.PATTERN)
    enc = tiktoken_encoding()
    for i, ids in got.select("doc_id", "ids").collect():
        ids = np.frombuffer(ids, "<u4")
        few = enc.encode_ordinary(long[i][:4000])
        assert enc.decode_bytes(ids.tolist()) == long[i].encode()
        assert np.array_equal(ids[:len(few) // 2], few[:len(few) // 2])
    merges = bpe_replay.MergeTable(bpe_replay.read_ranks(RANKS))
    for w in (b"-" * 20_001, b" " * 20_000, b"ab" * 9_999, b"=-" * 7_001):
        assert np.frombuffer(merges.replay([w])[0], "<u4").tolist() == enc._encode_single_piece(w)


def test_columns_named_like_results(spark):
    df = spark.createDataFrame([(1, "a b", "old", "older")], "doc_id long, text string, ids string, decoded string")
    coded = bpe_replay.bpe_encode(df, RANKS, P.PATTERN)
    assert coded.columns == ["doc_id", "text", "decoded", "ids"]
    back = bpe_replay.bpe_decode(coded, RANKS)
    assert back.columns == ["doc_id", "text", "ids", "decoded"]
    assert bytes(back.first().decoded) == b"a b"
    assert bpe_replay.bpe_decode(bpe_replay.bpe_encode(df.limit(0), RANKS, P.PATTERN), RANKS).count() == 0
    assert bpe_replay.bpe_encode(df.select("doc_id", F.col("text").alias("ids")), RANKS, P.PATTERN, "ids").columns == ["doc_id", "ids"]


def test_frames_round_trip():
    r = np.random.default_rng(0)
    for ids in (np.empty(0, np.uint32), np.array([7], np.uint32), np.full(5000, 9, np.uint32),
                r.integers(0, 50257, 3001).astype(np.uint32), r.integers(0, 2 ** 32, 2048).astype(np.uint32),
                np.where(r.random(9999) < 0.02, 2 ** 32 - 1, r.integers(0, 300, 9999)).astype(np.uint32)):
        for percentile in (50, 95, 100):
            assert np.array_equal(token_files.unpack(token_files.pack(ids, percentile)), ids)
    few = np.where(np.arange(102_400) % 100 == 0, 50_000, np.arange(102_400) % 256).astype(np.uint32)
    assert len(token_files.pack(few)) < 1.3 * len(few)  # a byte a value and the exceptions


def test_token_files(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer
    monkeypatch.setattr(token_files, "FRAME_IDS", 500)
    monkeypatch.setattr(token_files, "SLICE_CHARS", 3000)
    df, rows = table(spark)
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    path = token_files.write_token_files(df, str(tmp_path / "f"), P.path("byte_bpe_50k.json"))
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    assert [r.doc_id for r in got] == [r[0] for r in want]
    start = 0
    for r, (_, text, _) in zip(got, want):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens) == (start, len(ids))
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        start += len(ids)


def test_frequent_chunks_stay_encoded():
    """With too many chunks those used more than once stay, and texts are
    encoded as before."""
    with open(P.path("byte_bpe_50k.json")) as f:
        e = token_files._Encoder(f.read())

    def coded(texts):
        rows = [e.table.add(t) for t in texts]
        e.update()
        e.count(rows)
        return [b"".join(e.coded[i] for i in r.tolist()) for r in rows]

    texts = ["one two three", "one two four", " two\nthree x", ""]
    first = coded(texts)
    assert first == e.whole(texts)
    e.thin(2)
    assert e.table.chunks() == [" two", " one"] or sorted(e.table.chunks()) == [" two", "one"]
    assert len(e.coded) == len(e.uses) == 2
    assert coded(texts[::-1]) == first[::-1]
    e.thin(0)
    assert not e.coded and coded(texts) == first


def test_a_tokenizer_with_a_normalizer_takes_whole_texts(spark, tmp_path):
    from tokenizers import Tokenizer
    with open(P.path("word_bpe_49k.json")) as f:
        assert not token_files.splits_at_spaces(f.read())
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    df = spark.createDataFrame([(1, "Hello  World"), (2, None)], "doc_id long, text string")
    path = token_files.write_token_files(df, str(tmp_path / "f"), P.path("word_bpe_49k.json"), end_id=None)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in token_files.read_token_files(spark, path).collect()}
    assert got == {1: t.encode("Hello  World", add_special_tokens=False).ids, 2: []}


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_replay.bpe_decode(bpe_replay.bpe_encode(none, RANKS, P.PATTERN), RANKS).count() == 0
    path = token_files.write_token_files(none, str(tmp_path / "f"), P.path("byte_bpe_50k.json"))
    assert token_files.read_token_files(spark, path).count() == 0


def test_queries_equal_the_libraries(spark):
    from tokenizers import Tokenizer
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    enc = tiktoken_encoding()
    for r in QUERIES["op9_bpe_replay"](spark, sf).collect():
        ids = enc.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(docs[r.doc_id].encode()).hexdigest())
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    start = 0
    got = {r.doc_id: r for r in QUERIES["op5_token_files"](spark, sf).collect()}
    for d in sorted(docs):
        ids = np.array(t.encode(docs[d], add_special_tokens=False).ids + [0], "<u4")
        assert tuple(got[d]) == (d, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
