"""Fixed cleaning cases (computed with Python's re from the reference's
patterns, FIXTURES.md section 3)."""

import pytest
from pyspark.sql import functions as F

from textmill.functions import text as T
from textmill.functions.fixed import CONTRACTIONS
from textmill.operators.clean import clean

CASES = [
    ("I'd've said how'd'y, she'd can't won't've",
     "i would've said how did'y, she would cannot will not've",
     "i wouldve said how didy she would cannot will notve"),
    ("'Cause it's 1234567 1234 123 12 1 dollars!",
     "because it is ##### #### ### ## 1 dollars!",
     "because it is     1 dollars"),
    ("Caf\xe9 na\xefve_x — tr\xe8s “bon” \xbd \xb2 日本",
     "caf\xe9 na\xefve_x — tr\xe8s “bon” \xbd \xb2 日本",
     "caf\xe9 na\xefve_x  tr\xe8s bon \xbd \xb2 日本"),
    ("bit's y'all'd've that's", "bit is you all'd've that is", "bit is you alldve that is"),
    ("x\xa0y z​q́ ١٢", "x\xa0y z​q́ ١٢",
     "x\xa0y zq ١٢"),
    ("she’s it’s", "she’s it’s", "shes its"),
    ("a\x1cb\x85c ①", "a\x1cb\x85c ①", "a\x1cb\x85c ①"),
    ("NA", "na", "na"),
    ("ok", "ok", "ok"),
    ("!", "!", ""),
    ("a b c d e  plain   text", "a b c d e  plain   text", "a b c d e  plain   text"),
    ("line\nbreak\ttab 3.5/5", "line\nbreak\ttab 3.5/5", "line\nbreak\ttab 355"),
]

TOKEN_CASES = [
    ("I'd've said how'd'y, she'd can't won't've", "I ve said how y she can won ve",
     ['i', 'd', 've', 'said', 'how', 'd', 'y', 'she', 'd', 'can', 't', 'won', 't', 've'], 6, 41),
    ("'Cause it's 1234567 1234 123 12 1 dollars!", " Cause it dollars ",
     ['cause', 'it', 's', 'dollars'], 8, 42),
    ("Caf\xe9 na\xefve_x — tr\xe8s “bon” \xbd \xb2 日本", "Caf na ve tr bon ",
     ['caf', 'na', 've', 'x', 'tr', 's', 'bon'], 8, 32),
    ("ok", "ok", ['ok'], 1, 2),
    ("!", " ", [], 1, 1),
    ("a b c d e  plain   text", "a c e plain text", ['a', 'b', 'c', 'd', 'e', 'plain', 'text'], 7, 23),
    ("line\nbreak\ttab 3.5/5", "line break tab ", ['line', 'break', 'tab'], 4, 20),
]


def test_contraction_table_size():
    assert len(CONTRACTIONS) == 120
    assert all(set(k) <= set("abcdefghijklmnopqrstuvwxyzI'") for k in CONTRACTIONS)


def test_clean_chains(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "id long, text string")
    t7 = {r.id: r.text for r in clean(df, "text", punctuation=False).collect()}
    t6 = {r.id: r.text for r in clean(df, "text", punctuation=True).collect()}
    for i, (_, want7, want6) in enumerate(CASES):
        assert t7[i] == want7, (i, t7[i], want7)
        assert t6[i] == want6, (i, t6[i], want6)


def test_clean_text_identity_and_null(spark):
    df = spark.createDataFrame([("A-z [x]",), (None,)], "text string")
    got = df.select(T.clean_text("text").alias("a"), T.clean_text("text", strict=True).alias("b")).collect()
    assert got[0].a == "A-z [x]" and got[0].b == "Az [x]"
    assert got[1].a is None and got[1].b is None


def test_token_functions(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(TOKEN_CASES)], "id long, text string")
    rows = df.select("id", T.letters_only("text").alias("l"), T.tokenize("text").alias("t"),
                     T.n_words("text").alias("w"), T.n_chars("text").alias("c")).collect()
    for r in rows:
        _, l, t, w, c = TOKEN_CASES[r.id]
        assert (r.l, r.t, r.w, r.c) == (l, t, w, c), (r, TOKEN_CASES[r.id])


def test_misc_functions(spark):
    df = spark.createDataFrame([("  hello World\nfoo\r ", ["a", "b", "c"])], "s string, arr array<string>")
    r = df.select(T.normalize("s").alias("n"), T.collapse_ws("s").alias("c"),
                  T.capitalize(F.lit("pARIS")).alias("cap"), T.ngrams("arr", 2).alias("g"),
                  T.ngrams("arr", 4).alias("g4"), T.join_tokens("arr").alias("j"),
                  T.vocab_words(F.lit("Hello, world's-end\tX")).alias("v")).first()
    assert r.n == "hello world foo"
    assert r.c == "hello World foo"
    assert r.cap == "Paris"
    assert r.g == ["a b", "b c"] and r.g4 == []
    assert r.j == "a b c"
    assert r.v == ["hello", "world's", "end", "x"]


def test_mask_numbers_equals_sequential_replacements(spark):
    import random
    import re

    rnd = random.Random(11)
    samples = ["".join(rnd.choice("0123456789#a '") for _ in range(rnd.randint(0, 40))) for _ in range(3000)]

    def ref(x):
        for pattern, mask in (("[0-9]{5,}", "#####"), ("[0-9]{4}", "####"), ("[0-9]{3}", "###"), ("[0-9]{2}", "##")):
            x = re.sub(pattern, mask, x)
        return x

    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "id long, s string")
    got = {r.id: r.m for r in df.select("id", T.mask_numbers("s").alias("m")).collect()}
    assert all(got[i] == ref(s) for i, s in enumerate(samples))


def test_contractions_equal_python_on_random_text(spark):
    import random
    import re

    rnd = random.Random(5)
    keys = list(CONTRACTIONS)
    pieces = keys + ["a", "b", "'", " ", "i", "ll", "ve", "d", "'d", "x'"]
    samples = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 12))) for _ in range(2000)]
    pat = re.compile("(%s)" % "|".join(CONTRACTIONS))
    ref = [pat.sub(lambda m: CONTRACTIONS[m.group(0)], s) for s in samples]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "id long, s string")
    got = {r.id: r.e for r in df.select("id", T.expand_contractions("s").alias("e")).collect()}
    assert all(got[i] == ref[i] for i in range(len(samples)))
