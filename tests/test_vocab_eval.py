"""Vocabulary, encoding, embeddings, evaluation and sources: fixed cases from
FIXTURES.md section 4."""

import math
import re

import pytest
from pyspark.sql import functions as F

from textmill.functions import text as T
from textmill.functions.fixed import CONTRACTIONS
from textmill.operators import embed as E
from textmill.operators import evaluate as X
from textmill.operators import vocab as V
from textmill.sources import io


def two_texts(spark):
    return spark.createDataFrame([(0, "b a a"), (1, "c a b")], "doc_id long, text string")


def test_freq_vocab_ids(spark):
    d = V.vocab_tokens(two_texts(spark), "text")
    got = {r.token: r.id for r in V.freq_vocab(d, "tokens").collect()}
    assert got == {"a": 1, "b": 2, "c": 3}
    capped = {r.token: r.id for r in V.freq_vocab(d, "tokens", cap=3).collect()}
    assert capped == {"a": 1, "b": 2}


def test_first_seen_vocab_and_fixed_encoding(spark):
    d = two_texts(spark).withColumn("tokens", T.tokenize("text"))
    v2 = V.first_seen_vocab(d, "tokens", min_count=2)
    assert {r.token: r.id for r in v2.collect()} == {"b": 2, "a": 3}
    enc = {r.doc_id: (r.encoded, r.length) for r in V.encode_fixed(d, "tokens", v2, n=5).collect()}
    assert enc[1] == ([1, 3, 2, 0, 0], 3)
    assert enc[0] == ([2, 3, 3, 0, 0], 3)


def test_encode_drop_with_cap_and_empty(spark):
    d = V.vocab_tokens(two_texts(spark), "text")
    v1 = V.freq_vocab(d, "tokens")
    q = V.vocab_tokens(spark.createDataFrame([(1, "c a b"), (2, "zzz qqq"), (3, "")],
                                             "doc_id long, text string"), "text")
    got = {r.doc_id: r.ids for r in V.encode_drop(q, "tokens", v1, cap=3).collect()}
    assert got == {1: [1, 2], 2: [], 3: []}


def test_pad(spark):
    df = spark.createDataFrame([([1, 2, 3],)], "a array<bigint>")
    r = df.select(V.pad("a", 2).alias("cut"), V.pad("a", 4, "pre").alias("front"),
                  V.pad("a", 4, "post").alias("behind"), V.pad("a", 2, "post", "post").alias("cut_post")).first()
    assert r.cut == [2, 3] and r.front == [0, 1, 2, 3] and r.behind == [1, 2, 3, 0] and r.cut_post == [1, 2]


def test_masked_encoding(spark):
    d = two_texts(spark).withColumn("tokens", T.tokenize("text"))
    v2 = V.first_seen_vocab(d, "tokens", min_count=2)
    r = {x.doc_id: x for x in V.encode_masked(d, "tokens", v2, n=6).collect()}
    assert r[1].input_ids == [2, 1, 5, 4, 3, 0]
    assert r[1].attention_mask == [1, 1, 1, 1, 1, 0]


def test_drop_tokens_and_lemmas(spark):
    d = spark.createDataFrame([(0, ["the", "cats", "The", "sat", "the"])], "doc_id long, tokens array<string>")
    words = spark.createDataFrame([("the",)], "word string")
    assert V.drop_tokens_join(d, "tokens", words).first().tokens == ["cats", "The", "sat"]
    assert V.drop_tokens_join(d, "tokens", words, case_sensitive=False).first().tokens == ["cats", "sat"]
    assert d.select(T.drop_tokens("tokens", ["the"]).alias("t")).first().t == ["cats", "The", "sat"]
    lem = spark.createDataFrame([("cats", "cat")], "token string, lemma string")
    assert V.lemmatize(d, "tokens", lem).first().lemmas == ["the", "cat", "The", "sat", "the"]


def test_term_counts_and_ngrams(spark):
    d = spark.createDataFrame([(0, ["a", "b", "a"])], "doc_id long, tokens array<string>")
    assert sorted((r.term, r.n) for r in V.term_counts(d, "tokens").collect()) == [("a", 2), ("b", 1)]
    assert d.select(T.ngrams("tokens", 3).alias("g")).first().g == ["a b a"]


def test_word_vectors_odd_lines(spark, tmp_path):
    p = tmp_path / "vec.txt"
    p.write_text("a 1 2 3\n. . 4 5 6\n\nbad 1 x 3\nshort 1\n")
    got = {r.token: r.vec for r in io.read_word_vectors(spark, str(p), 3, on_bad="skip").collect()}
    assert got == {"a": [1.0, 2.0, 3.0], ". .": [4.0, 5.0, 6.0]}


def test_embedding_table_capitalised_fallback(spark):
    vocab = spark.createDataFrame([("paris", 1), ("rome", 2), ("x", 3)], "token string, id long")
    vecs = spark.createDataFrame([("Paris", [1.0, 2.0]), ("rome", [3.0, 4.0])], "token string, vec array<float>")
    t = {r.token: r.vec for r in E.embedding_table(vocab, vecs, 2).collect()}
    assert t["paris"] == [1.0, 2.0] and t["rome"] == [3.0, 4.0] and len(t["x"]) == 2
    t2 = {r.token: r.vec for r in E.embedding_table(vocab, vecs, 2, try_capitalized=False, fill="zeros").collect()}
    assert t2["paris"] == [0.0, 0.0]
    shifted = vocab.withColumn("id", F.col("id") + 1)  # ids from 2: 0 and 1 are the special rows
    sp = {r.id: r.vec for r in E.embedding_table(shifted, vecs, 2, special_rows=True, fill="uniform").collect()}
    assert sp[0] == [0.0, 0.0] and all(-0.25 <= x <= 0.25 for x in sp[1])


def test_normal_fill_moments(spark):
    keys = spark.range(0, 4000).withColumnRenamed("id", "id")
    vals = E.fill_table(keys, "normal", 1, "id", 10).select(F.explode("vec").alias("x"))
    r = vals.agg(F.avg("x").alias("m"), F.stddev("x").alias("s")).first()
    assert abs(r.m - (-0.005838499)) < 0.02 and abs(r.s - 0.48782197) < 0.02


def test_pool_avg_and_max(spark):
    d = spark.createDataFrame([(0, ["a", "b", "a", "zz"])], "doc_id long, tokens array<string>")
    vecs = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [4.0, 3.0])], "token string, vec array<float>")
    avg = E.pool(d, "tokens", vecs, "avg").first().doc_vec
    assert avg == pytest.approx([2.0, 1.0])
    assert E.pool(d, "tokens", vecs, "avg", oov="zero").first().doc_vec == pytest.approx([1.5, 0.75])
    assert E.pool(d, "tokens", vecs, "avg_max").first().doc_vec == pytest.approx([2.0, 1.0, 4.0, 3.0])


PAIRS = [(0, 0), (0, 0), (0, 1), (1, 1), (1, 0), (2, 1)]


def preds(spark):
    return spark.createDataFrame(PAIRS, "label int, pred int")


def test_accuracy_confusion_report(spark):
    df = preds(spark)
    assert X.accuracy(df).first().accuracy == 0.5
    cells = {(r.row_class, r.col_class): r.n for r in X.confusion(df).collect()}
    assert [[cells[(i, j)] for j in range(3)] for i in range(3)] == [[2, 1, 0], [1, 1, 0], [0, 1, 0]]
    rep = {r["class"]: r for r in X.classification_report(df).collect()}
    assert rep["0"].precision == pytest.approx(2 / 3) and rep["0"].recall == pytest.approx(2 / 3)
    assert rep["1"].precision == pytest.approx(1 / 3) and rep["1"].recall == pytest.approx(1 / 2)
    assert rep["2"].precision == 0 and rep["2"].recall == 0 and rep["2"].support == 1
    assert rep["weighted avg"].f1 == pytest.approx(0.466667, abs=1e-6)
    assert X.f1_weighted(df).first().f1_weighted == pytest.approx(0.466667, abs=1e-6)
    sw = {r["class"]: r for r in X.classification_report(df, swapped=True).collect()}
    assert sw["1"].precision == pytest.approx(1 / 2) and sw["1"].support == 3
    wide = {r.row_class: (r.c_0, r.c_1, r.c_2) for r in X.confusion_matrix(df, [0, 1, 2]).collect()}
    assert wide == {0: (2, 1, 0), 1: (1, 1, 0), 2: (0, 1, 0)}


def test_rmse_and_losses(spark):
    df = preds(spark)
    assert X.rmse(df).first().rmse == pytest.approx(math.sqrt(3 / 6))
    b = df.withColumn("batch_id", F.lit(0))
    assert X.rmse(b, by_batch=True).first().rmse == pytest.approx(math.sqrt(3 / 6))
    p = spark.createDataFrame([([0.0, 1.0], 1, 0), ([0.5, 0.5], 0, 0), ([0.9, 0.1], 1, 1)],
                              "probs array<double>, label int, batch_id int")
    per = [-math.log(1.0), -math.log(0.5), -math.log(0.1)]
    assert X.log_loss(p).first().log_loss == pytest.approx(sum(per) / 3)
    assert X.log_loss(p, reduce="batch_mean").first().log_loss == pytest.approx(((per[0] + per[1]) / 2 + per[2]) / 2)
    assert X.log_loss(p, reduce="batch_sum").first().log_loss == pytest.approx(((per[0] + per[1]) + per[2]) / 2)
    z = spark.createDataFrame([([0.0, 1.0], [0, 1])], "probs array<double>, targets array<int>")
    assert X.binary_log_loss(z).first().binary_log_loss == pytest.approx(0.0, abs=1e-12)
    z2 = spark.createDataFrame([([0.25, 0.5], [1, 0])], "probs array<double>, targets array<int>")
    assert X.binary_log_loss(z2).first().binary_log_loss == pytest.approx((-math.log(0.25) - math.log(0.5)) / 2)


def test_softmax_argmax(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, -1.0],)], "logits array<double>")
    r = X.decode_scores(df, "logits").first()
    e = [math.exp(x - 3.0) for x in [1.0, 3.0, 3.0, -1.0]]
    assert r.probs == pytest.approx([x / sum(e) for x in e]) and r.pred == 1


def test_running_metrics_every(spark):
    rows = [("r", s, float(s), s % 2, 2) for s in range(12)]
    df = spark.createDataFrame(rows, "run_id string, step long, loss double, n_correct long, n_examples long")
    got = {r.step: (r.loss_step, r.accu_step) for r in X.running_metrics(df, every=5).collect()}
    assert sorted(got) == [0, 5, 10]
    assert got[10][0] == pytest.approx(sum(range(11)) / 11)
    assert got[5][1] == pytest.approx(sum(s % 2 for s in range(6)) * 100 / 12)


def test_history_and_multilabel(spark):
    m = spark.createDataFrame([("r", 1, "loss", 0.5), ("r", 1, "acc", 0.9), ("r", 2, "loss", 0.4)],
                              "run_id string, epoch int, metric string, value double")
    h = {r.epoch: (r.loss, r.acc) for r in X.history(m, ["loss", "acc"]).collect()}
    assert h == {1: (0.5, 0.9), 2: (0.4, None)}
    ml = spark.createDataFrame([(["a", "b"], ["b", "a"]), (["a"], []), ([], ["b"])],
                               "labels array<string>, result array<string>")
    rep = {r.label: r for r in X.multilabel_report(ml, ["a", "b"]).collect()}
    assert rep["a"].tp == 1 and rep["a"].recall == 0.5 and rep["b"].precision == 0.5
    assert rep["exact_match"].precision == pytest.approx(1 / 3)


def test_read_reviews_csv(spark, tmp_path):
    p = tmp_path / "reviews.csv"
    p.write_text('marketplace,review_body,star_rating\nUS,"good\nphone",5\nUS,NA,4\nUS,ok,3.0\nUS,fine,x\n')
    rows = io.read_reviews(spark, str(p)).collect()
    got = [(r.review_body, r.star_rating) for r in rows]
    assert ("good\nphone", 5) in got and (None, 4) in got and ("ok", 3) in got and ("fine", None) in got


def test_read_news_tsv(spark, tmp_path):
    p = tmp_path / "news.tsv"
    p.write_text("1\tTitle one\thttp://x\tPub\tb\tS1\tx.com\t1394470370698\n")
    r = io.read_news_tsv(spark, str(p)).first()
    assert r.CATEGORY == "b" and r.TIMESTAMP == 1394470370698


def test_preview_and_metric_log(spark, tmp_path):
    df = spark.createDataFrame([(2, "bbbbbb"), (1, "aaaaaa")], "k int, s string")
    assert [tuple(r) for r in io.preview(df, 1, 3, ["k"]).collect()] == [(1, "aaa")]
    p = str(tmp_path / "log")
    io.log_metrics(spark.createDataFrame([("r", 1, "loss", 0.5)], "run_id string, epoch int, metric string, value double"), p)
    io.log_metrics(spark.createDataFrame([("r", 2, "loss", 0.4)], "run_id string, epoch int, metric string, value double"), p)
    assert io.read_metrics(spark, p).count() == 2


def test_fast_contraction_pattern_equals_plain():
    plain = re.compile(T.CONTRACTION_PATTERN)
    fast = re.compile(T.CONTRACTION_PATTERN_FAST)
    samples = ["x" + k + "y " + k.upper() for k in CONTRACTIONS] + ["it's y'all'd've I'd've 'cause o'clock"]
    for s in samples:
        f = lambda m: CONTRACTIONS[m.group(1)]
        assert plain.sub(f, s) == fast.sub(f, s)


def test_stop_words_without_jvm_equal_spark(spark):
    from pyspark.ml.feature import StopWordsRemover
    assert T.default_stop_words() == list(StopWordsRemover.loadDefaultStopWords("english"))


def _docs(spark, parts=None, shuffled=False):
    import random
    texts = ["b a a c", "c a b d", "e e a", "", "a b c d e f", "zz yy a"] * 5
    rows = [(i, t) for i, t in enumerate(texts)]
    if shuffled:
        random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tokens", T.tokenize("text"))
    return df.repartition(parts) if parts else df


def test_vocab_and_encoding_partition_independent(spark):
    def run(df):
        v1 = sorted(V.freq_vocab(df, "tokens").collect())
        v2 = V.first_seen_vocab(df, "tokens", min_count=2)
        enc = sorted(V.encode_fixed(df, "tokens", v2, n=4).collect())
        return v1, sorted(v2.collect()), enc
    base = run(_docs(spark))
    for parts in (1, 4, 17):
        assert run(_docs(spark, parts, shuffled=True)) == base


def test_map_label_missing_key_fails(spark):
    from textmill.operators.projection import map_label
    ok = spark.createDataFrame([(1,), (5,)], "star int")
    m = {1: 0, 2: 1, 3: 2, 4: 3, 5: 4}
    assert [r.star for r in map_label(ok, "star", m).collect()] == [0, 4]
    bad = spark.createDataFrame([(6,)], "star int")
    with pytest.raises(Exception):
        map_label(bad, "star", m).collect()


def test_density_integrates_to_one(spark):
    from textmill.operators.stats import density, histogram
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 2, 3, 3, 3, 4, 4, 5, 9]], "v double")
    d = sorted(density(df, "v", grid=2000).collect())
    step = d[1].x - d[0].x
    assert abs(sum(r.density for r in d) * step - 1.0) < 0.02
    h = {r.bin: r["count"] for r in histogram(df, "v", 4).collect()}
    assert h == {0: 3, 1: 5, 2: 1, 3: 1}  # = numpy.histogram(bins=4); the max lands in the last bin


def test_histogram_keeps_empty_bins(spark):
    from textmill.operators.stats import histogram
    df = spark.createDataFrame([(0.0,), (0.1,), (10.0,)], "v double")
    h = {r.bin: r["count"] for r in histogram(df, "v", 5).collect()}
    assert h == {0: 2, 1: 0, 2: 0, 3: 0, 4: 1}  # = numpy.histogram(bins=5)


def test_freq_vocab_large_cap_path_equals_topk(spark):
    d = V.vocab_tokens(_docs(spark), "text")
    small = sorted(V.freq_vocab(d, "tokens", cap=4).collect())
    old = V.TOPK_MAX
    try:
        V.TOPK_MAX = 1  # force the global-rank path
        big = sorted(V.freq_vocab(d, "tokens", cap=4).collect())
    finally:
        V.TOPK_MAX = old
    assert small == big and len(small) == 3


def test_save_and_load_vocab(spark, tmp_path):
    d = V.vocab_tokens(two_texts(spark), "text")
    v1 = V.freq_vocab(d, "tokens")
    io.save_vocab(v1, str(tmp_path / "vocab"))
    assert sorted(io.load_vocab(spark, str(tmp_path / "vocab")).collect()) == sorted(v1.collect())


def test_bag_of_words_vector_form(spark, tmp_path):
    from textmill.operators.pipeline import BagOfWords, fit_bag_of_words
    rows = [(0, ["a", "b", "a"], "x"), (1, ["b"], "x"), (1, ["b", "b", None], "y"), (None, ["c"], "z"), (5, [], "z"), (6, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, tokens array<string>, features string")
    terms = V.term_numbers(d, "tokens")
    assert sorted(map(tuple, terms.collect()), key=lambda r: r[3]) == [("b", 4, 3, 0), ("a", 2, 1, 1), ("c", 1, 1, 2)]
    want = [(0, 3, [0, 1], [1.0, 2.0]), (1, 3, [0], [1.0]), (1, 3, [0], [2.0]), (None, 3, [2], [1.0]), (5, 3, [], []), (6, 3, [], [])]
    assert sorted(map(tuple, V.bag_of_words(d, "tokens", terms).collect()), key=str) == sorted(want, key=str)
    fit_bag_of_words(d, str(tmp_path / "terms"), min_docs=2).write().save(str(tmp_path / "stage"))
    got = BagOfWords.load(str(tmp_path / "stage")).transform(d)
    assert got.columns == ["doc_id", "tokens", "features"]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.features.size, r.features.indices, r.features["values"]) for r in got.collect()) == [
        (-1, 1, [], []), (0, 1, [0], [1.0]), (1, 1, [0], [1.0]), (1, 1, [0], [2.0]), (5, 1, [], []), (6, 1, [], [])]
    none = d.limit(0)
    assert V.bag_of_words(d, "tokens", V.term_numbers(none, "tokens")).select("size", "indices").distinct().collect() == [(0, [])]
