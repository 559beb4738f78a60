"""Rank, splits and balancing: fixed cases (FIXTURES.md section 4) and the
"""

import random

from pyspark.sql import functions as F

from textmill.functions.hashing import seeded_hash
from textmill.operators import labels as L
from textmill.operators import sampling as B
from textmill.operators.rank import bucketed_rank, global_rank, hash_bucket, plain_rank

CLASSES = [1] * 6 + [2] * 3 + [3] * 3 + [4] * 9 + [5] * 6  # doc_id 0-26


def classes_df(spark, parts=None, shuffled=False):
    rows = [(i, lab) for i, lab in enumerate(CLASSES)]
    if shuffled:
        random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, label int")
    return df.repartition(parts) if parts else df


def test_bucketed_rank_equals_window(spark):
    df = spark.range(0, 3000).select(F.col("id").alias("doc_id"), (F.col("id") % 7).alias("c"))
    df = df.withColumn("h", seeded_hash(9, "doc_id"))
    a = bucketed_rank(df, ["c"], ["h", "doc_id"], hash_bucket("h", bits=4), out="r")
    b = plain_rank(df, ["c"], ["h", "doc_id"], out="r")
    assert sorted(a.select("doc_id", "r").collect()) == sorted(b.select("doc_id", "r").collect())


def test_global_rank_dense_and_ordered(spark):
    df = spark.range(0, 2000).select((F.col("id") * 7919 % 2000).alias("k")).repartition(5)
    r = global_rank(df, [F.asc("k")], out="r").collect()
    assert sorted((x.k, x.r) for x in r) == [(k, k + 1) for k in range(2000)]


def test_resample_to_class_sizes_and_copies(spark):
    out = B.resample_to_class(classes_df(spark), "label", 5, seed=42)
    counts = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {1: 6, 2: 6, 3: 6, 4: 6, 5: 6}
    # target class kept once, with copy 0; drawn rows only from their own class
    t = out.where("label = 5").collect()
    assert sorted(r.doc_id for r in t) == list(range(21, 27)) and all(r.copy_no == 0 for r in t)
    for r in out.collect():
        assert CLASSES[r.doc_id] == r.label
    assert out.select("doc_id", "copy_no").distinct().count() == out.count()


def test_resample_partition_independent(spark):
    base = sorted(B.resample_to_class(classes_df(spark), "label", 5, 42).collect())
    for parts in (1, 4, 17):
        assert sorted(B.resample_to_class(classes_df(spark, parts, True), "label", 5, 42).collect()) == base


def test_stratified_split_shares(spark):
    out = B.stratified_split(classes_df(spark), "label", 0.33, seed=42).collect()
    assert len(out) == len(CLASSES)
    per = {}
    for r in out:
        per.setdefault(r.label, []).append(r.split)
    for lab, splits in per.items():
        n = len(splits)
        assert splits.count("test") == int(n * 0.33 + 0.5)  # round half up per class


def test_stratified_split_partition_independent(spark):
    base = sorted(B.stratified_split(classes_df(spark), "label", 0.25, 7).collect())
    for parts in (1, 4, 17):
        got = sorted(B.stratified_split(classes_df(spark, parts, True), "label", 0.25, 7).collect())
        assert got == base


def test_split_by_row_any_copy(spark):
    # one row with 3 copies: once a copy is drawn for val, every copy is val
    rows = [(0, 0, "x")] + [(1, c, "x") for c in range(3)] + [(i, 0, "x") for i in range(2, 10)]
    df = spark.createDataFrame(rows, "doc_id long, copy_no long, label string")
    out = B.split_by_row(df, "label", 0.3, seed=1).collect()
    by_doc = {}
    for r in out:
        by_doc.setdefault(r.doc_id, set()).add(r.split)
    assert all(len(s) == 1 for s in by_doc.values())  # no row in both splits
    # and the same copies split independently can land in both splits
    seeds = range(40)
    leaked = False
    for s in seeds:
        plain = B.stratified_split(df, "label", 0.3, s, ["doc_id", "copy_no"]).where("doc_id = 1").collect()
        if len({r.split for r in plain}) > 1:
            leaked = True
            break
    assert leaked


def test_fraction_split_exact_and_complement(spark):
    df = spark.range(0, 101).withColumnRenamed("id", "doc_id")
    s = B.fraction_split(df, 0.8, seed=200)
    train = s.where("split = 'train'")
    assert train.count() == 81
    rest = B.complement(df, train)
    assert rest.count() == 20
    assert rest.join(train, "doc_id").count() == 0


def test_holdout_tail(spark):
    df = spark.range(0, 10).withColumnRenamed("id", "doc_id")
    out = {r.doc_id: r.split for r in B.holdout(df, 0.2).collect()}
    assert [out[i] for i in range(10)] == ["train"] * 8 + ["val"] * 2


def test_folds_balanced(spark):
    out = B.stratified_folds(classes_df(spark), "label", 3, seed=5).collect()
    per = {}
    for r in out:
        per.setdefault((r.label, r.fold), 0)
        per[(r.label, r.fold)] += 1
    assert per[(4, 0)] == per[(4, 1)] == per[(4, 2)] == 3


def test_label_codes(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, "c"), (4, None)], "doc_id long, lab string")
    first = {r.lab: r.code for r in L.label_codes(df, "lab", "first_seen").collect()}
    assert first == {"b": 0, "a": 1, "c": 2, None: None}
    srt = {r.lab: r.code for r in L.label_codes(df, "lab", "sorted").collect()}
    assert srt == {"a": 0, "b": 1, "c": 2, None: None}
    ints = spark.createDataFrame([(0, 10), (1, 9), (2, 100)], "doc_id long, y int")
    assert {r.y: r.code for r in L.label_codes(ints, "y", "sorted").collect()} == {9: 0, 10: 1, 100: 2}


def test_unseen_label_fails(spark):
    import pytest
    train = spark.createDataFrame([("a",), ("b",)], "lab string")
    test = spark.createDataFrame([("c",)], "lab string")
    codes = L.code_table(train, "lab", "sorted")
    with pytest.raises(Exception):
        L.apply_codes(test, codes, "lab").collect()


def test_edge_inputs(spark):
    empty = spark.createDataFrame([], "doc_id long, label int")
    assert B.stratified_split(empty, "label", 0.2, 1).count() == 0
    one = spark.createDataFrame([(i, 7) for i in range(5)], "doc_id long, label int")
    assert B.resample_to_class(one, "label", 7, 1).count() == 5
    nulls = spark.createDataFrame([(0, None), (1, 1), (2, 1)], "doc_id long, label int")
    assert B.stratified_split(nulls, "label", 0.5, 1).count() == 2


def test_bucket_bits_conf_does_not_change_results(spark):
    base = sorted(B.stratified_split(classes_df(spark), "label", 0.3, 4).collect())
    spark.conf.set("textmill.rank.bucketBits", "2")
    try:
        assert sorted(B.stratified_split(classes_df(spark), "label", 0.3, 4).collect()) == base
    finally:
        spark.conf.unset("textmill.rank.bucketBits")


def test_label_codes_both_joins(spark, monkeypatch):
    import textmill.operators.labels as LL
    df = spark.createDataFrame([(i, f"c{i % 7}") for i in range(50)], "doc_id long, lab string")
    base = sorted(LL.label_codes(df, "lab", "sorted").collect())
    monkeypatch.setattr(LL, "MAX_BROADCAST", 2)  # shuffle joins for applying and decoding
    assert sorted(LL.label_codes(df, "lab", "sorted").collect()) == base
    codes = LL.code_table(df, "lab", "sorted")
    coded = LL.apply_codes(df, codes, "lab").withColumn("label_name", F.lit("old"))
    dec = LL.decode_label(coded, codes, "code", label="lab")
    assert dec.columns == ["doc_id", "lab", "code", "label_name"]
    assert all(r.lab == r.label_name for r in dec.collect())
