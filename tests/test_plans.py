"""Plan-shape tests: the scale properties the README claims, read off the
physical plans, plus the hot-class property of the bucketed rank."""

import random

from pyspark.sql import functions as F

import __spark_entry__ as E
from textmill.functions import text as T
from textmill.functions.hashing import seeded_hash
from textmill.operators import sampling as B
from textmill.operators.rank import bucketed_rank, hash_bucket, plain_rank
from textmill.operators.stats import word_counts

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_prunes_and_pushes_down(spark):
    p = plan(E.queries()["a2_top_duplicate_texts"](spark, SF))
    assert "ReadSchema: struct<text:string,lang:string>" in p or "struct<text:string,lang:string>" in p
    assert "IsNotNull(text)" in p
    assert "TakeOrderedAndProject" in p


def test_tokenizer_evaluated_once_in_word_counts(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select(T.tokenize("text").alias("tokens"))
    p = plan(word_counts(d, "tokens"))
    assert p.count("regexp_extract_all") == 1


def test_class_rank_is_partitioned_by_class_and_bucket(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    p = plan(B.stratified_split(d, "lang", 0.2, 1))
    assert "hashpartitioning(lang" in p and "__tm_bucket" in p
    # no exchange moves the rows of a class into a single partition
    assert "SinglePartition" not in p


def test_bucketed_rank_with_a_hot_class(spark):
    rnd = random.Random(7)
    rows = [(i, 0 if rnd.random() < 0.34 else rnd.randint(1, 40)) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, c int").withColumn("h", seeded_hash(3, "doc_id"))
    a = bucketed_rank(df, ["c"], ["h", "doc_id"], hash_bucket("h", bits=6), out="r", total="n")
    b = plain_rank(df, ["c"], ["h", "doc_id"], out="r")
    got = sorted(a.select("doc_id", "r").collect())
    assert got == sorted(b.select("doc_id", "r").collect())
    sizes = {r.c: r["count"] for r in df.groupBy("c").count().collect()}
    assert all(r.n == sizes[r.c] for r in a.select("c", "n").distinct().collect())
