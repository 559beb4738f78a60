"""Joins that part hot keys from the others."""

import pytest
from pyspark.sql import functions as F

from textmill.operators.headtail import join_split


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("share", [1, 2, 4, 1000])
def test_rows_equal_a_plain_join(spark, how, share):
    rows = [("hot", i) for i in range(60)] + [("warm", i) for i in range(30)] + [("gone", i) for i in range(20)]
    rows += [(f"k{i}", i) for i in range(8)] + [(None, i) for i in range(5)]
    left = spark.createDataFrame(rows, "key string, n int")
    table = spark.createDataFrame([("hot", 1), ("warm", 2), ("k1", 3), ("k7", None), (None, 9)], "key string, v int")
    want = left.join(table, "key", how)
    got = join_split(left, table, "key", how=how, share=share)
    assert got.columns == want.columns
    order = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert order(got) == order(want)
    counts = left.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"))
    assert order(join_split(left, table, "key", counts, 118, how, share)) == order(want)
    assert order(join_split(left.limit(0), table, "key", how=how, share=share)) == []
    assert order(join_split(left, table.limit(0), "key", how=how, share=share)) == order(left.join(table.limit(0), "key", how))


def test_other_joins_are_refused(spark):
    one = spark.range(1)
    with pytest.raises(ValueError):
        join_split(one, one, "id", how="outer")
