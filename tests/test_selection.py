"""Exact quantiles by narrowing counts; density; leaks by fingerprint."""

import math

import numpy as np
import pytest

from textmill.operators import stats as A


@pytest.mark.parametrize("kind", ["ints", "normal", "wide", "two", "one", "same", "tiny"])
def test_quantiles_equal_numpy(spark, monkeypatch, kind):
    r = np.random.default_rng(4)
    x = {"ints": r.integers(-50, 400, 999), "normal": r.normal(size=1000), "two": [3.0, 8.0], "one": [7.5], "same": [2.0] * 40,
         "wide": np.concatenate([10.0 ** r.uniform(-200, 300, 300), -(10.0 ** r.uniform(-9, 9, 80)), [0.0, 1.7e308, -1.7e308]]),
         "tiny": 1 + np.arange(300) * 2.0 ** -52}[kind]
    monkeypatch.setattr(A, "BUCKETS", 16)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double").repartition(3)
    for q in (0.0, 0.13, 0.5, 0.9, 1.0):
        with np.errstate(over="ignore"):
            want = float(np.quantile(np.asarray(x, np.float64), q)) if kind != "wide" else None
        got = A.quantile(df, "v", q).first().q
        if kind == "wide":  # interpolation between far numbers may overflow in NumPy
            s = sorted(map(float, x))
            place = q * (len(s) - 1)
            a = s[int(place)]
            want = a + (s[min(int(place) + 1, len(s) - 1)] - a) * (place - int(place))
        assert got == pytest.approx(want, rel=1e-12, abs=0) or got == want
    if kind not in ("wide",):
        d = A.describe(df, "v").first()
        assert d["count"] == len(x) and d["min"] == min(x) and d["max"] == max(x)
        assert d["p50"] == pytest.approx(np.quantile(x, 0.5)) and d["p25"] == pytest.approx(np.quantile(x, 0.25))
        assert d["std"] is None if len(x) == 1 else d["std"] == pytest.approx(np.std(x, ddof=1), abs=1e-9)


def test_values_without_buckets(spark):
    df = spark.createDataFrame([(float("inf"),), (1.0,), (2.0,), (-float("inf"),), (3.0,)], "v double")
    assert A.quantile(df, "v", 0.5).first().q == 2.0
    none = spark.createDataFrame([(None,)], "v double")
    assert A.quantile(none, "v").first().q is None
    assert A.describe(none, "v").first()["count"] == 0 and A.describe(none.limit(0), "v").first()["p50"] is None


def test_density_makes_no_rows_a_value(spark, capsys):
    x = [1.0, 2.0, 2.0, 5.5, 9.0]
    df = spark.createDataFrame([(v,) for v in x], "v double").repartition(3)
    got = A.density(df, "v", 50)
    h = np.std(x, ddof=1) * len(x) ** -0.2
    for r in got.collect():
        want = sum(math.exp(-0.5 * ((r.x - v) / h) ** 2) for v in x) / (len(x) * h * math.sqrt(2 * math.pi))
        assert r.density == pytest.approx(want)
    got.explain()
    assert "Generate" not in capsys.readouterr().out


def test_no_exchange_is_keyed_by_text(spark, capsys):
    rows = [("a", 1, "train"), ("a", 1, "test"), ("a", 2, "train"), ("b", 1, "test"), ("b", 1, "test"), (None, 1, "test")]
    df = spark.createDataFrame(rows, "body string, label int, split string")
    out = A.split_leakage(df, "body", "label")
    assert sorted(map(tuple, out.collect())) == [("a", 1, "test", 1, 2), ("a", 1, "train", 1, 2), ("a", 2, "train", 1, 2), ("b", 1, "test", 2, 1)]
    out.explain()
    plan = capsys.readouterr().out
    assert "hashpartitioning(body" not in plan and "hashpartitioning(__tm_print" in plan
