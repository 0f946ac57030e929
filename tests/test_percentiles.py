"""Exact radix-select percentiles against numpy (linear interpolation)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wagelens.operators.percentiles import grouped_percentiles, value_histogram


@pytest.mark.parametrize("digit_bits,value_bits", [(4, 12), (20, 40), (12, 12)])
def test_grouped_percentiles_match_numpy(spark, digit_bits, value_bits):
    rng = np.random.default_rng(7)
    # a hot group holding a third of the rows, several small ones, one single-row group
    keys = ["hot"] * 600 + [f"g{i}" for i in rng.integers(0, 9, 1200)] + ["one"]
    vals = rng.integers(0, 4000, len(keys)).tolist()
    df = spark.createDataFrame(list(zip(keys, vals)), "k string, v long")
    hist = value_histogram(df, ["k"], F.col("v"))
    groups = hist.groupBy("k").agg(F.sum("_c").alias("_n"))
    probs = (0.25, 0.5, 0.75, 0.0, 1.0)
    names = ("q1", "med", "q3", "lo", "hi")
    got = {r.k: r for r in grouped_percentiles(hist, groups, ["k"], probs, names, scale=1.0,
                                               value_bits=value_bits, digit_bits=digit_bits).collect()}
    for k in set(keys):
        xs = np.array([v for kk, v in zip(keys, vals) if kk == k], dtype=float)
        for p, n in zip(probs, names):
            assert getattr(got[k], n) == pytest.approx(np.percentile(xs, p * 100), abs=1e-9), (k, p)


def test_null_group_key(spark):
    df = spark.createDataFrame([(None, 1), (None, 3), ("a", 5)], "k string, v long")
    hist = value_histogram(df, ["k"], F.col("v"))
    groups = hist.groupBy("k").agg(F.sum("_c").alias("_n"))
    got = {r.k: r.m for r in grouped_percentiles(hist, groups, ["k"], (0.5,), ("m",)).collect()}
    assert got == {None: 2.0, "a": 5.0}


def test_value_out_of_range_raises(spark):
    df = spark.createDataFrame([("a", 1 << 13)], "k string, v long")
    hist = value_histogram(df, ["k"], F.col("v"))
    groups = hist.groupBy("k").agg(F.sum("_c").alias("_n"))
    with pytest.raises(Exception):
        grouped_percentiles(hist, groups, ["k"], (0.5,), ("m",), value_bits=12,
                            digit_bits=12).collect()


def test_approx_switch_close_to_exact(spark):
    from wagelens.operators import stats
    from wagelens.plans.catalog import pay
    df = pay(spark, "/root/testdata/sf0.001")
    exact = {r.location: r.median_salary for r in stats.location_stats(df, limit=25).collect()}
    approx = {r.location: r.median_salary for r in stats.location_stats(df, limit=25, approx=True).collect()}
    assert exact.keys() == approx.keys()
    for k in exact:
        assert abs(exact[k] - approx[k]) <= 0.05 * exact[k]
