"""Percentiles counted from the rows, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wagelens.operators import rank_select, stats
from wagelens.operators.rank_select import narrow, row_percentiles, settle
from wagelens.operators.stats import measured
from wagelens.plans.catalog import pay

PROBS = (0.25, 0.5, 0.75, 0.0, 1.0)
NAMES = ("q1", "med", "q3", "lo", "hi")


def table():
    """A group with a third of the rows, an outlier, equal values, negative and very large ones, a single row, a null group."""
    rng = np.random.default_rng(7)
    rows = [("hot", int(v)) for v in rng.integers(2_000_000, 90_000_000, 4000)] + [("hot", 99_999_999_999)]
    rows += [(f"g{i}", int(v)) for i, v in zip(rng.integers(0, 9, 7000), rng.lognormal(16, 2, 7000))]
    rows += [("equal", 5)] * 50 + [("one", 77), ("two", -3), ("two", 4), (None, 1), (None, 2), (None, 2)]
    rows += [("negative", int(v)) for v in rng.integers(-10 ** 15, 10 ** 15, 500)] + [("nothing", None)]
    return rows


@pytest.mark.parametrize("small,bins,few", [(1 << 18, 1 << 16, True), (0, 1 << 16, True), (0, 16, False), (100, 64, False)])
def test_row_percentiles_match_numpy(spark, monkeypatch, small, bins, few):
    monkeypatch.setattr(rank_select, "BINS", bins)
    rows = table()
    df = spark.createDataFrame(rows, "k string, v long").repartition(6)
    groups = settle(df.groupBy("k").agg(*measured(F.col("v"))).where("_n > 0"), few)
    got = {r["k"]: r for r in row_percentiles(df, ["k"], F.col("v"), groups, PROBS, NAMES, few=few, small=small).collect()}
    assert set(got) == {k for k, v in rows if v is not None}
    for k in got:
        values = np.array([v for g, v in rows if g == k and v is not None], float)
        for p, name in zip(PROBS, NAMES):
            assert got[k][name] == pytest.approx(np.percentile(values, p * 100), rel=1e-15, abs=1e-9), (k, p)


def test_only_chosen_groups_are_counted(spark):
    df = spark.createDataFrame(table(), "k string, v long")
    groups = settle(df.where("k IN ('one', 'two')").groupBy("k").agg(*measured(F.col("v"))), True)
    for small in (0, 100):
        got = row_percentiles(df, ["k"], F.col("v"), groups, (0.5,), ("med",), few=True, small=small).collect()
        assert sorted((r["k"], r["med"]) for r in got) == [("one", 77.0), ("two", 0.5)]


def test_a_round_keeps_counts_and_not_rows(spark):
    """A hot group of many values leaves a bounded number of rows after the first shuffle."""
    df = spark.range(200_000).select(F.lit("hot").alias("k"), (F.col("id") * 7919 % 1_000_003).alias("_v"))
    groups = settle(df.groupBy("k").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).withColumn(
        "_targets", F.expr("array(struct(0 AS t, 99999L AS r))")), True)
    found = narrow(df, groups, ["k"], True, True).collect()
    assert len(found) == 1 and found[0]["_hi"] - found[0]["_lo"] < 4000
    plan = narrow(df, groups, ["k"], True, True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # bins of the groups, and their order


def test_top_k_statistic_shuffles_little(spark):
    """The statistic returned shuffles for the percentiles and the order only; its groups are already chosen."""
    df = pay(spark, "/root/testdata/sf0.001")
    plan = stats.job_title_stats(df, limit=5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and "LocalTableScan" in plan


def test_empty_input(spark):
    df = spark.createDataFrame([], "annual_base_pay long, location string")
    assert stats.pay_summary(df, ["location"], top=3).count() == 0
    row = stats.pay_summary(df, []).collect()
    assert len(row) == 1 and row[0]["count"] == 0 and row[0]["median_salary"] is None


def test_experience_of_any_width(spark):
    """Experience beyond the old fixed width, and below zero, is counted like any other."""
    df = pay(spark, "/root/testdata/sf0.001").limit(4).select("*")
    odd = df.withColumn("years_experience_industry", F.element_at(F.array(F.lit(-2.5), F.lit(1.0), F.lit(5000.0), F.lit(90000.25)),
                                                                  (F.row_number().over(rank_select.Window.orderBy("id"))).cast("int")))
    got = stats.pay_stats(odd).first()
    assert got["median_experience"] == 2500.5 and got["max_experience"] == 90000.25
