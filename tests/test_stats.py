"""Statistics: opt-in approximations and a hot group through the whole path."""

import numpy as np
from pyspark.sql import functions as F

from wagelens.operators import stats
from wagelens.plans.catalog import pay

from .conftest import SF_SMALL


def test_overview_approx_distinct_close(spark):
    df = pay(spark, SF_SMALL)
    exact = stats.overview(df).first()
    approx = stats.overview(df, approx_distinct=True).first()
    for c in ("unique_companies", "unique_locations", "unique_job_titles"):
        assert abs(getattr(approx, c) - getattr(exact, c)) <= 0.05 * getattr(exact, c) + 1


def test_hot_group_location_stats(spark):
    rng = np.random.default_rng(3)
    hot = rng.integers(100_000, 20_000_000, 4000)          # one location with most rows
    cold = rng.integers(100_000, 20_000_000, 400)
    rows = [("HOT", int(v)) for v in hot] + [(f"L{i % 4}", int(v)) for i, v in enumerate(cold)]
    df = spark.createDataFrame(rows, "location string, annual_base_pay long")
    got = {r.location: r for r in stats.location_stats(df, limit=10).collect()}
    assert got["HOT"]["count"] == 4000
    assert abs(got["HOT"].median_salary - np.percentile(hot / 100.0, 50)) < 1e-4
    assert got["HOT"].min_salary_cents == int(hot.min()) and got["HOT"].max_salary_cents == int(hot.max())
    for i in range(4):
        vals = np.array([v for j, v in enumerate(cold) if j % 4 == i]) / 100.0
        assert abs(got[f"L{i}"].median_salary - np.percentile(vals, 50)) < 1e-4
