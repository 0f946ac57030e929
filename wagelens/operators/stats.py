"""Grouped pay statistics (A01-A16) and the time-series list.

Every statistic follows one plan shape:

* one aggregation over the rows gives count, sum, min, max and all further
  measures per group.  It combines map-side, so a hot group is no hot task,
  and the average comes from the exact integer sum.
* HAVING and top-k run on that per-group frame, once: a report's few groups
  stay with the driver, many are written to the shared checkpoint folder.
* exact percentiles (``rank_select.py``) are then counted from the rows of the
  surviving groups only; no copy of the rows by value is made.

Money conventions: ``average_salary`` / percentiles in dollars (double, 4
places), ``min_salary_cents`` / ``max_salary_cents`` in cents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import compensation_range, experience_bracket, experience_level
from ..functions.money import round4, scale_cents, total_compensation
from ..schema import DEFAULT_KEYWORD
from .filters import PayFilter, apply_filter, engineer_filter, stat_guard
from .rank_select import FEW, row_percentiles, settle

PAY = "annual_base_pay"
EXP = "years_experience_industry"
ALL = "_all"


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str],
                 how: str = "inner") -> DataFrame:
    """Null-safe equi-join on ``keys`` keeping one copy of each key."""
    ren = {k: f"_rk_{k}" for k in keys}
    r = right.select(*[F.col(c).alias(ren.get(c, c)) for c in right.columns])
    cond = [left[k].eqNullSafe(r[ren[k]]) for k in keys]
    return left.join(r, cond, how).drop(*ren.values())


def measured(value: Column) -> list[Column]:
    """Count, exact sum, least and greatest of an integral column: ``_n``, ``_s``, ``_min``, ``_max``."""
    return [F.count(value).alias("_n"), F.sum(value.cast("decimal(20,0)")).alias("_s"), F.min(value).alias("_min"), F.max(value).alias("_max")]


def pay_summary(df: DataFrame, keys: Sequence[str], *, min_count: int | None = None,
                min_avg_dollars: float | None = None, top: int | None = None,
                probs: Sequence[float] = (0.5,), pct_names: Sequence[str] = ("median_salary",),
                extra_aggs: Sequence[Column] = (), count_name: str = "count",
                avg_name: str = "average_salary", min_name: str = "min_salary_cents",
                max_name: str = "max_salary_cents", min_max_dollars: bool = False,
                approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """The M5 measure set per group over already-guarded rows.

    ``keys=[]`` gives one global row (also when no row qualifies).
    ``approx=True`` swaps the exact percentiles for ``percentile_approx``
    (a fixed-size sketch per group, relative rank error ``1/accuracy``).
    """
    keys = list(keys)
    is_global = not keys
    if is_global:
        df = df.withColumn(ALL, F.lit(0))
        keys = [ALL]
    few = is_global or (top is not None and int(top) <= FEW)
    measures = [*measured(F.col(PAY)), *extra_aggs]
    if approx:
        dollars = F.col(PAY).cast("double") / F.lit(100.0)
        measures.append(F.percentile_approx(dollars, list(probs), accuracy).alias("_q"))
    if is_global:
        g = df.agg(*measures).withColumn(ALL, F.lit(0))
    else:
        g = df.groupBy(*keys).agg(*measures).where(F.col("_n") > 0)
    g = g.withColumn("_avg", F.col("_s").cast("double") / F.col("_n") / F.lit(100.0))
    if min_count is not None:
        g = g.where(F.col("_n") >= min_count)
    if min_avg_dollars is not None:
        g = g.where(F.col("_avg") > F.lit(float(min_avg_dollars)))
    order = [F.col("_avg").desc_nulls_last()] + [F.col(k).asc_nulls_last() for k in keys]
    if top is not None:
        g = g.orderBy(*order).limit(int(top))
    if approx:
        out = g.select("*", *[F.col("_q")[i].alias(n) for i, n in enumerate(pct_names)]).drop("_q")
    else:
        g = settle(g, few)
        pct = row_percentiles(df, keys, F.col(PAY), g, probs, pct_names, scale=100.0, few=few)
        out = join_on_keys(g, pct, keys, "left")
    lo, hi = F.col("_min"), F.col("_max")
    if min_max_dollars:
        lo, hi = round4(lo / F.lit(100.0)), round4(hi / F.lit(100.0))
    cols = [*keys,
            F.coalesce(F.col("_n"), F.lit(0)).cast("long").alias(count_name),
            round4("_avg").alias(avg_name),
            *[round4(n).alias(n) for n in pct_names],
            lo.alias(min_name), hi.alias(max_name),
            *[F.col(c) for c in out.columns
              if c not in set(keys) | {"_n", "_s", "_min", "_max", "_avg"} | set(pct_names)]]
    out = out.select(*cols)
    if is_global:
        return out.drop(ALL)
    return out.orderBy(F.col(avg_name).desc_nulls_last(), *[F.col(k).asc_nulls_last() for k in keys])


# ---------------------------------------------------------------------------
# live API statistics
# ---------------------------------------------------------------------------

def pay_stats(df: DataFrame, flt: PayFilter | None = None) -> DataFrame:
    """Global pay statistics with quartiles, std-dev and experience."""
    base = stat_guard(apply_filter(df, flt))
    hundredths = F.round(F.col(EXP) * 100).cast("long")
    pay = pay_summary(base, [], probs=(0.5, 0.25, 0.75),
                      pct_names=("median_salary", "q1_salary", "q3_salary"),
                      extra_aggs=[
                          round4(F.stddev_samp(scale_cents(PAY))).alias("standard_deviation"),
                          round4(F.avg(F.col(EXP).cast("double"))).alias("average_experience"),
                          F.min(F.col(EXP).cast("double")).alias("min_experience"),
                          F.max(F.col(EXP).cast("double")).alias("max_experience")]).withColumn(ALL, F.lit(0))
    exp = base.withColumn(ALL, F.lit(0))
    exp_n = settle(exp.agg(*measured(hundredths)).withColumn(ALL, F.lit(0)), True)
    exp_med = row_percentiles(exp, [ALL], hundredths, exp_n, (0.5,), ("median_experience",), scale=100.0, few=True)
    out = join_on_keys(pay, exp_med, [ALL], "left")
    return out.select("count", "average_salary", "median_salary", "min_salary_cents",
                      "max_salary_cents", "q1_salary", "q3_salary", "standard_deviation",
                      "average_experience",
                      round4("median_experience").alias("median_experience"),
                      "min_experience", "max_experience")


def location_stats(df: DataFrame, flt: PayFilter | None = None, limit: int = 10,
                   approx: bool = False) -> DataFrame:
    """M5 by location, HAVING count >= 3, best paid first."""
    base = stat_guard(apply_filter(df, flt), PAY, "location")
    return pay_summary(base, ["location"], min_count=3, top=limit, approx=approx)


def job_title_stats(df: DataFrame, flt: PayFilter | None = None, limit: int = 10) -> DataFrame:
    """M5 by job title, HAVING count >= 2."""
    base = stat_guard(apply_filter(df, flt), PAY, "job_title")
    return pay_summary(base, ["job_title"], min_count=2, top=limit)


def engineer_stats(df: DataFrame, flt: PayFilter | None = None,
                   keyword: str = DEFAULT_KEYWORD) -> DataFrame:
    """Global M5 over titles containing the keyword."""
    base = stat_guard(apply_filter(df, engineer_filter(flt, keyword)))
    return pay_summary(base, [])


def engineer_by_location(df: DataFrame, limit: int = 10,
                         keyword: str = DEFAULT_KEYWORD) -> DataFrame:
    """Keyword titles, M5 by location, HAVING count >= 2."""
    base = stat_guard(apply_filter(df, PayFilter(job_title_contains=keyword)), PAY, "location")
    return pay_summary(base, ["location"], min_count=2, top=limit)


def highest_paid_roles(df: DataFrame, min_experience: float = 0, max_experience: float = 50,
                       limit: int = 10, min_count: int = 3,
                       min_avg_dollars: float = 50_000) -> DataFrame:
    """Titles within an experience band, HAVING count >= 3 AND avg > $50k."""
    base = stat_guard(df, PAY, "job_title").where(
        F.col(EXP).between(F.lit(min_experience), F.lit(max_experience)))
    return pay_summary(base, ["job_title"], min_count=min_count, min_avg_dollars=min_avg_dollars,
                       top=limit,
                       extra_aggs=[round4(F.avg(F.col(EXP).cast("double"))).alias("avg_experience")])


def extended_stats(df: DataFrame, field: str = PAY, flt: PayFilter | None = None) -> DataFrame:
    """Count, min, max, avg, sum, sum of squares, population variance/std-dev.

    Variance comes from exact integer sums: (n*sum(x^2) - sum(x)^2) / n^2.
    """
    x = F.col(field).cast("decimal(20,0)")
    g = apply_filter(df, flt).where(F.col(field).isNotNull()).agg(
        F.count(F.col(field)).alias("count"), F.min(field).alias("min"), F.max(field).alias("max"),
        F.sum(x).alias("_s"), F.sum(x * x).alias("_ss"))
    n = F.col("count").cast("decimal(20,0)")
    var = ((n * F.col("_ss") - F.col("_s") * F.col("_s")).cast("double")
           / (F.col("count").cast("double") * F.col("count").cast("double")))
    return g.select("count", "min", "max",
                    round4(F.col("_s").cast("double") / F.col("count")).alias("avg"),
                    F.col("_s").cast("long").alias("sum"),
                    F.col("_ss").cast("double").alias("sum_of_squares"),
                    round4(var).alias("variance"),
                    round4(F.sqrt(var)).alias("std_deviation"))


# ---------------------------------------------------------------------------
# views and the overview table
# ---------------------------------------------------------------------------

_VIEW_NAMES = dict(count_name="total_records", avg_name="avg_salary", min_name="min_salary",
                   max_name="max_salary", min_max_dollars=True)


def compensation_by_location(df: DataFrame) -> DataFrame:
    """All locations (the NULL location is its own group)."""
    return pay_summary(stat_guard(df), ["location"], **_VIEW_NAMES)


def compensation_by_title(df: DataFrame) -> DataFrame:
    """All job titles."""
    return pay_summary(stat_guard(df, PAY, "job_title"), ["job_title"], **_VIEW_NAMES)


def engineer_compensation(df: DataFrame, keyword: str = DEFAULT_KEYWORD) -> DataFrame:
    """Keyword titles by (location, job title)."""
    base = stat_guard(apply_filter(df, PayFilter(job_title_contains=keyword)))
    return pay_summary(base, ["location", "job_title"], **_VIEW_NAMES)


def overview(df: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """Dashboard numbers of the whole table."""
    base = stat_guard(df)
    distinct = F.approx_count_distinct if approx_distinct else F.countDistinct
    counts = base.agg(distinct("employer").alias("unique_companies"),
                      distinct("location").alias("unique_locations"),
                      distinct("job_title").alias("unique_job_titles")).withColumn(ALL, F.lit(0))
    pay = pay_summary(base, [], probs=(0.25, 0.5, 0.75),
                      pct_names=("q1_salary", "median_salary", "q3_salary"),
                      count_name="total_records", avg_name="overall_avg_salary",
                      min_name="min_salary", max_name="max_salary", min_max_dollars=True)
    out = join_on_keys(pay.withColumn(ALL, F.lit(0)), counts, [ALL], "left")
    return out.select("total_records", "unique_companies", "unique_locations",
                      "unique_job_titles", "overall_avg_salary", "min_salary", "max_salary",
                      "q1_salary", "median_salary", "q3_salary",
                      F.current_timestamp().alias("last_updated"))


def refresh_overview(df: DataFrame, path: str, approx_distinct: bool = False) -> None:
    """A09 refresh: recompute and overwrite the materialized overview."""
    overview(df, approx_distinct).write.mode("overwrite").parquet(path)


def count_rows(df: DataFrame, flt: PayFilter | None = None) -> DataFrame:
    """A10: filtered row count."""
    return apply_filter(df, flt).agg(F.count(F.lit(1)).alias("total"))


# ---------------------------------------------------------------------------
# schema-declared statistics
# ---------------------------------------------------------------------------

def company_stats(df: DataFrame, flt: PayFilter | None = None, limit: int = 10,
                  min_count: int = 2) -> DataFrame:
    """M5 by employer."""
    base = stat_guard(apply_filter(df, flt), PAY, "employer")
    return pay_summary(base, ["employer"], min_count=min_count, top=limit)


def experience_bracket_stats(df: DataFrame, flt: PayFilter | None = None) -> DataFrame:
    """Count, average and median pay per experience bracket."""
    base = apply_filter(df, flt).where(F.col(PAY).isNotNull()).withColumn(
        "experience_bracket", experience_bracket(EXP))
    out = pay_summary(base, ["experience_bracket"])
    return out.select("experience_bracket", "count", "average_salary", "median_salary") \
              .orderBy("experience_bracket")


def gender_stats(df: DataFrame, flt: PayFilter | None = None) -> DataFrame:
    """Count and average by gender, gap to the best-paid gender in percent."""
    base = stat_guard(apply_filter(df, flt))
    g = base.groupBy("gender").agg(F.count(F.lit(1)).alias("count"),
                                   (F.avg(PAY) / F.lit(100.0)).alias("_avg"))
    # the per-gender frame has one row per gender value; the max is taken
    # with a global aggregate joined back on a constant key
    top = g.agg(F.max("_avg").alias("_top")).withColumn(ALL, F.lit(0))
    j = join_on_keys(g.withColumn(ALL, F.lit(0)), top, [ALL])
    gap = F.lit(100.0) * (F.col("_top") - F.col("_avg")) / F.col("_top")
    return j.select("gender", "count", round4("_avg").alias("average_salary"),
                    round4(gap).alias("pay_gap_percentage")).orderBy("gender")


def total_comp_stats(df: DataFrame, flt: PayFilter | None = None) -> DataFrame:
    """Sum (cents) and average (dollars) of base + bonus + stock."""
    base = stat_guard(apply_filter(df, flt))
    t = total_compensation()
    return base.agg(F.sum(t.cast("decimal(20,0)")).cast("long").alias("total_compensation_sum"),
                    round4(F.avg(t) / F.lit(100.0)).alias("average_total_compensation"))


def range_level_stats(df: DataFrame) -> DataFrame:
    """Facet counts of the two computed keyword fields."""
    t = total_compensation()
    return (df.select(compensation_range(t).alias("compensation_range"),
                      experience_level(EXP).alias("experience_level"))
              .groupBy("compensation_range", "experience_level")
              .agg(F.count(F.lit(1)).alias("count"))
              .orderBy("compensation_range", "experience_level"))


def experience_pay_correlation(df: DataFrame, flt: PayFilter | None = None) -> DataFrame:
    """Pearson correlation of experience and pay (dollars) + pair count."""
    base = stat_guard(apply_filter(df, flt)).where(F.col(EXP).isNotNull())
    return base.agg(F.count(F.lit(1)).alias("pairs"),
                    round4(F.corr(F.col(EXP).cast("double"), scale_cents(PAY))).alias("correlation"))


# ---------------------------------------------------------------------------
# time series
# ---------------------------------------------------------------------------

def salary_trends_by_location(df: DataFrame, location: str, start: str | None = None,
                              end: str | None = None) -> DataFrame:
    """Records of one location within optional dates, oldest first."""
    flt = PayFilter(location=location, timestamp_after=start, timestamp_before=end)
    return apply_filter(df, flt).orderBy(F.col("timestamp").asc_nulls_last(),
                                         F.col("id").asc_nulls_last())
