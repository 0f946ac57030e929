"""Named queries: Spark builders and their DuckDB oracle SQL.

Every builder takes ``(spark, sf_dir)`` and reads the driver tables through
the ``pay`` adapter (or another driver table), so its work grows with the
data.  Parameters are fixed per entry so results are comparable.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import round4
from ..operators import paging, quality, search, search_index, stats
from ..operators.filters import PayFilter, Range, apply_filter, stat_guard_sql
from ..schema import (RAW_FIELDS, TITLE_CATEGORIES, TITLE_SENIORITY, TITLE_SYNONYMS,
                      VARCHAR_LIMITS)
from ..sources import survey_csv
from ..session import computed, reuse, scratch_path
from ..sources.tables import PAY_SQL, materialized_pay, pay_inputs, read_table, table_path, with_pay, write_once
from ..streaming import changes, snapshots
from .sqltext import PAY_D, m5_query, pct, r4

#: keyword used by the keyword-title queries on the driver data (the
#: survey default is "engineer"; driver titles look like "SMALL blue bolt")
KEYWORD = "bolt"

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        REGISTRY[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def pay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical pay table over the driver tables (written once)."""
    return materialized_pay(spark, sf_dir)


# ---------------------------------------------------------------------------
# A: statistics
# ---------------------------------------------------------------------------

@register("engineer_by_location", m5_query(
    ["location"],
    f"job_title ILIKE '%{KEYWORD}%' AND {stat_guard_sql('annual_base_pay', 'location')}",
    having="count(*) >= 2", top=10))
def q_engineer_by_location(spark, sf_dir):
    return stats.engineer_by_location(pay(spark, sf_dir), limit=10, keyword=KEYWORD)



@register("pay_stats", with_pay(
    "SELECT count(*) AS count, " + r4("avg(annual_base_pay) / 100") + " AS average_salary, "
    + r4(pct(0.5)) + " AS median_salary, min(annual_base_pay) AS min_salary_cents, "
    "max(annual_base_pay) AS max_salary_cents, " + r4(pct(0.25)) + " AS q1_salary, "
    + r4(pct(0.75)) + " AS q3_salary, " + r4(f"stddev_samp({PAY_D})") + " AS standard_deviation, "
    + r4("avg(CAST(years_experience_industry AS DOUBLE))") + " AS average_experience, "
    + r4(pct(0.5, "years_experience_industry")) + " AS median_experience, "
    "min(CAST(years_experience_industry AS DOUBLE)) AS min_experience, "
    "max(CAST(years_experience_industry AS DOUBLE)) AS max_experience "
    "FROM pay WHERE " + stat_guard_sql()))
def q_pay_stats(spark, sf_dir):
    return stats.pay_stats(pay(spark, sf_dir))


F_MULTI = PayFilter(location_contains="nation_1", annual_base_pay=Range(min=1_000_000, max=8_000_000),
                    years_experience_industry=Range(min=5), timestamp_after="1996-01-01",
                    timestamp_before="2000-12-31 23:59:59")


@register("pay_stats_filtered", with_pay(
    "SELECT count(*) AS count, " + r4("avg(annual_base_pay) / 100") + " AS average_salary, "
    + r4(pct(0.5)) + " AS median_salary, min(annual_base_pay) AS min_salary_cents, "
    "max(annual_base_pay) AS max_salary_cents, " + r4(pct(0.25)) + " AS q1_salary, "
    + r4(pct(0.75)) + " AS q3_salary, " + r4(f"stddev_samp({PAY_D})") + " AS standard_deviation, "
    + r4("avg(CAST(years_experience_industry AS DOUBLE))") + " AS average_experience, "
    + r4(pct(0.5, "years_experience_industry")) + " AS median_experience, "
    "min(CAST(years_experience_industry AS DOUBLE)) AS min_experience, "
    "max(CAST(years_experience_industry AS DOUBLE)) AS max_experience "
    f"FROM pay WHERE {F_MULTI.to_sql()} AND " + stat_guard_sql()))
def q_pay_stats_filtered(spark, sf_dir):
    return stats.pay_stats(pay(spark, sf_dir), F_MULTI)


F_PAY = PayFilter(annual_base_pay=Range(min=1_000_000))


@register("location_stats", m5_query(
    ["location"], f"{F_PAY.to_sql()} AND {stat_guard_sql('annual_base_pay', 'location')}",
    having="count(*) >= 3", top=10))
def q_location_stats(spark, sf_dir):
    return stats.location_stats(pay(spark, sf_dir), F_PAY, limit=10)


@register("job_title_stats", m5_query(
    ["job_title"], stat_guard_sql("annual_base_pay", "job_title"), having="count(*) >= 2", top=10))
def q_job_title_stats(spark, sf_dir):
    return stats.job_title_stats(pay(spark, sf_dir), limit=10)


F_ENG = PayFilter(location_contains="NATION_1", job_title_contains="gear")  # title is overwritten


@register("engineer_stats", m5_query(
    [], f"{F_ENG.replace(job_title_contains=KEYWORD).to_sql()} AND {stat_guard_sql()}"))
def q_engineer_stats(spark, sf_dir):
    return stats.engineer_stats(pay(spark, sf_dir), F_ENG, keyword=KEYWORD)


@register("highest_paid_roles", m5_query(
    ["job_title"], stat_guard_sql("annual_base_pay", "job_title")
    + " AND years_experience_industry BETWEEN 0 AND 50",
    having="count(*) >= 3 AND avg(annual_base_pay) / 100 > 50000", top=10,
    extra=r4("avg(CAST(years_experience_industry AS DOUBLE))") + " AS avg_experience"))
def q_highest_paid_roles(spark, sf_dir):
    return stats.highest_paid_roles(pay(spark, sf_dir), 0, 50, 10)


@register("highest_paid_roles_senior", m5_query(
    ["job_title"], stat_guard_sql("annual_base_pay", "job_title")
    + " AND years_experience_industry BETWEEN 30 AND 50",
    having="count(*) >= 3 AND avg(annual_base_pay) / 100 > 50000", top=5,
    extra=r4("avg(CAST(years_experience_industry AS DOUBLE))") + " AS avg_experience"))
def q_highest_paid_roles_senior(spark, sf_dir):
    return stats.highest_paid_roles(pay(spark, sf_dir), 30, 50, 5)


@register("extended_stats", with_pay(
    "SELECT count(annual_base_pay) AS count, min(annual_base_pay) AS min, max(annual_base_pay) AS max, "
    + r4("CAST(sum(annual_base_pay) AS DOUBLE) / count(annual_base_pay)") + " AS avg, "
    "CAST(sum(annual_base_pay) AS BIGINT) AS sum, "
    "CAST(sum(CAST(annual_base_pay AS HUGEINT) * annual_base_pay) AS DOUBLE) AS sum_of_squares, "
    + r4("CAST(count(*) * sum(CAST(annual_base_pay AS HUGEINT) * annual_base_pay) - sum(CAST(annual_base_pay AS HUGEINT)) * sum(CAST(annual_base_pay AS HUGEINT)) AS DOUBLE) / (CAST(count(*) AS DOUBLE) * count(*))") + " AS variance, "
    + r4("sqrt(CAST(count(*) * sum(CAST(annual_base_pay AS HUGEINT) * annual_base_pay) - sum(CAST(annual_base_pay AS HUGEINT)) * sum(CAST(annual_base_pay AS HUGEINT)) AS DOUBLE) / (CAST(count(*) AS DOUBLE) * count(*)))") + " AS std_deviation "
    "FROM pay WHERE annual_base_pay IS NOT NULL"))
def q_extended_stats(spark, sf_dir):
    return stats.extended_stats(pay(spark, sf_dir))


_VIEW = dict(count_name="total_records", avg_name="avg_salary", min_name="min_salary",
             max_name="max_salary", min_max_dollars=True)


@register("compensation_by_location", m5_query(["location"], stat_guard_sql(), **_VIEW))
def q_compensation_by_location(spark, sf_dir):
    return stats.compensation_by_location(pay(spark, sf_dir))


@register("compensation_by_title", m5_query(
    ["job_title"], stat_guard_sql("annual_base_pay", "job_title"), **_VIEW))
def q_compensation_by_title(spark, sf_dir):
    return stats.compensation_by_title(pay(spark, sf_dir))


@register("engineer_compensation", m5_query(
    ["location", "job_title"], f"job_title ILIKE '%{KEYWORD}%' AND {stat_guard_sql()}", **_VIEW))
def q_engineer_compensation(spark, sf_dir):
    return stats.engineer_compensation(pay(spark, sf_dir), keyword=KEYWORD)


@register("overview", with_pay(
    "SELECT count(*) AS total_records, count(DISTINCT employer) AS unique_companies, "
    "count(DISTINCT location) AS unique_locations, count(DISTINCT job_title) AS unique_job_titles, "
    + r4("avg(annual_base_pay) / 100") + " AS overall_avg_salary, "
    + r4("min(annual_base_pay) / 100.0") + " AS min_salary, "
    + r4("max(annual_base_pay) / 100.0") + " AS max_salary, "
    + r4(pct(0.25)) + " AS q1_salary, " + r4(pct(0.5)) + " AS median_salary, "
    + r4(pct(0.75)) + " AS q3_salary FROM pay WHERE " + stat_guard_sql()))
def q_overview(spark, sf_dir):
    return stats.overview(pay(spark, sf_dir)).drop("last_updated")


F_COUNT = PayFilter(industry="Brand#13", gender="r", employment_type="f",
                    annual_bonus=Range(min=100_000), years_experience_company=Range(max=25))


@register("count_rows", with_pay(f"SELECT count(*) AS total FROM pay WHERE {F_COUNT.to_sql()}"))
def q_count_rows(spark, sf_dir):
    return stats.count_rows(pay(spark, sf_dir), F_COUNT)


@register("company_stats", m5_query(
    ["employer"], stat_guard_sql("annual_base_pay", "employer"), having="count(*) >= 2", top=10))
def q_company_stats(spark, sf_dir):
    return stats.company_stats(pay(spark, sf_dir), limit=10)


_BRACKET_SQL = ("CASE WHEN years_experience_industry < 2 THEN '0-2 years' "
                "WHEN years_experience_industry < 5 THEN '2-5 years' "
                "WHEN years_experience_industry < 10 THEN '5-10 years' ELSE '10+ years' END")


@register("experience_bracket_stats", with_pay(
    f"SELECT {_BRACKET_SQL} AS experience_bracket, count(*) AS count, "
    + r4("avg(annual_base_pay) / 100") + " AS average_salary, " + r4(pct(0.5)) + " AS median_salary "
    "FROM pay WHERE annual_base_pay IS NOT NULL GROUP BY 1 ORDER BY 1"))
def q_experience_bracket_stats(spark, sf_dir):
    return stats.experience_bracket_stats(pay(spark, sf_dir))


@register("gender_stats", with_pay(
    "SELECT gender, count, " + r4("a") + " AS average_salary, "
    + r4("100.0 * (max(a) OVER () - a) / max(a) OVER ()") + " AS pay_gap_percentage FROM ("
    "SELECT gender, count(*) AS count, avg(annual_base_pay) / 100 AS a FROM pay WHERE "
    + stat_guard_sql() + " GROUP BY gender) t ORDER BY gender"))
def q_gender_stats(spark, sf_dir):
    return stats.gender_stats(pay(spark, sf_dir))


_TOTAL_SQL = "(coalesce(annual_base_pay, 0) + coalesce(annual_bonus, 0) + coalesce(stock_value, 0))"


@register("total_comp_stats", with_pay(
    f"SELECT CAST(sum({_TOTAL_SQL}) AS BIGINT) AS total_compensation_sum, "
    + r4(f"avg({_TOTAL_SQL}) / 100.0") + " AS average_total_compensation FROM pay WHERE "
    + stat_guard_sql()))
def q_total_comp_stats(spark, sf_dir):
    return stats.total_comp_stats(pay(spark, sf_dir))


_RANGE_SQL = (f"CASE WHEN {_TOTAL_SQL} / 100.0 < 50000 THEN 'Entry Level' "
              f"WHEN {_TOTAL_SQL} / 100.0 < 100000 THEN 'Mid Level' "
              f"WHEN {_TOTAL_SQL} / 100.0 < 200000 THEN 'Senior Level' ELSE 'Executive Level' END")
_LEVEL_SQL = ("CASE WHEN coalesce(years_experience_industry, 0) < 2 THEN 'Junior' "
              "WHEN coalesce(years_experience_industry, 0) < 5 THEN 'Mid-Level' "
              "WHEN coalesce(years_experience_industry, 0) < 10 THEN 'Senior' ELSE 'Expert' END")


@register("range_level_stats", with_pay(
    f"SELECT {_RANGE_SQL} AS compensation_range, {_LEVEL_SQL} AS experience_level, count(*) AS count "
    "FROM pay GROUP BY 1, 2 ORDER BY 1, 2"))
def q_range_level_stats(spark, sf_dir):
    return stats.range_level_stats(pay(spark, sf_dir))


@register("experience_pay_correlation", with_pay(
    "SELECT count(*) AS pairs, " + r4(f"corr(CAST(years_experience_industry AS DOUBLE), {PAY_D})")
    + " AS correlation FROM pay WHERE " + stat_guard_sql()
    + " AND years_experience_industry IS NOT NULL"))
def q_experience_pay_correlation(spark, sf_dir):
    return stats.experience_pay_correlation(pay(spark, sf_dir))


@register("salary_trends_by_location", with_pay(
    "SELECT id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS ts, annual_base_pay, job_title "
    "FROM pay WHERE location = 'NATION_3' AND timestamp >= TIMESTAMP '1996-01-01' "
    "AND timestamp <= TIMESTAMP '1997-12-31 23:59:59' ORDER BY timestamp, id"))
def q_salary_trends_by_location(spark, sf_dir):
    df = stats.salary_trends_by_location(pay(spark, sf_dir), "NATION_3", "1996-01-01",
                                         "1997-12-31 23:59:59")
    return df.select("id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts"),
                     "annual_base_pay", "job_title")


# ---------------------------------------------------------------------------
# O / J: list, sort, page, lookup, projection
# ---------------------------------------------------------------------------

F_LIST = PayFilter(employer="supplier#0000000", location_contains="nation_")
LIST_SORT = [("ANNUAL_BASE_PAY", "DESC"), ("TIMESTAMP", "ASC")]


def _list_sql(where: str, order: str, limit: int, offset: int, cols: str) -> str:
    return with_pay(f"SELECT {cols} FROM pay WHERE {where} ORDER BY {order}, id ASC "
                    f"LIMIT {limit} OFFSET {offset}")


_LIST_COLS = ("id, employer, location, job_title, annual_base_pay, "
              "strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS ts")


def _list_cols(df, *extra):
    return df.select("id", "employer", "location", "job_title", "annual_base_pay",
                     F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts"), *extra)


@register("list_page", _list_sql(F_LIST.to_sql(),
                                 "annual_base_pay DESC NULLS FIRST, timestamp ASC NULLS LAST",
                                 20, 40, _LIST_COLS))
def q_list_page(spark, sf_dir):
    rows, _ = paging.list_pay(pay(spark, sf_dir), F_LIST, LIST_SORT, limit=20, offset=40)
    return _list_cols(rows)


@register("list_page_deep", _list_sql("TRUE", "annual_base_pay DESC NULLS FIRST, timestamp ASC NULLS LAST", 50, 30_000, _LIST_COLS))
def q_list_page_deep(spark, sf_dir):
    rows, _ = paging.list_pay(pay(spark, sf_dir), None, LIST_SORT, limit=50, offset=30_000)
    return _list_cols(rows)


@register("list_page_info", with_pay(
    f"SELECT count(*) AS total_count, 40 + 20 < count(*) AS has_next_page, "
    f"TRUE AS has_previous_page FROM pay WHERE {F_LIST.to_sql()}"))
def q_list_page_info(spark, sf_dir):
    _, info = paging.list_pay(pay(spark, sf_dir), F_LIST, LIST_SORT, limit=20, offset=40)
    return info


@register("sort_bonus_nulls", _list_sql(
    "TRUE", "annual_bonus DESC NULLS FIRST, years_experience_company ASC NULLS LAST", 100, 0,
    _LIST_COLS + ", annual_bonus"))
def q_sort_bonus_nulls(spark, sf_dir):
    sort = [("ANNUAL_BONUS", "DESC"), ("YEARS_EXPERIENCE_COMPANY", "ASC")]
    df = paging.page(pay(spark, sf_dir), sort, limit=500, offset=0)  # capped to 100
    return _list_cols(df, "annual_bonus")


@register("page_limit_capped", _list_sql(
    "TRUE", "years_experience_industry ASC NULLS LAST", 100, 7, _LIST_COLS))
def q_page_limit_capped(spark, sf_dir):
    df = paging.page(pay(spark, sf_dir), [("YEARS_EXPERIENCE_INDUSTRY", "ASC")], limit=1000, offset=7)
    return _list_cols(df)


@register("page_after_cursor", _list_sql(
    "TRUE", "annual_base_pay DESC NULLS FIRST", 20, 20, _LIST_COLS))
def q_page_after_cursor(spark, sf_dir):
    df = pay(spark, sf_dir)
    sort = [("ANNUAL_BASE_PAY", "DESC")]
    first = paging.page_after(df, sort, None, 20)
    # the cursor of the last row of page one (a 20-row page -> driver)
    last = first.orderBy(F.col("annual_base_pay").asc(), F.col("id").desc()).select("cursor").first()
    return _list_cols(paging.page_after(df, sort, last["cursor"], 20))


@register("get_by_id", with_pay(
    "SELECT id, employer, job_title, annual_base_pay FROM pay WHERE id = "
    "(SELECT min(id) FROM pay WHERE location = 'NATION_7')"))
def q_get_by_id(spark, sf_dir):
    df = pay(spark, sf_dir)
    rid = df.where(F.col("location") == "NATION_7").agg(F.min("id")).first()[0]
    return paging.get_by_id(df, rid).select("id", "employer", "job_title", "annual_base_pay")


@register("get_by_id_missing", with_pay("SELECT id FROM pay WHERE id = '1'"))
def q_get_by_id_missing(spark, sf_dir):
    return paging.get_by_id(pay(spark, sf_dir), "1").select("id")


@register("api_view", with_pay(
    "SELECT id, annual_base_pay AS annualBasePayCents, "
    "CASE WHEN annual_base_pay <> 0 THEN CAST(floor(annual_base_pay / 100.0 + 0.5) AS BIGINT) END AS annualBasePay, "
    "CASE WHEN annual_bonus <> 0 THEN CAST(floor(annual_bonus / 100.0 + 0.5) AS BIGINT) END AS annualBonus, "
    "CASE WHEN stock_value <> 0 THEN CAST(floor(stock_value / 100.0 + 0.5) AS BIGINT) END AS stockValue, "
    "CASE WHEN annual_base_pay > 0 THEN '$' || format('{:,}', CAST(floor(abs(annual_base_pay) / 100.0 + 0.5) AS BIGINT)) END AS annualBasePayFormatted, "
    f"CASE WHEN {_TOTAL_SQL} <> 0 THEN CAST(floor({_TOTAL_SQL} / 100.0 + 0.5) AS BIGINT) END AS totalCompensation, "
    f"CASE WHEN {_TOTAL_SQL} > 0 THEN '$' || format('{{:,}}', CAST(floor(abs({_TOTAL_SQL}) / 100.0 + 0.5) AS BIGINT)) END AS totalCompensationFormatted, "
    "job_title AS jobTitle, location, employer FROM pay"))
def q_api_view(spark, sf_dir):
    return paging.select_fields(pay(spark, sf_dir), [
        "id", "annualBasePayCents", "annualBasePay", "annualBonus", "stockValue",
        "annualBasePayFormatted", "totalCompensation", "totalCompensationFormatted", "jobTitle",
        "location", "employer"])



# ---------------------------------------------------------------------------
# F / N: cleaning rules over survey-shaped text derived from the driver data
# ---------------------------------------------------------------------------

def _fmt_int_sql(x: str) -> str:
    return f"CAST(CAST(floor({x}) AS BIGINT) AS VARCHAR)"


#: raw survey text built from the pay adapter (same strings in both engines)
RAW_SQL = (
    "SELECT id, "
    "CASE WHEN gender = 'R' THEN '   ' ELSE concat(' ', employer, chr(39) || 's ') END AS employer, "
    "location, concat(chr(34), job_title, chr(34)) AS job_title, "
    "strftime(timestamp, '%-m/%-d/%Y %-H:%-M:%-S') AS timestamp, "
    "CASE gender WHEN 'A' THEN concat(" + _fmt_int_sql("annual_base_pay / 100000") + ", '.', "
    + _fmt_int_sql("annual_base_pay / 10000 - floor(annual_base_pay / 100000) * 10") + ", 'k') "
    "WHEN 'N' THEN concat('$', format('{:,}', CAST(floor(annual_base_pay / 100) AS BIGINT))) "
    "ELSE concat('USD ', " + _fmt_int_sql("annual_base_pay / 100") + ", '.', "
    "lpad(" + _fmt_int_sql("annual_base_pay - floor(annual_base_pay / 100) * 100") + ", 2, '0')) END AS annual_base_pay, "
    "CASE WHEN annual_bonus IS NULL THEN 'n/a' ELSE " + _fmt_int_sql("annual_bonus / 100") + " END AS annual_bonus, "
    "CASE employment_type WHEN 'O' THEN concat(" + _fmt_int_sql("years_experience_industry") + ", ' - ', "
    + _fmt_int_sql("years_experience_industry + 3") + ", ' years') "
    "ELSE concat(" + _fmt_int_sql("years_experience_industry") + ", ' years or more') END AS years_experience_industry, "
    "concat(" + _fmt_int_sql("years_experience_company") + ", ',5') AS years_experience_company, "
    "CASE gender WHEN 'A' THEN ' Yes ' WHEN 'N' THEN 'Not Offered' ELSE 'maybe' END AS health_insurance_offered, "
    "CASE employment_type WHEN 'F' THEN concat(" + _fmt_int_sql("years_experience_industry") + ", '.5') "
    "ELSE " + _fmt_int_sql("years_experience_industry * 4") + " END AS actual_hours_per_week "
    "FROM pay")


def raw_survey_frame(spark, sf_dir):
    """Spark twin of ``RAW_SQL``: survey-shaped text from the pay adapter."""
    c = F.col

    def fmt_int(x):
        return F.floor(x).cast("long").cast("string")

    pay_c = c("annual_base_pay")
    years = c("years_experience_industry")
    df = pay(spark, sf_dir)
    return computed(
        df, c("id"),
        F.when(c("gender") == "R", F.lit("   "))
         .otherwise(F.concat(F.lit(" "), c("employer"), F.lit("'s "))).alias("employer"),
        c("location"),
        F.concat(F.lit('"'), c("job_title"), F.lit('"')).alias("job_title"),
        F.date_format("timestamp", "M/d/yyyy H:m:s").alias("timestamp"),
        F.when(c("gender") == "A",
               F.concat(fmt_int(pay_c / 100000), F.lit("."),
                        fmt_int(pay_c / 10000 - F.floor(pay_c / 100000) * 10), F.lit("k")))
         .when(c("gender") == "N",
               F.concat(F.lit("$"), F.format_number(F.floor(pay_c / 100), 0)))
         .otherwise(F.concat(F.lit("USD "), fmt_int(pay_c / 100), F.lit("."),
                             F.lpad(fmt_int(pay_c - F.floor(pay_c / 100) * 100), 2, "0")))
         .alias("annual_base_pay"),
        F.when(c("annual_bonus").isNull(), F.lit("n/a"))
         .otherwise(fmt_int(c("annual_bonus") / 100)).alias("annual_bonus"),
        F.when(c("employment_type") == "O",
               F.concat(fmt_int(years), F.lit(" - "), fmt_int(years + 3), F.lit(" years")))
         .otherwise(F.concat(fmt_int(years), F.lit(" years or more")))
         .alias("years_experience_industry"),
        F.concat(fmt_int(c("years_experience_company")), F.lit(",5")).alias("years_experience_company"),
        F.when(c("gender") == "A", F.lit(" Yes ")).when(c("gender") == "N", F.lit("Not Offered"))
         .otherwise(F.lit("maybe")).alias("health_insurance_offered"),
        F.when(c("employment_type") == "F", F.concat(fmt_int(years), F.lit(".5")))
         .otherwise(fmt_int(years * 4)).alias("actual_hours_per_week"), keep=())


_LEAD_U = "'^([0-9]+(\\.[0-9]*)?|\\.[0-9]+)'"
_LEAD_S = "'^-?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)'"
_RANGE = "'(?i)([0-9]+)\\s*[-–]\\s*([0-9]+)\\s*years?'"


def _num_sql(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL OR {x} = '' THEN NULL "
            f"WHEN regexp_matches({x}, {_RANGE}) THEN (CAST(regexp_extract({x}, {_RANGE}, 1) AS DOUBLE) "
            f"+ CAST(regexp_extract({x}, {_RANGE}, 2) AS DOUBLE)) / 2.0 "
            f"ELSE TRY_CAST(NULLIF(regexp_extract(regexp_replace({x}, '[^0-9.\\-]', '', 'g'), {_LEAD_S}, 0), '') AS DOUBLE) END")


def _money_sql(x: str) -> str:
    kept = f"regexp_replace(lower({x}), '[^0-9.k]', '', 'g')"
    k_num = (f"TRY_CAST(NULLIF(regexp_extract(regexp_replace({kept}, '^([^k]*)k', '\\1'), {_LEAD_U}, 0), '') AS DOUBLE)")
    plain = f"TRY_CAST(NULLIF(regexp_extract({kept}, {_LEAD_U}, 0), '') AS DOUBLE)"
    return (f"CASE WHEN {x} IS NULL OR {x} = '' THEN NULL "
            f"WHEN strpos({kept}, 'k') > 0 THEN CAST(floor({k_num} * 1000.0 * 100.0 + 0.5) AS BIGINT) "
            f"WHEN {plain} > 0 THEN CAST(floor({plain} * 100.0 + 0.5) AS BIGINT) END")


def _sanitize_sql(x: str) -> str:
    t = f"regexp_replace(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), '[' || chr(39) || chr(34) || ']', '', 'g')"
    return f"CASE WHEN {t} <> '' THEN {t} END"


def _clamp_exp(x: str) -> str:
    return f"CASE WHEN {x} > 99 THEN 50.0 WHEN {x} < 0 THEN NULL ELSE {x} END"


CLEAN_SQL = with_pay(
    "SELECT id, coalesce(" + _sanitize_sql("r.employer") + ", 'Unknown Company') AS employer, "
    "coalesce(" + _sanitize_sql("r.location") + ", 'Unknown Location') AS location, "
    "coalesce(" + _sanitize_sql("r.job_title") + ", 'Unknown Position') AS job_title, "
    "strftime(try_strptime(r.timestamp, '%m/%d/%Y %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS ts, "
    + _clamp_exp(_num_sql("r.years_experience_industry")) + " AS years_experience_industry, "
    + _clamp_exp(_num_sql("r.years_experience_company")) + " AS years_experience_company, "
    "least(" + _money_sql("r.annual_base_pay") + ", 99999999999) AS annual_base_pay, "
    + _money_sql("r.annual_bonus") + " AS annual_bonus, "
    "CASE lower(trim(r.health_insurance_offered)) WHEN 'yes' THEN TRUE WHEN 'not offered' THEN FALSE END AS health_insurance_offered, "
    "h AS actual_hours_per_week, "
    "CAST(round((CASE WHEN trim(coalesce(r.employer, '')) <> '' THEN 25 ELSE 0 END + "
    "CASE WHEN trim(coalesce(r.location, '')) <> '' THEN 25 ELSE 0 END + "
    "CASE WHEN trim(coalesce(r.job_title, '')) <> '' THEN 25 ELSE 0 END + "
    "CASE WHEN trim(coalesce(r.annual_base_pay, '')) <> '' THEN 25 ELSE 0 END) / 100.0 * 100) AS INTEGER) AS data_quality_score, "
    "concat_ws(',', CASE WHEN h < 0 OR h > 168 THEN 'hours_out_of_range' END, "
    "CASE WHEN h IS NOT NULL AND h <> floor(h) THEN 'actual_hours_per_week_not_integer' END) AS reasons "
    "FROM (SELECT *, " + _num_sql("actual_hours_per_week") + " AS h FROM (" + RAW_SQL + ")) r")


@register("clean_survey_rules", CLEAN_SQL)
def q_clean_survey_rules(spark, sf_dir):
    raw = raw_survey_frame(spark, sf_dir)
    raw = raw.select("id", *[F.col(f) if f in raw.columns else F.lit(None).cast("string").alias(f)
                             for f in RAW_FIELDS])
    cleaned = survey_csv.clean_survey(raw, "lineitem", keep=("id",))
    cleaned = survey_csv.clamp_outliers(survey_csv.keep_valid_rows(cleaned))
    cleaned = cleaned.withColumn("row_number", F.lit(1))
    reasons = survey_csv.constraint_reasons(cleaned)
    return cleaned.select(
        "id", "employer", "location", "job_title",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts"),
        "years_experience_industry", "years_experience_company", "annual_base_pay",
        "annual_bonus", "health_insurance_offered", "actual_hours_per_week",
        "data_quality_score", F.concat_ws(",", reasons).alias("reasons"))



# ---------------------------------------------------------------------------
# C: change capture / apply / streaming sync
# ---------------------------------------------------------------------------

def _scratch(spark, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def _snapshots(spark, sf_dir):
    df = pay(spark, sf_dir)
    before = df.where(F.col("location") != "NATION_0")
    after = df.where(F.col("location") != "NATION_1").withColumn(
        "annual_bonus", F.when(F.col("gender") == "A", F.coalesce("annual_bonus", F.lit(0)) + 1)
                         .otherwise(F.col("annual_bonus")))
    return before, after.select(*before.columns)


@register("capture_changes", with_pay(
    "SELECT CASE WHEN b.id IS NULL THEN 'INSERT' WHEN a.id IS NULL THEN 'DELETE' ELSE 'UPDATE' END "
    "AS operation, coalesce(a.id, b.id) AS id, a.annual_bonus AS annual_bonus "
    "FROM (SELECT * FROM pay WHERE location <> 'NATION_0') b FULL OUTER JOIN "
    "(SELECT id, CASE WHEN gender = 'A' THEN coalesce(annual_bonus, 0) + 1 ELSE annual_bonus END "
    "AS annual_bonus FROM pay WHERE location <> 'NATION_1') a ON b.id = a.id "
    "WHERE b.id IS NULL OR a.id IS NULL OR b.annual_bonus IS DISTINCT FROM a.annual_bonus"))
def q_capture_changes(spark, sf_dir):
    before, after = _snapshots(spark, sf_dir)
    ch = changes.capture_changes(before, after)
    return ch.select("operation", "id", F.col("data.annual_bonus").alias("annual_bonus"))


@register("capture_snapshot_changes", with_pay(
    "SELECT CAST(2 AS BIGINT) AS seq, CASE WHEN b.id IS NULL THEN 'INSERT' WHEN a.id IS NULL THEN 'DELETE' ELSE 'UPDATE' END "
    "AS operation, coalesce(a.id, b.id) AS id, a.annual_bonus AS annual_bonus, a.job_title AS job_title "
    "FROM (SELECT * FROM pay WHERE location <> 'NATION_0') b FULL OUTER JOIN "
    "(SELECT id, job_title, CASE WHEN gender = 'A' THEN coalesce(annual_bonus, 0) + 1 ELSE annual_bonus END "
    "AS annual_bonus FROM pay WHERE location <> 'NATION_1') a ON b.id = a.id "
    "WHERE b.id IS NULL OR a.id IS NULL OR b.annual_bonus IS DISTINCT FROM a.annual_bonus"))
def q_capture_snapshot_changes(spark, sf_dir):
    base = _scratch(spark, "snapshots")
    for df in _snapshots(spark, sf_dir):
        snapshots.write_snapshot(df, base, buckets=16)
    ch = snapshots.capture_snapshot_changes(spark, base)
    return ch.select("seq", "operation", "id", F.col("data.annual_bonus").alias("annual_bonus"), F.col("data.job_title").alias("job_title"))


_EVENTS_CH_SQL = (
    "SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'DELETE' "
    "WHEN event_type = 'signup' THEN 'INSERT' ELSE 'UPDATE' END AS operation, "
    "CAST(user_id AS VARCHAR) AS id, CAST(round(value * 100) AS BIGINT) AS annual_base_pay, "
    "TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS years_experience_industry FROM events")

_STATE_SQL = (
    "SELECT id, seq, annual_base_pay, years_experience_industry, "
    "annual_base_pay AS total_compensation, "
    "CASE WHEN annual_base_pay / 100.0 < 50000 THEN 'Entry Level' WHEN annual_base_pay / 100.0 < 100000 "
    "THEN 'Mid Level' WHEN annual_base_pay / 100.0 < 200000 THEN 'Senior Level' ELSE 'Executive Level' END "
    "AS compensation_range, "
    "CASE WHEN coalesce(years_experience_industry, 0) < 2 THEN 'Junior' "
    "WHEN coalesce(years_experience_industry, 0) < 5 THEN 'Mid-Level' "
    "WHEN coalesce(years_experience_industry, 0) < 10 THEN 'Senior' ELSE 'Expert' END AS experience_level "
    f"FROM ({_EVENTS_CH_SQL}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1 "
    "AND operation <> 'DELETE'")

_STATE_COLS = ("id", "seq", "annual_base_pay", "years_experience_industry", "total_compensation",
               "compensation_range", "experience_level")


def _events(spark, sf_dir):
    return read_table(spark, sf_dir, "events")


@register("apply_changes", _STATE_SQL)
def q_apply_changes(spark, sf_dir):
    state = changes.apply_changes(None, changes.events_as_changes(_events(spark, sf_dir)))
    return changes.live_rows(state).select(*_STATE_COLS)


@register("apply_changes_out_of_order", _STATE_SQL)
def q_apply_changes_out_of_order(spark, sf_dir):
    """Three batches that arrive newest first: older upserts come after newer deletes."""
    events = changes.events_as_changes(_events(spark, sf_dir))
    state = None
    for part in (2, 1, 0):  # thirds of every thousand sequence numbers, then of all of them
        state = changes.apply_changes(state, events.where(F.floor(F.col("seq") % 1000 / 334) == part))
    return changes.live_rows(state).select(*_STATE_COLS)


_WHOLE_ROW = ("id", "source_file", "timestamp", "employer", "industry", "location", "country", "job_title", "gender", "employment_type",
              "years_experience_industry", "years_experience_company", "annual_base_pay", "annual_bonus", "stock_value")


@register("whole_row_feed", with_pay(
    "SELECT " + ", ".join(
        "CASE WHEN gender = 'A' THEN coalesce(annual_bonus, 0) + 1 ELSE annual_bonus END AS annual_bonus" if c == "annual_bonus" else c
        for c in _WHOLE_ROW) + " FROM pay WHERE location <> 'NATION_1'"))
def q_whole_row_feed(spark, sf_dir):
    """Capture, JSON text, parse and apply with whole rows: the old snapshot becomes the new one, in every column."""
    before, after = _snapshots(spark, sf_dir)
    buckets = changes.key_buckets(before, after)
    before, after = (changes.stored_by_key(df, buckets) for df in (before, after))
    feed = changes.change_to_json(changes.capture_changes(before, after, seq=2))
    events = changes.change_from_json(feed, changes.change_schema(after.schema)).repartition(buckets, "id")  # to the target's buckets
    state = changes.apply_changes(before.withColumn("seq", F.lit(1).cast("long")), events, enrich=False)
    return changes.live_rows(state).select(*_WHOLE_ROW)


@register("change_json_roundtrip", f"SELECT seq, operation, id, annual_base_pay FROM ({_EVENTS_CH_SQL}) "
          "WHERE operation <> 'DELETE' UNION ALL SELECT seq, operation, id, NULL FROM "
          f"({_EVENTS_CH_SQL}) WHERE operation = 'DELETE'")
def q_change_json_roundtrip(spark, sf_dir):
    js = changes.change_to_json(changes.events_as_changes(_events(spark, sf_dir)))
    back = changes.change_from_json(js)
    return back.select("seq", "operation", "id", F.col("data.annual_base_pay").alias("annual_base_pay"))


def _event_stream(spark, sf_dir):
    schema = _events(spark, sf_dir).schema
    # the file source watches a folder; the glob picks the events file in it
    return (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
            .option("maxFilesPerTrigger", 1).parquet(sf_dir))


@register("stream_changes", _STATE_SQL)
def q_stream_changes(spark, sf_dir):
    base, ckpt = _scratch(spark, "docs"), _scratch(spark, "docs-ckpt")
    q = changes.stream_changes(changes.events_as_changes(_event_stream(spark, sf_dir)), base, ckpt, buckets=None)
    q.awaitTermination()
    return changes.current_state(spark, base).select(*_STATE_COLS)


@register("latest_state_stream", "SELECT id, seq, operation FROM (" + _EVENTS_CH_SQL + ") "
          "QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1")
def q_latest_state_stream(spark, sf_dir):
    out, ckpt = _scratch(spark, "latest"), _scratch(spark, "latest-ckpt")
    st = changes.latest_state(changes.events_as_changes(_event_stream(spark, sf_dir)))
    changes.run_to_table(st.select("id", "seq", "operation"), out, ckpt, mode="complete")
    return spark.read.parquet(out)


@register("streaming_overview",
          "SELECT event_type, count(*) AS total_records, sum(CAST(round(value * 100) AS BIGINT)) AS sum_value, "
          "min(CAST(round(value * 100) AS BIGINT)) AS min_value, "
          "max(CAST(round(value * 100) AS BIGINT)) AS max_value FROM events GROUP BY event_type")
def q_streaming_overview(spark, sf_dir):
    out, ckpt = _scratch(spark, "overview"), _scratch(spark, "overview-ckpt")
    s = _event_stream(spark, sf_dir).select(
        "event_type", F.col("user_id").alias("id"),
        F.round(F.col("value") * 100).cast("long").alias("annual_base_pay"))
    changes.run_to_table(changes.streaming_overview(s, by="event_type", approx=False), out, ckpt)
    return spark.read.parquet(out)


@register("reconcile", with_pay(
    "SELECT count(s.id) AS source_count, count(t.id) AS target_count, "
    "count_if(t.id IS NULL) AS missing_in_target, count_if(s.id IS NULL) AS extra_in_target "
    "FROM pay s FULL OUTER JOIN (SELECT id FROM pay WHERE location <> 'NATION_2') t ON s.id = t.id"))
def q_reconcile(spark, sf_dir):
    df = pay(spark, sf_dir)
    return changes.reconcile(df, df.where(F.col("location") != "NATION_2"))



# ---------------------------------------------------------------------------
# H: search
# ---------------------------------------------------------------------------

_STEM_SQL = ("CASE WHEN length(t) <= 3 THEN t WHEN regexp_matches(t, 'ies$') THEN regexp_replace(t, 'ies$', 'y') "
             "WHEN regexp_matches(t, '(ss|us|is)$') THEN t "
             "WHEN regexp_matches(t, 'ing$') AND length(t) > 5 THEN regexp_replace(t, 'ing$', '') "
             "WHEN regexp_matches(t, 'ed$') AND length(t) > 4 THEN regexp_replace(t, 'ed$', '') "
             "WHEN regexp_matches(t, '(ch|sh|x|z)es$') THEN regexp_replace(t, 'es$', '') "
             "WHEN regexp_matches(t, 's$') THEN regexp_replace(t, 's$', '') ELSE t END")

_TOK_SQL = "list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: length(t) > 0)"


def _tok_sql(x: str) -> str:
    return _TOK_SQL.format(x=x)


FUZZY_TEXT = "blt gizmoo"


def _fuzzy_sql(field: str, text: str) -> str:
    conds = []
    for t in search.py_tokens(text):
        k = search.auto_fuzziness(t)
        conds.append(f"(abs(length(token) - {len(t)}) <= {k} AND levenshtein(token, '{t}') <= {k})")
    return with_pay(
        f"SELECT id, {field} FROM pay WHERE id IN (SELECT id FROM (SELECT id, "
        f"unnest({_tok_sql(field)}) AS token FROM pay) WHERE {' OR '.join(conds)})")


@register("fuzzy_match_title", _fuzzy_sql("job_title", FUZZY_TEXT))
def q_fuzzy_match_title(spark, sf_dir):
    return search.fuzzy_match(pay(spark, sf_dir), "job_title", FUZZY_TEXT).select("id", "job_title")


def _title_tokens_sql(x: str) -> str:
    """The title analyzer: longest synonym phrases between blanks, then stems."""
    groups = sorted({first for _, first in search.title_phrases()})
    s = f"(' ' || array_to_string({_tok_sql(x)}, '  ') || ' ')"
    for phrase, first in search.title_phrases():
        s = f"replace({s}, ' {phrase.replace(' ', '  ')} ', ' #{groups.index(first)}# ')"
    for i, first in enumerate(groups):
        s = f"replace({s}, '#{i}#', '{first}')"
    return f"list_transform(list_filter(string_split({s}, ' '), lambda t: length(t) > 0), lambda t: {_STEM_SQL})"


def _terms_sql(fields: dict[str, str]) -> str:
    """All terms of a row: the analyzer's name and the token."""
    of = {"standard": _tok_sql, "title": _title_tokens_sql}
    return "list_concat(" + ", ".join(
        f"coalesce(list_transform({of[a](f)}, lambda t: '{a}:' || t), [])" for f, a in fields.items()) + ", [])"


def _bm25_sql(from_sql: str, key: str, terms_of: str, query: str, limit: int, analyzers: tuple[str, ...] = ("standard", "title"),
              ctes: str = "", where: str = "TRUE") -> str:
    """``where`` tells the rows that may be found; the statistics are of all rows."""
    of = {"standard": _tok_sql, "title": _title_tokens_sql}
    wanted = " UNION ".join(f"SELECT '{a}:' || unnest({of[a](chr(39) + query + chr(39))}) AS term" for a in analyzers)
    score = ("ln(1.0 + (CAST(n AS DOUBLE) - dfreq + 0.5) / (dfreq + 0.5)) * CAST(tf AS DOUBLE) * 2.2 "
             "/ (CAST(tf AS DOUBLE) + 1.2 * (0.25 + 0.75 * dl / avgdl))")
    return (
        f"WITH {ctes}q AS ({wanted}), d AS (SELECT {key} AS k, {terms_of} AS t, {where} AS allowed FROM {from_sql}), "
        "st AS (SELECT count(*) AS n, avg(CAST(len(t) AS DOUBLE)) AS avgdl FROM d), "
        "h AS (SELECT k, dl, term, allowed, count(*) AS tf FROM (SELECT k, len(t) AS dl, allowed, unnest(t) AS term FROM d) "
        "WHERE term IN (SELECT term FROM q) GROUP BY ALL), "
        "df AS (SELECT term, count(*) AS dfreq FROM h GROUP BY term) "
        f"SELECT k AS {key}, {r4(f'sum({score})')} AS score FROM h JOIN df USING (term) CROSS JOIN st WHERE allowed "
        f"GROUP BY k ORDER BY {r4(f'sum({score})')} DESC, k LIMIT {limit}")


def pay_index(spark: SparkSession, sf_dir: str) -> str:
    """Token tables of the pay table, written once per input version."""
    return write_once(spark, "pay-index", pay_inputs(sf_dir), lambda out: search_index.write_index(pay(spark, sf_dir), out), "/totals")


def document_index(spark: SparkSession, sf_dir: str) -> str:
    """Token tables of the documents' whole texts, written once per input version."""
    docs = read_table(spark, sf_dir, "documents", spread_rows=True)
    return write_once(spark, "document-index", [table_path(sf_dir, "documents")],
                      lambda out: search_index.write_index(docs, out, "doc_id", {"text": "standard"}), "/totals")


PAY_QUERY = "blue bolt nation_3"
_PAY_TERMS_SQL = _terms_sql(search_index.PAY_FIELDS)
_PAY_CTE = "pay AS (" + PAY_SQL + "), "


@register("search_pay", _bm25_sql("pay", "id", _PAY_TERMS_SQL, PAY_QUERY, 20, ctes=_PAY_CTE))
def q_search_pay(spark, sf_dir):
    return search_index.search(spark, pay_index(spark, sf_dir), PAY_QUERY, limit=20)


@register("search_pay_filtered", _bm25_sql(
    "pay", "id", _PAY_TERMS_SQL, "bolts supplier NATION_7", 20, ctes=_PAY_CTE, where="country = 'ASIA' AND annual_base_pay >= 2000000"))
def q_search_pay_filtered(spark, sf_dir):
    allowed = pay(spark, sf_dir).where("country = 'ASIA' AND annual_base_pay >= 2000000")
    return search_index.search(spark, pay_index(spark, sf_dir), "bolts supplier NATION_7", limit=20, allowed=allowed)


#: titles with the words of the synonym groups in place of the parts' names
TITLE_WORDS = (("bolt", "Software Engineers"), ("nut", "SWE"), ("gear", "Sr. Developers"), ("widget", "lead data analyst"),
               ("gizmo", "Product Owner"), ("SMALL", "Entry-Level"), ("LARGE", "Principal"))
_WORDED_SQL = "job_title"
for _word, _title in TITLE_WORDS:
    _WORDED_SQL = f"replace({_WORDED_SQL}, '{_word}', '{_title}')"
_WORDED_CTE = _PAY_CTE + f"worded AS (SELECT id, {_WORDED_SQL} AS job_title FROM pay), "


def worded_index(spark: SparkSession, sf_dir: str) -> str:
    title = F.col("job_title")
    for word, new in TITLE_WORDS:
        title = F.replace(title, F.lit(word), F.lit(new))
    return write_once(spark, "worded-index", pay_inputs(sf_dir), lambda out: search_index.write_index(
        pay(spark, sf_dir).select("id", title.alias("job_title")), out, "id", {"job_title": "title"}), "/totals")


@register("search_titles_synonyms", _bm25_sql(
    "worded", "id", _terms_sql({"job_title": "title"}), "senior swe", 40, ("title",), ctes=_WORDED_CTE))
def q_search_titles_synonyms(spark, sf_dir):
    return search_index.search(spark, worded_index(spark, sf_dir), "senior swe", limit=40, analyzers=("title",))


DOC_QUERY = "the market data en le"


@register("search_documents", _bm25_sql("documents", "doc_id", _terms_sql({"text": "standard"}), DOC_QUERY, 20, ("standard",)))
def q_search_documents(spark, sf_dir):
    return search_index.search(spark, document_index(spark, sf_dir), DOC_QUERY, limit=20, key="doc_id", analyzers=("standard",))


FUZZY_TEXTS = {"employer": "suplier 000000012", "job_title": "blt gizmoos", "location": "13 7 nat"}


def _fuzzy_fields_sql(texts: dict[str, str], fields: dict[str, str]) -> str:
    """Full edit distance of every token to every analysed token of the field's text."""
    of = {"standard": _tok_sql, "title": _title_tokens_sql}
    conds = []
    for f, text in texts.items():
        tokens = of[fields[f]]
        conds.append(
            f"len(list_filter(flatten(list_transform({tokens(chr(39) + text + chr(39))}, lambda q: list_transform({tokens(f)}, lambda t: "
            "levenshtein(t, q) <= CASE WHEN length(q) <= 2 THEN 0 WHEN length(q) <= 5 THEN 1 ELSE 2 END))), lambda x: x)) > 0")
    return with_pay("SELECT id, employer, job_title, location FROM pay WHERE " + " AND ".join(conds))


@register("fuzzy_match_pay", _fuzzy_fields_sql(FUZZY_TEXTS, search_index.PAY_FIELDS))
def q_fuzzy_match_pay(spark, sf_dir):
    return search_index.fuzzy_match_fields(pay(spark, sf_dir), pay_index(spark, sf_dir), FUZZY_TEXTS).select(
        "id", "employer", "job_title", "location")


def _suggest_sql(field: str, prefix: str, limit: int = 10) -> str:
    return with_pay(
        f"SELECT {field} AS text, CAST(count(*) AS DOUBLE) AS score FROM pay "
        f"WHERE starts_with(lower({field}), '{prefix.lower()}') GROUP BY {field} "
        f"ORDER BY score DESC, text LIMIT {limit}")


@register("suggest_employer", _suggest_sql("employer", "Supplier#00000001"))
def q_suggest_employer(spark, sf_dir):
    return search.suggest(pay(spark, sf_dir), "employer", "Supplier#00000001")


@register("suggest_title", _suggest_sql("job_title", "small b"))
def q_suggest_title(spark, sf_dir):
    return search.suggest(pay(spark, sf_dir), "job_title", "small b")


@register("suggest_location", _suggest_sql("location", "nation_1", 5))
def q_suggest_location(spark, sf_dir):
    return search.suggest(pay(spark, sf_dir), "location", "nation_1", 5)


@register("exact_term", with_pay("SELECT id, industry FROM pay WHERE industry = 'Brand#13'"))
def q_exact_term(spark, sf_dir):
    return search.exact_term(pay(spark, sf_dir), "industry", "Brand#13").select("id", "industry")


# ---------------------------------------------------------------------------
# X: quality and dimensions
# ---------------------------------------------------------------------------

def _validation_sql() -> str:
    rules = {
        "pay_negative": "annual_base_pay < 0",
        "pay_out_of_bounds": "annual_base_pay < 100000 OR annual_base_pay > 1000000000",
        "experience_negative": "years_experience_industry < 0",
        "experience_above_60": "years_experience_industry > 60",
    }
    for name in ("source_file", "employer", "industry", "location", "country", "job_title",
                 "employment_type", "gender"):
        rules[f"{name}_too_long"] = f"length({name}) > {VARCHAR_LIMITS[name]}"
    parts = [f"SELECT '{n}' AS rule, count_if(coalesce({p}, FALSE)) AS failures, count(*) AS total FROM pay"
             for n, p in rules.items()]
    return with_pay(
        "SELECT rule, failures, total, floor(failures / total * 1000000 + 0.5) / 1000000 AS failure_rate, "
        "failures / total > 0.05 AS alert FROM (" + " UNION ALL ".join(parts) + ")")


@register("validation_report", _validation_sql())
def q_validation_report(spark, sf_dir):
    return quality.validation_report(pay(spark, sf_dir))


@register("build_companies", with_pay(
    "SELECT employer AS name, industry, CAST(NULL AS VARCHAR) AS size_category, "
    "CAST(NULL AS BOOLEAN) AS is_public FROM (SELECT employer, industry, count(*) AS n FROM pay "
    "WHERE employer IS NOT NULL AND industry IS NOT NULL GROUP BY 1, 2) "
    "QUALIFY row_number() OVER (PARTITION BY employer ORDER BY n DESC, industry) = 1"))
def q_build_companies(spark, sf_dir):
    return quality.build_companies(pay(spark, sf_dir)).drop("company_id")


@register("build_locations", with_pay(
    "SELECT nullif(trim(p[1]), '') AS city, CASE WHEN len(p) > 1 THEN nullif(trim(p[2]), '') END "
    "AS state_province, CASE WHEN len(p) > 2 THEN nullif(trim(p[3]), '') END AS country, full_location "
    "FROM (SELECT DISTINCT location AS full_location, string_split(location, ',') AS p FROM pay "
    "WHERE location IS NOT NULL)"))
def q_build_locations(spark, sf_dir):
    return quality.build_locations(pay(spark, sf_dir)).select(
        "city", "state_province", "country", "full_location")


def _rules_sql(x: str, rules, default: str) -> str:
    whens = " ".join(f"WHEN regexp_matches(lower({x}), '{p}') THEN '{label}'" for label, p in rules)
    return f"CASE {whens} ELSE '{default}' END"


def _normalize_title_sql(x: str) -> str:
    s = f"lower({x})"
    for group in TITLE_SYNONYMS:
        alts = sorted(group[1:], key=len, reverse=True)
        s = f"regexp_replace({s}, '\\b(" + "|".join(alts) + f")\\b', '{group[0]}', 'g')"
    return f"array_to_string(list_transform({_tok_sql(s)}, lambda t: {_STEM_SQL}), ' ')"


@register("build_job_titles", with_pay(
    f"SELECT title, {_normalize_title_sql('title')} AS normalized_title, "
    f"{_rules_sql('title', TITLE_CATEGORIES, 'Other')} AS category, "
    f"{_rules_sql('title', TITLE_SENIORITY, 'Mid')} AS seniority_level "
    "FROM (SELECT DISTINCT job_title AS title FROM pay WHERE job_title IS NOT NULL)"))
def q_build_job_titles(spark, sf_dir):
    return quality.build_job_titles(pay(spark, sf_dir)).drop("job_title_id")


_DEDUP_KEYS = ["employer", "job_title", "location", "annual_base_pay", "timestamp"]


@register("deduplicate", with_pay(
    "SELECT id FROM pay QUALIFY row_number() OVER (PARTITION BY "
    + ", ".join(_DEDUP_KEYS) + " ORDER BY source_file, id) = 1"))
def q_deduplicate(spark, sf_dir):
    return quality.deduplicate(pay(spark, sf_dir), _DEDUP_KEYS).select("id")


_INITCAP = ("array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')")


@register("normalize_record", with_pay(
    "SELECT id, CASE WHEN annual_base_pay BETWEEN 100000 AND 1000000000 THEN annual_base_pay END "
    "AS annual_base_pay_bounded, "
    + _INITCAP.format(x="regexp_replace(regexp_replace(trim(location), '\\s*,\\s*', ', ', 'g'), '\\s+', ' ', 'g')")
    + " AS location_normalized, " + _normalize_title_sql("job_title") + " AS job_title_normalized, "
    "regexp_replace(regexp_replace(regexp_replace(lower(trim(employer)), '[.,]', '', 'g'), "
    "'\\s+(inc|llc|ltd|corp|corporation|co|company)$', ''), '\\s+', ' ', 'g') AS employer_normalized FROM pay"))
def q_normalize_record(spark, sf_dir):
    return quality.normalize_record(pay(spark, sf_dir)).select(
        "id", "annual_base_pay_bounded", "location_normalized", "job_title_normalized",
        "employer_normalized")


def _dimensions(df):
    return [quality.load_dimension(build(df)) for build in (quality.build_companies, quality.build_locations, quality.build_job_titles)]


@register("star_join", with_pay(
    "SELECT id, employer IS NOT NULL AS has_company, location IS NOT NULL AS has_location, "
    "job_title IS NOT NULL AS has_title FROM pay"))
def q_star_join(spark, sf_dir):
    df = pay(spark, sf_dir)
    j = quality.star_join(df, *_dimensions(df))
    return j.select("id", F.col("company_id").isNotNull().alias("has_company"),
                    F.col("location_id").isNotNull().alias("has_location"),
                    F.col("job_title_id").isNotNull().alias("has_title"))



@register("star_join_names", with_pay(
    "SELECT id, employer AS company, location AS full_location, job_title AS title, "
    "nullif(trim(string_split(location, ',')[1]), '') AS city FROM pay"))
def q_star_join_names(spark, sf_dir):
    """Back from the keys to the dimensions: every row finds its own company, place and title."""
    df = pay(spark, sf_dir)
    companies, places, titles = _dimensions(df)
    j = quality.star_join(df, companies, places, titles).select("id", "company_id", "location_id", "job_title_id")
    return (j.join(companies.select("company_id", F.col("name").alias("company")), "company_id", "left")
            .join(places.select("location_id", "full_location", "city"), "location_id", "left")
            .join(titles.select("job_title_id", "title"), "job_title_id", "left")
            .select("id", "company", "full_location", "title", "city"))


# ---------------------------------------------------------------------------
# N: CSV round trip, report, sample, strict loader, parse-error split
# ---------------------------------------------------------------------------

_S3 = "salary_survey-3.csv"
_CSV_COLS = ("employer", "location", "job_title", "timestamp", "annual_base_pay", "annual_bonus",
             "years_experience_industry", "years_experience_company")


def _write_survey_csv(spark, sf_dir) -> str:
    """The derived raw text written as survey-3 CSV files (real headers)."""
    from ..schema import SURVEY_HEADERS
    hdr = SURVEY_HEADERS[_S3]
    raw = raw_survey_frame(spark, sf_dir)
    out = _scratch(spark, "survey3-csv")
    (raw.select(*[F.col(c).alias(hdr[c]) for c in _CSV_COLS])
        .write.option("header", True).option("escape", '"').csv(out))
    return out


_CSV_CLEAN_COLS = ("employer", "location", "job_title", "ts", "years_experience_industry",
                   "years_experience_company", "annual_base_pay", "annual_bonus", "data_quality_score")


@register("ingest_csv_roundtrip", "SELECT " + ", ".join(_CSV_CLEAN_COLS) + " FROM (" + CLEAN_SQL + ")")
def q_ingest_csv_roundtrip(spark, sf_dir):
    path = _write_survey_csv(spark, sf_dir)
    table, rejected, _ = survey_csv.ingest_surveys(spark, {_S3: path})
    cols = ["employer", "location", "job_title", "timestamp", "years_experience_industry",
            "years_experience_company", "annual_base_pay", "annual_bonus", "data_quality_score"]
    both = table.select(*cols).unionByName(rejected.select(*cols))  # loaded + quarantined rows
    return both.select(
        "employer", "location", "job_title",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts"),
        F.col("years_experience_industry").cast("double").alias("years_experience_industry"),
        F.col("years_experience_company").cast("double").alias("years_experience_company"),
        "annual_base_pay", "annual_bonus",
        F.col("data_quality_score").cast("int").alias("data_quality_score"))


_LOAD_SQL = ("SELECT CASE WHEN grouping(f) = 1 THEN 'TOTAL' ELSE f END AS source_file, count(*) AS rows_read, count(*) AS rows_valid, "
             "CAST(count_if(bad) AS BIGINT) AS rows_rejected, CAST(count_if(NOT bad) AS BIGINT) AS rows_loaded "
             "FROM (SELECT 'salary_survey-3.csv' AS f, coalesce(annual_base_pay < 0 OR years_experience_industry < 0 "
             "OR abs(round(years_experience_industry, 2)) >= 1000 OR abs(round(years_experience_company, 2)) >= 1000, FALSE) AS bad "
             "FROM (" + CLEAN_SQL + ")) GROUP BY ROLLUP (f)")


@register("ingest_report", _LOAD_SQL)
def q_ingest_report(spark, sf_dir):
    path = _write_survey_csv(spark, sf_dir)
    return survey_csv.ingest_surveys(spark, {_S3: path})[2]


@register("sample_rows", with_pay("SELECT employer, job_title, annual_base_pay, location FROM pay ORDER BY id LIMIT 5"))
def q_sample_rows(spark, sf_dir):
    return survey_csv.sample_rows(pay(spark, sf_dir), 5, order=("id",))


def _strict_money_sql(x: str) -> str:
    return (f"CASE WHEN regexp_matches({x}, '^[0-9]+(\\.[0-9]+)?$') "
            f"THEN CAST(round(CAST({x} AS DECIMAL(30,10)) * 100) AS BIGINT) END")


def _strict_num_sql(x: str) -> str:
    return (f"CASE WHEN regexp_matches({x}, '^[0-9]+(\\.[0-9]+)?$') "
            f"THEN CAST(CAST({x} AS DECIMAL(30,10)) AS DOUBLE) END")


@register("clean_survey_strict", with_pay(
    "SELECT id, coalesce(nullif(trim(employer, ' '), ''), 'Unknown') AS employer, "
    "coalesce(nullif(trim(job_title, ' '), ''), 'Unknown') AS job_title, "
    + _strict_money_sql("annual_base_pay") + " AS annual_base_pay, "
    + _strict_money_sql("annual_bonus") + " AS annual_bonus, "
    + _strict_num_sql("years_experience_industry") + " AS years_experience_industry, "
    + _strict_num_sql("actual_hours_per_week") + " AS actual_hours_per_week, "
    "CASE WHEN lower(health_insurance_offered) IN ('yes', 'true', '1') THEN TRUE "
    "WHEN lower(health_insurance_offered) IN ('no', 'false', '0') THEN FALSE END AS health_insurance_offered, "
    "strftime(CAST(strptime(regexp_extract(timestamp, '^([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})', 1), '%m/%d/%Y') AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS ts "
    f"FROM ({RAW_SQL}) WHERE employer IS NOT NULL AND employer <> ''"))
def q_clean_survey_strict(spark, sf_dir):
    raw = raw_survey_frame(spark, sf_dir)
    raw = raw.select("id", *[F.col(f) if f in raw.columns else F.lit(None).cast("string").alias(f)
                             for f in RAW_FIELDS])
    out = survey_csv.clean_survey_strict(raw, "lineitem", keep=("id",))
    return out.select("id", "employer", "job_title", "annual_base_pay", "annual_bonus",
                      F.col("years_experience_industry").cast("double").alias("years_experience_industry"),
                      F.col("actual_hours_per_week").cast("double").alias("actual_hours_per_week"),
                      "health_insurance_offered",
                      F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts"))


def _unparsed_sql(x: str, parser) -> str:
    return f"CASE WHEN trim(coalesce({x}, '')) <> '' AND ({parser(x)}) IS NULL THEN '{x}_unparsed' END"


@register("skip_bad_rows", with_pay(
    "SELECT id, reasons FROM (SELECT id, concat_ws(',', "
    + ", ".join([_unparsed_sql(f, _money_sql) for f in ("annual_base_pay", "annual_bonus")]
                + [_unparsed_sql(f, _num_sql) for f in ("years_experience_industry",
                                                        "years_experience_company",
                                                        "actual_hours_per_week")])
    + f") AS reasons FROM ({RAW_SQL})) WHERE reasons <> ''"))
def q_skip_bad_rows(spark, sf_dir):
    raw = raw_survey_frame(spark, sf_dir)
    raw = raw.select("id", *[F.col(f) if f in raw.columns else F.lit(None).cast("string").alias(f)
                             for f in RAW_FIELDS])
    _, bad = survey_csv.skip_bad_rows(raw)
    return bad.select("id", F.concat_ws(",", "_parse_errors").alias("reasons"))


# ---------------------------------------------------------------------------
# Snapshot export, documents, JSON change stream
# ---------------------------------------------------------------------------

@register("export_snapshot", with_pay("SELECT id, annual_base_pay FROM pay"))
def q_export_snapshot(spark, sf_dir):
    return changes.export_snapshot(pay(spark, sf_dir).select("id", "annual_base_pay"))


_DOC_SQL = with_pay(
    f"SELECT id, annual_base_pay, {_TOTAL_SQL} AS total_compensation, {_RANGE_SQL} AS compensation_range, "
    f"{_LEVEL_SQL} AS experience_level FROM pay")


@register("backfill_documents", _DOC_SQL)
def q_backfill_documents(spark, sf_dir):
    out = _scratch(spark, "documents")
    changes.backfill_documents(pay(spark, sf_dir), out, batch_rows=1000)
    return spark.read.parquet(out).select("id", "annual_base_pay", "total_compensation",
                                          "compensation_range", "experience_level")


@register("write_metrics", with_pay("SELECT count(*) AS processed, 0 AS failed FROM pay"))
def q_write_metrics(spark, sf_dir):
    ok, failed = changes.write_documents(pay(spark, sf_dir), _scratch(spark, "documents-m"))
    return spark.range(1).select(F.lit(ok + failed).cast("long").alias("processed"),
                                 F.lit(failed).cast("int").alias("failed"))


@register("upsert_document", with_pay(
    "SELECT id, CASE WHEN location = 'NATION_5' THEN annual_base_pay + 1 ELSE annual_base_pay END "
    "AS annual_base_pay FROM pay"))
def q_upsert_document(spark, sf_dir):
    df = pay(spark, sf_dir)
    docs = df.where(F.col("location") == "NATION_5").select(
        "id", (F.col("annual_base_pay") + 1).alias("annual_base_pay"))
    return changes.upsert_document(df.select("id", "annual_base_pay"), docs) \
                  .select("id", "annual_base_pay")


@register("read_changes_json", f"SELECT seq, operation, id, annual_base_pay FROM ({_EVENTS_CH_SQL}) "
          "WHERE operation <> 'DELETE' UNION ALL SELECT seq, operation, id, NULL FROM "
          f"({_EVENTS_CH_SQL}) WHERE operation = 'DELETE'")
def q_read_changes_json(spark, sf_dir):
    feed = _scratch(spark, "feed")
    changes.change_to_json(changes.events_as_changes(_events(spark, sf_dir))).write.text(feed)
    stream = changes.read_changes(spark, feed, fmt="json", max_files=4)
    out, ckpt = _scratch(spark, "feed-out"), _scratch(spark, "feed-ckpt")

    def sink(batch, batch_id):
        batch.select("seq", "operation", "id", F.col("data.annual_base_pay").alias("annual_base_pay")) \
             .write.mode("append").parquet(out)
    q = (stream.writeStream.foreachBatch(sink).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


# ---------------------------------------------------------------------------
# O04, P14/P15/P24, P09/P10/P21, H01
# ---------------------------------------------------------------------------

@register("top_groups", m5_query(["location"], stat_guard_sql(), top=5, **_VIEW))
def q_top_groups(spark, sf_dir):
    return paging.top_groups(stats.compensation_by_location(pay(spark, sf_dir)), "avg_salary", 5,
                             ["location"])


F_ALIAS = PayFilter(employer_contains="supplier#00000002", salary_range=Range(max=9_000_000),
                    experience_range=Range(min=10, max=40))


@register("filter_subsets", with_pay(
    "SELECT id FROM pay WHERE annual_base_pay > 10000000 AND timestamp > TIMESTAMP '1997-01-01' "
    f"UNION ALL SELECT id FROM pay WHERE {F_ALIAS.to_sql()}"))
def q_filter_subsets(spark, sf_dir):
    from ..operators.filters import high_pay, recent
    df = pay(spark, sf_dir)
    a = recent(high_pay(df), "1997-01-01").select("id")
    b = apply_filter(df, F_ALIAS).select("id")
    return a.unionByName(b)


F_SURVEY = PayFilter(health_insurance_offered=True, data_quality_score_min=75,
                     actual_hours_per_week=Range(min=20, max=150))


@register("filter_survey_fields", "SELECT id FROM (" + CLEAN_SQL + ") WHERE health_insurance_offered "
          "AND data_quality_score >= 75 AND actual_hours_per_week >= 20 AND actual_hours_per_week <= 150")
def q_filter_survey_fields(spark, sf_dir):
    raw = raw_survey_frame(spark, sf_dir)
    raw = raw.select("id", *[F.col(f) if f in raw.columns else F.lit(None).cast("string").alias(f)
                             for f in RAW_FIELDS])
    cleaned = survey_csv.clamp_outliers(survey_csv.keep_valid_rows(
        survey_csv.clean_survey(raw, "lineitem", keep=("id",))))
    # filters run on the written (cleaned) table, as after a load; pushing them
    # below the parse projections would inline every parse rule into the predicate
    return apply_filter(reuse(cleaned), F_SURVEY).select("id")


#: survey fields that the pay adapter lacks, derived from its columns; the same text runs in both engines
_OPTIONAL = {
    "company_size": "CASE WHEN years_experience_company > 25 THEN 'Large' ELSE 'large' END",
    "education_level": "CASE WHEN gender = 'A' THEN 'PhD' WHEN gender = 'N' THEN NULL ELSE 'BSc' END",
    "public_private": "CASE WHEN annual_base_pay % 4 = 0 THEN 'Private' ELSE 'Public' END",
    "employment_type": "CASE WHEN employment_type = 'O' THEN 'Full-time' WHEN gender = 'R' THEN 'full_time' ELSE 'Full-time job' END",
    "is_happy_at_position": "CASE WHEN annual_bonus IS NULL THEN NULL ELSE annual_bonus % 2 = 0 END",
    "plans_to_resign": "annual_base_pay % 3 = 0",
    "is_validated": "annual_base_pay % 5 > 0",
    "created_at": "CAST(timestamp AS TIMESTAMP) + INTERVAL 36 HOUR",
}
_OPTIONAL_FILTERS = {
    "company": (PayFilter(company_size="Large", education_level="PhD", public_private="Public"),
                "company_size = 'Large' AND education_level = 'PhD' AND public_private = 'Public'"),
    "mood": (PayFilter(is_happy_at_position=True, plans_to_resign=False, is_validated=True),
             "is_happy_at_position AND NOT plans_to_resign AND is_validated"),
    "unhappy": (PayFilter(is_happy_at_position=False), "is_happy_at_position = FALSE"),
    "created": (PayFilter(created_after="1995-03-01 12:00:00", created_before="1995-03-04 12:00:00"),
                "created_at BETWEEN TIMESTAMP '1995-03-01 12:00:00' AND TIMESTAMP '1995-03-04 12:00:00'"),
    "type": (PayFilter(employment_type="FULL_TIME", education_level="BSc", plans_to_resign=True),
             "lower(employment_type) IN ('full-time', 'full_time') AND education_level = 'BSc' AND plans_to_resign"),
}


@register("filter_optional_fields", "WITH pay AS (" + PAY_SQL + "), t AS (SELECT id, "
          + ", ".join(f"{x} AS {c}" for c, x in _OPTIONAL.items()) + " FROM pay) "
          + " UNION ALL ".join(f"SELECT '{n}' AS filter, id FROM t WHERE {w}" for n, (_, w) in _OPTIONAL_FILTERS.items()))
def q_filter_optional_fields(spark, sf_dir):
    df = pay(spark, sf_dir).select("id", *[F.expr(x).alias(c) for c, x in _OPTIONAL.items()])
    found = [apply_filter(df, flt).select(F.lit(n).alias("filter"), "id") for n, (flt, _) in _OPTIONAL_FILTERS.items()]
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


@register("tokenize_documents",
          f"SELECT doc_id, len({_tok_sql('text')}) AS tokens, {_tok_sql('text')}[1] AS first_token "
          "FROM documents")
def q_tokenize_documents(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", spread_rows=True)
    t = search.tokenize("text")
    return docs.select("doc_id", F.size(t).alias("tokens"), F.get(t, F.lit(0)).alias("first_token"))



def _feed_in_time_order(spark, sf_dir, parts: int = 3) -> str:
    """Change JSON written as ``parts`` appends in sequence order (a growing feed)."""
    ch = changes.events_as_changes(_events(spark, sf_dir))
    cuts = ch.approxQuantile("seq", [i / parts for i in range(1, parts)], 0.0)  # parts-1 numbers
    bounds = [None, *cuts, None]
    feed = _scratch(spark, "feed-ordered")
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (F.col("seq") > lo)
        if hi is not None:
            cond = cond & (F.col("seq") <= hi)
        changes.change_to_json(ch.where(cond)).coalesce(1).write.mode("append").text(feed)
    return feed


@register("stream_changes_bucketed", _STATE_SQL)
def q_stream_changes_bucketed(spark, sf_dir):
    feed = _feed_in_time_order(spark, sf_dir)
    base, ckpt = _scratch(spark, "docs-b"), _scratch(spark, "docs-b-ckpt")
    stream = changes.read_changes(spark, feed, fmt="json", max_files=1)
    q = changes.stream_changes(stream, base, ckpt, buckets=16)
    q.awaitTermination()
    return changes.bucketed_state(spark, base).select(*_STATE_COLS)



@register("refresh_overview", ORACLE["overview"])
def q_refresh_overview(spark, sf_dir):
    out = _scratch(spark, "overview-table")
    stats.refresh_overview(pay(spark, sf_dir), out)
    return spark.read.parquet(out).drop("last_updated")


def queries() -> dict[str, Builder]:
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
