"""Algebraic checks for sort / page / cursor and filters."""

from pyspark.sql import functions as F

from wagelens.operators import paging
from wagelens.operators.filters import PayFilter, Range, apply_filter
from wagelens.plans.catalog import pay

from .conftest import SF_SMALL

SORT = [("ANNUAL_BONUS", "DESC"), ("TIMESTAMP", "ASC")]


def test_pages_concatenate_to_full_sort(spark):
    df = pay(spark, SF_SMALL).where(F.col("location") == "NATION_3")
    full = [r.id for r in paging.sort_pay(df, SORT).collect()]
    pages = []
    for off in range(0, len(full), 100):
        pages += [r.id for r in paging.page(df, SORT, limit=100, offset=off).collect()]
    assert pages == full


def test_cursor_pages_concatenate(spark):
    df = pay(spark, SF_SMALL).where(F.col("location") == "NATION_3")
    full = [r.id for r in paging.sort_pay(df, SORT).collect()]
    got, cursor = [], None
    while True:
        rows = paging.page_after(df, SORT, cursor, 50).collect()
        if not rows:
            break
        got += [r.id for r in rows]
        cursor = rows[-1].cursor
    assert got == full


def test_limit_defaults_and_cap(spark):
    df = pay(spark, SF_SMALL)
    assert paging.page(df).count() == 20
    assert paging.page(df, limit=1000).count() == 100
    info = paging.page_info(df, 20, 0).first()
    assert info.has_next_page and not info.has_previous_page


def test_filter_and_sql_agree(spark):
    f = PayFilter(location_contains="nation_1", annual_base_pay=Range(min=1_000_000),
                  gender="a", timestamp_after="1996-01-01")
    n = apply_filter(pay(spark, SF_SMALL), f).count()
    assert n > 0
    assert "annual_base_pay >= 1000000" in f.to_sql().replace('"', "")


def test_contains_escapes_wildcards(spark):
    df = pay(spark, SF_SMALL)
    assert apply_filter(df, PayFilter(employer="supplier%")).count() == 0
    assert apply_filter(df, PayFilter(employer="supplier%", escape=False)).count() == df.count()


def test_select_fields_prunes(spark):
    df = paging.select_fields(pay(spark, SF_SMALL), ["id", "annualBasePay"])
    assert df.columns == ["id", "annualBasePay"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:string,annual_base_pay:bigint>" in plan


def test_range_filter_pushed_to_scan(spark):
    df = apply_filter(pay(spark, SF_SMALL), PayFilter(annual_base_pay=Range(min=1_000_000),
                                                      location="NATION_3")).select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: ", 1)[1]
    assert "EqualTo(location,NATION_3)" in pushed and "GreaterThanOrEqual(" in pushed
    assert "ReadSchema: struct<id:string,location:string,annual_base_pay:bigint>" in plan


def test_unknown_sort_field_falls_back(spark):
    df = pay(spark, SF_SMALL)
    assert paging.sort_keys(df, [("NOT_A_FIELD", "ASC")]) == [("timestamp", "ASC")]
    assert paging.sort_keys(df, None) == [("timestamp", "DESC")]
    with_created = df.withColumn("created_at", F.col("timestamp"))
    assert paging.sort_keys(with_created, None) == [("created_at", "DESC")]


def test_list_pay_with_fields(spark):
    rows, info = paging.list_pay(pay(spark, SF_SMALL), PayFilter(location="NATION_3"),
                                 [("ANNUAL_BASE_PAY", "DESC")], limit=5, offset=0,
                                 fields=["id", "annualBasePay", "annualBasePayFormatted"])
    got = rows.collect()
    assert len(got) == 5 and rows.columns == ["id", "annualBasePay", "annualBasePayFormatted"]
    assert all(r.annualBasePayFormatted.startswith("$") for r in got)
    assert info.first().total_count >= 5


def test_deep_pages_equal_the_order(spark):
    """Pages at every depth, over ties and nulls, are those of the whole order; beyond the end they are empty."""
    df = pay(spark, SF_SMALL).withColumn("annual_base_pay", F.when(F.col("annual_base_pay") % 7 > 0, F.floor(F.col("annual_base_pay") / 1_000_000)))
    sort = [("annual_base_pay", "DESC"), ("timestamp", "ASC")]
    whole = [r["id"] for r in paging.sort_pay(df, sort).select("id").collect()]
    for offset in (0, 3, 2990, len(whole) - 30, len(whole), len(whole) + 500):
        got = paging.deep_page(df, sort, 70, offset).select("id").collect()
        assert [r["id"] for r in got] == whole[offset:offset + 70]
    assert paging.deep_page(df.limit(0), sort, 10, 5).count() == 0
