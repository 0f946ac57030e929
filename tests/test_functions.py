"""Value tables for the scalar rules (FIXTURES.md section 3)."""

import datetime as dt

import pytest

from wagelens.functions import levels as L
from wagelens.functions import money as M
from wagelens.functions import parse as P

CURRENCY = {"$50,000": 5000000, "65,000": 6500000, "50k": 5000000, "USD 72.5K": 7250000,
            "1.5m": 150, "50k-60k": 506000000, "50000 - 60000": 500006000000, "-500": 50000,
            "0": None, "0k": 0, "1.234.567": 123, "£42,500.55": 4250055, "n/a": None, "ok": None,
            "": None}
NUMBER = {"11 - 20 years": 15.5, "5-7 years": 6.0, "5-7": 5.0, "2 – 4 Years": 3.0,
          "1 year or less": 1.0, "41 years or more": 41.0, "1.5 - 2.5 years": 1.5, "-3": -3.0,
          "--5": None, "3,5": 35.0, "0": 0.0, "x": None, "": None}
BOOLEAN = {"Yes": True, " TRUE ": True, "1": True, "y": True, "Offered": True, "no": False,
           "0": False, "Not Offered": False, "maybe": None}
SANITIZE = {'  "Acme\'s"  ': "Acmes", '" x "': " x ", "'\"": None, "   ": None}


def _eval(spark, values, fn):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    return {r.s: r.v for r in df.select("s", fn("s").alias("v")).collect()}


def test_parse_currency(spark):
    assert _eval(spark, CURRENCY, P.parse_currency_cents) == CURRENCY


def test_parse_currency_m_suffix(spark):
    out = _eval(spark, ["1.5m", "2 million", "50k", "per month 5000"],
                lambda c: P.parse_currency_cents(c, m_suffix=True))
    assert out["1.5m"] == 150000000 and out["2 million"] == 200000000
    assert out["50k"] == 5000000 and out["per month 5000"] == 500000


def test_parse_number(spark):
    assert _eval(spark, NUMBER, P.parse_number) == NUMBER


def test_parse_boolean(spark):
    assert _eval(spark, BOOLEAN, P.parse_boolean) == BOOLEAN


def test_sanitize(spark):
    assert _eval(spark, SANITIZE, P.sanitize_string) == SANITIZE


def test_parse_date(spark):
    out = _eval(spark, ["4/24/2019 11:43:21", "4/24/2019", "soon", "4/24/2019 junk",
                        "4/24/2019 1:05:06 PM"], P.parse_date)
    assert out["4/24/2019 11:43:21"] == dt.datetime(2019, 4, 24, 11, 43, 21)
    assert out["4/24/2019"] == dt.datetime(2019, 4, 24)
    assert out["4/24/2019 1:05:06 PM"] == dt.datetime(2019, 4, 24, 13, 5, 6)
    assert out["soon"] is None and out["4/24/2019 junk"] is None


def test_quality_score(spark):
    df = spark.createDataFrame([("a", "b", "c", "d"), ("a", " ", "c", "d"), ("a", None, "", "d"),
                                (None, None, None, "d"), (None, None, None, None)],
                               "e string, l string, t string, p string")
    got = [r.q for r in df.select(P.data_quality_score("e", "l", "t", "p").alias("q")).collect()]
    assert got == [100, 75, 50, 25, 0]


@pytest.mark.parametrize("cents,dollars,fmt", [(12000050, 120001, "$120,001"), (0, None, None),
                                               (None, None, None), (12000000, 120000, "$120,000")])
def test_money(spark, cents, dollars, fmt):
    df = spark.createDataFrame([(cents,)], "c long")
    r = df.select(M.cents_to_dollars("c").alias("d"), M.format_currency("c").alias("f")).first()
    assert r.d == dollars and r.f == fmt


def test_levels(spark):
    df = spark.createDataFrame([(4999999, None), (5000000, 1.9), (10000000, 2.0), (20000000, 5.0),
                                (1, 10.0)], "t long, y double")
    rows = df.select(L.compensation_range("t").alias("r"), L.experience_level("y").alias("l"),
                     L.experience_bracket("y").alias("b")).collect()
    assert [r.r for r in rows] == ["Entry Level", "Mid Level", "Senior Level", "Executive Level",
                                   "Entry Level"]
    assert [r.l for r in rows] == ["Junior", "Junior", "Mid-Level", "Senior", "Expert"]
    assert [r.b for r in rows] == ["10+ years", "0-2 years", "2-5 years", "5-10 years", "10+ years"]


def test_strict_rules(spark):
    df = spark.createDataFrame([("12.5", "yes", "4/24/2019 11:00"), ("1,000", "Y", "soon"),
                                ("7", "FALSE", "12/1/2020")], "n string, b string, d string")
    rows = df.select(P.strict_money_cents("n").alias("m"), P.strict_boolean("b").alias("b"),
                     P.strict_date("d").alias("d")).collect()
    assert [r.m for r in rows] == [1250, None, 700]
    assert [r.b for r in rows] == [True, None, False]
    assert rows[0].d == dt.datetime(2019, 4, 24) and rows[2].d == dt.datetime(2020, 12, 1)


def test_format_currency_negative_and_half(spark):
    df = spark.createDataFrame([(-250,), (-12345678,), (150,)], "c long")
    got = [r.f for r in df.select(M.format_currency("c").alias("f")).collect()]
    assert got == ["-$3", "-$123,457", "$2"]


def test_gender_gap_formula(spark):
    from wagelens.operators import stats
    df = spark.createDataFrame([("A", 10000000), ("A", 10000000), ("B", 5000000)],
                               "gender string, annual_base_pay long")
    got = {r.gender: r.pay_gap_percentage for r in stats.gender_stats(df).collect()}
    assert got == {"A": 0.0, "B": 50.0}
