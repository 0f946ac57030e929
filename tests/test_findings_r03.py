"""Round 3 findings: parsing work is done once a value, not again in the filters above it."""

import re

from pyspark.sql import functions as F

from wagelens.schema import RAW_FIELDS
from wagelens.session import computed
from wagelens.sources import survey_csv


def _raw(spark):
    df = spark.createDataFrame([("1", "12k", "5 years"), ("2", "many", "x"), ("3", None, " ")], "id string, annual_base_pay string, y string")
    raw = df.withColumnRenamed("y", "years_experience_industry")
    return raw.select("id", *[F.col(f) if f in raw.columns else F.lit(None).cast("string").alias(f) for f in RAW_FIELDS])


def _filters(df) -> str:
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return "\n".join(line for line in plan.splitlines() if re.search(r"\bFilter\b|Join", line))


def test_bad_rows_are_told_from_parts_computed_once(spark):
    good, bad = survey_csv.skip_bad_rows(_raw(spark))
    assert {r["id"]: list(r["_parse_errors"]) for r in bad.collect()} == {"2": ["annual_base_pay_unparsed", "years_experience_industry_unparsed"]}
    assert sorted(r["id"] for r in good.collect()) == ["1", "3"]
    assert good.columns == _raw(spark).columns and bad.columns == [*good.columns, "_parse_errors"]
    assert "regexp" not in _filters(bad) and "regexp" not in _filters(good)


def test_valid_rows_are_filtered_by_parsed_parts(spark):
    cleaned = survey_csv.keep_valid_rows(survey_csv.clean_survey(_raw(spark), "lineitem", keep=("id",)).where("annual_base_pay > 0"))
    assert [(r["id"], r["annual_base_pay"]) for r in cleaned.collect()] == [("1", 1_200_000)]
    assert "regexp_extract" not in _filters(cleaned)


def test_computed_columns_do_not_move_into_filters(spark):
    df = computed(spark.range(4), F.upper(F.hex("id")).alias("h")).where("h > '1'")
    assert sorted(r["h"] for r in df.collect()) == ["2", "3"] and "hex" not in _filters(df)


def test_snapshots_are_stored_without_a_shuffle(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrame

    from wagelens.streaming import snapshots
    monkeypatch.setattr(DataFrame, "repartition", lambda *a: (_ for _ in ()).throw(AssertionError("rows are shuffled")))
    base = str(tmp_path / "s")
    df = spark.range(0, 100, 1, 3).select(F.col("id").cast("string").alias("id"), (F.col("id") % 7).alias("v"))
    assert snapshots.write_snapshot(df, base, buckets=4) == 1
    assert snapshots.write_snapshot(df.where("id <> '5'").withColumn("v", F.when(F.col("id") == "9", 70).otherwise(F.col("v"))), base, buckets=4) == 2
    got = {(r["operation"], r["id"]) for r in snapshots.capture_snapshot_changes(spark, base).collect()}
    assert got == {("DELETE", "5"), ("UPDATE", "9")}


def test_stems_without_regular_expressions(spark):
    """Ends by comparison give what the regular expressions of the rule give."""
    from wagelens.operators.search import _stem
    t = F.col("t")
    rule = (F.when(F.length(t) <= 3, t).when(t.rlike("ies$"), F.regexp_replace(t, "ies$", "y")).when(t.rlike("(ss|us|is)$"), t)
            .when(t.rlike("ing$") & (F.length(t) > 5), F.regexp_replace(t, "ing$", "")).when(t.rlike("ed$") & (F.length(t) > 4), F.regexp_replace(t, "ed$", ""))
            .when(t.rlike("(ch|sh|x|z)es$"), F.regexp_replace(t, "es$", "")).when(t.rlike("s$"), F.regexp_replace(t, "s$", "")).otherwise(t))
    words = [a + b for a in ("", "a", "ab", "berr", "größ", "日本語") for b in ("", "ies", "ss", "us", "is", "ing", "ed", "ches", "shes", "xes", "zes", "es", "s", "sing", "eds")]
    df = spark.createDataFrame([(w,) for w in [*words, None]], "t string").select("t", _stem(t).alias("got"), rule.alias("want"))
    assert df.where(~F.col("got").eqNullSafe(F.col("want"))).count() == 0
    assert "regexp" not in df.select("got")._jdf.queryExecution().optimizedPlan().toString().lower().replace("rlike", "regexp")


def test_titles_with_and_without_synonyms(spark):
    from wagelens.operators.search import _stem, normalize_title, tokenize
    from wagelens.schema import TITLE_SYNONYMS
    titles = [t for g in TITLE_SYNONYMS for a in g for t in (a.upper(), f"x {a}s", f"{a} lead", f"a{a}")] + ["SMALL blue bolts", "", None]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    s = F.lower("t")
    for group in TITLE_SYNONYMS:
        s = F.regexp_replace(s, r"\b(" + "|".join(re.escape(a) for a in sorted(group[1:], key=len, reverse=True)) + r")\b", group[0])
    want = F.array_join(F.transform(tokenize(s), _stem), " ")
    assert df.where(~normalize_title("t").eqNullSafe(want)).count() == 0
