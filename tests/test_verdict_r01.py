"""Faults that were found by probing: identity, ranges, order of events, signs."""

import pytest
from pyspark.sql import functions as F

from wagelens import session
from wagelens.operators import quality
from wagelens.operators.percentiles import grouped_percentiles, value_histogram
from wagelens.sources import survey_csv as S
from wagelens.streaming import changes as CH


def test_rows_are_numbered_before_any_is_dropped(spark, tmp_path):
    folder = tmp_path / "salary_survey-3.csv"
    folder.mkdir()
    head = "Timestamp,Employer,Location,Job Title,Years of Experience,Years at Employer,Annual Base Pay,Signing Bonus,Annual Bonus,Annual Stock Value/Bonus,Gender,Additional Comments\n"
    row = "4/24/2019,A,B,%s,1,1,%s,,,,,\n"
    (folder / "a.csv").write_text(head + row % ("", "") + row % ("x", 10) + row % ("", "") + row % ("x", 30) + row % ("y", 40))
    (folder / "b.csv").write_text(head + row % ("x", 60) + row % ("x", 70) + row % ("", "") + row % ("x", 90))
    kept, _ = S.load_survey(spark, str(folder), "salary_survey-3.csv")
    rows = S.assign_id(kept).select("row_number", "annual_base_pay", "id").collect()
    assert sorted((r[0], r[1]) for r in rows) == [(2, 1000), (4, 3000), (5, 4000), (6, 6000), (7, 7000), (9, 9000)]
    assert len({r[2] for r in rows}) == len(rows)


def test_one_bad_row_does_not_end_the_load(spark):
    cols = "annual_base_pay long, years_experience_industry double, actual_hours_per_week double, source_file string, row_number long, annual_vacation_weeks double, required_hours_per_week double"
    df = spark.createDataFrame([(1, 1.0, 40.0, "f", 1, 99999999999.0, 40.0), (1, 1.0, 40.0, "f", 2, 3.0, 40.0)], cols)
    ok, bad = S.check_constraints(df)
    assert [r["reasons"] for r in bad.collect()] == [["annual_vacation_weeks_out_of_range"]]
    assert [r["row_number"] for r in S.to_table_schema(S.assign_id(ok)).collect()] == [2]
    assert S.to_table_schema(S.assign_id(df)).where("annual_vacation_weeks IS NULL").count() == 1
    from wagelens.functions import parse as P
    assert spark.createDataFrame([("9" * 20,)], "x string").select(P.strict_money_cents(F.col("x"))).first()[0] is None


def test_percentiles_of_negative_and_large_values(spark):
    rows = [("a", v) for v in (-100, 100, 200, 300, 400)] + [("b", v) for v in (-5, -3)] + [("c", 2 ** 50), ("c", 2 ** 50 + 2)]
    df = spark.createDataFrame(rows, "k string, v long")
    groups = df.groupBy("k").agg(F.count("*").alias("_n"))
    got = {r["k"]: r["m"] for r in grouped_percentiles(value_histogram(df, ["k"], F.col("v")), groups, ["k"], (0.5,), ("m",)).collect()}
    assert got == {"a": 200.0, "b": -4.0, "c": float(2 ** 50 + 1)}


def _events(spark, rows):
    rows = [(*r[:3], r[3] and (*r[3], None, None, None)) for r in rows]
    return spark.createDataFrame(rows, "seq long, operation string, id string, data struct<id:string,annual_base_pay:long,annual_bonus:long,stock_value:long,years_experience_industry:double>")


def test_an_older_event_leaves_the_stored_row_whole(spark):
    target = spark.createDataFrame([("u1", 10, 100, "Acme"), ("u2", 1, 5, "B")], "id string, seq long, annual_base_pay long, employer string")
    got = CH.apply_changes(target, _events(spark, [(6, "UPDATE", "u1", ("u1", 7)), (2, "UPDATE", "u2", ("u2", 9))]), enrich=False)
    assert sorted(tuple(r) for r in got.select("id", "seq", "annual_base_pay", "employer").collect()) == [("u1", 10, 100, "Acme"), ("u2", 2, 9, "B")]


def test_a_late_upsert_does_not_undo_a_delete(spark, tmp_path):
    base = str(tmp_path / "t")
    fn = CH.versioned_upsert(base)
    fn(_events(spark, [(1, "INSERT", "a", ("a", 1)), (2, "INSERT", "b", ("b", 2)), (9, "DELETE", "a", None)]), 0)
    fn(_events(spark, [(5, "UPDATE", "a", ("a", 50)), (6, "UPDATE", "b", ("b", 60))]), 1)
    assert [(r["id"], r["annual_base_pay"]) for r in CH.current_state(spark, base).collect()] == [("b", 60)]


def test_changes_after_an_upsert_apply(spark):
    target = spark.createDataFrame([("u1", 3, 100)], "id string, seq long, annual_base_pay long")
    after = CH.upsert_document(target, spark.createDataFrame([("u1", 5)], "id string, annual_base_pay long"))
    assert after.first()["annual_base_pay"] == 5
    later = CH.apply_changes(after, _events(spark, [(6, "UPDATE", "u1", ("u1", 77))]), enrich=False)
    assert later.first()["annual_base_pay"] == 77


@pytest.mark.parametrize("title,category,seniority", [
    ("Recruiter", "Other", "Mid"), ("Guide", "Other", "Mid"), ("Building Inspector", "Other", "Mid"), ("Doctor", "Other", "Mid"),
    ("International Sales Manager", "Management", "Mid"), ("Senior Software Engineer", "Engineering", "Senior"), ("UI Designer", "Design", "Mid"),
    ("Data Science Intern", "Data", "Intern"), ("CTO", "Management", "Executive"), ("Sr. Developer", "Engineering", "Senior")])
def test_title_labels(spark, title, category, seniority):
    df = spark.createDataFrame([(title,)], "t string")
    got = quality.build_job_titles(df.withColumnRenamed("t", "job_title")).first()
    assert (got["category"], got["seniority_level"]) == (category, seniority)


def test_no_shared_folder_is_an_error_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return type("C", (), {"get": lambda self, k, d=None: d})()

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": lambda self, k: None})()

    with pytest.raises(ValueError):
        session.checkpoint_dir(Session())
