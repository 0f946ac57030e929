"""Search operators against brute force on small data."""

from pyspark.sql import functions as F

from wagelens.operators import search as H
from wagelens.operators import quality as X
from wagelens.plans.catalog import pay

from .conftest import SF_SMALL


def _lev(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def test_fuzzy_matches_brute_force(spark):
    df = pay(spark, SF_SMALL)
    text = "blt gizmoo"
    got = {r.id for r in H.fuzzy_match(df, "job_title", text).collect()}
    terms = H.py_tokens(text)
    want = set()
    for r in df.select("id", "job_title").collect():
        toks = H.py_tokens(r.job_title)
        if any(_lev(t, q) <= H.auto_fuzziness(q) for t in toks for q in terms):
            want.add(r.id)
    assert got == want and got


def test_normalize_title_synonyms(spark):
    df = spark.createDataFrame([("Sr. SWE",), ("Senior Software Engineers",), ("VP of Data Analysts",)],
                               "t string")
    got = [r.n for r in df.select(H.normalize_title("t").alias("n")).collect()]
    assert got[0] == got[1] == "senior software engineer"
    # synonyms run before the stemmer (as in the analyzer chain): "analysts" is no synonym hit
    assert got[2] == "vice president of data analyst"


def test_suggest_prefix_case_insensitive(spark):
    df = pay(spark, SF_SMALL)
    rows = H.suggest(df, "job_title", "SMALL B", 3).collect()
    assert rows and all(r.text.lower().startswith("small b") for r in rows)
    assert [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)


def test_dedupe_keeps_lowest(spark):
    df = spark.createDataFrame([("a", 2, "x", 1), ("a", 1, "x", 2), ("b", 1, "y", 3)],
                               "employer string, row_number int, job_title string, v int")
    out = X.deduplicate(df.withColumn("source_file", F.lit("f")), ["employer", "job_title"])
    got = sorted((r.employer, r.row_number, r.v) for r in out.collect())
    assert got == [("a", 1, 2), ("b", 1, 3)]


def test_validation_report_alerts(spark):
    rep = {r.rule: r for r in X.validation_report(pay(spark, SF_SMALL)).collect()}
    assert rep["pay_negative"].failures == 0
    assert rep["pay_out_of_bounds"].alert in (True, False)
