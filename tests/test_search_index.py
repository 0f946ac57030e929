"""Token tables: ranked and fuzzy search against brute force."""

import math
import random

import pytest

from wagelens.operators import search, search_index as S
from wagelens.plans.catalog import pay, pay_index

from .conftest import SF_SMALL
from .test_search import _lev


@pytest.fixture(scope="module")
def titles(spark):
    return spark.createDataFrame(
        [(1, "Acme", "Software Engineers", "Rome"), (2, "Acme", "SWE", "Rome"), (3, "Acme", "Sr. Developer II", "Oslo"), (4, "Bolt", "lead programmer", "Oslo"),
         (5, "Bolt", "Data Analyst", None), (6, None, None, None), (7, "Acme", "Entry-Level coder", "Rome"), (8, "Acme", "product owners", "Rome"),
         (9, "Engineer Ltd", "Vice President, Products", "Rome"), (10, "", "VP", "")],
        "id long, employer string, job_title string, location string")


def test_title_analyzer(spark, titles):
    got = {r["id"]: r["t"] for r in titles.select("id", search.title_tokens("job_title").alias("t")).collect()}
    assert got[1] == ["software", "engineer"] == got[2]
    assert got[3] == ["senior", "software", "engineer", "ii"]
    assert got[4] == ["senior", "software", "engineer"]
    assert got[5] == ["data", "scientist"] and got[6] is None
    assert got[7] == ["junior", "software", "engineer"]
    assert got[8] == ["product", "owner"]  # the phrase is "product owner": synonyms come before stems
    assert got[9] == ["vice", "president", "product"] and got[10] == ["vice", "president"]


def test_longest_phrase_wins(spark):
    rows = spark.createDataFrame([("product manager manager",), ("head of analyst",), ("pm pm mgr",), ("data  analyst-analyst",), ("#1# sr",)], "t string")
    got = [r["n"] for r in rows.select(search.title_tokens("t").alias("n")).collect()]
    assert got == [["product", "manager", "manager"], ["director", "of", "data", "scientist"], ["product", "manager", "product", "manager", "manager"],
                   ["data", "scientist", "data", "scientist"], ["1", "senior"]]


@pytest.fixture(scope="module")
def index(spark, titles, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "t")
    S.write_index(titles, path)
    return path


def test_synonyms_find_each_other(spark, index):
    found = lambda q: {r["id"] for r in S.search(spark, index, q).collect()}
    assert found("swe") == {1, 2, 3, 4, 7} == found("software engineers") - {9}
    assert found("sr") == {3, 4} and found("engineer") == {1, 2, 3, 4, 7, 9}
    assert found("") == set() == found("zzz") and found("oslo") == {3, 4}


def test_scores_by_brute_force(spark, titles, index):
    docs = {}
    for r in titles.select("id", *[S.field_terms(f, a).alias(f) for f, a in S.PAY_FIELDS.items()]).collect():
        docs[r["id"]] = [t for f in S.PAY_FIELDS for t in r[f]]
    average = sum(map(len, docs.values())) / len(docs)
    wanted = {f"{a}:{t}" for a in ("standard", "title") for t in S.analysed(spark, "senior swe acme", a)}
    want = {}
    for doc, terms in docs.items():
        score = 0.0
        for t in wanted & set(terms):
            df, tf = sum(t in d for d in docs.values()), terms.count(t)
            score += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(terms) / average))
        if wanted & set(terms):
            want[doc] = pytest.approx(score, abs=1e-4)
    got = S.search(spark, index, "senior swe acme").collect()
    assert {r["id"]: r["score"] for r in got} == want
    assert [(-r["score"], r["id"]) for r in got] == sorted((-r["score"], r["id"]) for r in got)


def test_filter_keeps_the_statistics(spark, titles, index):
    whole = {r["id"]: r["score"] for r in S.search(spark, index, "swe rome").collect()}
    some = {r["id"]: r["score"] for r in S.search(spark, index, "swe rome", allowed=titles.where("id < 3")).collect()}
    assert some == {k: v for k, v in whole.items() if k < 3} and some


def test_query_reads_its_partitions_only(spark):
    path = pay_index(spark, SF_SMALL)
    df = S.search(spark, path, "bolt")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan or "PartitionFilters: [bucket" in plan
    assert "job_title" not in plan and "documents" not in plan


def test_segments_agree_with_their_expression(spark):
    tokens = ["a", "ab", "abc", "abcd", "abcdefg", "épée", "x" * 30]
    rows = spark.createDataFrame([(t,) for t in tokens], "token string").select("token", S.segment_signatures(S.F.col("token")).alias("s")).collect()
    for r in rows:
        n = len(r["token"])
        assert sorted(r["s"]) == sorted(f"{k}:{n}:{i}:{text}" for k in range(3) if n >= k + 1 for i, _, text in S.segments(r["token"], k))


def test_near_tokens_by_brute_force():
    rng = random.Random(2)
    for _ in range(4000):  # every token within the distance of a term shares a signature with it
        term = "".join(rng.choices("abc", k=rng.randint(1, 12)))
        token = list(term)
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(token))
            if rng.random() < 0.5:
                token[at:at + 1] = rng.choice(["", "a", "b"])
            else:
                token.insert(at, rng.choice("abc"))
        token = "".join(token)
        edits = search.auto_fuzziness(term)
        if token and _lev(token, term) <= edits:
            own = {f"{k}:{len(token)}:{i}:{t}" for k in range(3) if len(token) > k for i, _, t in S.segments(token, k)}
            assert own & set(S.term_signatures(term)), (term, token)


@pytest.mark.parametrize("literals", [5000, 0])
def test_fuzzy_fields_by_brute_force(spark, titles, index, monkeypatch, literals):
    monkeypatch.setattr(search, "LITERALS", literals)
    tokens = {f: {r["id"]: r["t"] or [] for r in titles.select("id", S.ANALYZERS[a](f).alias("t")).collect()} for f, a in S.PAY_FIELDS.items()}
    for texts in ({"employer": "acne", "job_title": "developr programer", "location": "romee"}, {"job_title": "swee"}, {"job_title": "vp"},
                  {"location": "osl rom"}, {"employer": "..."}, {"employer": "bol", "job_title": "sr"}):
        want = {r["id"] for r in titles.collect()}
        for f, text in texts.items():
            terms = S.analysed(spark, text, S.PAY_FIELDS[f])
            want &= {i for i, ts in tokens[f].items() if any(_lev(t, q) <= search.auto_fuzziness(q) for t in ts for q in terms)}
        got = S.fuzzy_match_fields(titles, index, texts)
        assert {r["id"] for r in got.collect()} == want
        assert got.columns == titles.columns


def test_fuzzy_match_does_not_shuffle_rows(spark):
    df = pay(spark, SF_SMALL)
    plan = search.fuzzy_match(df, "job_title", "blt gizmoo")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("FileScan") == 1
    both = S.fuzzy_match_fields(df, pay_index(spark, SF_SMALL), {"job_title": "blt", "location": "13"})
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
