"""Findings of round 3, token tables: postings are counted within their rows and not shuffled."""

import collections
import math

import pytest

from wagelens.operators import search_index as S

FIELDS = {"text": "standard"}


def test_postings_are_not_shuffled(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"a b a w{i}") for i in range(50)], "id long, text string")
    S.write_index(rows, str(tmp_path / "t"), fields=FIELDS)
    lists = spark.read.parquet(str(tmp_path / "t" / "rows"))
    plan = S.row_postings(lists.select("row", "key", "dl", lists.f0.alias("terms")), None)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    postings = spark.read.parquet(str(tmp_path / "t" / "postings"))
    assert set(postings.columns) == {"bucket", "term", "row", "tf", "dl"}
    assert collections.Counter((r["term"], r["tf"]) for r in postings.collect())[("standard:a", 2)] == 50


@pytest.mark.parametrize("key", ["string", "long"])
def test_repeated_and_null_keys(spark, tmp_path, key):
    """Rows of one key and one length count as one, as where they met in a shuffle; the scores of a key add up."""
    texts = [(1, "a b a"), (1, "a b a"), (1, "a c"), (None, "a b"), (None, "c a"), (None, None), (2, "b"), (3, ""), (4, "a"), (2, None), (5, "é É x")]
    rows = spark.createDataFrame([(k if k is None or key == "long" else str(k), t) for k, t in texts], f"id {key}, text string").repartition(3)
    S.write_index(rows, str(tmp_path / "t"), fields=FIELDS)
    tf = collections.Counter()
    for k, t in texts:
        for w in (t or "").lower().split():
            tf[(k, len(t.split()), w)] += 1
    average = sum(len((t or "").split()) for _, t in texts) / len(texts)
    df = collections.Counter(w for _, _, w in tf)
    want = collections.Counter()
    for (k, dl, w), n in tf.items():
        if w in ("a", "b", "é"):
            want[k] += math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * dl / average))
    got = S.search(spark, str(tmp_path / "t"), "a b é", analyzers=("standard",)).collect()
    assert {r["id"] if key == "long" or r["id"] is None else int(r["id"]): r["score"] for r in got} == {k: pytest.approx(v, abs=1e-4) for k, v in want.items()}
    allowed = rows.where("id = 1")
    some = S.search(spark, str(tmp_path / "t"), "a b", analyzers=("standard",), allowed=allowed).collect()
    assert [str(r["id"]) for r in some] == ["1"]
