"""Round 2 advice, op5: pair counts of all tokens, whatever the input is split into, and no pair beyond a table."""

import random

import numpy as np
import pytest

from wagelens.llm import lm_score


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(41)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 12))) for _ in range(80)]
    rows = [(i, " ".join(rng.choices(words, k=60)) + f" odd{rng.getrandbits(30)}") for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string").cache()


def test_pair_counts_are_of_tokens(docs):
    counts = [{r["key"]: r["n"] for r in lm_score.learn(d)[1].where("kind = 1").collect()} for d in (docs.coalesce(1), docs.repartition(7))]
    assert counts[0] == counts[1]
    words = lm_score.learn(docs)[1].where("kind = 0").agg({"n": "sum"}).first()[0]
    assert sum(n for k, n in counts[0].items() if k >> 16 == lm_score.START) == words


def test_scores_do_not_depend_on_the_pair_table(docs):
    model, counts = lm_score.learn(docs)
    # words are looked up in the same table in both runs; only the pair table differs
    model.keys = model.keys[:0]
    want = {r["doc_id"]: r["score"] for r in lm_score.score(docs, model, counts).collect()}
    keep = np.argsort(-model.pair_counts, kind="stable")[:20]
    keep = np.sort(keep)
    model.pair_keys, model.pair_counts, model.more_pairs = model.pair_keys[keep], model.pair_counts[keep], True
    got = {r["doc_id"]: r["score"] for r in lm_score.score(docs, model, counts).collect()}
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-6 for d in want)
