"""Findings of round 3, op5: the attention weights are learned from every training document."""

import random

import numpy as np
from pyspark.sql import functions as F

from wagelens.llm import lm_score
from wagelens.llm.language_id import held_out


def test_weights_come_from_all_documents(spark):
    """Texts outside a sample of 1,500 by id differ in the order of their words alone, so all counts agree; the weights must not."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=12))) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(4)
    known = docs.where(~held_out(F.col("doc_id"), lm_score.FOLDS))
    n = known.count()
    beyond = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000)) > int(1_000_000 * 1500 / n) + 1
    turned = docs.withColumn("text", F.when(beyond, F.array_join(F.reverse(F.split("text", " ")), " ")).otherwise(F.col("text")))
    a, b = lm_score.learn(docs)[0], lm_score.learn(turned)[0]
    assert np.array_equal(a.counts, b.counts) and np.array_equal(a.pair_counts, b.pair_counts)
    assert not np.array_equal(a.attention.w["e"], b.attention.w["e"])
    # a window a text of 12 words and a start; each learned from once a pass
    assert a.windows == b.windows == n
    again = lm_score.learn(docs)[0]
    assert np.array_equal(a.attention.w["e"], again.attention.w["e"])


def test_long_texts_are_learned_whole(spark):
    texts = [" ".join(["word"] * k) for k in (0, 1, 31, 32, 300)] + [None]
    docs = spark.createDataFrame([(d, t) for d, t in zip((1, 2, 3, 4, 6, 7), texts)], "doc_id long, text string")
    kept = docs.where(~held_out(F.col("doc_id"), lm_score.FOLDS)).collect()
    want = sum(-(-(len((r["text"] or "").split()) + 1) // lm_score.WINDOW) for r in kept)
    assert lm_score.learn(docs)[0].windows == want


def test_steps_follow_the_slope():
    """A step of the written-out gradient lowers the loss of its own windows."""
    rng = np.random.default_rng(2)
    net = lm_score.Attention(np.full(lm_score.CLASSES, 1 / lm_score.CLASSES))
    x, y = rng.integers(0, lm_score.INPUTS, (16, lm_score.WINDOW)), rng.integers(0, lm_score.CLASSES, (16, lm_score.WINDOW))
    loss = lambda: -net.log10(net.hidden(x)[0].reshape(-1, lm_score.WIDTH), y.ravel()).mean()
    before = loss()
    for _ in range(20):
        net.step(x, y)
    assert loss() < before - 0.1
