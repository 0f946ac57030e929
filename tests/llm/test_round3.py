"""Round 3: the exact skip of op8, languages without a limit, labels that the pipeline fills in."""

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from wagelens.llm import decontaminate, language_id

from .test_llm import sentence


def test_the_skip_loses_no_candidate(monkeypatch):
    """With and without the test of a passage's length the same leaks are found, also among repeated words."""
    rng = random.Random(31)
    items = [(i, sentence(rng, 30, i % 3) + ". " + sentence(rng, 8, i % 3) + ".") for i in range(20)]
    index = decontaminate.Index(items)
    texts = []
    for i in range(60):
        w = items[i % 20][1].split()
        near = [x if rng.random() < 0.8 else "new%d" % i for x in w]
        texts.append(" ".join(sentence(rng, rng.randint(0, 90), i % 3).split() + near * rng.randint(0, 2) + [w[0]] * rng.randint(0, 20)))
    df = np.array([1 + h % 50 for h in index.features.tolist()])
    index.weigh(df, 60)
    index.decompose(np.zeros(index.omega().shape), 0.0)
    got = decontaminate.leaks_in(index, pa.array(texts))
    projected = []
    plain = decontaminate._near_passages

    def counted(*args):
        for rows, vec, least in plain(*args):
            projected.append(len(rows))
            yield rows, vec, least

    monkeypatch.setattr(decontaminate, "_near_passages", counted)
    assert decontaminate.leaks_in(index, pa.array(texts)) == got
    few = sum(projected)
    projected.clear()
    least = index.beyond.copy()
    # a bound that lets every passage through: no weight of other words in the skip, all of it in the comparison
    class Loose(np.ndarray):
        def min(self, *a, **k):
            return 0.0

    index.beyond = least.view(Loose)
    assert decontaminate.leaks_in(index, pa.array(texts)) == got
    assert sum(projected) > few and len(got) >= 20


def test_more_languages_than_are_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 2)
    rng = random.Random(32)
    rows = [(i, sentence(rng, 30, i % 2), ("xa", "yb")[i % 2]) for i in range(200)] + [(1000 + i, sentence(rng, 5, 2), "odd%d" % i) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language_id.learn(docs)
    assert profiles.langs == ["xa", "yb"]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs.select("doc_id", "text"), profiles).collect()}
    assert all(got[i] == ("xa", "yb")[i % 2] for i in range(200))


def test_pipeline_fills_in_languages(spark):
    rng = random.Random(33)
    rows = [(i, sentence(rng, 30, i % 2), None if i > 150 else ("xa", "yb")[i % 2], "s", 9) for i in range(200)]
    rows += [(500, "123", None, "s", 3), (501, None, "xa", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.identify_language(spark, docs, "")
    assert got.columns == docs.columns
    assert {r["doc_id"]: r["lang"] for r in got.collect()} == {i: ("xa", "yb")[i % 2] for i in range(200)}


def test_sums_of_segments():
    rng = np.random.default_rng(34)
    table = rng.integers(0, 9, (50, 7)).astype(np.float32)
    for sizes in ([1], [3, 1, 200, 64, 65, 2], [70, 80], list(rng.integers(1, 100, 40))):
        row = rng.integers(0, 50, sum(sizes))
        first = np.cumsum([0, *sizes[:-1]])
        want = np.add.reduceat(table[row], first, axis=0)
        assert (decontaminate._sums(table, row, first) == want).all()
