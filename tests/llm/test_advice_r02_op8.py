"""Round 2 advice, op8: items copied into many documents, of frequent words, long and short."""

import random

import numpy as np

from wagelens.llm import decontaminate

ITEMS, DOCS = "item_id long, text string", "doc_id long, text string"


def sentence(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(4, 7))) for _ in range(n))


def leaks(spark, docs, items):
    found = decontaminate.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    return sorted((r["doc_id"], r["item_id"]) for r in found)


def test_item_in_many_documents(spark):
    """Copies and near copies in 40 % of the documents, and an item of words that all documents hold."""
    rng = random.Random(21)
    items = [(i, sentence(rng, 16) + ". " + sentence(rng, 4) + ".") for i in range(6)]
    near = items[0][1].split()
    near[3] = "other"
    common = "the of and to in is was for on that by with as at"
    items.append((6, " ".join(rng.sample(common.split(), 14))))
    docs, want = [], []
    for i in range(100):
        text = [sentence(rng, 45), " ".join(rng.sample(common.split(), 14)), sentence(rng, 40)]
        if i < 40:
            text.insert(1, items[0][1] if i % 2 else " ".join(near))
            want.append((i, 0))
        if i == 70:
            text.insert(2, sentence(rng, 5) + " " + items[6][1])
            want.append((i, 6))
        docs.append((i, " ".join(text)))
    got = leaks(spark, docs, items)
    assert [x for x in got if x[1] != 6] == [x for x in want if x[1] != 6]
    assert (70, 6) in got


def test_long_and_short_items(spark):
    rng = random.Random(22)
    long, five = sentence(rng, 400), "Paris is France's largest city"
    items = [(0, long), (1, five), (2, sentence(rng, 30)), (3, None), (4, "")]
    changed = long.split()
    for k in range(0, 400, 9):
        changed[k] = "changed"
    docs = [(i, sentence(rng, 120)) for i in range(20)]
    docs += [(100, f"{sentence(rng, 37)} {long} {sentence(rng, 50)}"), (101, f"{sentence(rng, 20)} {five.upper()} {sentence(rng, 20)}"),
             (102, " ".join(changed)), (103, "Paris is France's very largest city"), (104, " ".join(long.split()[:100]))]
    assert leaks(spark, docs, items) == [(100, 0), (101, 1), (102, 0)]


def test_pieces_cover_an_item():

    for n in (8, 64, 65, 96, 400):
        w = np.arange(n, dtype=np.uint64)
        pieces = decontaminate.pieces_of(w)
        assert set(np.concatenate(pieces).tolist()) == set(range(n)) and all(len(p) <= decontaminate.LONG for p in pieces)


def test_blocks_give_the_leaks_of_one_block(spark, monkeypatch):
    rng = random.Random(23)
    items = [(i, sentence(rng, 24)) for i in range(12)]
    docs = [(i, sentence(rng, 60) + (" " + items[i][1] if i < 12 else "")) for i in range(30)]
    monkeypatch.setattr(decontaminate, "ITEMS", 4)
    assert leaks(spark, docs, items) == [(i, i) for i in range(12)]
    table, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    kept = decontaminate.without_leaks(table, bench)
    assert kept.columns == table.columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(12, 30))
    assert iter(got := decontaminate.build_indexes(table, bench)) is got  # one at a time
