"""Phrase mining against brute force."""

import collections
import random
import re

import duckdb
import numpy as np
import pyarrow as pa

from wagelens.llm import phrases

from ..conftest import SF_MID


def brute(rows, least, top):
    """(lang, rank, phrase, a, l, r, n, score) by counting every phrase."""
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    inside = collections.Counter()
    for (lang, w), a in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i:i + k]] = max(a, inside[lang, w[i:i + k]])
    out = collections.defaultdict(list)
    for (lang, w), a in candidates.items():
        if 100 * inside[lang, w] >= 80 * a:
            continue
        score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -score) for lang, found in out.items()
                  for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1))


def some_rows():
    rng = random.Random(3)
    vocabulary = ["the", "The", "of", "New", "york", "é", "ünd", "zz", "q\x00", "\x1f", "a-b", " "]
    rows = [(None, "en"), ("", "en"), (" \t\n.,", None), ("one", None), (None, None), ("new york " * 3000, "en"), ("x" * 3000, "fr")]
    for _ in range(400):
        words = rng.choices(vocabulary, weights=[9, 3, 5, 4, 4, 2, 2, 1, 1, 1, 1, 1], k=rng.randint(0, 60))
        rows.append(("".join(w + rng.choice((" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", ":")) for w in words),
                     rng.choice(("en", "en", "fr", "und", None))))
    return rows + rows[50:60] * 5


def test_phrases_by_brute_force(spark):
    rows = some_rows()
    df = spark.createDataFrame([(i, t, g, 1, "x", 2.0) for i, (t, g) in enumerate(rows)],
                               "doc_id long, text string, lang string, n long, phrase string, score double").repartition(5)
    for least, top in ((30, 2000), (4, 50)):
        got = sorted(tuple(r) for r in phrases.collocations(phrases.count_phrases(df, least), top).collect())
        assert got == brute(rows, least, top) and len({r[0] for r in got}) == 3
    assert phrases.collocations(phrases.count_phrases(df.limit(0))).count() == 0


def test_exact_counts_and_scores_past_64_bits(spark):
    big = 10 ** 15
    counts = spark.createDataFrame(
        [("en", 0, "", 9 * big), ("en", 1, "a", 4 * big + 1), ("en", 1, "b", 3 * big), ("en", 1, "c", 5 * big), ("en", 2, "a b", 3 * big - 1),
         ("en", 2, "b c", 2 * big), ("en", 3, "a b c", 2 * big - 7)], "lang string, words int, phrase string, n long")
    got = {r["phrase"]: r for r in phrases.collocations(counts).collect()}
    assert "b c" not in got and got["a b"]["score"] == 2_000_000 * (3 * big - 1) // (7 * big + 1)
    assert (got["a b c"]["l"], got["a b c"]["r"]) == (3 * big - 1, 5 * big)


def test_summary_keeps_every_frequent_key():
    rng = np.random.default_rng(4)
    for capacity in (700, 50):  # over mass / least, and far below it
        keys = np.concatenate([rng.integers(0, 20_000, 20_000), np.repeat(np.arange(50, 150), 31)]).astype(np.uint64)
        rng.shuffle(keys)
        summary = phrases.Summary(30, capacity)
        for part in np.array_split(keys, 40):
            summary.add(*phrases.added(part, np.ones(len(part), np.int64)))
        want = {k for k, n in collections.Counter(keys.tolist()).items() if n >= 30}
        left = set(summary.survivors().tolist())
        assert want <= left and summary.taken < 30
        if capacity == 700:
            assert len(summary.keys) <= 1400 and len(left) < 2000


def test_bitmap_holds_what_was_put_in(spark):
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 2 ** 64, 5000, dtype=np.uint64)
    run = phrases.summarised(1, 100_000)
    batch = pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.ones(5000, np.int64))], names=["key", "n"])
    places = spark.createDataFrame(pa.Table.from_batches(list(run(iter([batch])))))
    with np.errstate(over="ignore"):
        known = phrases.Survivors.of(places)
        assert known.holds(keys).all()
        assert known.holds(rng.integers(0, 2 ** 64, 20_000, dtype=np.uint64)).sum() < 5


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_MID}/documents.parquet')")
    want = sorted(con.execute(phrases.OP11_SQL).fetchall())
    assert sorted(tuple(r) for r in phrases.op11_phrase_collocations(spark, SF_MID).collect()) == want
