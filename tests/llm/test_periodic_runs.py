"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np

from wagelens.llm import periodic_runs
from wagelens.llm.common import mix

from ..conftest import SF_SMALL

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def brute_runs(w):
    """All runs of a list of words, by trying every period at every place."""
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(24, 3 * q) and not any(
                    all(w[x] == w[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_words(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def brute_row(doc_id, text):
    w = brute_words(doc_id, text)
    runs = brute_runs(w)
    gone = {x for s, n, q in runs for x in range(s + q, s + n)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def hashed(w):
    ids = {}
    with np.errstate(over="ignore"):
        return mix(np.array([ids.setdefault(x, len(ids)) for x in w], np.uint64))


def found(texts):
    first = np.cumsum([0] + [len(t) for t in texts])
    with np.errstate(over="ignore"):
        rows = periodic_runs.find_runs(hashed([x for t in texts for x in t]), first)
    out = [[] for _ in texts]
    for of, *run in zip(*(x.tolist() for x in rows)):
        out[of].append(tuple(run))
    return out


def test_runs_by_brute_force():
    rng = random.Random(5)
    texts = [[], ["a"], ["a"] * 23, ["a"] * 24, ["a"] * 100, ["a", "b"] * 12, ["a", "b"] * 12 + ["a"], list("aab" * 30 + "ab" * 30)]
    for _ in range(300):  # few letters: many nested and neighbouring runs, also across the ends of texts
        letters = "abcd"[:rng.randint(1, 4)]
        t = []
        while len(t) < rng.randint(20, 160):
            block = rng.choices(letters, k=rng.randint(1, 30))
            t += (block * rng.randint(1, 6))[:rng.randint(1, 90)]
        texts.append(t)
    got = found(texts)
    for t, runs in zip(texts, got):
        assert runs == brute_runs(t)
    assert sum(map(len, got)) > 200


def test_fibonacci_and_thue_morse_words():
    a, b = "a", "ab"
    while len(b) < 700:
        a, b = b, b + a
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(600))
    for t in (list(b), list(thue)):
        assert found([t])[0] == brute_runs(t)
    assert brute_runs(list(b)) and not brute_runs(list(thue))


def test_long_periods():
    rng = random.Random(6)
    block = [str(rng.random()) for _ in range(5000)]
    t = ["x"] + block * 3 + block[:7] + ["y"]
    assert found([t]) == [[(1, 15007, 5000)]]
    assert found([["x"] + block * 2 + block[:4999]]) == [[]]


def test_time_is_near_linear():
    import time
    spent = []
    for n in (20_000, 40_000, 80_000):
        begin = time.perf_counter()
        assert found([["a", "b", "c"] * n]) == [[(0, 3 * n, 3)]]
        spent.append(time.perf_counter() - begin)
    assert spent[2] < 10 * spent[0] + 0.5


def test_operator_on_odd_tables(spark):
    rows = [(None, None, 1), (1, "", 2), (2, " \t\x0b ", 3), (3, "a " * 30, 4), (3, "a " * 30, 4), (4, "A a " * 40 + "end", 5),
            (5, "é ü\n" * 20, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = {r["doc_id"]: r for r in periodic_runs.collapse_runs(df).collect()}
    assert got[None]["n_words"] == 0 and got[None]["collapsed"] == "" and got[2]["runs"] == []
    assert [tuple(r) for r in got[3]["runs"]] == [(0, 30, 1)] and got[3]["collapsed"] == "a" and got[3]["text"] == "a " * 30
    assert [tuple(r) for r in got[4]["runs"]] == [(0, 80, 2)] and got[4]["collapsed"] == "A a end"
    assert got[5]["collapsed"] == "é ü"
    assert periodic_runs.collapse_runs(df).count() == 7
    assert periodic_runs.collapse_runs(df.limit(0)).count() == 0
    assert periodic_runs.collapse_runs(df.withColumnRenamed("runs", "_text")).count() == 7


def test_query_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    docs = [d for d in docs if len(WORD.findall(d["text"] or "")) < 1500]
    got = {tuple(r) for r in periodic_runs.op13_periodic_runs(spark, SF_SMALL).collect()}
    want = {brute_row(*d) for d in docs}
    assert want <= got and sum(r[1] for r in want) > 3
