"""Operators of the training-data pipeline on small tables, against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from wagelens.llm import (chat_format, decontaminate, jaccard_join, language_id, line_dedup, lm_score, mixing, permutation_index,
                          registry, secret_scan, sharding)
from wagelens.llm.common import Words, text_bytes
from wagelens.llm.graph import components

from ..conftest import SF_SMALL

WORD = re.compile(r"[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, score double, copies int, _id int"


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def words(t):
    return WORD.findall(lower(t))


def sentence(rng, n, language=0):
    letters = ("abcdefgh", "ijklmnop", "qrstuvéü")[language]
    return " ".join("".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(n))


def fixture():
    """Nulls, empty and long texts, repeated rows, near copies, ties; extra columns with clashing names."""
    rng = random.Random(1)
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, "One"), (4, "one"), (5, "two words"), (6, "Two  words")]
    rows += [(10 + i, sentence(rng, rng.randint(3, 60), i % 3)) for i in range(40)]
    base = sentence(rng, 80).split()
    for i in range(15):
        w = list(base)
        for _ in range(i // 4):
            w[rng.randrange(len(w))] = "x%d" % rng.randrange(99)
        rows.append((100 + i, " ".join(w)))
    rows += [(200, sentence(rng, 8000)), (100, " ".join(base)), (100, " ".join(base)), (None, " ".join(base)), (None, None), (201, "x" * 5000)]
    return [(d, t, ("xa", "yb", "zc")[(d or 0) % 3] if d and d >= 10 else None, None if (d or 0) % 7 == 0 else "s%d" % ((d or 0) % 4),
             len(t or ""), 1, "a", 0.5, 3, 9) for d, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_words_and_offsets():
    texts = ["Ab c", None, "", "\x0bé x\t", "a"]
    data, off = text_bytes(pa.array(texts))
    with np.errstate(over="ignore"):
        w = Words(data, off)
    assert np.diff(w.first).tolist() == [len(words(t)) for t in texts]
    again, off2 = text_bytes(pa.array(["aB", "c", "a"]))
    with np.errstate(over="ignore"):
        v = Words(again, off2)
    assert v.hash[0] == w.hash[0] and v.hash[2] == w.hash[-1] and v.hash[1] == w.hash[1]


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 8), (8, 9), (5, 5), (None, 4)] + [(50, 51 + i) for i in range(40)] + [(90, 40)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 40: 40, 50: 40, **{51 + i: 40 for i in range(40)}}
    assert components(links.limit(0)).count() == 0


def brute_components(rows, n, num, den):
    sets = {}
    for k, (d, t) in enumerate(rows):
        w = words(t)
        sets[k] = set(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else ({tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    known = [k for k in sets if rows[k][0] is not None]
    for a in known:
        for b in known:
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = collections.defaultdict(list)
    for k in known:
        least[find(k)].append(rows[k][0])
    return sorted((d if d is not None else -1, len(sets[k]), min(least[find(k)]) if d is not None else -1) for k, (d, _) in enumerate(rows))


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 8, 10)])
def test_jaccard_join(docs, n, num, den, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL_BUCKET", 2)  # so that blocks are used on a small table
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"])
                 for r in jaccard_join.jaccard_components(docs, n, num, den).collect())
    assert got == brute_components([(r[0], r[1]) for r in fixture()], n, num, den)


def test_partenum_pairs_share_a_signature():
    rng = np.random.default_rng(0)
    scheme = jaccard_join.PartEnum(8, 10)
    for size in (1, 3, 9, 17, 40, 100, 333, 1000):
        for _ in range(10):
            x = np.unique(rng.integers(0, 2 ** 63, size, dtype=np.uint64))
            y = x
            while True:  # as far as the threshold allows
                z = np.union1d(np.delete(y, rng.integers(len(y))) if rng.random() < 0.5 and len(y) > 1 else y, rng.integers(0, 2 ** 63, 1, dtype=np.uint64))
                if 10 * len(np.intersect1d(x, z)) < 8 * len(np.union1d(x, z)):
                    break
                y = z
            with np.errstate(over="ignore"):
                a, b = (np.concatenate([*scheme.signatures(s), np.zeros(0, np.uint64)]) for s in (x, y))
            assert np.array_equal(x, y) or len(np.intersect1d(a, b))


def test_jaccard_keep_one_and_empty(docs, empty):
    kept = jaccard_join.keep_one(docs, 5, 8, 10)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(100) == 1 and ids.count(None) == 2 and 101 not in ids and 3 in ids and 4 not in ids
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok", None, "", "&lt;|end|>\n", "<|turn|>&amp;&", "x<|start|>user\n", "[/INST]é"]
    rows = [(i % 3 if i % 5 else None, (i // 2) % 4, ("user", "assistant", None, "as[s\n&nl;")[(i * 7 // 3) % 4], texts[i % 7], "x") for i in range(60)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat_format.read_chats(chat_format.format_chats(table)).collect()}
    key = lambda t: tuple((x is not None, x) for x in t)
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1], r[2], r[3]) for r in rows if r[0] == conv), key=key)
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == [(r or "", t or "") for _, r, t in turns]
        assert "".join(s["text"] for s in got[conv]["segments"]) == got[conv]["formatted"]
        assert [chat_format.START in s["text"] for s in got[conv]["segments"] if s["loss"]] == [False] * sum(r == "assistant" for _, r, _ in turns)
    assert chat_format.format_chats(table.limit(0)).count() == 0


def test_language_id(docs, empty):
    profiles = language_id.learn(docs)
    rows = fixture()
    got = language_id.identify(docs, profiles).collect()
    assert len(got) == len(rows) and set(docs.columns) - {"score"} <= set(got[0].asDict())
    for r in got:
        if not re.search(r"[^\W\d_]", r["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in ("xa", "yb", "zc") and 0 <= r["score"] <= 1
    assert language_id.learn(empty).langs == []
    assert {r["lang_pred"] for r in language_id.identify(docs, language_id.Profiles({})).collect()} == {"und"}


def test_out_of_place_distance():
    p = language_id.Profiles({"b": [5, 7], "a": [7, 5]}, most=2)
    assert p.langs == ["a", "b"] and p.place.tolist() == [[1, 0], [0, 1], [-1, -1]]


@pytest.mark.parametrize("query", ["op2_chat_format", "op4_mixing"])
def test_query_against_sql(spark, query):
    from tools.oracle_check import duck, rows_of_duck, rows_of_spark
    assert rows_of_spark(registry.queries()[query](spark, SF_SMALL)) == rows_of_duck(duck(SF_SMALL), registry.oracle_sql()[query])


def fill(sizes):
    """Targets by resharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped = set()
    while True:
        open_ = [s for s in names if s not in capped]
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        target = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_} | {s: 3.0 * sizes[s] for s in capped}
        more = {s for s in open_ if target[s] > 3 * sizes[s] + 1e-9}
        if not more:
            return target
        capped |= more


def test_mixing(spark, docs, empty):
    got = mixing.mix(docs).collect()
    sizes = collections.Counter()
    for r in fixture():
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    target, taken = fill(sizes), collections.Counter()
    assert len(got) == len(fixture())
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] + r["part"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(WORD.findall(r["text"])) for r in mixed.collect()) == sum(taken.values())
    assert mixing.mix(empty).count() == 0


def test_lm_score(spark, docs, empty):
    model, counts = lm_score.learn(docs)
    rows = fixture()
    c = collections.Counter()
    for d, t, *_ in rows:
        if d is not None and zlib.crc32(str(d).encode()) % 10:
            c.update(words(t))
            c[None] += 1
    n, v = sum(c.values()), len(c)
    expected = sorted((-1 if d is None else d, len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), None]),
                       round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words(t), None]), 6)) for d, t, *_ in rows)
    got = lm_score.score(docs, model, counts).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == expected
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)
    nothing, none = lm_score.learn(empty)
    assert lm_score.score(empty, nothing, none).count() == 0
    assert all(np.isfinite(r["score"]) for r in lm_score.score(docs, nothing, none).collect())


def test_attention_is_causal_and_normalised():
    rng = np.random.default_rng(0)
    net = lm_score.Attention(np.full(lm_score.CLASSES, 1 / lm_score.CLASSES))
    x = rng.integers(0, lm_score.INPUTS, (2, lm_score.WINDOW))
    y = x.copy()
    y[:, 20:] = 3
    a, b = net.hidden(x)[0], net.hidden(y)[0]
    assert np.allclose(a[:, :20], b[:, :20], atol=1e-5) and not np.allclose(a[:, 20:], b[:, 20:])
    total = sum(10 ** net.log10(a[0, :1], np.array([k]))[0] for k in range(lm_score.CLASSES))
    assert math.isclose(total, 1, rel_tol=1e-5)
    for sizes in ([1], [32, 33, 7, 200]):
        places, _, scored = lm_score.windows(np.array(sizes))
        assert sorted(places[scored]) == list(range(sum(sizes)))  # each place once


def test_word_probabilities_do_not_exceed_one():
    sub = lm_score.Subwords(lm_score.VOCABULARY)
    data, off = text_bytes(pa.array(["aa ab ba aa aa q"]))
    with np.errstate(over="ignore"):
        c = lm_score.Chunk(data, off)
        lead, _ = sub.step(c.start, c.end, c.eight)
        totals = collections.Counter()
        for i, k in zip(lead.tolist(), c.count.tolist()):
            totals[i] += k
        model = lm_score.Model(sub, (c.hash, c.count, lead), (np.zeros(0, np.uint64), np.zeros(0, np.int64), None), totals, {}, {}, 6, 4, 1)
        _, cls, log, _ = model.words(c)
    share = collections.Counter()
    for k, p in zip(cls, 10 ** log):
        share[int(k)] += p
    assert all(0 < s <= 1 for s in share.values())


def test_line_dedup(spark, empty):
    rng = random.Random(3)
    a, b = sentence(rng, 30), sentence(rng, 25)
    near = a[:-4] + "zzzz"
    rows = [(1, f"{a}\n\n{b}\nshort"), (2, f"{near}\nshort\n{sentence(rng, 20)}"), (3, None), (4, ""), (5, f"{b}\n{a}"), (5, f"{b}\n{a}"), (None, "short"), (6, "é\n \né")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((r["n_lines"], r["n_kept"], r["dropped"]))
    # nulls come first in the order of documents
    assert by[None] == [(1, 1, [])] and by[1] == [(4, 3, [3])] and by[2] == [(3, 1, [0, 1])] and by[3] == [(0, 0, [])]
    assert by[4] == [(1, 1, [])] and sorted(by[5]) == [(2, 0, [0, 1])] * 2 and by[6] == [(3, 2, [2])]
    assert line_dedup.dedup_lines(empty).count() == 0


def test_sharding(spark, docs, empty):
    rows = docs.select("doc_id", "text")
    got = sharding.shuffle_to_shards(rows, 8).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sorted(((r["doc_id"] is None, r["doc_id"], r["text"] or "") for r in got)) == sorted((r[0] is None, r[0], r[1] or "") for r in fixture())
    assert sharding.shuffle_to_shards(rows.limit(0)).count() == 0


def test_communication_matrix():
    m = sharding.communication_matrix([5, 0, 12, 3], [5, 5, 5, 5], 1)
    assert [sum(r) for r in m] == [5, 0, 12, 3] and [sum(c) for c in zip(*m)] == [5, 5, 5, 5]
    rng = np.random.default_rng(2)
    draws = [sharding.hypergeometric(30, 70, 20, u) for u in rng.random(4000)]
    assert abs(np.mean(draws) - 6) < 0.1 and abs(np.var(draws) - 20 * 0.3 * 0.7 * 80 / 99) < 0.25
    assert abs(sharding.hypergeometric(10 ** 12, 10 ** 12, 10 ** 11, 0.5) - 5 * 10 ** 10) < 10 ** 6


def test_decontamination(spark, empty):
    rng = random.Random(4)
    items = [(i, sentence(rng, 30, i % 3) + ". " + sentence(rng, 8, i % 3) + ".") for i in range(12)] + [(90, None), (91, "too short")]
    w = items[1][1].split()
    rows = [(i, sentence(rng, 200, i % 3)) for i in range(40)]
    rows += [(100, sentence(rng, 50) + " " + items[0][1].upper() + " " + sentence(rng, 50)), (101, " ".join(w[:10] + ["new"] + w[10:20] + w[22:])),
             (102, None), (103, ""), (100, items[2][1]), (None, items[3][1]), (104, " ".join(w[:8])), (105, "Too  short"),
             (106, "a line too short for all")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(table, bench).collect()}
    assert got == {(100, 0), (101, 1), (100, 2), (None, 3), (105, 91)}
    assert sorted(r["doc_id"] for r in decontaminate.without_leaks(table, bench).collect()) == [*range(40), 102, 103, 104, 106]
    assert decontaminate.find_leaks(table, bench.limit(0)).count() == 0 and decontaminate.find_leaks(table.limit(0), bench).count() == 0


def test_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = rng.integers(0, 4, rng.integers(1, 20)), rng.integers(0, 4, rng.integers(0, 30))
        grid = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                grid[i + 1, j + 1] = grid[i, j] + 1 if a[i] == b[j] else max(grid[i, j + 1], grid[i + 1, j])
        assert decontaminate.common_subsequence(a, b) == grid[-1, -1]


def test_secret_scan(spark, empty):
    rng = random.Random(5)
    rows = [(0, None), (1, ""), (2, "PassWord: 'abc' token=token:abcdefgh12"), (3, "é api_key = \"0123456789abcdef0123456789abcdef01\" AKIAABCDEFGHIJKL12")]
    rows += [(10 + i, f"{sentence(rng, 20)} password={rng.getrandbits(80):020x} {sentence(rng, 5)} order-{rng.getrandbits(60)}-{rng.getrandbits(20)}") for i in range(60)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    got = {r["doc_id"]: r for r in secret_scan.scan(table, secret_scan.train(table)).collect()}
    for d, t in rows:
        t = t or ""
        base = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m.group(2)) >= 8]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 16]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 32]
        said = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(base))
        assert [got[d][c] for c in ("n_assign", "n_access", "n_hex")] == [sum(k == i for _, k, _ in base) for i in range(3)]
        assert got[d]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(got[d]["spans"].split(","))
    assert got[2]["n_assign"] == 0  # the short match was consumed
    assert secret_scan.train(empty) is None and secret_scan.scan(empty, None).count() == 0


def test_secret_network_learns():
    rng = random.Random(6)
    pos = [f"{sentence(rng, 4)} key={rng.getrandbits(90):x} {sentence(rng, 3)}" for _ in range(80)]
    neg = [f"{sentence(rng, 4)} {'-'.join(sentence(rng, 4).split())}-abcdabcdabcd {sentence(rng, 3)}" for _ in range(80)]
    x = np.array([secret_scan.windows_of(t, *secret_scan.candidates_of(t)[0])[0] for t in pos + neg])
    y = np.array([1] * 80 + [0] * 80)
    net = secret_scan.CharNet()
    net.fit(x[::2], y[::2])
    net.calibrate(x[1::2], y[1::2])
    p = net.probability(x[1::2])
    assert (p[:40] >= net.threshold).mean() >= secret_scan.RECALL and (p[40:] < net.threshold).mean() >= 0.9


def test_nearest(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x[:300] = x[7]  # equal vectors
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    rows += [(3100, None, 1), (3200, [], 1), (3300, [0.0] * 24, 1), (3400, [float("nan")] * 24, 1), (3500, [None] + [1.0] * 23, 1), (None, rows[0][1], 1),
             (5, rows[5][1], 1), (4000, [1.0, 2.0], 1), (4001, [1.0, 3.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    from pyspark.sql import functions as F
    got = collections.defaultdict(list)
    for r in permutation_index.nearest(table, F.col("id") % 100 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == [*range(0, 3000, 100), 4000] and [v for _, v, _ in got[4000]] == [4001]
    assert [v for _, v, _ in sorted(got[100])] == list(range(10)) and all(s == 0 for _, _, s in got[100])
    full = x.astype(np.float64)
    hits = 0
    for q in range(300, 3000, 100):
        d = np.sqrt(((full - full[q]) ** 2).sum(1))
        d[q] = np.inf
        own = sorted(got[q])
        assert [r for r, _, _ in own] == list(range(1, 11)) and all(math.isclose(s, d[v]) for _, v, s in own)
        hits += len({v for _, v, _ in own} & set(np.lexsort((np.arange(3000), d))[:10].tolist()))
    assert hits / 270 >= 0.9
    assert permutation_index.nearest(table.limit(0), F.col("id") % 100 == 0).count() == 0


def test_pipeline_stages(spark, docs, empty):
    import corpus_pipeline as P
    left, right = docs, empty
    for name, stage in P.STAGES:
        left, right = stage(spark, left, SF_SMALL), stage(spark, right, SF_SMALL)
        assert right.count() == 0
        if name != P.STAGES[-1][0]:
            assert left.columns == docs.columns
    assert left.count() > 0 and {"shard", "slot"} <= set(left.columns)


def test_registered():
    import __spark_entry__ as E
    names = set(E.queries())
    assert {f"op{n}_" for n in range(1, 14)} == {re.match(r"op\d+_", n).group() for n in names if n.startswith("op")} and "pipeline" in names


def near_line_components(lines):
    """Brute force: components of distinct lines by 5-character shingles, similarity 0.8."""
    def cut(t):
        return {t[i:i + 5] for i in range(len(t) - 4)} or {t}
    lines = sorted(set(lines))
    sets = [cut(t) for t in lines]
    root = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return {t: root[i] for i, t in enumerate(lines)}


@pytest.mark.parametrize("small", [8, 1])
def test_line_components(spark, monkeypatch, small):
    """Against brute force: families of near lines, short and non-Latin lines, and large buckets by blocks."""
    monkeypatch.setattr(line_dedup, "SMALL_BUCKET", small)
    monkeypatch.setattr(line_dedup, "BLOCK", 4)
    rng = random.Random(5)
    lines = ["a", "ab", "abcd", "abcde", "日本語のとても長い行です。東京", "日本語のとても長い行です。東京!", "x" * 40, "x" * 41]
    for i in range(12):
        w = sentence(rng, 40, i % 3).split()
        for _ in range(14):
            v = list(w)
            for _ in range(rng.randint(0, 3)):
                v[rng.randrange(len(v))] = sentence(rng, 1, i % 3)
            lines.append(" ".join(v))
    rng.shuffle(lines)
    rows = [(i, "\n".join(lines[i::30])) for i in range(30)]
    component = near_line_components(lines)
    first = {}
    for i, text in rows:
        for n, t in enumerate(text.split("\n")):
            first.setdefault(component[t], (i, n))
    want = {i: [n for n, t in enumerate(text.split("\n")) if first[component[t]] != (i, n)] for i, text in rows}
    got = {r["doc_id"]: list(r["dropped"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
