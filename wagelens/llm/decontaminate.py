"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of ``2 * STEP`` words at every ``STEP``-th word of a
document.  A passage and a benchmark item are TF-IDF vectors over the words of
the benchmark; document frequencies are counted over all documents, and every
word keeps a weight of at least ``LEAST_IDF``, however frequent.  An item of
more than ``LONG`` words is cut into pieces of a passage's width, and any piece
makes it a candidate.  A randomised SVD of passages
(distributed: each task adds up A'(A*omega) over the passages of all its
documents, and all pieces are added, with equal norms) gives the latent space,
with rank enough for every piece of a block.  Passages whose cosine to a
piece reaches ``COSINE`` are candidates; words beyond the benchmark weigh no
more there than the piece's own words do, so that frequent words are not
drowned.  A passage too short in that space to reach any piece is not projected.
Beside this, every place where all words of an item stand in a row
is found by hash.  A candidate is a leak when the longest
common subsequence of item and neighbourhood covers ``LCS`` of the item's
words; below ``SURE`` the item's answer (its last sentence) must be covered by
half as well, which tells a paraphrase from a text on the same matter.

The benchmark is read in blocks of about ``ITEMS`` pieces; of several blocks, one
index is held at a time, and its leaks are written before the next is built.

Defined cases: null text has no words; items under ``LEAST_WORDS`` words match
where all their words stand in a row, those under ``LEAST_INSIDE`` words only a
text that has no other words, and items without words match nothing; repeated items and rows are reported
each; null ids are kept; an empty table on either side gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, chunks_of, mix, released, shared, small_batches, table, text_bytes

STEP = 16
LEAST_IDF = 0.05
EXTRA_RANK = 32
COSINE, LCS, SURE, ANSWER = 0.35, 0.6, 0.8, 0.5
LEAST_WORDS, LEAST_INSIDE = 8, 3
#: words of an item that is one piece; a longer one is cut into pieces of 2 * STEP words
LONG = 4 * STEP
#: pieces of a block of items
ITEMS = 512
#: parts of the sketch that one task adds up
FAN_IN = 32
#: share of the items beside all passages in the decomposition, and the least weight of an item: in proportion
#: to the passages, so that at every size nearly all of every item stays in the latent space
ITEM_SHARE, ITEM_WEIGHT = 6.0, 32.0

_ODD = [np.uint64(int(x) | 1) for x in mix(np.arange(51, 51 + LEAST_WORDS, dtype=np.uint64))]


def _words_of(texts: list[str]) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        data, off = text_bytes(pa.array(texts, pa.string()))
        w = Words(data, off)
    return [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:])]


def answer_of(text: str) -> str:
    """The last sentence of an item."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if p]
    return parts[-1] if parts else ""


def masks_of(pattern: np.ndarray) -> dict[int, int]:
    """The places of each word of a pattern as bits."""
    at: dict[int, int] = {}
    for i, w in enumerate(pattern.tolist()):
        at[w] = at.get(w, 0) | (1 << i)
    return at


def common_subsequence(pattern: np.ndarray, text: np.ndarray, at: dict[int, int] | None = None, least: float = 0.0) -> int:
    """Length of the longest common subsequence (bit-parallel, one step a word of the pattern).

    ``at``: ``masks_of(pattern)``.  Where it cannot reach ``least``, the number of the pattern's words that the text has.
    """
    masks = [m for m in map((masks_of(pattern) if at is None else at).get, text.tolist()) if m]
    most = reduce(or_, masks, 0).bit_count()
    if most < least:
        return most
    full = (1 << len(pattern)) - 1
    v = full
    for m in masks:
        u = v & m
        v = ((v + u) | (v - u)) & full
    return len(pattern) - v.bit_count()


class Lookup:
    """Places in a sorted array of distinct hashes, found by their leading bits."""

    def __init__(self, keys: np.ndarray):
        bits = min(20, len(keys).bit_length() + 4)
        self.keys, self.shift = keys, np.uint64(64 - bits)
        self.first = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.ended = np.append(keys, np.uint64(2 ** 64 - 1))

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash; -1 where it is no key."""
        at = self.first[h >> self.shift]
        found = self.ended[at]
        behind = np.flatnonzero(found < h)
        while len(behind):  # as often as keys share their leading bits
            at[behind] += 1
            found[behind] = self.ended[at[behind]]
            behind = behind[found[behind] < h[behind]]
        return np.where((found == h) & (at < len(self.keys)), at, -1)


class Index:
    """One block of benchmark items and its latent space."""

    def __init__(self, items: list[tuple]):
        words = _words_of([t or "" for _, t in items])
        used = [i for i, w in enumerate(words) if len(w)]
        self.ids = [items[i][0] for i in used]
        self.words = [words[i] for i in used]
        self.answers = _words_of([answer_of(items[i][1]) for i in used])
        cut = [(i, p) for i, w in enumerate(self.words) if len(w) >= LEAST_WORDS for p in pieces_of(w)]
        self.pieces, self.owner = [p for _, p in cut], np.array([i for i, _ in cut], np.int64)
        self.features = np.unique(np.concatenate(self.words)) if used else np.zeros(0, np.uint64)
        # items by the hash of their first words, as many as LEAST_WORDS
        self.heads: dict[int, dict[int, list[int]]] = {}
        with np.errstate(over="ignore"):
            for i, w in enumerate(self.words):
                n = min(len(w), LEAST_WORDS)
                self.heads.setdefault(n, {}).setdefault(int(_rows_of_words(w[:n], n)[0]), []).append(i)
        self.head_places = {n: Lookup(np.array(sorted(h), np.uint64)) for n, h in self.heads.items()}
        self.places = Lookup(self.features)
        self.masks = [(masks_of(w), masks_of(a)) for w, a in zip(self.words, self.answers)]
        self.idf = np.zeros(len(self.features))
        self.other = 1.0
        self.basis = np.zeros((len(self.features), 0), np.float32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Feature of each word; -1 for a word that the benchmark lacks."""
        return self.places(h)

    def weigh(self, df: np.ndarray, rows: int) -> None:
        self.idf = np.log((1 + rows) / (1 + df)) + LEAST_IDF
        self.other = float(np.median(self.idf))
        # words beyond the benchmark weigh no more than the words of a piece
        self.beyond = np.array([min(self.other, math.sqrt((self.idf[self.find(p)] ** 2).mean())) for p in self.pieces]) ** 2

    def item_rows(self) -> np.ndarray:
        out = np.zeros((len(self.pieces), len(self.features)))
        for i, w in enumerate(self.pieces):
            np.add.at(out[i], self.find(w), 1)
        return out * self.idf

    def omega(self) -> np.ndarray:
        rank = min(len(self.features), len(self.pieces) + EXTRA_RANK)
        return np.random.default_rng(11).normal(size=(len(self.features), rank)).astype(np.float32)

    def decompose(self, sketch: np.ndarray, passages: float) -> None:
        """One-pass eigenvectors of A'A from its sketch A'A*omega over ``passages`` rows and the items."""
        weight = max(ITEM_WEIGHT, math.sqrt(ITEM_SHARE * passages / len(self.pieces)))
        plain = self.item_rows()
        norm = np.maximum(1e-9, np.linalg.norm(plain, axis=1))[:, None]
        rows, omega = weight * plain * (norm.max() / norm), self.omega().astype(np.float64)
        y = sketch + rows.T @ (rows @ omega)
        q, _ = np.linalg.qr(y)
        small = np.linalg.lstsq((q.T @ omega).T, (q.T @ y).T, rcond=None)[0].T
        value, vector = np.linalg.eigh((small + small.T) / 2)
        keep = value > 1e-9 * max(1e-300, value.max())
        self.basis = np.ascontiguousarray(q @ vector[:, keep], np.float32)
        self.weighted = (self.idf[:, None] * self.basis).astype(np.float32)
        self.latent = (plain @ self.basis / norm).astype(np.float32)


def pieces_of(words: np.ndarray) -> list[np.ndarray]:
    """Passages of 2 * STEP words, side by side, the last one up to the end; a shorter item is one piece."""
    if len(words) <= LONG:
        return [words]
    return [words[min(at, len(words) - 2 * STEP):][:2 * STEP] for at in range(0, len(words), 2 * STEP)]


def _rows_of_words(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` words in a row from each place on."""
    m = max(0, len(h) - n + 1)
    total = np.zeros(m, np.uint64)
    for j in range(n):
        total += h[j:j + m] * _ODD[j]
    return mix(total)


def _exact(index: Index, w: Words) -> set[tuple[int, int]]:
    """(text, item) where all words of the item stand in a row."""
    out = set()
    for n, places in index.head_places.items():
        h = _rows_of_words(w.hash, n)
        if not len(h):
            continue
        at = np.flatnonzero(places(h) >= 0)
        text = np.searchsorted(w.first, at, "right") - 1
        if n < LEAST_INSIDE:
            alone = (w.first[text] == at) & (w.first[text + 1] == at + n)
            at, text = at[alone], text[alone]
        for place, d in zip(at.tolist(), text.tolist()):
            for item in index.heads[n][int(h[place])]:
                own = index.words[item]
                if (d, item) not in out and place + len(own) <= w.first[d + 1] and np.array_equal(w.hash[place:place + len(own)], own):
                    out.add((d, item))
    return out


def _blocks(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block of each word, first block of each text, and text of each block."""
    sizes = np.diff(words.first)
    n = -(-sizes // STEP)
    start = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(sizes)), sizes)
    block = start[doc] + (np.arange(len(doc)) - words.first[doc]) // STEP
    return block, start, np.repeat(np.arange(len(sizes)), n)


def _sums(table: np.ndarray, row: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``table[row]`` over the segments that begin at ``first``.

    The k-th rows of all short segments are added at once, which is much
    faster than ``add.reduceat`` over wide rows; long segments are summed one by one.
    """
    size = np.diff(first, append=len(row))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    out = np.empty((len(first), table.shape[1]), table.dtype)
    long = int((size > 64).sum())
    for i in range(long):
        out[i] = table[row[first[i]:first[i] + size[i]]].sum(axis=0)
    out[long:] = table[row[first[long:]]]
    for k in range(1, int(size[long]) if long < len(size) else 0):
        upto = long + int(np.searchsorted(-size[long:], -k))
        out[long:upto] += table[row[first[long:upto] + k]]
    result = np.empty_like(out)
    result[order] = out
    return result


def _sum_by(table: np.ndarray, row: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``table[row]`` by ``key`` (ordered, below ``n``)."""
    out = np.zeros((n, table.shape[1]), np.float32)
    if len(key):
        at = np.flatnonzero(np.diff(key, prepend=-1))
        out[key[at]] = _sums(table, row, at)
    return out


def _count_df(sent):
    def run(batches):
        index = sent.value
        df, rows = np.zeros(len(index.features), np.int64), 0
        for batch in batches:
            data, off = text_bytes(batch["text"])
            rows += batch.num_rows
            with np.errstate(over="ignore"):
                for i, j in chunks_of(data, off):
                    w = Words(data[off[i]:off[j]], off[i:j + 1] - off[i])
                    f = index.find(w.hash)
                    doc = np.repeat(np.arange(j - i), np.diff(w.first))[f >= 0]
                    pair = np.unique(doc * len(index.features) + f[f >= 0])
                    df += np.bincount(pair % len(index.features), minlength=len(index.features))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], rows))], names=["f", "n"])
    return run


def _sketch(sent):
    def run(batches):
        index = sent.value
        idf = index.idf.astype(np.float32)[:, None]
        omega = index.omega() * idf
        total, passages = np.zeros(omega.shape), 0
        for batch in batches:
            data, off = text_bytes(batch["text"])
            with np.errstate(over="ignore"):
                for i, j in chunks_of(data, off, 500_000):
                    w = Words(data[off[i]:off[j]], off[i:j + 1] - off[i])
                    block, start, doc = _blocks(w)
                    f = index.find(w.hash)
                    keep = f >= 0
                    f, block = f[keep], block[keep]
                    passage = block - (block - start[doc[block]]) % 2  # passages of 2 * STEP words, side by side
                    if len(f):
                        new = np.diff(passage, prepend=-1) != 0
                        y = _sums(omega, f, np.flatnonzero(new))
                        passages += len(y)
                        order = np.argsort(f.astype(np.uint16) if len(index.features) <= 65536 else f, kind="stable")
                        f, passage = f[order], (np.cumsum(new) - 1)[order]
                        first = np.flatnonzero(np.diff(f, prepend=-1))
                        total[f[first]] += _sums(y, passage, first)
        total = (total * idf).astype(np.float32)
        task = TaskContext.get().partitionId()
        yield _part(-1, task, np.array([passages], np.float32))
        for at in range(0, len(total), 1024):
            yield _part(at // 1024, task, total[at:at + 1024])
    return run


def _part(at: int, task: int, rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([task], pa.int32()), pa.array([rows.tobytes()], pa.binary())],
                                      names=["at", "task", "part"])


def _add_parts(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(p, np.float32).astype(np.float64) for p in t["part"].to_pylist())
    return pa.table({"at": t["at"].slice(0, 1), "task": t["task"].slice(0, 1), "part": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def _sum_of_tasks(parts: DataFrame, tasks: int) -> DataFrame:
    """The sum of the tasks' parts, ``FAN_IN`` of them at a time, so that no task adds up all of them."""
    while True:
        tasks = -(-tasks // FAN_IN)
        parts = (parts.select("at", F.expr(f"task div {FAN_IN}").cast("int").alias("task"), "part")
                 .groupBy("at", "task").applyInArrow(_add_parts, "at int, task int, part binary"))
        if tasks <= 1:
            return parts


def _near_passages(index: Index, f: np.ndarray, block: np.ndarray, square: np.ndarray, others: np.ndarray,
                   doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first block, latent vector, least squared product with an item) of the passages that can be candidates.

    A latent item is no longer than 1, so a passage's product with it is at
    most the passage's own length, which the counts of its words bound.  Only
    passages whose length reaches the least product are projected; no
    candidate is lost.
    """
    n = len(doc)
    pair, count = np.unique(block * len(index.features) + f, return_counts=True)
    length = np.sqrt(np.bincount(pair // len(index.features), weights=(count * index.idf[pair % len(index.features)]) ** 2, minlength=n))
    begin = np.arange(n)
    after = np.minimum(begin + 1, n - 1)
    both = (after > begin) & (doc[after] == doc)
    own, beyond, most = (x + np.where(both, x[after], 0) for x in (square, others, length))
    able = np.flatnonzero((most > 0) & (most ** 2 * 1.001 + 1e-9 >= COSINE ** 2 * (own + beyond * index.beyond.min())))
    for i in range(0, len(able), 4096):
        rows = able[i:i + 4096]
        needed = np.unique(np.concatenate([rows, after[rows][both[rows]]]))
        place = np.searchsorted(needed, block)
        used = needed[np.minimum(place, len(needed) - 1)] == block
        part = np.vstack([_sum_by(index.weighted, f[used], place[used], len(needed)), np.zeros((1, index.weighted.shape[1]), np.float32)])
        vec = part[np.searchsorted(needed, rows)] + part[np.where(both[rows], np.searchsorted(needed, after[rows]), len(needed))]
        yield rows, vec, np.maximum(1e-9, COSINE ** 2 * (own[rows, None] + beyond[rows, None] * index.beyond))


def leaks_in(index: Index, texts: pa.Array) -> list[tuple[int, int, float]]:
    """(row, item, share of the item's words found in order) for the leaks in some texts."""
    out: list[tuple[int, int, float]] = []
    data, off = text_bytes(texts)
    with np.errstate(over="ignore"):
        for i, j in chunks_of(data, off, 1_000_000):
            w = Words(data[off[i]:off[j]], off[i:j + 1] - off[i])
            block, start, doc = _blocks(w)
            if not len(doc):
                continue
            whole = _exact(index, w)
            out += [(i + d, item, 1.0) for d, item in sorted(whole)]
            if not index.pieces:
                continue
            f = index.find(w.hash)
            keep = f >= 0
            square = np.bincount(block[keep], weights=index.idf[f[keep]] ** 2, minlength=len(doc))
            others = np.bincount(block[~keep], minlength=len(doc))
            found: dict[int, set] = {}
            for begin, vec, least in _near_passages(index, f[keep], block[keep], square, others, doc):
                reach = vec @ index.latent.T
                for r, piece in zip(*np.nonzero((reach > 0) & (reach * reach >= least))):
                    d, item = int(doc[begin[r]]), int(index.owner[piece])
                    if (d, item) not in whole:
                        found.setdefault((d, item), set()).add(int(begin[r]))
            for (d, item), blocks in found.items():
                own, best, (masks, answer) = index.words[item], 0.0, index.masks[item]
                for b in sorted(blocks):
                    at = w.first[d] + (b - start[d]) * STEP
                    span = w.hash[max(w.first[d], at - len(own)):min(w.first[d + 1], at + 2 * STEP + len(own))]
                    share = common_subsequence(own, span, masks, LCS * len(own)) / len(own)
                    if LCS <= share < SURE and len(index.answers[item]):
                        if common_subsequence(index.answers[item], span, answer) < ANSWER * len(index.answers[item]):
                            share = 0.0
                    best = max(best, share)
                    if best == 1.0:
                        break
                if best >= LCS:
                    out.append((i + d, item, best))
    return out


def build_indexes(docs: DataFrame, benchmark: DataFrame) -> Iterator[tuple[Index, bool]]:
    """Latent indexes of all items, about ``ITEMS`` pieces a block, one at a time; and whether it is the only block."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    size = F.size(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"))
    blocks = math.ceil((items.agg(F.sum(F.when(size <= LONG, 1).otherwise(F.ceil(size / F.lit(2 * STEP))))).first()[0] or 0) / ITEMS)
    texts = docs.select(F.col("text").cast("string").alias("text"))
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect() if blocks > 1 else items.collect()
        index = Index(sorted(((r["item_id"], r["text"]) for r in own), key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")))
        if not index.ids:
            continue
        sent = spark.sparkContext.broadcast(index)
        counted = texts.mapInArrow(released(_count_df(sent)), "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()
        rows = next((r["n"] for r in counted if r["f"] == -1), 0)
        df = np.zeros(len(index.features), np.int64)
        for r in counted:
            if r["f"] >= 0:
                df[r["f"]] = r["n"]
        index.weigh(df, rows)
        sent.destroy()
        sent = spark.sparkContext.broadcast(index)
        sums = _sum_of_tasks(texts.mapInArrow(released(_sketch(sent)), "at int, task int, part binary"), texts.rdd.getNumPartitions())
        sketch, passages = np.zeros(index.omega().shape), 0.0
        for r in sums.collect():  # features x rank of one block of items
            got = np.frombuffer(bytes(r["part"]), np.float32)
            if r["at"] < 0:
                passages = float(got[0])
                continue
            got = got.reshape(-1, sketch.shape[1])
            sketch[r["at"] * 1024:r["at"] * 1024 + len(got)] = got
        sent.destroy()
        if index.pieces:
            index.decompose(sketch, passages)
        yield index, blocks == 1


def _report(sent, keys: list[str]):
    """The columns ``keys`` of the rows with a leak, item and share of each."""
    def run(batches):
        for batch in batches:
            found = [(r, sent.value.ids[i], s) for r, i, s in leaks_in(sent.value, batch["text"])]
            rows = pa.array([r for r, _, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch[k].take(rows) for k in keys], pa.array([i for _, i, _ in found], pa.int64()), pa.array([s for _, _, s in found], pa.float64())],
                names=[*keys, "item_id", "lcs"])
    return run


def _clean(sent):
    def run(batches):
        for batch in batches:
            bad = {r for r, _, _ in leaks_in(sent.value, batch["text"])}
            yield batch.filter(pa.array([r not in bad for r in range(batch.num_rows)], pa.bool_()))
    return run


def _leaks_by_block(rows: DataFrame, indexes, keys: list[str]) -> DataFrame:
    """(keys, item_id, lcs) of all blocks; of several, each is written before the next one is built."""
    spark = rows.sparkSession
    schema = ", ".join([*[f"{k} long" for k in keys], "item_id long, lcs double"])
    out = spark.createDataFrame([], schema)
    for index, only in indexes:
        sent = spark.sparkContext.broadcast(index)
        found = rows.mapInArrow(released(_report(sent, keys)), schema)
        if only:
            return found
        out = out.union(shared(found, "leaks"))
        sent.destroy()
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, lcs): every leak of a benchmark item in a document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _leaks_by_block(rows, build_indexes(docs, benchmark), ["doc_id"])


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no leak, all columns."""
    indexes = build_indexes(docs, benchmark)
    first = next(indexes, None)
    if first is None:
        return docs
    if first[1]:
        return docs.mapInArrow(released(_clean(docs.sparkSession.sparkContext.broadcast(first[0]))), docs.schema)
    # a text that leaks does so in every row: rows go by two hashes of their text
    text = F.col("text").cast("string")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))
    rows = docs.select(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text"))
    bad = _leaks_by_block(rows, chain([first], indexes), ["h1", "h2"]).select("h1", "h2").distinct()
    return own.join(bad, ["h1", "h2"], "left_anti").select("row.*")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks of the benchmark in all documents."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
