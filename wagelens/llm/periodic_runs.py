"""Periodic runs of words, and texts with the repeats of each run collapsed.

A run of period q is a stretch of consecutive words whose smallest period is q,
of ``max(LEAST_WORDS, 3 q)`` words at least, that no neighbouring word extends.

Method: a dictionary of basic factors.  For each power of two ``l`` every place
gets a name of the ``l`` words that begin there (from the names of its two
halves), and places of one name within a text give each place its successor.
Neighbouring places with one successor distance ``d`` are the members of
arithmetic progressions of difference ``d``; together they propose a run of
period ``d``, which reaches from the first of them to ``l + d`` words after the
last.  A distance over ``l`` (up to twice ``l``) is proposed again at the next
length, where it is decided; so every period belongs to one length, with
``l / 2 < d <= l``, and no run comes twice.  There a proposal is exact: with
``d <= l`` a smaller period of the stretch, or a further word with the same
period, would have been a nearer or a further successor of the same kind.  A
run of ``3 d`` words or more holds its first factor and the successor of it
(``l + d < 3 d``), so none is missed.  Names are 64-bit hashes; the words
of each run are compared once more.

Time is n log n in the words of a text; a batch holds texts of some megabytes,
or one longer text.

Defined cases: null and empty texts have no words, no runs and the empty
collapsed text; words are told apart by case; repeated rows give equal rows;
an empty table gives an empty result; other columns are carried, and columns
named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, chunks_of, mix, small_batches, table, text_bytes

#: words of a run at least, and periods of a run at least
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: the least factor that is searched: shorter periods are found by it too, since a run has LEAST_WORDS words
LEAST_FACTOR = 8

RUNS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("runs", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))),
    T.StructField("collapsed", T.StringType())])


def successors(names: np.ndarray, places: np.ndarray, text: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance to the next place of one name and text), ordered by place, distances up to ``most``."""
    order = np.argsort(names)
    same = names[order][1:] == names[order][:-1]
    again = np.zeros(len(order), bool)
    again[1:] = same
    again[:-1] |= same
    few = order[again]
    few = few[np.lexsort((places[few], names[few]))]
    name, place = names[few], places[few]
    near = (name[1:] == name[:-1]) & (text[few[1:]] == text[few[:-1]])
    near &= place[1:] - place[:-1] <= most
    i, d = place[:-1][near], (place[1:] - place[:-1])[near]
    by = np.argsort(i)
    return i[by], d[by]


def find_runs(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of all runs, ordered; ``first`` are the offsets of the texts in ``words``."""
    sizes = np.diff(first)
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(words))
    end = first[1:][text]
    names, l = words, 1
    found = []
    while len(place):
        if l >= LEAST_FACTOR:
            whole = np.flatnonzero(place + l <= end)
            low = 0 if l == LEAST_FACTOR else l // 2
            i, d = successors(names[whole], place[whole], text[whole], l)
            i, d = i[d > low], d[d > low]
            if len(i):
                cut = np.flatnonzero((np.diff(i) != 1) | (np.diff(d) != 0)) + 1
                a, b = np.concatenate([[0], cut]), np.concatenate([cut, [len(i)]]) - 1
                start, period = i[a], d[a]
                length = i[b] - start + l + period
                keep = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
                found += [(s, n, p) for s, n, p in zip(start[keep].tolist(), length[keep].tolist(), period[keep].tolist())
                          if np.array_equal(words[s:s + n - p], words[s + p:s + n])]
        # names of twice the length, for texts that can hold a run of a period over the length
        longer = np.zeros(len(names), np.uint64)
        longer[:len(names) - l] = mix(names[:len(names) - l] * _LEFT + names[l:] * _RIGHT)
        l *= 2
        least = max(LEAST_WORDS, LEAST_PERIODS * (l // 2 + 1)) if l > LEAST_FACTOR else LEAST_WORDS
        live = sizes[text] >= least
        names, place, text, end = longer[live], place[live], text[live], end[live]
    if not found:
        return (np.zeros(0, np.int64),) * 4
    start, length, period = np.array(found, np.int64).T
    of = np.searchsorted(first, start, "right") - 1
    by = np.lexsort((period, start))
    return of[by], (start - first[of])[by], length[by], period[by]


_LEFT, _RIGHT = (np.uint64(int(x) | 1) for x in mix(np.arange(71, 73, dtype=np.uint64)))


def _collapse(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The words outside the repeats (every word of a run after its first period), joined by one space."""
    words = text.encode().split()  # ASCII blanks only: the word separators
    if spans:
        edge = np.zeros(len(words) + 1, np.int64)
        for start, length, period in spans:
            edge[start + period] += 1
            edge[start + length] -= 1
        keep = np.cumsum(edge) == 0
        words = [w for w, k in zip(words, keep[:-1].tolist()) if k]
    return b" ".join(words).decode()


def collapse_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed``."""
    small_batches(docs.sparkSession)
    new = set(RUNS.fieldNames())
    kept = [f for f in docs.schema.fields if f.name not in new]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        result = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in batches:
            texts = batch.column(len(kept))
            data, off = text_bytes(texts)
            counts, runs = [], []
            with np.errstate(over="ignore"):
                for i, j in chunks_of(data, off):
                    words = Words(data[off[i]:off[j]], off[i:j + 1] - off[i], lower=False)
                    of, *run = find_runs(words.hash, words.first)
                    cut = np.searchsorted(of, np.arange(j - i + 1))
                    rows = list(zip(*(x.tolist() for x in run)))
                    counts += np.diff(words.first).tolist()
                    runs += [rows[a:b] for a, b in zip(cut[:-1], cut[1:])]
            collapsed = [_collapse(t or "", r) for t, r in zip(texts.to_pylist(), runs)]
            runs = [[dict(zip(("start", "length", "period"), r)) for r in rows] for rows in runs]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(kept)], pa.array(counts, pa.int64()), pa.array(runs, pa.list_(result)),
                 pa.array(collapsed, pa.string())], names=[*(f.name for f in kept), *RUNS.fieldNames()])

    rows = docs.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)], F.col("text").cast("string").alias("t"))
    return rows.mapInArrow(work, T.StructType([*kept, *RUNS.fields]))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The texts of the query: with h = crc32(doc_id) divisible by 10, the words from some place on repeat (doc_id, text)."""
    doc = F.col("doc_id").cast("long")
    h = F.crc32(doc.cast("string").cast("binary"))
    rows = (docs.select(doc.alias("doc_id"), F.col("text").cast("string").alias("text"), h.alias("_h"))
            .withColumn("_w", F.when(F.col("_h") % 10 == 0, F.expr(r"regexp_extract_all(text, '([^\\x20\\x09-\\x0D]+)', 1)")))
            .withColumn("_n", F.when(F.size("_w") > 0, F.size("_w")))
            .withColumn("_g", F.floor(F.col("_h") / 10))
            .withColumn("_a", (F.col("_g") % F.col("_n")).cast("int"))
            .withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int")))
    return rows.select("doc_id", F.expr(
        "CASE WHEN _n IS NULL THEN text ELSE array_join(concat(slice(_w, 1, _a), slice(flatten("
        "array_repeat(slice(_w, _a + 1, _p), cast(ceil((_n - _a) / _p) AS int))), 1, _n - _a)), ' ') END").alias("text"))


def strongest(runs: Column) -> Column:
    """The run of greatest length / period, compared exactly; the first of equal ones; null without a run."""
    return F.reduce(F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), F.get(runs, 0), lambda best, r: F.when(
        r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all whole documents, with planted ones, as counts, the strongest run and digests."""
    found = collapse_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.col("best")
    return (found.withColumn("best", strongest(F.col("runs")))
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"),
                    best["length"].alias("length"), best["period"].alias("period"),
                    F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                    F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
                    F.sha2("collapsed", 256).alias("collapsed_sha256")))
