"""Phrase collocation mining by Misra-Gries summaries and an exact second pass.

Texts are lower-cased (A-Z), split into pieces at ``BREAKS`` and into words at
blanks; a phrase is some consecutive words of a piece.  All counts are per
language.  Phrases of 2 to ``LONGEST`` words that occur ``LEAST`` times are
scored by their weakest cut.

Method.  A task counts the n-grams of its texts, as 64-bit names; the counts
are dealt by name into hash partitions, and each partition folds them into a
Misra-Gries summary: over its capacity of counters, the count of the first
counter too many is taken from all of them.  What was taken is at most mass /
capacity, so with a capacity over mass / ``LEAST`` every n-gram that occurs
``LEAST`` times survives.  The number of partitions follows the mass (bounded
by the bytes of the texts), so that a summary has ``CAPACITY`` counters
whatever the size of the data; the taken count is kept, and a summary that
would take ``LEAST`` grows instead.  Words and pairs go first; longer n-grams
are counted where all their pairs survived.  Survivors become a bitmap of
fixed size (``BITS``, two places a name), built by Spark's bitmap aggregate
and broadcast; what it lets through wrongly costs time, not results.  The
second pass counts the texts of all n-grams that the bitmap passes, exactly,
by language and phrase: a task packs its counts in one table a hash partition,
and a task a partition adds them.

Parts of a phrase occur as often as it does, so the same counts hold the parts
of every cut.  Scores are decimals of 38 digits.

Defined cases: null and empty texts count nothing; null language is ``und``;
repeated rows and null ids count like others; an empty table gives no rows;
other columns are not read.  Texts are read whole, some megabytes at a time or
one longer text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, chunks_of, mix, released, shared, signed, small_batches, table, text_bytes

#: piece breaks and blanks (fixed values)
BREAKS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
LEAST, LONGEST, TOP = 30, 4, 2000
#: counters of a summary
CAPACITY = 1 << 21
#: bits of the survivors' bitmap, whatever the size of the data (16 MB)
BITS = 27
#: distinct n-grams that a task holds before it passes their counts on
HELD = 1_000_000

_IS_BREAK = np.zeros(256, bool)
_IS_BREAK[list(BREAKS)] = True
_IS_WORD = ~_IS_BREAK
_IS_WORD[list(BLANKS)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = [np.uint64(int(x) | 1) for x in mix(np.arange(31, 31 + LONGEST, dtype=np.uint64))]
_AGAIN = np.uint64(0xD6E8FEB86659FD93)


def language_name(lang: str) -> int:
    return int.from_bytes(hashlib.sha256(lang.encode()).digest()[:8], "little")


class Grams:
    """The words of some texts with the piece and language they stand in, and names of their n-grams."""

    def __init__(self, data: np.ndarray, off: np.ndarray, langs: np.ndarray):
        words = Words(data, off, is_word=_IS_WORD)
        self.data, self.start, self.end = data, words.start, words.end
        self.text = np.repeat(np.arange(len(off) - 1), np.diff(words.first))
        breaks = np.cumsum(_IS_BREAK[data])
        self.piece = breaks[words.start] + self.text  # both never fall, so equal sums are equal pieces
        self.hash = words.hash
        self.lang = langs[self.text]

    def __len__(self) -> int:
        return len(self.hash)

    def names(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, name) of the n-grams within pieces."""
        m = max(0, len(self) - n + 1)
        at = np.flatnonzero(self.piece[n - 1:] == self.piece[:m])
        total = self.lang[at] + np.uint64(n)
        for j in range(n):
            total = total + self.hash[at + j] * _ODD[j]
        return at, mix(total)

    def phrases(self, at: np.ndarray, n: int) -> pa.Array:
        """The lower-cased words of n-grams, joined by one space."""
        word = (at[:, None] + np.arange(n)).ravel()
        size = (self.end - self.start)[word] + 1
        size[n - 1::n] -= 1
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        source = np.repeat(self.start[word] - (stop - size), size) + np.arange(total)
        out = _LOWER[self.data[np.minimum(source, len(self.data) - 1)]]
        space = np.ones(len(word), bool)
        space[n - 1::n] = False
        out[stop[space] - 1] = 0x20
        ends = np.concatenate([[0], stop[n - 1::n]]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(out)).cast(pa.string())


def grams_of(batch: pa.RecordBatch) -> Iterator[tuple[Grams, list[str]]]:
    """``Grams`` of the (text, lang) rows of a batch, in pieces of bounded size, with the language of each text."""
    data, off = text_bytes(batch.column(0))
    langs = batch.column(1).to_pylist()
    known = {x: language_name(x) for x in set(langs)}
    named = np.array([known[x] for x in langs], np.uint64)
    with np.errstate(over="ignore"):
        for i, j in chunks_of(data, off):
            yield Grams(data[off[i]:off[j]], off[i:j + 1] - off[i], named[i:j]), langs[i:j]


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ordered, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


class Survivors:
    """A bitmap of names: no name that was put in is missed."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def holds(self, names: np.ndarray) -> np.ndarray:
        found = np.ones(len(names), bool)
        for place in (names, names * _AGAIN):
            place = place >> np.uint64(64 - BITS)
            found &= (self.words[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return found

    @staticmethod
    def of(names: DataFrame) -> Survivors:
        """The bitmap of rows of (first, second) places; the driver gets 2^BITS bits at most."""
        places = names.select(F.explode(F.array("first", "second")).alias("place"))
        rows = (places.groupBy(F.bitmap_bucket_number(F.col("place") + 1).alias("bucket"))
                .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("place") + 1)).alias("bits"))).toArrow()
        words = np.zeros(1 << (BITS - 3), np.uint8)
        for bucket, bits in zip(rows["bucket"].to_pylist(), rows["bits"].to_pylist()):
            at = (bucket - 1) * len(bits)
            words[at:at + len(bits)] = np.frombuffer(bits, np.uint8)
        return Survivors(words)


class Summary:
    """Misra-Gries counters of one hash partition."""

    def __init__(self, least: int, capacity: int):
        self.least, self.capacity, self.taken = least, capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts = added(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
        if len(self.keys) > self.capacity:
            at = len(self.keys) - self.capacity - 1
            much = int(np.partition(self.counts, at)[at])
            if self.taken + much >= self.least:  # more mass than the partitions were made for: keep all, and grow
                self.capacity = 2 * len(self.keys)
                return
            self.taken += much
            left = self.counts > much
            self.keys, self.counts = self.keys[left], self.counts[left] - much

    def survivors(self) -> np.ndarray:
        """All keys that can have been added ``least`` times."""
        return self.keys[self.counts + self.taken >= self.least]


def local_counts(sizes: tuple[int, ...], known=None):
    """Tasks that count the n-grams of their texts: (key, n).  With ``known``, only those whose pairs all survived."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        fresh, size = [], 0

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(counts)], names=["key", "n"])

        for batch in batches:
            for g, _ in grams_of(batch):
                pairs = None
                if known is not None:
                    at, names = g.names(2)
                    pairs = np.zeros(len(g) + LONGEST, bool)
                    pairs[at] = known.value.holds(names)
                for n in sizes:
                    at, names = g.names(n)
                    if pairs is not None:
                        names = names[np.logical_and.reduce([pairs[at + j] for j in range(n - 1)])]
                    fresh.append(names)
                    size += len(names)
                if size > HELD:
                    new = np.concatenate(fresh)
                    keys, counts = added(np.concatenate([keys, new]), np.concatenate([counts, np.ones(len(new), np.int64)]))
                    fresh, size = [], 0
                    if len(keys) > HELD:
                        yield rows()
                        keys, counts = keys[:0], counts[:0]
        new = np.concatenate([keys[:0], *fresh])
        keys, counts = added(np.concatenate([keys, new]), np.concatenate([counts, np.ones(len(new), np.int64)]))
        yield rows()
    return run


def summarised(least: int, capacity: int):
    """Tasks that fold the (key, n) rows of a hash partition into a summary and give its survivors' bitmap places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary, held, size = Summary(least, capacity), [], 0

        def fold():
            summary.add(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))

        for batch in batches:
            held.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= capacity:
                fold()
                held, size = [], 0
        if held:
            fold()
        keys = summary.survivors()
        with np.errstate(over="ignore"):
            places = [signed(x >> np.uint64(64 - BITS)) for x in (keys, keys * _AGAIN)]
        for i in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(p[i:i + 100_000]) for p in places], names=["first", "second"])
    return run


def partitions(mass: int, least: int) -> int:
    """Hash partitions whose summaries hold all n-grams that occur ``least`` times; twice over, since partitions differ in mass."""
    return max(1, -(-2 * mass // (least * CAPACITY)))


def frequent(texts: DataFrame, sizes: tuple[int, ...], mass: int, least: int, known=None) -> DataFrame:
    """The bitmap places of a superset of the n-grams that occur ``least`` times."""
    parts = partitions(mass, least)
    counts = texts.mapInArrow(released(local_counts(sizes, known)), "key long, n long")
    return counts.repartition(parts, "key").mapInArrow(released(summarised(least, CAPACITY)), "first long, second long")


COUNTS = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])


def packed(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as out:
        out.write_table(t)
    return sink.getvalue().to_pybytes()


def exact_counts(known, parts: int):
    """Tasks that count the texts of the n-grams in the bitmap, and all words (words 0).

    A row (part, counts) is the packed table of a task's counts in one hash partition.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def rows(more: list[tuple[np.ndarray, pa.Table]]):
            t, names = pa.concat_tables([x for _, x in more]), np.concatenate([k for k, _ in more])
            part = mix(names) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
            for i in range(parts):
                if cut[i] < cut[i + 1]:
                    own = t.take(pa.array(order[cut[i]:cut[i + 1]])).group_by(["lang", "words", "phrase"]).aggregate([("n", "sum")])
                    own = own.select(["lang", "words", "phrase", "n_sum"]).rename_columns(COUNTS.names)
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([packed(own)], pa.binary())], names=["part", "counts"])

        total: dict[str, int] = {}
        for batch in batches:
            for g, langs in grams_of(batch):
                names_of = np.array(langs, dtype=object)
                for lang, n in zip(langs, np.bincount(g.text, minlength=len(langs)).tolist()):
                    total[lang] = total.get(lang, 0) + n
                for n in range(1, LONGEST + 1):
                    at, names = g.names(n)
                    passed = known.value.holds(names)
                    keys, first, count = np.unique(names[passed], return_index=True, return_counts=True)
                    at = at[passed][first]
                    held.append((keys, pa.Table.from_arrays([
                        pa.array(names_of[g.text[at]], pa.string()), pa.array(np.full(len(at), n, np.int32)), g.phrases(at, n),
                        pa.array(count.astype(np.int64))], schema=COUNTS)))
                    size += len(keys)
                if size > HELD:
                    yield from rows(held)
                    held, size = [], 0
        words = pa.Table.from_arrays([pa.array(list(total), pa.string()), pa.array(np.zeros(len(total), np.int32)),
                                      pa.array([""] * len(total), pa.string()), pa.array(list(total.values()), pa.int64())], schema=COUNTS)
        with np.errstate(over="ignore"):
            yield from rows([*held, (np.array([language_name(x) for x in total], np.uint64), words)])
    return run


def added_counts(least: int):
    """Tasks that add the packed counts of a hash partition and give the phrases that reach ``least``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, fresh, size = COUNTS.empty_table(), [], 0

        def fold(more: list[pa.Table]) -> pa.Table:
            t = pa.concat_tables(more).group_by(["lang", "words", "phrase"]).aggregate([("n", "sum")])
            return t.select(["lang", "words", "phrase", "n_sum"]).rename_columns(COUNTS.names)

        for batch in batches:
            for one in batch.column(1):
                fresh.append(pa.ipc.open_stream(one.as_buffer()).read_all())
                size += fresh[-1].num_rows
                if size > HELD + total.num_rows:
                    total, fresh, size = fold([total, *fresh]), [], 0
        total = fold([total, *fresh])
        n = total["n"].to_numpy()
        yield from total.filter(pa.array((n >= least) | (total["words"].to_numpy() == 0))).combine_chunks().to_batches(100_000)
    return run


def count_phrases(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, words, phrase, n) of all phrases of 1 to LONGEST words that occur ``least`` times, exact; words 0: all words."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0)).alias("n")).first()["n"]
    # words, and n-grams of one length, are at most half of the bytes and ends: two lengths have a mass of at most ``size``
    short = shared(frequent(texts, (1, 2), size, least), "phrases-short")
    known = spark.sparkContext.broadcast(Survivors.of(short))
    longer = shared(frequent(texts, tuple(range(3, LONGEST + 1)), size, least, known), "phrases-long")
    both = spark.sparkContext.broadcast(Survivors.of(short.unionByName(longer)))
    parts = partitions(size, least)
    counts = (texts.mapInArrow(released(exact_counts(both, parts)), "part int, counts binary").repartition(parts, "part")
              .mapInArrow(released(added_counts(least)), "lang string, words int, phrase string, n long"))
    return shared(counts, "phrases-counts")


def collocations(counts: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` phrases a language of ``count_phrases``: lang, rank, phrase, a, l, r, n, score."""
    phrases = counts.where("words >= 2").select("lang", "words", "phrase", F.col("n").alias("a"))
    parts = counts.where("words >= 1").select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    cut = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select("*", F.expr("substring_index(phrase, ' ', k)").alias("left"), F.expr("substring_index(phrase, ' ', k - words)").alias("right"))
    met = (cut.join(parts.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"])
           .join(parts.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"]))
    score = F.expr("2000000 * cast(a AS decimal(20)) div (cast(l AS decimal(20)) + cast(r AS decimal(20)))")
    scored = (met.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
              .select("lang", "phrase", "a", "cut.l", "cut.r", F.col("cut.score").alias("score")))
    inner = phrases.where("words >= 3").select("lang", F.col("a").alias("f"), F.explode(F.expr(
        "flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), "
        "i -> array_join(slice(split(phrase, ' ', -1), i, m), ' '))))")).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = (scored.join(inner, ["lang", "phrase"], "left")
            .where("longer IS NULL OR 100 * cast(longer AS decimal(20)) < 80 * cast(a AS decimal(20))"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    totals = counts.where("words = 0").select("lang", "n")
    return (left.withColumn("rank", rank).where(F.col("rank") <= top).join(totals, "lang")
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first phrases over all whole documents."""
    return collocations(count_phrases(table(spark, sf_dir, "documents")))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, w, unnest([1, 2, 3, 4]) AS words FROM lists),
grams AS (
  SELECT lang, words, unnest(list_transform(range(1, len(w) - words + 2), lambda i: array_to_string(w[i:i + words - 1], ' '))) AS phrase
  FROM sizes),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM lists GROUP BY lang),
counts AS (SELECT lang, words, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
phrases AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE words >= 2),
cuts AS (
  SELECT lang, words, phrase, a, k, array_to_string(w[1:k], ' ') AS lhs, array_to_string(w[k + 1:words], ' ') AS rhs
  FROM (SELECT *, unnest(range(1, words)) AS k FROM phrases)),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r,
    2000000::HUGEINT * c.a // (x.f::HUGEINT + y.f::HUGEINT) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.lhs JOIN counts y ON y.lang = c.lang AND y.phrase = c.rhs),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
spans AS (SELECT lang, a, w, m, unnest(range(1, words - m + 2)) AS i, words
  FROM (SELECT *, unnest(range(2, words)) AS m FROM phrases WHERE words >= 3)),
inner_parts AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM spans GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN inner_parts p ON p.lang = b.lang AND p.phrase = b.phrase
  WHERE p.longer IS NULL OR 100::HUGEINT * p.longer < 80::HUGEINT * b.a),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, CAST(r.score AS BIGINT) AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""
