"""Language identification by rank-order n-gram profiles.

A profile is the ``PROFILE`` most frequent character n-grams (1 to 3 letters,
words padded by one blank) in order.  A document gets the language whose
profile has the least out-of-place distance from the document's own: the sum
over its n-grams of the difference of the two places, ``PROFILE`` for an n-gram
that the language lacks.  Ties go to the smaller language name.

Learning uses text and lang alone, of documents with a lang and with
crc32(doc_id as text) mod 5 not 0, from a bounded sample of whole texts: about
``SAMPLE`` a language, chosen by a hash of the id.  Prediction reads whole texts.

Defined cases: null or letterless text is ``und`` with score 0; so is every
text when nothing could be learned; a null doc_id is never held out and never
learned from; very short texts are compared by what they have; repeated rows
give equal rows; an empty table gives an empty result; other columns are not
read by ``identify``.  ``score`` is 1 - distance / greatest possible distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import released, shared, small_batches, table

PROFILE = 400
SAMPLE = 400
UNDETERMINED = "und"
#: languages that are learned: of more, those with the most labelled documents
MOST_LANGUAGES = 10_000

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Per code point: 1 for a letter (built once a worker)."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def top_grams(text: str | None, most: int = PROFILE, counts: bool = False):
    """The most frequent n-grams as integers, in order of count, then value."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    if not text:
        return none if counts else none[0]
    raw = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    code = np.where(_letters()[raw], raw, 0).astype(np.int64)
    code = np.concatenate([[0], code, [0]])
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0)
    c = code[keep] + 1  # a blank is 1
    if len(c) < 3:
        return none if counts else none[0]
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    grams = np.concatenate([c[c > 1], two, three])
    grams.sort()
    at = np.flatnonzero(np.diff(grams, prepend=-1))
    number = np.diff(at, append=len(grams))
    grams = grams[at]
    if counts:
        return grams, number
    return grams[np.argsort(-number, kind="stable")[:most]]


def held_out(doc_id: Column, folds: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _count(batches):
    held: dict[str, tuple] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
            g, n = top_grams(text, counts=True)
            if lang in held:
                g, n = np.concatenate([held[lang][0], g]), np.concatenate([held[lang][1], n])
            held[lang] = (g, n)
            if len(g) > 2_000_000:
                held[lang] = _add(g, n)
    for lang, (g, n) in held.items():
        g, n = _add(g, n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n)], names=["lang", "gram", "n"])


def _add(g, n):
    g, back = np.unique(g, return_inverse=True)
    return g, np.bincount(back, weights=n, minlength=len(g)).astype(np.int64)


class Profiles:
    """Places of all known n-grams by language."""

    def __init__(self, by_lang: dict[str, list[int]], most: int = PROFILE):
        self.most = most
        self.langs = sorted(by_lang)
        self.grams = np.unique(np.array([g for p in by_lang.values() for g in p], np.int64))
        self.place = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int32)
        for j, lang in enumerate(self.langs):
            self.place[np.searchsorted(self.grams, by_lang[lang]), j] = np.arange(len(by_lang[lang]))

    def closest(self, text: str | None) -> tuple[str, float]:
        own = top_grams(text, self.most)
        if len(own) == 0 or not self.langs:
            return UNDETERMINED, 0.0
        at = np.searchsorted(self.grams, own)
        at = np.where((at < len(self.grams)) & (self.grams[np.minimum(at, len(self.grams) - 1)] == own), at, len(self.grams))
        place = self.place[at]
        off = np.where(place < 0, self.most, np.abs(place - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(off.argmin())
        return self.langs[best], 1.0 - float(off[best]) / (self.most * len(own))

    def spoken(self, text: str | None) -> bool:
        """Whether the text is in some language: exactly the texts with a letter are not ``und``."""
        return len(top_grams(text, 1)) > 0


def learn(docs: DataFrame, folds: int = 5) -> Profiles:
    """Profiles from the labelled documents outside the held-out fold."""
    small_batches(docs.sparkSession)
    known = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").where(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds))
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    if not sizes:
        return Profiles({})
    shares = docs.sparkSession.createDataFrame(
        [(r["lang"], int(1_000_000 * min(1.0, SAMPLE / r["count"])) + 1) for r in sizes], "lang string, share int")
    sample = known.join(F.broadcast(shares), "lang").where(
        F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000)) < F.col("share")).select("lang", "text")
    counted = sample.mapInArrow(released(_count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PROFILE)
    by_lang: dict[str, list[int]] = {}
    for r in best.orderBy("lang", "place").collect():  # PROFILE rows a language
        by_lang.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(by_lang)


def _predict(sent):
    def run(batches):
        for batch in batches:
            found = [sent.value.closest(t) for t in batch["text"].to_pylist()]
            cols = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"])
    return run


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` from column text; clashing columns give way."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.drop("lang_pred", "score")
    sent = spark.sparkContext.broadcast(profiles)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(released(_predict(sent)), f"{schema}, lang_pred string, score double")


def _spoken(sent):
    def run(batches):
        for batch in batches:
            texts = batch["text"].to_pylist()
            if sent.value.langs and "lang" in batch.schema.names and pa.types.is_string(batch["lang"].type):
                found = [sent.value.closest(t)[0] for t in texts]
                batch = batch.set_column(batch.schema.get_field_index("lang"), "lang", pa.array(found, pa.string()))
            yield batch.filter(pa.array([sent.value.spoken(t) for t in texts], pa.bool_()))
    return run


def with_language(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """The rows of ``docs`` whose text is in some language, with the language predicted from the whole text as ``lang``.

    Only null or letterless texts go.  Labels teach the profiles; every row's ``lang``, labelled or not, is the
    prediction.  Where nothing could be learned, the rows keep their ``lang``.
    """
    small_batches(docs.sparkSession)
    return docs.mapInArrow(released(_spoken(docs.sparkSession.sparkContext.broadcast(profiles))), docs.schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    profiles = learn(docs)
    rows = docs.select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), F.col("text").cast("string").alias("text"))
    return identify(rows, profiles).select("doc_id", "held_out", "lang_pred", "score")
