"""Mixing sources to target weights with weighted sampling (DataFrame functions only).

Size of a document: its words.  Sources by code point (null last) weigh 5, 2,
1, repeating.  A source's target is its share of all words; targets stop at
``MOST_EPOCHS`` times the source's size and the excess goes to the others by
weight until none is above (the fixed point is found in one pass over the
sources ordered by size per weight).

Selection.  Every document has an Efraimidis-Spirakis key, -ln(u) / quality,
with u from a hash of its id, so reruns agree and any partitioning gives the
same mix.  Whole epochs of a source come first; what is left of its target
goes to documents in key order by prefix sums of their sizes, and the document
at the boundary gives its leading words.  Prefix sums run per (source, key
range), with range totals added, so a hot source is spread over many tasks.

Defined cases: null text has size 0 and is never taken; null source is a
source of its own; null ids share one key; repeated rows are documents of
their own; ties go to the smaller id, then size; an unlabelled document has
quality 1; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import bounded_broadcast
from .common import WORD_PATTERN, shared, table

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
#: sampling weight of a document by its quality label; 1 without a label
QUALITY_WEIGHTS = {1: 2.0, 0: 0.5}
SEED = "mix-1"
ROWS_PER_RANGE = 5000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(s, source_size, target) from (s, source, source_size)."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.row_number().over(order) - 1) % len(WEIGHTS)) + 1)
    weighed = sizes.withColumn("w", weight.cast("long")).withColumn("cap", MOST_EPOCHS * F.col("source_size"))
    total = math.lcm(*WEIGHTS)
    by_ratio = Window.orderBy((F.col("source_size") * F.expr(f"{total} div w")), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    filled = (weighed
              .withColumn("k", F.row_number().over(by_ratio))
              .withColumn("left", F.sum("source_size").over(whole)
                          - F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .withColumn("w_left", F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
              .withColumn("open", F.col("w") * F.col("left") <= F.col("cap") * F.col("w_left"))
              .withColumn("first_open", F.min(F.when(F.col("open"), F.struct("k", "left", "w_left"))).over(whole)))
    return filled.select("s", "source_size", F.when(
        F.col("k") >= F.col("first_open.k"),
        (F.col("w") * F.col("first_open.left")).cast("double") / F.col("first_open.w_left").cast("double"))
        .otherwise(F.col("cap").cast("double")).alias("target"))


def mix(docs: DataFrame, labels: DataFrame | None = None, seed: str = SEED, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, part, taken) per row of ``docs`` (doc_id, text, source).

    ``copies`` whole copies and ``part`` leading words of one more are taken.
    ``keep``: columns of ``docs`` to carry.
    """
    keep = keep or []
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept") if keep else F.lit(None).alias("kept"),
                        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                        n_words(F.col("text").cast("string")).alias("size"))
    quality = F.lit(1.0)
    if labels is not None:
        own = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
        sized = sized.join(own, "doc_id", "left")
        for value, weight in QUALITY_WEIGHTS.items():
            quality = F.when(F.col("quality") == value, F.lit(weight)).otherwise(quality)
    hashed = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    u = (F.conv(F.substring(hashed, 1, 12), 16, 10).cast("long") + 0.5) / float(1 << 48)
    # sources are joined by a key that is never null
    name = F.coalesce(F.concat(F.lit("v"), F.col("source")), F.lit("n"))
    keyed = sized.select("kept", "doc_id", "source", "size", (-F.log(u) / quality).alias("key"), name.alias("s"))
    keyed = shared(keyed, "keyed")
    sizes = shared(keyed.groupBy("s", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "sources")
    rows = sizes.agg(F.sum("n")).first()[0] or 0
    ranges = max(16, math.ceil(rows / ROWS_PER_RANGE))
    targets = (source_targets(sizes)
               .withColumn("budget", F.floor(F.col("target") + 0.5).cast("long"))
               .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)))
               .select("s", "source_size", "target", "epochs", (F.col("budget") - F.col("epochs") * F.col("source_size")).alias("rest")))

    ranged = keyed.withColumn("r", F.floor((1 - F.exp(-F.col("key"))) * ranges).cast("int"))
    before = (ranged.groupBy("s", "r").agg(F.sum("size").alias("words"))
              .withColumn("offset", F.coalesce(F.sum("words").over(
                  Window.partitionBy("s").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .join(bounded_broadcast(targets), "s").drop("words"))
    inside = Window.partitionBy("s", "r").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("offset") - F.col("inside")))
    whole = (F.col("extra") == F.col("size")) & (F.col("size") > 0)
    return (ranged.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .join(before, ["s", "r"]).withColumn("extra", extra)
            .withColumn("copies", F.when(F.col("size") > 0, F.col("epochs") + F.when(whole, 1).otherwise(0)).otherwise(0).cast("int"))
            .withColumn("part", F.when(whole, F.lit(0)).otherwise(F.col("extra")).cast("long"))
            .withColumn("taken", F.col("epochs") * F.col("size") + F.col("extra"))
            .select("kept", "doc_id", "source", "size", "source_size", "target", "copies", "part", "taken"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents; quality weights from the labels."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies", "part")


OP4_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS bigint) AS size FROM documents
), quality AS (
  SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), keyed AS (
  SELECT s.doc_id, s.source, s.size,
    -ln((CAST('0x' || substr(md5('mix-1|' || coalesce(CAST(s.doc_id AS varchar), '')), 1, 12) AS bigint) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)
      / CASE quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS key
  FROM sized s LEFT JOIN quality q ON s.doc_id = q.doc_id
), sources AS (
  SELECT source, CAST(sum(size) AS bigint) AS source_size FROM keyed GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 3 * source_size AS cap FROM sources
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source_size * (10 // w), source NULLS LAST) AS k FROM weighed
), filled AS (
  SELECT *, (SELECT sum(source_size) FROM sources) - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_words,
    sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
  FROM ranked
), first_open AS (
  SELECT k AS k0, rest_words AS left0, w_left AS w0 FROM filled WHERE w * rest_words <= cap * w_left ORDER BY k LIMIT 1
), targets AS (
  SELECT source, source_size,
    CASE WHEN k >= k0 THEN CAST(w * left0 AS double) / CAST(w0 AS double) ELSE CAST(cap AS double) END AS target
  FROM filled LEFT JOIN first_open ON true
), budgets AS (
  SELECT *, CAST(floor(target + 0.5) AS bigint) AS budget FROM targets
), cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM budgets
), summed AS (
  SELECT k.doc_id, k.source, k.size, c.source_size, c.target, c.epochs, c.budget - c.epochs * c.source_size AS rest,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed k JOIN cut c ON k.source IS NOT DISTINCT FROM c.source
), taken AS (
  SELECT *, CAST(greatest(0, least(size, rest - before)) AS bigint) AS extra FROM summed
)
SELECT doc_id, size, source_size, target, CAST(epochs * size + extra AS bigint) AS taken, source,
  CAST(CASE WHEN size = 0 THEN 0 WHEN extra = size THEN epochs + 1 ELSE epochs END AS int) AS copies,
  CAST(CASE WHEN extra = size AND size > 0 THEN 0 ELSE extra END AS bigint) AS part
FROM taken
"""


def leading_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame, labels: DataFrame | None = None, seed: str = SEED) -> DataFrame:
    """The documents of the mix with the columns of ``docs``: a row a copy, then one of the leading words.

    ``n_chars``, where ``docs`` has it, follows the text of a part.
    """
    # whole rows are numbered and written once; only numbers and sizes go through the mix
    numbered = shared(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept")), "numbered")
    narrow = numbered.select("rid", "kept.doc_id", "kept.text", "kept.source")
    taken = (mix(narrow, labels, seed, keep=["rid"]).where("copies > 0 OR part > 0")
             .select(F.col("kept.rid").alias("rid"), "copies", "part").join(numbered, "rid"))
    row = F.explode(F.concat(F.array_repeat(F.lit(0).cast("long"), F.col("copies")),
                             F.when(F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<long>"))))
    rows = taken.select("kept", row.alias("only"))
    text = F.when(F.col("only") > 0, leading_words(F.col("kept.text"), F.col("only"))).otherwise(F.col("kept.text"))
    out = rows.select("only", *[text.alias("text") if c == "text" else F.col(f"kept.`{c}`").alias(c) for c in docs.columns])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("only") > 0, F.length("text").cast(out.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop("only")
