"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Law: ``rows`` - shard sizes differ by one row at most, and every assignment of
rows to (shard, slot) is equally likely up to the quality of the hash.

Method.  Rows keep the place they have in the stored input (partition and
position, written once, so retries agree).  Input partitions fold into at most
``SOURCES`` source groups; the matrix of rows that go from each group to each
shard is drawn exactly from the multivariate hypergeometric law on the driver
(``SOURCES`` x shards numbers, whatever the size of the data).  Each group is
permuted by a hash and cut by its matrix row (exchange), and each shard is
permuted by a second hash: hash ranges of a shard are ordered apart and joined
by prefix sums, so no task holds a whole shard.

Defined cases: null text counts no bytes (size 1, crc of the empty text); null
and repeated ids are rows like others; fewer rows than shards leave shards
empty; an empty table gives an empty result; other columns are carried only
where named.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared, table

SOURCES = 1024
#: aim for the rows of one hash range of a shard
ROWS_PER_RANGE = 2000


def hypergeometric(good: int, bad: int, draws: int, u: float) -> int:
    """Quantile u of the hypergeometric law, from its masses around the mode (any size)."""
    total = good + bad
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    sd = math.sqrt(draws * (good / total) * (bad / total) * max(1, total - draws) / max(1, total - 1))
    reach = int(14 * sd) + 20
    x = np.arange(max(low, mode - reach), min(high, mode + reach) + 1, dtype=np.float64)
    ratio = np.log(good - x[:-1]) + np.log(draws - x[:-1]) - np.log(x[1:]) - np.log(bad - draws + x[1:])
    mass = np.concatenate([[0.0], np.cumsum(ratio)])
    mass = np.exp(mass - mass.max())
    cdf = np.cumsum(mass)
    return int(x[min(len(x) - 1, np.searchsorted(cdf, u * cdf[-1], side="right"))])


def communication_matrix(rows: list[int], columns: list[int], seed: int) -> list[list[int]]:
    """Counts with the given row and column sums, drawn exactly."""
    rng = np.random.default_rng(seed)
    left = list(columns)
    matrix = []
    for n in rows:
        line, rest = [], sum(left)
        for c in left[:-1]:
            take = hypergeometric(c, rest - c, n, rng.random()) if n else 0
            line.append(take)
            n -= take
            rest -= c
        line.append(n)
        left = [c - t for c, t in zip(left, line)]
        matrix.append(line)
    return matrix


def shuffle_to_shards(rows: DataFrame, shards: int = 8, seed: int = 20240607) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards-1) and ``slot`` (gapless from 0 in each shard)."""
    names = [c for c in rows.columns if c not in ("shard", "slot")]
    placed = shared(rows.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("r"),
                                (F.spark_partition_id() % SOURCES).alias("g"),
                                F.monotonically_increasing_id().alias("pos")), "placed")
    counts = {r["g"]: r["n"] for r in placed.groupBy("g").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    groups = sorted(counts)
    matrix = communication_matrix([counts[g] for g in groups], sizes, seed)
    cuts = placed.sparkSession.createDataFrame(
        [(g, [int(x) for x in np.cumsum(line)[:-1]]) for g, line in zip(groups, matrix)], "g int, cuts array<long>")

    local = Window.partitionBy("g").orderBy(F.xxhash64(F.lit(seed), "pos"), "pos")
    ranges = max(1, math.ceil(total / shards / ROWS_PER_RANGE))
    sent = (placed.withColumn("k", F.row_number().over(local) - 1)
            .join(F.broadcast(cuts), "g")
            .withColumn("shard", F.size(F.filter("cuts", lambda c: c <= F.col("k"))))
            .withColumn("order", F.xxhash64(F.lit(seed + 1), "pos"))
            .withColumn("range", F.shiftright(F.shiftrightunsigned("order", 33) * F.lit(ranges), 31))
            .select("r", "pos", "shard", F.shiftrightunsigned("order", 1).alias("order"), "range"))
    sent = shared(sent, "sent")
    before = (sent.groupBy("shard", "range").agg(F.count("*").alias("n"))
              .withColumn("offset", F.coalesce(F.sum("n").over(
                  Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .drop("n"))
    again = Window.partitionBy("shard", "range").orderBy("order", "pos")
    return (sent.join(before, ["shard", "range"])
            .withColumn("slot", F.row_number().over(again) - 1 + F.col("offset"))
            .select("r.*", "shard", "slot"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 7 under the law ``rows``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    return shuffle_to_shards(rows).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
