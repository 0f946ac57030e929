"""Numbered snapshots with digests a key bucket.

A snapshot is stored under ``<base>/version=<n>`` by key bucket, and beside it
one short row a bucket: rows, and digests of the rows and of the keys.  Two
snapshots are compared by their digests first; only buckets that differ are
read and joined.  The version number is the ``seq`` of the events, so that
they feed ``apply_changes``.

A digest is the exact sum of two 64-bit hashes of each row (values and which
of them are null), so the order of rows and repeated rows do not disturb it;
a changed bucket keeps both sums, and is missed, by a chance of about 2^-128.
One writer a base.  A version counts once its digests are committed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import _fs, is_committed
from .changes import bucket_of, capture_changes, reconcile

SALT = "second"


def _sums(columns: list[str], name: str) -> list[Column]:
    told = [x for c in columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    exact = lambda h: F.sum(h.cast("decimal(20,0)"))
    return [exact(F.xxhash64(*told)).alias(f"{name}1"), exact(F.xxhash64(F.lit(SALT), *reversed(told))).alias(f"{name}2")]


def bucket_digests(df: DataFrame, key: str = "id") -> DataFrame:
    """One row a bucket of a table that has ``_bucket``: rows, digests of rows (``d``) and keys (``k``)."""
    columns = sorted(c for c in df.columns if c != "_bucket")
    return df.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"), F.count(F.col(key)).alias("keys"),
                                     *_sums(columns, "d"), *_sums([key], "k"))


def versions(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the committed snapshots."""
    root = base.rstrip("/")
    return [v for v in _numbers(spark, root) if is_committed(spark, f"{root}/version={v}/_digests")]


def _numbers(spark: SparkSession, root: str) -> list[int]:
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n.split("=", 1)[1]) for n in names if n.startswith("version="))


def write_snapshot(df: DataFrame, base: str, key: str = "id", buckets: int = 64) -> int:
    """Store ``df`` as the next version and return its number; an unfinished version is written over."""
    spark, root = df.sparkSession, base.rstrip("/")
    done = versions(spark, root)
    number = done[-1] + 1 if done else 1
    place = f"{root}/version={number}"
    # every task writes its rows of each bucket: no row is shuffled to be stored
    cut = df.withColumn("_bucket", bucket_of(key, buckets))
    cut.write.mode("overwrite").option("compression", "zstd").partitionBy("_bucket").parquet(place)
    cut.limit(0).write.mode("overwrite").parquet(f"{place}/_schema")  # an empty snapshot keeps its columns
    stored = spark.read.schema(cut.schema).parquet(place)
    bucket_digests(stored, key).coalesce(1).write.mode("overwrite").parquet(f"{place}/_digests")  # one row a bucket
    return number


def read_snapshot(spark: SparkSession, base: str, number: int) -> DataFrame:
    """The rows of a version, with ``_bucket``."""
    place = f"{base.rstrip('/')}/version={number}"
    return spark.read.schema(spark.read.parquet(f"{place}/_schema").schema).parquet(place)


def changed_buckets(spark: SparkSession, base: str, before: int, after: int, part: str = "d") -> list[int]:
    """Buckets whose rows (``part="k"``: keys) differ between two versions; at most one number a bucket."""
    b, a = (spark.read.parquet(f"{base.rstrip('/')}/version={v}/_digests")
            .select("_bucket", F.struct("n", f"{part}1", f"{part}2").alias(f"s{i}")) for i, v in enumerate((before, after)))
    return sorted(r["_bucket"] for r in b.join(a, "_bucket", "full_outer").where(~F.col("s0").eqNullSafe(F.col("s1")))
                  .select("_bucket").collect())


def capture_snapshot_changes(spark: SparkSession, base: str, before: int | None = None, after: int | None = None,
                             key: str = "id") -> DataFrame:
    """C02 between two versions (the last two, unless named): events with ``seq`` = the later version's number.

    Rows without a key are no events.  Both versions must have the same
    columns; a difference is an error, not a silent loss.
    """
    if before is None or after is None:
        before, after = versions(spark, base)[-2:]
    old, new = (read_snapshot(spark, base, v) for v in (before, after))
    if sorted(old.columns) != sorted(new.columns):
        raise ValueError(f"versions {before} and {after} have other columns")
    buckets = changed_buckets(spark, base, before, after)
    old, new = (d.where(F.col("_bucket").isin(buckets) & F.col(key).isNotNull()).drop("_bucket") for d in (old, new))
    return capture_changes(old.select(*new.columns), new, key, seq=after)


def reconcile_snapshots(spark: SparkSession, base: str, source: int, target: int, key: str = "id") -> DataFrame:
    """C07 between two versions: counts from the digests, missing and extra ids from buckets whose keys differ.

    Rows without a key count nowhere.
    """
    buckets = changed_buckets(spark, base, source, target, "k")
    s, t = (read_snapshot(spark, base, v).where(F.col("_bucket").isin(buckets) & F.col(key).isNotNull())
            for v in (source, target))
    counts = [spark.read.parquet(f"{base.rstrip('/')}/version={v}/_digests").agg(F.coalesce(F.sum("keys"), F.lit(0)).alias(name))
              for v, name in ((source, "source_count"), (target, "target_count"))]
    found = reconcile(s, t, key).select("missing_in_target", "extra_in_target")
    # three frames of one row each
    return counts[0].crossJoin(counts[1]).crossJoin(found)
