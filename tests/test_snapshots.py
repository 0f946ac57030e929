"""Snapshots with bucket digests: only buckets that differ are read, and the events feed the table."""

import glob

import pytest
from pyspark.sql import functions as F

from wagelens.streaming import changes as C
from wagelens.streaming import snapshots as S

BUCKETS = 16


@pytest.fixture
def base(spark, tmp_path):
    return str(tmp_path / "snap")


def _rows(spark, n=400):
    return spark.range(n).select(F.col("id").cast("string").alias("id"), (F.col("id") * 100).alias("annual_base_pay"),
                                 F.when(F.col("id") % 3 == 0, F.lit("x")).alias("employer"), F.lit(None).cast("string").alias("location"))


def _events(df):
    return sorted((r["seq"], r["operation"], r["id"], r["data"]["annual_base_pay"] if r["data"] else None) for r in df.collect())


def test_one_changed_row_reads_one_bucket(spark, base):
    rows = _rows(spark)
    S.write_snapshot(rows, base, buckets=BUCKETS)
    S.write_snapshot(rows.withColumn("annual_base_pay", F.when(F.col("id") == "7", 1).otherwise(F.col("annual_base_pay"))), base, buckets=BUCKETS)
    assert S.versions(spark, base) == [1, 2] and len(S.changed_buckets(spark, base, 1, 2)) == 1
    (bucket,) = S.changed_buckets(spark, base, 1, 2)
    for file in glob.glob(f"{base}/version=*/_bucket=*/part-*"):
        if f"_bucket={bucket}/" not in file:
            with open(file, "wb") as f:
                f.write(b"not to be read")
    assert _events(S.capture_snapshot_changes(spark, base)) == [(2, "UPDATE", "7", 1)]


def test_order_of_rows_and_files_is_no_change(spark, base):
    S.write_snapshot(_rows(spark), base, buckets=BUCKETS)
    same = S.write_snapshot(S.read_snapshot(spark, base, 1).drop("_bucket").repartition(5), base, buckets=BUCKETS)
    assert S.changed_buckets(spark, base, 1, same) == [] and S.capture_snapshot_changes(spark, base).count() == 0


def test_a_value_that_moves_between_null_columns_is_seen(spark, base):
    rows = _rows(spark, 9)
    S.write_snapshot(rows, base, buckets=2)
    S.write_snapshot(rows.select("id", "annual_base_pay", F.col("location").alias("employer"), F.col("employer").alias("location")), base, buckets=2)
    assert sorted(r["id"] for r in S.capture_snapshot_changes(spark, base).collect()) == ["0", "3", "6"]


def test_equal_to_the_full_join_and_feeds_the_table(spark, base):
    before = _rows(spark)
    after = before.where("id NOT IN ('3', '50')").withColumn("annual_base_pay", F.when(F.col("id") == "9", F.lit(None)).otherwise(F.col("annual_base_pay"))) \
        .unionByName(_rows(spark, 403).where("id >= '400' AND length(id) = 3"))
    S.write_snapshot(before, base, buckets=BUCKETS)
    number = S.write_snapshot(after, base, buckets=BUCKETS)
    events = S.capture_snapshot_changes(spark, base)
    assert _events(events) == _events(C.capture_changes(before, after, seq=number))
    state = C.apply_changes(before.withColumn("seq", F.lit(1).cast("long")), events, enrich=False)
    got = C.live_rows(state).select(*after.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, after.collect()), key=str)
    want = C.reconcile(before, after).first().asDict()
    assert S.reconcile_snapshots(spark, base, 1, 2).first().asDict() == want and want["missing_in_target"] == 2


def test_empty_versions_and_null_keys(spark, base):
    none = _rows(spark, 0)
    S.write_snapshot(none, base, buckets=4)
    S.write_snapshot(_rows(spark, 3).unionByName(_rows(spark, 1).withColumn("id", F.lit(None).cast("string"))), base, buckets=4)
    assert [e[1:3] for e in _events(S.capture_snapshot_changes(spark, base))] == [("INSERT", "0"), ("INSERT", "1"), ("INSERT", "2")]
    assert S.reconcile_snapshots(spark, base, 1, 2).first().asDict() == {
        "source_count": 0, "target_count": 3, "missing_in_target": 0, "extra_in_target": 3}


def test_other_columns_are_an_error(spark, base):
    S.write_snapshot(_rows(spark, 3), base, buckets=2)
    S.write_snapshot(_rows(spark, 3).drop("employer"), base, buckets=2)
    with pytest.raises(ValueError):
        S.capture_snapshot_changes(spark, base)
