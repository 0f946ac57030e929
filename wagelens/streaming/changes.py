"""Change capture, apply and sync.

A change event is ``(seq, operation, id, data)`` with ``operation`` one of
INSERT / UPDATE / DELETE and ``data`` the new row (NULL for DELETE).

Skew: the latest event per id is picked with ``max_by`` in a grouped
aggregation (map-side partial aggregation), never with a window partitioned
by id, so an id with a huge share of the events does not end up in one task.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.levels import enrich_document, touch_updated_at
from ..session import _fs, is_committed, scratch_path

OPS = ("INSERT", "UPDATE", "DELETE")

#: row payload of the events-derived change feed
EVENT_DATA_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("employment_type", T.StringType()),
    T.StructField("years_experience_industry", T.DoubleType()),
    T.StructField("annual_base_pay", T.LongType()),
    T.StructField("annual_bonus", T.LongType()),
    T.StructField("stock_value", T.LongType()),
])

CHANGE_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("operation", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("data", EVENT_DATA_SCHEMA),
])


# ---------------------------------------------------------------------------
# F16: JSON form of a change
# ---------------------------------------------------------------------------

def change_to_json(changes: DataFrame) -> DataFrame:
    """F16: one JSON text per change (the notification payload)."""
    return changes.select(F.to_json(F.struct("seq", "operation", "id", "data")).alias("value"))


def change_from_json(text: DataFrame, schema: T.StructType = CHANGE_SCHEMA,
                     col: str = "value") -> DataFrame:
    """F16: parse payloads with an explicit schema (no inference)."""
    return text.select(F.from_json(F.col(col), schema).alias("c")).select("c.*")


def events_as_changes(events: DataFrame) -> DataFrame:
    """The driver ``events`` table read as a change feed.

    seq = event_id, id = user_id, ``error`` -> DELETE, ``signup`` -> INSERT,
    anything else -> UPDATE; value (dollars) -> annual_base_pay cents;
    ``props.k`` -> years of experience.
    """
    op = (F.when(F.col("event_type") == "error", F.lit("DELETE"))
           .when(F.col("event_type") == "signup", F.lit("INSERT"))
           .otherwise(F.lit("UPDATE")))
    data = F.struct(
        F.col("user_id").cast("string").alias("id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("event_type").alias("employment_type"),
        F.get_json_object("props", "$.k").try_cast("double").alias("years_experience_industry"),
        F.round(F.col("value") * 100).cast("long").alias("annual_base_pay"),
        F.lit(None).cast("long").alias("annual_bonus"),
        F.lit(None).cast("long").alias("stock_value"),
    )
    return events.select(F.col("event_id").alias("seq"), op.alias("operation"),
                         F.col("user_id").cast("string").alias("id"),
                         F.when(op != "DELETE", data).alias("data"))


# ---------------------------------------------------------------------------
# Diff two snapshots
# ---------------------------------------------------------------------------

def change_schema(row: T.StructType, key: str = "id") -> T.StructType:
    """Schema of the change events of a table: the payload is the whole row without its key."""
    data = T.StructType([f for f in row.fields if f.name != key])
    return T.StructType([T.StructField("seq", T.LongType()), T.StructField("operation", T.StringType()),
                         T.StructField(key, row[key].dataType), T.StructField("data", data)])


NESTED = (T.ArrayType, T.StructType, T.MapType)


def row_digests(columns: list[str], name: str) -> list[Column]:
    """``<name>1`` and ``<name>2``: two 64-bit hashes of the values of a row and of which are null (no nested columns)."""
    told = [x for c in columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    return [F.xxhash64(F.lit(1), *told).alias(f"{name}1"), F.xxhash64(F.lit("second"), *reversed(told)).alias(f"{name}2")]


def capture_changes(before: DataFrame, after: DataFrame, key: str = "id", seq: int | None = None) -> DataFrame:
    """INSERT / UPDATE / DELETE events that turn ``before`` into ``after``.

    One full outer join on the key.  Of ``before`` only the key and two 64-bit
    digests of a row are shuffled, and of ``after`` those and the columns that
    are read from the events: two rows that differ pass as equal by a chance of
    about 2^-128.  Nested columns, whose hashes do not tell where a null
    stands, are carried whole and compared null-safe.  The payload is the whole
    new row.  ``seq`` (say, the number of the snapshot) makes them a feed that
    ``apply_changes`` takes: one snapshot changes an id once.
    """
    if seq is not None:
        return capture_changes(before, after, key).select(
            F.lit(seq).cast("long").alias("seq"), "operation", key, "data")
    cols = [c for c in after.columns if c != key]
    nested = [c for c in cols if any(isinstance(d.schema[c].dataType, NESTED) for d in (before, after))]
    # a column whose type changed compares as the common type of both, as a comparison of the structs would
    cast = [c for c in cols if c not in nested and before.schema[c].dataType != after.schema[c].dataType]
    flat = [c for c in cols if c not in nested and c not in cast]
    whole = F.struct(*[F.col(f"`{c}`") for c in (*nested, *cast)]) if nested or cast else F.lit(True)
    b = before.select(F.col(key).alias("_bk"), *row_digests(flat, "_b"), whole.alias("_bn"))
    a = after.select(F.col(key).alias("_ak"), *row_digests(flat, "_a"), whole.alias("_an"), F.struct(*cols).alias("_a"))
    j = b.join(a, b["_bk"] == a["_ak"], "full_outer")
    same = (F.col("_b1") == F.col("_a1")) & (F.col("_b2") == F.col("_a2")) & F.col("_bn").eqNullSafe(F.col("_an"))
    op = (F.when(F.col("_bk").isNull(), F.lit("INSERT"))
           .when(F.col("_ak").isNull(), F.lit("DELETE"))
           .when(~same, F.lit("UPDATE")))
    return (j.select(op.alias("operation"), F.coalesce("_ak", "_bk").alias(key),
                     F.col("_a").alias("data"))
             .where(F.col("operation").isNotNull()))


#: aim for the stored bytes of one key bucket
BUCKET_BYTES = 32 << 20


def key_buckets(*dfs: DataFrame) -> int:
    """Buckets of about ``BUCKET_BYTES`` for the largest of some frames, by the files under them; eight at least."""
    def stored(df):
        return sum(fs.getFileStatus(p).getLen() for fs, p in (_fs(df.sparkSession, f) for f in df.inputFiles()))

    return max(8, *(math.ceil(stored(df) / BUCKET_BYTES) for df in dfs))


def stored_by_key(df: DataFrame, buckets: int, key: str = "id") -> DataFrame:
    """``df`` written once in key buckets and read back, so that joins on the key shuffle none of its rows.

    Parquet holds a row in a third of the bytes of a shuffle or less.  The table
    is known to the session's catalog only while it is looked up.
    """
    spark, name = df.sparkSession, f"by_key_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", scratch_path(spark, name)).option("compression", "zstd").saveAsTable(name, format="parquet")
    stored = spark.table(name)
    stored.schema  # noqa: B018 - resolved before the name goes; the files stay
    spark.sql(f"DROP TABLE {name}")
    return stored


# ---------------------------------------------------------------------------
# Latest event per id and apply
# ---------------------------------------------------------------------------

def latest_changes(changes: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """Last event per id (C04 'last event wins', C06 state)."""
    payload = F.struct(*[F.col(c) for c in changes.columns if c != key])
    return (changes.groupBy(key).agg(F.max_by(payload, F.col(seq)).alias("_last"))
                   .select(key, "_last.*"))


ENRICHED = ("total_compensation", "compensation_range", "experience_level", "updated_at")


def live_rows(state: DataFrame) -> DataFrame:
    """The rows of a state that are not deleted, without their operation."""
    return state.where(F.coalesce(F.col("operation") != "DELETE", F.lit(True))).drop("operation")


def apply_changes(target: DataFrame | None, changes: DataFrame, key: str = "id",
                  enrich: bool = True, stamp: bool = False,
                  keep_tombstones: bool = True) -> DataFrame:
    """Upsert INSERT/UPDATE rows (enriched), mark DELETEs.

    ``target`` rows have the columns of ``data`` (+ ``seq`` and enrichment);
    ``None`` means an empty target.  The result is the new full state.  When
    the target carries ``seq``, its rows compete with the batch by sequence
    number, so an event older than the stored row does not overwrite it
    (batches arriving out of order).  Deleted ids stay as rows with
    ``operation = 'DELETE'`` (and NULL values), so that a late, older upsert
    cannot bring them back; ``live_rows`` gives the others.  Without
    ``keep_tombstones`` the result is those live rows, which forget deletes.
    ``stamp`` sets ``updated_at`` of the rows that a change touched (F15).
    """
    data_fields = [f.name for f in changes.schema["data"].dataType.fields]
    last = latest_changes(changes.select(key, "seq", "operation", "data"), key)
    fields = [f for f in data_fields if f != key]
    beyond = []
    if target is not None:
        # one join meets every stored row, whole, with the change of its id
        last = last.withColumn("_take", F.lit(True)).join(
            target.select(F.col(key).alias("_key"), F.struct(*target.columns).alias("_stored")), F.col(key) == F.col("_key"), "full_outer")
        beyond = [c for c in target.columns
                  if c not in {key, "seq", "operation", "_bucket", *fields, *(ENRICHED[:3] if enrich else ())}]
        take = F.coalesce("_take", F.lit(False))
        if "seq" in target.columns:
            # an event older than the stored row changes nothing
            take &= ~F.coalesce(F.col("_stored.seq") > F.col("seq"), F.lit(False))
        last = last.withColumn("_take", take)
    deleted = F.col("operation") == "DELETE"
    if not keep_tombstones:
        last = last.where(~deleted if target is None else ~F.col("_take") | ~deleted)
    rows = last.select(key, "seq", *(["operation"] if keep_tombstones else []),
                       *[F.col(f"data.{f}").alias(f) for f in fields],
                       # columns that the payload does not carry keep their stored values
                       *[F.when(~deleted, F.col(f"_stored.{c}")).alias(c) for c in beyond],
                       *(["_take", "_stored"] if target is not None else []))
    if enrich:
        rows = enrich_document(rows)
        if keep_tombstones:
            rows = rows.withColumns({c: F.when(~deleted, F.col(c)) for c in ENRICHED[:3]})
    if stamp:
        rows = touch_updated_at(rows)
    if target is None:
        return rows
    made = [c for c in rows.columns if c not in ("_take", "_stored")]

    def either(c):
        change = F.when(F.col("_take"), F.col(c)) if c in made else F.when(F.col("_take"), F.lit(None))
        return (change.otherwise(F.col(f"_stored.{c}")) if c in target.columns else change).alias(c)

    return rows.select(*map(either, [*target.columns, *[c for c in made if c not in target.columns]]))


def upsert_document(target: DataFrame, doc: DataFrame, key: str = "id") -> DataFrame:
    """Index one (or a few) documents by id: an UPDATE-only change set.

    The change takes the document's own ``seq`` or else the stored one (the
    upsert wins that tie), so later changes of the id still apply.
    """
    cols = [c for c in doc.columns if c != "seq"]
    seq = F.lit(0).cast("long")
    if "seq" in doc.columns:
        seq = F.col("seq")
    elif "seq" in target.columns:
        doc = doc.join(target.select(key, F.col("seq").alias("_seq")), key, "left")
        seq = F.coalesce(F.col("_seq"), seq)
    changes = doc.select(seq.alias("seq"), F.lit("UPDATE").alias("operation"),
                         F.col(key), F.struct(*cols).alias("data"))
    return apply_changes(target, changes, key, enrich=False, keep_tombstones="operation" in target.columns)


# ---------------------------------------------------------------------------
# Reconcile and accounting
# ---------------------------------------------------------------------------

def reconcile(source: DataFrame, target: DataFrame, key: str = "id") -> DataFrame:
    """Counts on both sides plus ids missing from / extra in the target."""
    s = source.select(F.col(key).alias("_s"))
    t = target.select(F.col(key).alias("_t"))
    j = s.join(t, s["_s"] == t["_t"], "full_outer")
    return j.agg(F.count("_s").alias("source_count"), F.count("_t").alias("target_count"),
                 F.count_if(F.col("_t").isNull()).alias("missing_in_target"),
                 F.count_if(F.col("_s").isNull()).alias("extra_in_target"))


def with_write_metrics(df: DataFrame, name: str, key: str = "id"):
    """Attach processed / failed counters (failed = no id) via ``observe``."""
    from pyspark.sql import Observation
    obs = Observation(name)
    observed = df.observe(obs, F.count(F.lit(1)).alias("processed"),
                          F.count_if(F.col(key).isNull()).alias("failed"))
    return observed, obs


# ---------------------------------------------------------------------------
# Snapshot export, document write, backfill
# ---------------------------------------------------------------------------

def export_snapshot(df: DataFrame, key: str = "id") -> DataFrame:
    """The table range-partitioned by id, each partition in id order.

    Writers consume partitions in parallel instead of paging with OFFSET, and
    cut them into batches of exactly the size they ask for (``write_documents``);
    the number of partitions follows the size of the data, not of a batch.
    """
    return df.repartitionByRange(key).sortWithinPartitions(key)


#: for very many small files: no checksum file beside each (on local disks Hadoop starts a process for every file it
#: makes; Parquet pages hold checksums of their own), and no dictionaries, which a batch is too short for
SMALL_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true",
               "parquet.enable.dictionary": "false"}


def write_documents(df: DataFrame, path: str, key: str = "id", mode: str = "overwrite", batch_rows: int = 0):
    """Write keyed search documents; returns (ok, failed) counts.

    Rows without an id are failures and are not written.  With ``batch_rows``
    no file holds more rows.
    """
    observed, obs = with_write_metrics(df, "documents", key)
    rows = observed.where(F.col(key).isNotNull()).write.mode(mode).option("maxRecordsPerFile", batch_rows)
    (rows.options(**SMALL_FILES) if batch_rows else rows).parquet(path)
    m = obs.get
    return m.get("processed", 0) - m.get("failed", 0), m.get("failed", 0)


def backfill_documents(pay: DataFrame, path: str, batch_rows: int = 1000):
    """Full copy of the table into the document store (N15 -> F14 -> N16)."""
    return write_documents(enrich_document(export_snapshot(pay)), path, batch_rows=batch_rows)


# ---------------------------------------------------------------------------
# Structured Streaming
# ---------------------------------------------------------------------------

def read_changes(spark: SparkSession, path: str, fmt: str = "json",
                 schema: T.StructType = CHANGE_SCHEMA, max_files: int | None = None) -> DataFrame:
    """The change feed as a stream of files (no socket, no port)."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


def committed_versions(spark: SparkSession, base: str) -> list[int]:
    """Batch ids with a completed (``_SUCCESS``) table version under ``base``."""
    fs, p = _fs(spark, base)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith("batch=") and fs.exists(
                spark.sparkContext._jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            out.append(int(name.split("=", 1)[1]))
    return sorted(out)


def current_state(spark: SparkSession, base: str, schema: T.StructType | None = None) -> DataFrame | None:
    vs = committed_versions(spark, base)
    if not vs:
        return None
    return live_rows(spark.read.parquet(f"{base.rstrip('/')}/batch={vs[-1]}"))


def versioned_upsert(base: str, key: str = "id"):
    """C05 batch function: new version = previous committed version + batch.

    Version ``batch=<id>`` is written in full; a replay of the same batch id
    rewrites the same version from the same inputs (idempotent), and readers
    only see versions whose ``_SUCCESS`` marker exists.  Deleted ids stay as
    tombstones, so an older event of a later batch does not bring them back;
    ``current_state`` reads the live rows.
    """
    def fn(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        prev_ids = [v for v in committed_versions(spark, base) if v < batch_id]
        prev = (spark.read.parquet(f"{base.rstrip('/')}/batch={prev_ids[-1]}")
                if prev_ids else None)
        new = apply_changes(prev, batch, key, stamp=True)
        new.write.mode("overwrite").parquet(f"{base.rstrip('/')}/batch={batch_id}")
    return fn


def bucket_of(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def bucketed_upsert(base: str, buckets: int = 64, key: str = "id"):
    """C05 batch function that rewrites only the id-hash buckets a batch touches.

    The table under ``base`` is partitioned by ``_bucket = pmod(xxhash64(id), B)``.
    A batch reads the touched buckets of the current table (partition
    pruning), applies its changes, stages the result under ``base/_staging``
    and swaps the touched partitions with a dynamic partition overwrite.
    Deleted ids stay as tombstones; read the live rows with ``bucketed_state``.
    Events carry whole rows, so applying a batch twice gives the same state
    (a replay after a failure is idempotent).  Untouched buckets are never
    read or written.
    """
    def fn(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        root = base.rstrip("/")
        batch = batch.withColumn("_bucket", bucket_of(key, buckets))
        touched = [r["_bucket"] for r in batch.select("_bucket").distinct().collect()]  # <= B ints
        if not touched:
            return
        prev = None
        if is_committed(spark, root):
            prev = (spark.read.parquet(root).where(F.col("_bucket").isin(touched)))
        new = apply_changes(prev.drop("_bucket") if prev is not None else None,
                            batch.drop("_bucket"), key, stamp=True)
        new = new.withColumn("_bucket", bucket_of(key, buckets))
        staging = f"{root}/_staging/batch={batch_id}"
        new.write.mode("overwrite").parquet(staging)
        staged = spark.read.parquet(staging)
        # touched buckets whose rows were all deleted are emptied explicitly
        empty = [b for b in touched if b not in {r["_bucket"] for r in
                                                  staged.select("_bucket").distinct().collect()}]
        fs, _ = _fs(spark, root)
        jvm = spark.sparkContext._jvm
        for b in empty:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/_bucket={b}"), True)
        prev_mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            staged.write.mode("overwrite").partitionBy("_bucket").parquet(root)
        finally:
            spark.conf.set("spark.sql.sources.partitionOverwriteMode", prev_mode)
        # a dynamic overwrite commits partitions only; mark the table readable
        fs.create(jvm.org.apache.hadoop.fs.Path(f"{root}/_SUCCESS"), True).close()
        fs.delete(jvm.org.apache.hadoop.fs.Path(staging), True)
    return fn


def compact_tombstones(spark: SparkSession, base: str, before_seq: int) -> int:
    """Drop tombstones with ``seq < before_seq`` from a bucketed table.

    Only buckets holding such tombstones are rewritten (staged, then swapped
    with a dynamic partition overwrite).  Call it once no event older than
    ``before_seq`` can still arrive.  Returns the number of rewritten buckets.
    """
    root = base.rstrip("/")
    t = spark.read.parquet(root)
    old = (F.col("operation") == "DELETE") & (F.col("seq") < before_seq)
    buckets = [r["_bucket"] for r in t.where(old).select("_bucket").distinct().collect()]
    if not buckets:
        return 0
    staging = f"{root}/_staging/compact-{before_seq}"
    t.where(F.col("_bucket").isin(buckets) & ~old).write.mode("overwrite").parquet(staging)
    staged = spark.read.parquet(staging)
    fs, _ = _fs(spark, root)
    jvm = spark.sparkContext._jvm
    kept = {r["_bucket"] for r in staged.select("_bucket").distinct().collect()}
    for b in buckets:
        if b not in kept:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/_bucket={b}"), True)
    prev_mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        staged.write.mode("overwrite").partitionBy("_bucket").parquet(root)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", prev_mode)
    fs.create(jvm.org.apache.hadoop.fs.Path(f"{root}/_SUCCESS"), True).close()
    fs.delete(jvm.org.apache.hadoop.fs.Path(staging), True)
    return len(buckets)


def bucketed_state(spark: SparkSession, base: str) -> DataFrame:
    """Live rows of a bucketed table (tombstones and the bucket column removed)."""
    return live_rows(spark.read.parquet(base).drop("_bucket"))


def stream_changes(changes: DataFrame, base: str, checkpoint: str, key: str = "id",
                   available_now: bool = True, processing_time: str | None = None,
                   buckets: int | None = 64):
    """Keep the document table current from a change stream.

    ``buckets=B`` rewrites only the touched id-hash buckets (``bucketed_upsert``,
    read by ``bucketed_state``); ``buckets=None`` writes a full new version per
    batch (``versioned_upsert``, read by ``current_state``), for small tables.
    """
    fn = versioned_upsert(base, key) if buckets is None else bucketed_upsert(base, buckets, key)
    w = (changes.writeStream.foreachBatch(fn)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "1 minute")
    return w.start()


def latest_state(changes: DataFrame, key: str = "id") -> DataFrame:
    """Current event per id as streaming state (update/complete mode)."""
    return latest_changes(changes, key)


def streaming_overview(stream: DataFrame, value: str = "annual_base_pay",
                       by: str | None = None, approx: bool = True) -> DataFrame:
    """Dashboard numbers kept fresh by a streaming aggregation.

    Exact count / sum / min / max; with ``approx`` also approximate median
    and distinct ids (exact versions of those are not streaming-capable).
    """
    aggs = [F.count(F.lit(1)).alias("total_records"),
            F.sum(F.col(value)).alias("sum_value"),
            F.min(value).alias("min_value"), F.max(value).alias("max_value")]
    if approx:
        aggs += [F.percentile_approx(value, 0.5, 10000).alias("approx_median"),
                 F.approx_count_distinct("id").alias("approx_ids")]
    g = stream.groupBy(by) if by else stream.groupBy()
    return g.agg(*aggs)


def _overwrite_sink(path: str):
    def fn(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)
    return fn


def start_overview_stream(stream: DataFrame, path: str, checkpoint: str,
                          every: str = "5 minutes", value: str = "annual_base_pay",
                          by: str | None = None):
    """Keep the dashboard numbers fresh; the complete result is rewritten
    to ``path`` on every trigger (default every 5 minutes)."""
    agg = streaming_overview(stream, value=value, by=by, approx=True)
    return (agg.writeStream.outputMode("complete").foreachBatch(_overwrite_sink(path))
               .option("checkpointLocation", checkpoint).trigger(processingTime=every).start())


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> None:
    """Run a streaming aggregation to completion and write its last result."""
    def fn(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)
    q = (df.writeStream.outputMode(mode).foreachBatch(fn)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()

