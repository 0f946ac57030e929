"""SparkSession construction and shared settings."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# Session settings every job in this package relies on.  Timestamps are
# compared across engines, so the session time zone is pinned to UTC.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpointed intermediates are removed once their RDD is released
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "wagelens", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    On a cluster this is whatever the deployment names in
    ``spark.checkpoint.dir`` (a shared filesystem).  Only where it is unset
    on a local master (tests) a fresh scratch folder is created and
    registered; any other master without it is an error, since executors do
    not share a machine-local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        try:
            d = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            d = None
    if not d:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="wagelens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A named location under the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def is_committed(spark: SparkSession, path: str) -> bool:
    """A table folder whose write finished (``_SUCCESS`` marker present)."""
    return path_exists(spark, path.rstrip("/") + "/_SUCCESS")


def compiled(spark: SparkSession) -> None:
    """Keep generated methods within 8,000 bytes of code.

    The JVM only interprets longer methods, some ten times slower; over this
    size Spark compiles an operator at a time instead of a whole stage.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def computed(df, *columns, keep: tuple[str, ...] = ("*",)):
    """The ``keep`` columns of ``df`` and more columns, evaluated once a row.

    Columns of a plain ``select`` are put into every later expression that
    names them, filters above all, and evaluated again there; nothing is moved
    below a generator.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*columns))))


def reuse(df):
    """Write ``df`` once to the shared checkpoint folder and read it back.

    For an intermediate that several branches of one plan consume (the value
    histogram of the statistics): without it each branch re-scans and
    re-shuffles, because filters inferred per branch keep Spark from reusing
    the exchange.  ``checkpoint`` is reliable (shared storage) and cuts the
    lineage, so a lost executor does not recompute the scan either.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df, name: str):
    """``reuse`` as Parquet with zstd: for many rows that are read by columns, a fraction of a checkpoint's bytes."""
    path, schema = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}"), df.schema
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
