"""Driver Parquet tables and the ``pay`` adapter over them.

The survey CSVs of the original service are not shipped, so the canonical
``pay`` columns are derived from the TPC-H-like tables:

    lineitem JOIN part JOIN supplier JOIN nation JOIN region

Join strategy: nation and region are dimension tables of a fixed, tiny size;
they are broadcast only after a bounded row count proves it.  part and
supplier grow with the scale factor, so their joins are left to Catalyst /
AQE, which broadcast them only when the measured size is under
``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffle (sort-merge)
on the key.  supplier is joined to its (tiny) geography first so the fact
side meets one supplier dimension instead of three tables.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import _fs, compiled, is_committed, scratch_path

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

#: dimension row bound under which an explicit broadcast hint is applied
BROADCAST_ROW_BOUND = 100_000


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def spread(df: DataFrame) -> DataFrame:
    """Give a narrow scan enough tasks for per-row work.

    A big input arrives as many file splits and this is a no-op.  A small
    input written as one Parquet row group scans in a single task however
    many splits it is cut into, and everything pipelined after the scan
    (broadcast joins, parsing, tokenizing) would run on one core; such an
    input is redistributed round-robin to the cluster's parallelism.
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str, spread_rows: bool = False) -> DataFrame:
    compiled(spark)
    df = spark.read.parquet(table_path(sf_dir, name))
    return spread(df) if spread_rows else df


_SIZE_PROOFS: dict[tuple, bool] = {}


def has_at_most(df: DataFrame, max_rows: int, cache_key: tuple | None = None) -> bool:
    """Bounded size proof: reads at most ``max_rows + 1`` rows.

    ``cache_key`` (e.g. the file path and its modification time) lets a
    session reuse a proof for an unchanged input.
    """
    if cache_key is not None and (cache_key, max_rows) in _SIZE_PROOFS:
        return _SIZE_PROOFS[(cache_key, max_rows)]
    ok = df.limit(max_rows + 1).count() <= max_rows
    if cache_key is not None:
        _SIZE_PROOFS[(cache_key, max_rows)] = ok
    return ok


def input_stamp(spark: SparkSession, paths: list[str]) -> str:
    """Names, lengths and times of the files under some paths, on any file system, as a short digest."""
    found = []
    for path in paths:
        fs, p = _fs(spark, path)
        files = fs.listFiles(p, True) if fs.exists(p) else None
        while files is not None and files.hasNext():
            f = files.next()
            found.append(f"{f.getPath().toString()}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.sha256("|".join(sorted(found)).encode()).hexdigest()[:16]


def _file_key(path: str) -> tuple | None:
    try:
        return (path, os.path.getmtime(path))
    except OSError:
        return None  # not a local path: prove again each time


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROW_BOUND,
                      path: str | None = None) -> DataFrame:
    """Broadcast ``df`` only when it provably has at most ``max_rows`` rows;
    otherwise hand it back untouched so the join shuffles."""
    key = _file_key(path) if path else None
    return F.broadcast(df) if has_at_most(df, max_rows, key) else df


def money_cents(c: Column) -> Column:
    """Dollar double -> cents (round half up, positive values)."""
    return F.round(c * 100).cast("long")


def supplier_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = bounded_broadcast(read_table(spark, sf_dir, "nation")
                               .select("n_nationkey", "n_name", "n_regionkey"),
                               path=table_path(sf_dir, "nation"))
    region = bounded_broadcast(read_table(spark, sf_dir, "region").select("r_regionkey", "r_name"),
                               path=table_path(sf_dir, "region"))
    return (supplier
            .join(nation, supplier.s_nationkey == nation.n_nationkey)
            .join(region, nation.n_regionkey == region.r_regionkey)
            .select("s_suppkey", "s_name", "n_name", "r_name"))


def pay_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical pay columns over the driver tables (lazy plan)."""
    li = read_table(spark, sf_dir, "lineitem", spread_rows=True)
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    geo = supplier_geo(spark, sf_dir)
    j = (li.join(part, li.l_partkey == part.p_partkey)
           .join(geo, li.l_suppkey == geo.s_suppkey))
    base = money_cents(F.col("l_extendedprice"))
    return j.select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in
                           ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                    base.cast("string")).alias("id"),
        F.lit("lineitem").alias("source_file"),
        F.col("l_shipdate").alias("timestamp"),
        F.col("s_name").alias("employer"),
        F.col("p_brand").alias("industry"),
        F.col("n_name").alias("location"),
        F.col("r_name").alias("country"),
        F.concat(F.col("p_type"), F.lit(" "), F.col("p_name")).alias("job_title"),
        F.col("l_returnflag").alias("gender"),
        F.col("l_linestatus").alias("employment_type"),
        F.col("l_quantity").alias("years_experience_industry"),
        F.col("p_size").cast("double").alias("years_experience_company"),
        base.alias("annual_base_pay"),
        F.when(F.col("l_discount") > 0,
               money_cents(F.col("l_extendedprice") * F.col("l_discount"))).alias("annual_bonus"),
        F.when(F.col("l_tax") > 0,
               money_cents(F.col("l_extendedprice") * F.col("l_tax"))).alias("stock_value"),
    )


PAY_INPUTS = ("lineitem", "part", "supplier", "nation", "region")


def write_once(spark: SparkSession, name: str, inputs: list[str], write: Callable[[str], None], last: str = "") -> str:
    """A folder under the shared checkpoint folder that ``write`` fills once per version of the input files.

    The name holds the digest of the input files, so a changed input gives a
    new folder; only a folder whose write committed (``_SUCCESS``, of its part
    ``last`` where it has several) is used.
    """
    path = scratch_path(spark, f"{name}-{input_stamp(spark, inputs)}")
    if not is_committed(spark, path + last):
        write(path)
    return path


def pay_inputs(sf_dir: str) -> list[str]:
    return [table_path(sf_dir, t) for t in PAY_INPUTS]


def materialized_pay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pay table written once per input version (``write_once``).

    The canonical table is loaded once and queried many times, as in the
    survey service.  Queries then scan Parquet with column pruning and filter
    pushdown instead of re-running the five-table join.
    """
    compiled(spark)
    path = write_once(spark, "pay", pay_inputs(sf_dir),
                      lambda out: pay_table(spark, sf_dir).write.mode("overwrite").parquet(out))
    key = (spark.sparkContext.applicationId, path)
    if key not in _READERS:
        _READERS[key] = spark.read.parquet(path)
    return _READERS[key]


_READERS: dict[tuple, DataFrame] = {}


#: the same adapter as SQL text; runs unchanged in Spark SQL and DuckDB
PAY_SQL = """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice*100) AS bigint)) AS id,
  'lineitem' AS source_file, l_shipdate AS timestamp,
  s_name AS employer, p_brand AS industry, n_name AS location, r_name AS country,
  concat(p_type, ' ', p_name) AS job_title, l_returnflag AS gender, l_linestatus AS employment_type,
  l_quantity AS years_experience_industry,
  CAST(p_size AS double) AS years_experience_company,
  CAST(round(l_extendedprice*100) AS bigint) AS annual_base_pay,
  CASE WHEN l_discount > 0 THEN CAST(round(l_extendedprice*l_discount*100) AS bigint) END AS annual_bonus,
  CASE WHEN l_tax > 0 THEN CAST(round(l_extendedprice*l_tax*100) AS bigint) END AS stock_value
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def with_pay(sql_body: str) -> str:
    """Wrap an oracle query so that it can read a ``pay`` relation."""
    return f"WITH pay AS (\n{PAY_SQL}\n)\n{sql_body}"
