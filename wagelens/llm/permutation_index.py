"""Approximate nearest neighbours by a permutation index.

A vector is represented by its ``LISTED`` nearest pivots in order.  Rows are
dealt into blocks of about ``BLOCK`` rows; inside a block every pivot has an
inverted file (posting: row, place of the pivot in the row's order).  A query
walks the files of its own pivots, which gives Spearman's footrule between the
two truncated orders for every row; the best ``SHARE`` of the block's rows
(``LEAST`` at least) are reranked by exact distance.  Pivots are fitted on a
bounded sample (the ``PIVOTS`` distinct vectors of least id hash among the
first ``SAMPLE``); every row is indexed and every query meets every block.

Defined cases: rows with a null id, a null, empty or zero vector, or a null or
non-finite component take no part; identical rows count once; vectors meet
only vectors of their own length; fewer candidates than asked give them all;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared, table

PIVOTS, LISTED, SAMPLE = 256, 128, 2048
BLOCK, QUERY_GROUP = 4096, 1024
SHARE, LEAST = 0.08, 200


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v, dim) of the rows that take part, in double precision."""
    v = F.col("v")
    return (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
            .where(F.col("id").isNotNull() & v.isNotNull())
            .where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
            .where(F.exists("v", lambda x: x != 0))
            .dropDuplicates().withColumn("dim", F.size("v")).withColumn("h", F.xxhash64("id", "v")))


def _matrix(col: pa.ChunkedArray, rows: int) -> np.ndarray:
    arr = col.combine_chunks()
    return np.asarray(arr.flatten(), np.float64).reshape(rows, -1)


def _places(x: np.ndarray, pivots: np.ndarray, listed: int) -> np.ndarray:
    """Per row and pivot ``listed`` minus the pivot's place; 0 where it is not listed."""
    d = (pivots ** 2).sum(1)[None, :] - 2 * x @ pivots.T
    order = np.argsort(d, axis=1, kind="stable")[:, :listed]
    out = np.zeros(d.shape, np.int16)
    np.put_along_axis(out, order, (listed - np.arange(order.shape[1])).astype(np.int16)[None, :], axis=1)
    return out


def _search(pivots_by_dim, listed: int, share: float, least: int, k: int):
    def run(data: pa.Table, queries: pa.Table) -> pa.Table:
        found_q, found_h, found_id, found_s = [], [], [], []
        if data.num_rows and queries.num_rows:
            data = data.sort_by([("id", "ascending"), ("h", "ascending")])
            x, q = _matrix(data["v"], data.num_rows), _matrix(queries["qv"], queries.num_rows)
            ids, hashes = data["id"].to_numpy(), data["h"].to_numpy()
            q_ids, q_hashes = queries["qid"].to_numpy(), queries["qh"].to_numpy()
            pivots = pivots_by_dim.value.get(x.shape[1])
            most = max(least, math.ceil(share * len(x)))
            files = None
            if pivots is not None and most < len(x):
                gain_x, gain_q = _places(x, pivots, listed), _places(q, pivots, listed)
                files = [(rows := np.flatnonzero(g), g[rows]) for g in gain_x.T]  # posting lists
            for i in range(len(q)):
                if files is None:
                    rows = np.arange(len(x))
                else:
                    # footrule = constant - 2 * sum over common pivots of listed - max(places)
                    score = np.zeros(len(x), np.int32)
                    for p in np.flatnonzero(gain_q[i]):
                        at, g = files[p]
                        score[at] += np.minimum(g, gain_q[i, p])
                    rows = np.argsort(-score, kind="stable")[:most + 1]
                rows = rows[(ids[rows] != q_ids[i]) | (hashes[rows] != q_hashes[i])]
                dist = np.sqrt(((x[rows] - q[i]) ** 2).sum(axis=1))
                best = np.lexsort((ids[rows], dist))[:k]
                found_q += [q_ids[i]] * len(best)
                found_h += [q_hashes[i]] * len(best)
                found_id.append(ids[rows[best]])
                found_s.append(dist[best])
        cat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        return pa.table({"query_id": pa.array(found_q, pa.int64()), "qh": pa.array(found_h, pa.int64()),
                         "vec_id": pa.array(cat(found_id, np.int64)), "score": pa.array(cat(found_s, np.float64))})
    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query row (``is_query`` on column id)."""
    spark = vectors.sparkSession
    rows = shared(usable(vectors, id_col, vec_col), "vectors")
    sizes = {r["dim"]: (r["n"], r["q"]) for r in rows.groupBy("dim").agg(
        F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).collect()}
    pivots: dict[int, list] = {}
    for r in rows.orderBy("h").limit(SAMPLE).select("dim", "v").collect():
        own = pivots.setdefault(r["dim"], [])
        if len(own) < PIVOTS and r["v"] not in own:
            own.append(r["v"])
    sent = spark.sparkContext.broadcast({d: np.array(p) for d, p in pivots.items() if len(p) >= 16})

    plan = spark.createDataFrame(
        [(d, math.ceil(n / BLOCK), max(1, math.ceil(q / QUERY_GROUP))) for d, (n, q) in sizes.items()],
        "dim int, blocks int, groups int")
    dealt = rows.join(F.broadcast(plan), "dim")  # a row for each vector length
    data = (dealt.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "h"), F.col("blocks")))
            .select("dim", "block", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), "id", "h", "v"))
    queries = (dealt.where(is_query)
               .select(F.col("dim").alias("qdim"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("qblock"),
                       F.pmod(F.xxhash64(F.lit(2), "h"), F.col("groups")).cast("int").alias("qg"),
                       F.col("id").alias("qid"), F.col("h").alias("qh"), F.col("v").alias("qv")))
    found = data.groupBy("dim", "block", "g").cogroup(queries.groupBy("qdim", "qblock", "qg")).applyInArrow(
        _search(sent, LISTED, SHARE, LEAST, k), "query_id long, qh long, vec_id long, score double")
    near = Window.partitionBy("query_id", "qh").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op10_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors whose id is divisible by 100 against all others."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
