"""Exact grouped percentiles (``percentile_cont``) without one-task groups.

Spark's built-in ``percentile`` keeps a value->count map per group and merges
it in one task, so a hot group (say a third of all rows) puts all of its
distinct values into one task's memory.  Here the values are integral and
of either sign (money in cents, experience in hundredths; they are shifted by
the least of the histogram, whose range sets the number of levels), and the k-th
smallest value of every group is found by radix selection:

1. ``hist``: rows aggregated to (keys, value, count) -- map-side partial
   aggregation, then a shuffle on (keys, value) which spreads a hot group.
2. For every group and requested rank, the value is built digit by digit
   (``digit_bits`` bits per level).  A level aggregates the histogram to
   (keys, prefix, digit) -> count, joins it with the open targets on
   (keys, prefix) and runs a cumulative sum over at most ``2**digit_bits``
   digits per (group, target).  No task ever holds more than that many rows
   of one group, whatever the group size.

``percentile_cont`` semantics: with ``n`` rows and fraction ``p``,
``pos = (n - 1) * p``; the result interpolates the values at ranks
``floor(pos)`` and ``ceil(pos)`` (0-based) as ``lo + (hi - lo) * (pos - floor(pos))``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: default value width: covers cents up to 1.1e12 (> the 99,999,999,999 cap)
MONEY_BITS = 40
#: hundredths of experience years (DECIMAL(5,2) -> < 100000)
HUNDREDTHS_BITS = 17


def value_histogram(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """(keys, _u, _c): rows per group and exact integral value."""
    return (df.select(*keys, value.cast("long").alias("_u"))
              .where(F.col("_u").isNotNull())
              .groupBy(*keys, "_u")
              .agg(F.count(F.lit(1)).alias("_c")))


def _key_match(left: DataFrame, right: DataFrame, keys: Sequence[str], rkeys: Sequence[str]):
    return [left[k].eqNullSafe(right[r]) for k, r in zip(keys, rkeys)]


def select_ranks(hist: DataFrame, targets: DataFrame, keys: Sequence[str], *,
                 value_bits: int = MONEY_BITS, digit_bits: int = 20,
                 broadcast_targets: bool = False, shift_by: int = 0) -> DataFrame:
    """Value at 0-based rank ``_r`` for each target row.

    ``hist``: (keys, _u, _c).  ``targets``: (keys, _t, _r, ...extra) with
    ``_t`` unique per group.  Returns (keys, _t, ...extra, _v).
    ``broadcast_targets`` is for callers that have a proven bound on the
    number of target rows (e.g. the top-k groups of a report).
    """
    keys = list(keys)
    levels = max(1, -(-value_bits // digit_bits))
    mask = (1 << digit_bits) - 1
    rkeys = [f"_k{i}" for i in range(len(keys))]
    if shift_by:
        hist = hist.withColumn("_u", F.col("_u") - F.lit(shift_by))
    extra = [c for c in targets.columns if c not in set(keys) | {"_t", "_r"}]
    cur = targets.select(*[F.col(k).alias(r) for k, r in zip(keys, rkeys)],
                         "_t", "_r", *extra, F.lit(0).cast("long").alias("_p"))
    guard = F.when(F.col("_u") >= F.lit(1 << (levels * digit_bits)),
                   F.raise_error(F.lit(f"percentile value exceeds {levels * digit_bits} bits")))
    for level in range(levels):
        shift = (levels - 1 - level) * digit_bits
        lvl = hist.select(*keys,
                          F.coalesce(guard.cast("long"),
                                     F.shiftright("_u", shift + digit_bits)).alias("_pre"),
                          F.shiftright("_u", shift).bitwiseAND(F.lit(mask)).alias("_d"),
                          F.col("_c").alias("_dc"))
        if shift > 0:
            # (keys, value) is unique in hist, so only upper levels aggregate
            lvl = lvl.groupBy(*keys, "_pre", "_d").agg(F.sum("_dc").alias("_dc"))
        right = F.broadcast(cur) if broadcast_targets else cur
        cond = _key_match(lvl, right, keys, rkeys) + [lvl["_pre"] == right["_p"]]
        j = lvl.join(right, cond).select(*[lvl[k] for k in keys], "_t", "_r", *extra,
                                         "_p", "_d", "_dc")
        w = (Window.partitionBy(*keys, "_t").orderBy("_d")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        j = j.withColumn("_cum", F.sum("_dc").over(w))
        before = F.col("_cum") - F.col("_dc")
        cur = (j.where((before <= F.col("_r")) & (F.col("_r") < F.col("_cum")))
                .select(*[F.col(k).alias(r) for k, r in zip(keys, rkeys)], "_t",
                        (F.col("_r") - before).alias("_r"), *extra,
                        F.shiftleft("_p", digit_bits).bitwiseOR(F.col("_d")).alias("_p")))
    return cur.select(*[F.col(r).alias(k) for k, r in zip(keys, rkeys)], "_t", *extra,
                      (F.col("_p") + F.lit(shift_by)).alias("_v"))


def percentile_targets(groups: DataFrame, keys: Sequence[str], probs: Sequence[float],
                       n_col: str = "_n") -> DataFrame:
    """Two rank targets (floor and ceil of (n-1)p) per group and fraction."""
    qs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"))
                   for i, p in enumerate(probs)])
    t = (groups.select(*keys, F.col(n_col).alias("_n"), F.explode(qs).alias("_q"))
               .withColumn("_pos", (F.col("_n") - 1).cast("double") * F.col("_q.p")))
    sides = F.array(F.struct(F.lit(0).alias("s"), F.floor("_pos").cast("long").alias("r")),
                    F.struct(F.lit(1).alias("s"), F.ceil("_pos").cast("long").alias("r")))
    return (t.select(*keys, "_q", "_pos", F.explode(sides).alias("_side"))
             .select(*keys,
                     (F.col("_q.i") * 2 + F.col("_side.s")).alias("_t"),
                     F.col("_side.r").alias("_r"),
                     (F.col("_pos") - F.floor("_pos")).alias("_frac")))


def grouped_percentiles(hist: DataFrame, groups: DataFrame, keys: Sequence[str],
                        probs: Sequence[float], names: Sequence[str], *, scale: float = 1.0,
                        value_bits: int | None = None, digit_bits: int = 20,
                        n_col: str = "_n", bounded_groups: bool = False) -> DataFrame:
    """keys + one double column per fraction: exact ``percentile_cont``.

    ``groups`` holds the groups to evaluate (keys + ``n_col`` row count);
    groups absent from it are skipped, so a top-k report only pays for k
    groups.  Values are divided by ``scale`` before interpolation.  Without
    ``value_bits`` the width comes from the histogram's least and greatest
    value; with it values must lie in [0, 2 ** width).
    """
    keys = list(keys)
    if bounded_groups and keys:
        # only the histogram rows of the few selected groups enter the levels
        # (a broadcast semi-join bounded by the number of groups, e.g. top-k)
        gk = F.broadcast(groups.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)]))
        hist = hist.join(gk, [hist[k].eqNullSafe(gk[f"_g{i}"]) for i, k in enumerate(keys)],
                         "left_semi")
    targets = percentile_targets(groups, keys, probs, n_col)
    low = 0
    if value_bits is None:
        least, most = hist.agg(F.min("_u"), F.max("_u")).first()
        low = least or 0
        value_bits = max(1, ((most or 0) - low).bit_length())
    picked = select_ranks(hist, targets, keys, value_bits=value_bits, digit_bits=digit_bits,
                          broadcast_targets=bounded_groups, shift_by=low)
    v = F.col("_v").cast("double") / F.lit(float(scale))
    aggs = []
    for i, name in enumerate(names):
        lo = F.max(F.when(F.col("_t") == 2 * i, v))
        hi = F.max(F.when(F.col("_t") == 2 * i + 1, v))
        frac = F.max(F.when(F.col("_t") == 2 * i, F.col("_frac")))
        aggs.append((lo + (hi - lo) * frac).alias(name))
    return picked.groupBy(*keys).agg(*aggs)
