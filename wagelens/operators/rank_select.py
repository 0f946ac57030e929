"""Exact grouped percentiles straight from the rows, without a copy of them.

``percentile_cont`` semantics as in ``percentiles.py``, which works on a
histogram; here the rows themselves are scanned, and only counts are shuffled.

The groups to evaluate are known first (keys, ``_n`` rows, ``_min``, ``_max``).

* Where every group has at most ``SMALL`` rows, or values within a range of
  ``SMALL``, Spark's exact ``percentile`` is used over the rows of the chosen
  groups: its map of values is bounded by ``SMALL`` entries a group.
* Otherwise each group starts with one bracket, its least and greatest value,
  that holds all target ranks.  A round scans the rows inside the brackets and
  counts them by bin (map-side combined, a hot group is spread over its bins):
  the first bins are logarithmic, so that an outlier does not widen them, later
  ones divide the bracket evenly, and a bracket of ``BINS`` values or less has
  one bin a value.  The bin that holds a rank becomes its next bracket, cut to
  the least and greatest value in it.  Money takes two or three rounds.

No task holds more than ``BINS`` rows of a bracket, whatever the group's size,
and values may be of any size and sign.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reuse
from ..sources.tables import bounded_broadcast

#: different values of a group up to which they may meet in one task
SMALL = 1 << 18
#: bins of a bracket at most
BINS = 1 << 16
#: logarithmic bins per factor of e, in the first round
LOG_BINS = 256
#: groups up to which the chosen ones are kept on the driver (a report's top k)
FEW = 1000


def settle(df: DataFrame, few: bool) -> DataFrame:
    """Evaluate once: some rows as a local relation, more in the shared checkpoint folder."""
    if few:
        return df.sparkSession.createDataFrame(df.toArrow(), df.schema)
    return reuse(df)


def _on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> list[Column]:
    return [left[k].eqNullSafe(right[f"_g{i}"]) for i, k in enumerate(keys)]


def _renamed(groups: DataFrame, keys: Sequence[str], *rest: str | Column, few: bool) -> DataFrame:
    g = groups.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)], *rest)
    return F.broadcast(g) if few else bounded_broadcast(g)


def _targets(n: Column, probs: Sequence[float]) -> Column:
    """Ranks floor and ceil of (n - 1) p per fraction, as array<struct<t, r>>."""
    out = []
    for i, p in enumerate(probs):
        place = (n - 1).cast("double") * F.lit(float(p))
        out += [F.struct(F.lit(2 * i).alias("t"), F.floor(place).cast("long").alias("r")),
                F.struct(F.lit(2 * i + 1).alias("t"), F.ceil(place).cast("long").alias("r"))]
    return F.array(*out)


def narrow(rows: DataFrame, brackets: DataFrame, keys: Sequence[str], few: bool, first: bool) -> DataFrame:
    """One round: (keys, _lo, _hi, _targets) with every bracket cut to the bins that hold its ranks."""
    b = _renamed(brackets, keys, "_lo", "_hi", "_targets", few=few)
    ends = b.drop("_targets")  # an array among the counts would have every row sorted
    met = rows.join(ends, [*_on(rows, ends, keys), F.col("_v").between(F.col("_lo"), F.col("_hi"))])
    at, width = F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo") + 1
    wide = (F.floor(F.log1p(at.cast("double")) * LOG_BINS) if first
            else F.floor(at.cast("double") / width.cast("double") * BINS))
    bins = (met.select(*[rows[k] for k in keys], "_lo", "_v",
                       F.when(width <= BINS, at).otherwise(wide).cast("long").alias("_bin"))
            .groupBy(*keys, "_lo", "_bin")
            .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most")))
    order = Window.partitionBy(*keys, "_lo").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = bins.withColumn("_upto", F.sum("_c").over(order)).withColumn("_before", F.col("_upto") - F.col("_c"))
    ranks = b.select(*[F.col(f"_g{i}").alias(f"_h{i}") for i in range(len(keys))], F.col("_lo").alias("_from"), "_targets")
    cut = cut.join(ranks, [*[cut[k].eqNullSafe(ranks[f"_h{i}"]) for i, k in enumerate(keys)], cut["_lo"] == ranks["_from"]])
    held = F.filter("_targets", lambda x: (x["r"] >= F.col("_before")) & (x["r"] < F.col("_upto")))
    return (cut.withColumn("_held", held).where(F.size("_held") > 0)
            .select(*[cut[k] for k in keys], F.col("_least").alias("_lo"), F.col("_most").alias("_hi"),
                    F.transform("_held", lambda x: F.struct(x["t"].alias("t"), (x["r"] - F.col("_before")).alias("r"))).alias("_targets")))


def row_percentiles(df: DataFrame, keys: Sequence[str], value: Column, groups: DataFrame,
                    probs: Sequence[float], names: Sequence[str], *, scale: float = 1.0,
                    few: bool = False, small: int = SMALL) -> DataFrame:
    """keys + one double column per fraction: exact ``percentile_cont`` of an integral ``value``.

    ``groups`` (keys, ``_n``, ``_min``, ``_max``) are the groups to evaluate; it should be settled.
    ``few``: at most ``FEW`` groups.  Null values count nowhere.
    """
    keys = list(keys)
    rows = df.select(*keys, value.cast("long").alias("_v")).where(F.col("_v").isNotNull())
    most = groups.agg(F.max(F.least(F.col("_n"), F.col("_max") - F.col("_min") + 1))).first()[0] or 0
    if most <= small:
        g = _renamed(groups, keys, few=few)
        q = (rows.join(g, _on(rows, g, keys), "left_semi").groupBy(*keys)
             .agg(F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs])).alias("_q")))
        return q.select(*keys, *[(F.col("_q")[i] / F.lit(float(scale))).alias(n) for i, n in enumerate(names)])
    wanted = groups.where(F.col("_n") > 0).select(
        *keys, F.col("_min").alias("_lo"), F.col("_max").alias("_hi"), _targets(F.col("_n"), probs).alias("_targets"))
    done, first = None, True
    while True:
        found = settle(narrow(rows, wanted, keys, few, first), few)
        exact = found.where(F.col("_lo") == F.col("_hi"))
        done = exact if done is None else done.unionByName(exact)
        wanted, first = found.where(F.col("_lo") < F.col("_hi")), False
        if wanted.isEmpty():
            break
    ranks = done.select(*keys, (F.col("_lo").cast("double") / F.lit(float(scale))).alias("_x"), F.explode("_targets").alias("_t"))
    at = lambda t: F.max(F.when(F.col("_t.t") == t, F.col("_x")))
    ends = ranks.groupBy(*keys).agg(*[at(t).alias(f"_x{t}") for t in range(2 * len(probs))])
    g = _renamed(groups, keys, F.col("_n").alias("_rows"), few=few)
    ends = ends.join(g, _on(ends, g, keys))

    def between(i: int, p: float) -> Column:
        place = (F.col("_rows") - 1).cast("double") * F.lit(float(p))
        return F.col(f"_x{2 * i}") + (F.col(f"_x{2 * i + 1}") - F.col(f"_x{2 * i}")) * (place - F.floor(place))

    return ends.select(*[ends[k] for k in keys], *[between(i, p).alias(n) for i, (p, n) in enumerate(zip(probs, names))])
