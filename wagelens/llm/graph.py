"""Connected components of a link table by alternating large and small stars.

Both steps group by node with a map-side minimum, so a node with very many
links costs one partial row per task; no component is ever gathered.  Each
round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each neighbour of a node to the least node around it.

    Large star: the neighbours greater than the node; small star: the smaller
    ones and the node itself.
    """
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:  # from the greater end to the smaller
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.where("u <> m").select("u", F.col("m").alias("v"))
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(own)


def components(links: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(node, component): the least node reachable, for every node with a link.

    ``links`` may hold repeats, both directions and self links; nulls are
    ignored.  An empty table gives an empty result.  Raises after ``most``
    rounds (the rounds grow with the logarithm of the number of nodes).
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = shared(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    for _ in range(most):
        edges = shared(_star(_star(edges, True), False).where("u <> v").distinct(), "star")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (now["n"], now["s"]) == before:
            break
        before = (now["n"], now["s"])
    else:
        raise RuntimeError("components: no fixed point")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
