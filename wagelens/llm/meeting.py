"""Where signatures meet: packed exchange, buckets, exact checks and blocks.

Shared by the operators that join sets by signatures.  Entries (signature,
node) leave the tasks packed in blobs, one row a task and slice of the
signature space, with repeats of a signature inside a task folded to one: a hot
signature costs a row per task.  Small buckets give all their pairs; a large
one gives the links to its least member, and members that are still in
different components are compared in blocks of ``block`` x ``block``.  ``cut``
gives the sets of a column of texts, in order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, shared, signed

#: signatures that a task packs at once, and the aim for one slice of the space
PACK, SLICE = 1_500_000, 400_000


def pack(sign: np.ndarray, node: np.ndarray, slices: int):
    """Rows (slice, single, several).

    ``single`` has the first node of each signature seen here, dealt by the
    signature.  ``several`` has all nodes of those with two or more here; they
    have met already and are dealt by signature and node over slices of their
    own, so that no task gets all sets of a hot signature.
    """
    order = np.lexsort((node, sign))
    sign, node = sign[order], node[order]
    new = np.ones(len(sign), bool)
    new[1:] = (sign[1:] != sign[:-1]) | (node[1:] != node[:-1])
    sign, node = sign[new], node[new]
    head = np.ones(len(sign), bool)
    head[1:] = sign[1:] != sign[:-1]
    group = np.cumsum(head) - 1
    several = (np.bincount(group) > 1)[group] if len(group) else np.zeros(0, bool)
    n = np.uint64(slices)
    rows = [(k, b"", both) for k, both in _dealt(slices + (mix(sign[several] ^ node[several]) % n).astype(np.int64), sign[several], node[several])]
    rows += [(k, one, b"") for k, one in _dealt((sign[head] % n).astype(np.int64), sign[head], node[head])]
    ids, single, both = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(single, pa.binary()), pa.array(both, pa.binary())],
                                      names=["slice", "single", "several"])


def _dealt(where: np.ndarray, sign: np.ndarray, node: np.ndarray):
    """(slice, blob) for every slice in ``where``."""
    order = np.argsort(where, kind="stable")
    sign, node, where = sign[order], node[order], where[order]
    edges = np.flatnonzero(np.diff(where, prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(where)]):
        yield int(where[a]), sign[a:b].tobytes() + node[a:b].tobytes()


def unpack(blobs) -> tuple[np.ndarray, np.ndarray]:
    signs, nodes = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for b in blobs:
        x = np.frombuffer(b, np.uint64)
        signs.append(x[:len(x) // 2])
        nodes.append(x[len(x) // 2:])
    return np.concatenate(signs), np.concatenate(nodes)


def meet(t: pa.Table) -> pa.Table:
    """All entries of the slice's signatures that have at least two nodes."""
    sign, node = unpack(t["single"].to_pylist())
    order = np.lexsort((node, sign))
    sign, node = sign[order], node[order]
    new = np.ones(len(sign), bool)
    new[1:] = (sign[1:] != sign[:-1]) | (node[1:] != node[:-1])
    sign, node = sign[new], node[new]
    head = np.ones(len(sign), bool)
    head[1:] = sign[1:] != sign[:-1]
    group = np.cumsum(head) - 1
    keep = (np.bincount(group) > 1)[group] if len(group) else np.zeros(0, bool)
    more_sign, more_node = unpack(t["several"].to_pylist())
    both = np.stack([np.concatenate([sign[keep], more_sign]), np.concatenate([node[keep], more_node])], axis=1)
    both = np.unique(both, axis=0) if len(both) else both
    return pa.table({"sign": pa.array(signed(both[:, 0])), "node": pa.array(signed(both[:, 1]))})


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    if min(len(x), len(y)) * den < num * max(len(x), len(y)):
        return False
    both = len(x) + len(y) - len(np.union1d(x, y))
    return den * both >= num * (len(x) + len(y) - both)


def sets_by_node(nodes, texts: pa.Array, cut) -> dict:
    """Sets of the distinct nodes of a batch (each text is cut up once)."""
    place: dict[int, int] = {}
    for i, node in enumerate(nodes):
        place.setdefault(node, i)
    return dict(zip(place, cut(texts.take(pa.array(list(place.values()), pa.int64())))))


def verify(cut, num: int, den: int):
    def run(batches):
        for batch in batches:
            a, b = batch["a"].to_pylist(), batch["b"].to_pylist()
            sets = sets_by_node(a + b, pa.concat_arrays([batch["text_a"], batch["text_b"]]), cut)
            kept = [(x, y) for x, y in zip(a, b) if linked(sets[x], sets[y], num, den)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in kept], pa.int64()), pa.array([y for _, y in kept], pa.int64())], names=["a", "b"])
    return run


def block_links(cut, num: int, den: int):
    """Links between the two sides of a block (inside one side where they are the same), as a spanning forest."""
    def run(t: pa.Table) -> pa.Table:
        nodes = t["node"].to_pylist()
        comps = t["component"].to_pylist()
        sides = t["side"].to_pylist()
        own = t["i"][0].as_py() == t["j"][0].as_py()
        texts = t["text"].combine_chunks()
        sets = list(cut(texts))
        size = np.array([len(s) for s in sets])
        everything = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), size)
        values, column = np.unique(everything, return_inverse=True)
        seen = np.bincount(column, minlength=len(values))
        column_of = np.cumsum(seen > 1) - 1  # an element of one set only is in no intersection
        keep = seen[column] > 1
        owner, column = owner[keep], column_of[column[keep]]
        both = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            x, y = np.searchsorted(column, [low, low + 4096])
            grid = np.zeros((len(sets), 4096), np.float32)
            grid[owner[x:y], column[x:y] - low] = 1
            both += grid @ grid.T
        both = both.astype(np.int64)
        hit = den * both >= num * (size[:, None] + size[None, :] - both)
        root = {c: c for c in comps}

        def find(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out = []
        for x, y in zip(*np.nonzero(np.triu(hit, 1))):
            if not own and sides[x] == sides[y]:
                continue
            cx, cy = find(comps[x]), find(comps[y])
            if cx != cy:
                root[max(cx, cy)] = min(cx, cy)
                out.append((nodes[x], nodes[y]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})
    return run


def close_marks(most: int):
    """Rows of a block that have a partner on the other side, in another component, whose marks differ in at most ``most`` places."""
    def run(t: pa.Table) -> pa.Table:
        own = t["i"][0].as_py() == t["j"][0].as_py()
        m1, m2, comp, side = (t[c].to_numpy() for c in ("m1", "m2", "component", "side"))
        keep = np.zeros(len(t), bool)
        for x in range(len(t)):
            near = np.bitwise_count(((m1 ^ m1[x]) | (m2 ^ m2[x])).view(np.uint64)) <= most
            keep[x] = (near & (comp != comp[x]) & (own | (side != side[x]))).any()
        return t.select(["hub", "i", "j", "node", "component", "side"]).filter(pa.array(keep))
    return run


def blocks(large: DataFrame, comps: DataFrame, texts: DataFrame, cut, num: int, den: int, block: int, sieve: tuple | None = None) -> DataFrame:
    """Links between members of large buckets that are still in different components.

    Buckets with the same least member (hub) are one group: two sets that share
    a bucket share its hub, so no pair is missed, and the many signatures of a
    family of similar sets fold into few groups.  A group is cut into blocks,
    and each pair of its blocks is compared by one task group.  ``sieve``: marks
    (node, m1, m2) and the places in which two linked sets may differ; texts are
    fetched only for rows that pass ``close_marks``.
    """
    placed = large.select("hub", "node").distinct().join(comps, "node", "left").select("hub", "node", F.coalesce("component", "node").alias("component"))
    counted = placed.groupBy("hub", "component").agg(F.count("*").alias("n"))
    sizes = (counted.groupBy("hub").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("size")).where("size > main.n")
             .select("hub", F.col("main.component").alias("main"), F.ceil(F.col("main.n") / F.lit(block)).cast("int").alias("m"),
                     F.ceil((F.col("size") - F.col("main.n")) / F.lit(block)).cast("int").alias("r")))
    # blocks 0 to m - 1 hold the largest component, m to m + r - 1 the rest
    rest, h = F.col("component") != F.col("main"), F.xxhash64("node")
    side = F.when(rest, F.col("m") + F.pmod(h, F.col("r"))).otherwise(F.pmod(h, F.col("m"))).cast("int")
    others = F.sequence(F.when(rest, F.lit(0)).otherwise(F.col("m")), F.col("m") + F.col("r") - 1)
    sided = (placed.join(sizes, "hub").select("hub", "node", "component", side.alias("side"), F.explode(others).alias("o"))
             .select("hub", "node", "component", "side", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j")))
    if sieve:
        marks, most = sieve
        sided = (sided.join(marks, "node").groupBy("hub", "i", "j")
                 .applyInArrow(close_marks(most), "hub long, i int, j int, node long, component long, side int"))
    sided = shared(sided, "sided")
    return (sided.join(texts, "node").groupBy("hub", "i", "j")
            .applyInArrow(block_links(cut, num, den), "a long, b long"))
