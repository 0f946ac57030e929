"""N-gram Jaccard join by PartEnum signatures (exact).

A document is the set of its distinct n-word shingles.  Two sets link when
their Jaccard similarity reaches ``threshold``; the result names the connected
component of every document.

Method.  Set sizes are cut into bands.  For two sets of sizes a, b the
similarity bound allows at most (1-t)/(1+t)*(a+b) elements in one set only.
Every band, and every border between two bands, has an instance: the hashed
feature domain is cut into ``n1`` groups of ``n2`` parts.  With at most k
differing elements some group has at most ``k2 = n2 - subset`` of them, so a
subset of its parts agrees in full: its projection is the shared signature.
A set in reach of a border signs the border's instance too.  Empty projections
are left out where the group count has slack enough to do without them, and
kept otherwise, so no link is lost.

Work.  Equal sets fold into one node first.  Signatures meet as ``meeting``
says (links leave a block as a spanning forest).  Pairs that sizes or parity
bitmaps rule out go before texts are read.  No bucket is capped, and no group
is held whole by one task.

Defined cases: null text is empty; an empty set links with nothing and is its
own component; rows with null doc_id are returned with a null component and
take no part; repeated rows and repeated ids give one row each; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from functools import lru_cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, released, shared, signed, small_batches, table, text_bytes, text_sets, chunks_of
from .graph import components
from .meeting import PACK, SLICE, blocks, meet, pack, verify

#: sizes of a band reach from one bound to this multiple of it
BAND_RATIO = 1.5
#: buckets of at most so many sets give all their pairs
SMALL_BUCKET = 8
#: sets on one side of a block comparison
BLOCK = 256
#: bits of the parity bitmap of a set
PARITY_BITS = 1024


class PartEnum:
    """Instances and signatures for a threshold num/den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def differing(self, total: int) -> int:
        """Most elements in one set only, for sizes that add up to ``total``."""
        return (self.den - self.num) * total // (self.den + self.num)

    def largest_partner(self, size: int) -> int:
        return size * self.den // self.num

    @lru_cache(maxsize=None)
    def bands(self, most: int) -> tuple[int, ...]:
        out = [1]
        while out[-1] <= most:
            out.append(max(out[-1] + 1, int(out[-1] * BAND_RATIO)))
        return tuple(out)

    @lru_cache(maxsize=None)
    def instances(self, size: int) -> tuple[tuple[int, int, int], ...]:
        """(id, k, least size) of the instances that a set of this size signs."""
        bounds = self.bands(1 << max(4, (2 * self.largest_partner(size)).bit_length()))
        i = next(j for j, low in enumerate(bounds) if bounds[j + 1] > size)
        low, high = bounds[i], bounds[i + 1] - 1
        found = [(2 * i, self.differing(2 * high), low)]
        reach = self.largest_partner(high)
        if self.largest_partner(size) > high:  # some partner lies in a higher band
            found.append((2 * i + 1, self.differing(high + reach), low))
        below = 1
        while below <= i:  # partners in lower bands
            top = bounds[i - below + 1] - 1
            if self.largest_partner(top) < size:
                break
            far = self.largest_partner(top)
            found.append((2 * (i - below) + 1, self.differing(top + far), bounds[i - below]))
            below += 1
        return tuple(x for x in found if x[1] >= 1)  # k = 0: equal sets only

    @lru_cache(maxsize=None)
    def shape(self, k: int, least: int) -> tuple[int, int, int, int]:
        """n1, n2, k2 and the slack in groups."""
        n2, k2 = (3, 1) if k <= 16 else (1, 0)
        need = k // (k2 + 1) + 1
        weak = math.exp(-least * (n2 - k2) / (need * n2)) * (n2 if k2 else 1)
        slack = math.ceil(1.5 * need * weak) + 2 if need > 4 else 0
        return need + slack, n2, k2, slack

    @lru_cache(maxsize=4096)
    def plan(self, instance: int, k: int, least: int):
        n1, n2, k2, slack = self.shape(k, least)
        subsets = np.array(list(combinations(range(n2), n2 - k2)))
        key = mix(np.arange(n1 * len(subsets), dtype=np.uint64) + np.uint64(instance + 1) * np.uint64(1 << 40))
        return n1, n2, slack, subsets, key

    def count(self, size: int) -> int:
        """How many signatures a set of this size has, about."""
        if size == 0:
            return 0
        return sum(n1 * math.comb(n2, k2) for n1, n2, k2, _ in (self.shape(k, low) for _, k, low in self.instances(size)))

    def signatures(self, elements: np.ndarray) -> list[np.ndarray]:
        """Signatures of a sorted set of hashes, an array for each instance."""
        out = []
        if len(elements) == 0:
            return out
        body = mix(elements ^ np.uint64(0x5851F42D4C957F2D))
        top = elements >> np.uint64(32)
        for instance, k, least in self.instances(len(elements)):
            n1, n2, slack, subsets, key = self.plan(instance, k, least)
            part = ((top * np.uint64(n1 * n2)) >> np.uint64(32)).astype(np.int64)
            at = np.flatnonzero(np.diff(part, prepend=-1))
            sums, full = np.zeros(n1 * n2, np.uint64), np.zeros(n1 * n2, bool)
            sums[part[at]] = np.add.reduceat(body, at)
            full[part[at]] = True
            if n2 == 1:
                projected, some = sums, full
            else:
                # the parts of a subset keep their places: each is mixed with its own
                placed = mix(sums.reshape(n1, n2) + np.arange(1, n2 + 1, dtype=np.uint64))
                projected = placed[:, subsets].sum(axis=2, dtype=np.uint64).ravel()
                some = full.reshape(n1, n2)[:, subsets].any(axis=2).ravel()
            sign = mix(projected + key)
            weak = n1 - int(some.reshape(n1, -1).all(axis=1).sum())
            out.append(sign[some] if weak <= slack else sign)
        return out


# -- one row a document ------------------------------------------------------

FINGERPRINT = "doc_id long, text_hash long, n_shingles long, f1 long, f2 long, n_signatures long, parity binary"


def _fingerprints(n: int, scheme: PartEnum):
    def run(batches):
        for batch in batches:
            rows = []
            with np.errstate(over="ignore"):
                for s in text_sets(batch["text"], n):
                    rows.append((len(s), mix(mix(s).sum(dtype=np.uint64) + np.uint64(len(s))) if len(s) else 0,
                                 mix((s * np.uint64(0xD1342543DE82EF95) ^ (s >> np.uint64(29))).sum(dtype=np.uint64)) if len(s) else 0,
                                 scheme.count(len(s)), _parity(s)))
            cols = list(zip(*rows)) if rows else [(), (), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text_hash"], pa.array(cols[0], pa.int64()),
                 pa.array(signed(np.array(cols[1], np.uint64))), pa.array(signed(np.array(cols[2], np.uint64))),
                 pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.binary())],
                names=["doc_id", "text_hash", "n_shingles", "f1", "f2", "n_signatures", "parity"])
    return run


def _parity(s: np.ndarray) -> bytes:
    """Which of ``PARITY_BITS`` classes hold an odd number of elements.

    Elements in both of two sets cancel out, so two bitmaps differ in at most
    as many bits as there are elements in one set only.
    """
    place = (mix(s) >> np.uint64(40)).astype(np.int64) % PARITY_BITS
    return np.packbits(np.bincount(place, minlength=PARITY_BITS) & 1).tobytes()


def _plausible(scheme: PartEnum):
    """Pairs whose sizes and parity bitmaps allow a link."""
    def run(batches):
        for batch in batches:
            na, nb = (batch[c].to_numpy(zero_copy_only=False) for c in ("na", "nb"))
            x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint64).reshape(len(na), PARITY_BITS // 64) for c in ("pa", "pb"))
            apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            keep = (apart <= scheme.differing(na + nb)) & (np.minimum(na, nb) * scheme.den >= scheme.num * np.maximum(na, nb))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep))
    return run


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))


def _node(s: np.ndarray) -> np.uint64:
    return mix(mix(s).sum(dtype=np.uint64) + np.uint64(len(s)))


# -- signatures --------------------------------------------------------------

def _signing(n: int, scheme: PartEnum, slices: int):
    def run(batches):
        signs, nodes, held = [], [], 0
        with np.errstate(over="ignore"):
            for batch in batches:
                for s in text_sets(batch["text"], n):
                    if len(s) == 0:
                        continue
                    node = _node(s)
                    for x in scheme.signatures(s):
                        signs.append(x)
                        nodes.append(np.full(len(x), node, np.uint64))
                        held += len(x)
                    if held >= PACK:
                        yield pack(np.concatenate(signs), np.concatenate(nodes), slices)
                        signs, nodes, held = [], [], 0
            if held:
                yield pack(np.concatenate(signs), np.concatenate(nodes), slices)
    return run


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, component_hash) for every row of ``docs`` (doc_id, text).

    ``component_id``: the least doc_id reachable by links of similarity of at
    least num/den on n-word shingles, itself included; ``component_hash``: the
    least text hash of that doc_id in the component.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scheme, cut = PartEnum(num, den), partial(text_sets, n=n)
    keyed = _keyed(docs)
    prints = shared(keyed.mapInArrow(released(_fingerprints(n, scheme)), FINGERPRINT), "fingerprints")

    # one node for each distinct set, named by its fingerprint; its least row stands for it
    classes = shared(prints.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("f1", "f2", "n_shingles")
                     .agg(F.min(F.struct("doc_id", "text_hash")).alias("r"), F.max("n_signatures").alias("n_signatures"),
                          F.max("parity").alias("parity"))
                     .select("f1", "f2", "n_shingles", F.col("r.doc_id").alias("doc_id"),
                             F.col("r.text_hash").alias("text_hash"), "n_signatures", "parity"), "classes")
    total = classes.agg(F.sum("n_signatures")).first()[0] or 0
    slices = max(64, math.ceil(total / SLICE))

    packed = keyed.where("doc_id IS NOT NULL").select("text").mapInArrow(
        released(_signing(n, scheme, slices)), "slice int, single binary, several binary")
    met = shared(packed.groupBy("slice").applyInArrow(meet, "sign long, node long"), "met")

    buckets = met.groupBy("sign").agg(F.count("*").alias("size"), F.min("node").alias("hub"))
    small = shared(met.join(buckets.where(f"size <= {SMALL_BUCKET}").select("sign"), "sign")
                   .groupBy("sign").agg(F.sort_array(F.collect_set("node")).alias("nodes"))
                   .select("nodes").distinct(), "small")
    large = shared(met.join(buckets.where(f"size > {SMALL_BUCKET}"), "sign"), "large")
    pairs = (small.select(F.explode("nodes").alias("a"), "nodes").select("a", F.explode("nodes").alias("b")).where("a < b")
             .union(large.select(F.col("hub").alias("a"), F.col("node").alias("b")).where("a <> b")).distinct())
    marks = classes.select("f1", "n_shingles", "parity")
    near = (pairs.join(marks.toDF("a", "na", "pa"), "a").join(marks.toDF("b", "nb", "pb"), "b").select("a", "b", "na", "nb", "pa", "pb")
            .mapInArrow(released(_plausible(scheme)), "a long, b long"))
    near = shared(near, "near")
    texts = _texts(keyed, classes, near.select(F.explode(F.array("a", "b")).alias("node")).union(large.select("node")))

    checked = (near.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
               .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
               .mapInArrow(released(verify(cut, num, den)), "a long, b long"))
    links = shared(checked, "pairs")
    comps = shared(components(links), "components")

    if large.head(1):
        more = shared(blocks(large, comps, texts, cut, num, den, BLOCK), "blocks")
        if more.head(1):
            comps = shared(components(links.union(more)), "components")

    # a class has the least document of its component
    named = classes.join(comps.withColumnRenamed("node", "f1"), "f1", "left").select(
        "f1", "f2", "n_shingles", "doc_id", "text_hash", F.coalesce("component", "f1").alias("component"))
    least = named.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("r"))
    named = named.join(least, "component").select(
        "f1", "f2", "n_shingles", F.col("r.doc_id").alias("component_id"), F.col("r.text_hash").alias("component_hash"))
    return (prints.join(named, ["f1", "f2", "n_shingles"], "left")
            .select("doc_id", "text_hash", "n_shingles",
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component_hash", "text_hash")).alias("component_hash")))


def _texts(keyed: DataFrame, classes: DataFrame, met: DataFrame) -> DataFrame:
    """(node, text) of the sets named in ``met``."""
    wanted = classes.select(F.col("f1").alias("node"), "doc_id", "text_hash").join(
        met.select("node").distinct(), "node", "left_semi")
    found = keyed.join(wanted, ["doc_id", "text_hash"]).select("node", "text")
    return shared(found.dropDuplicates(["node"]), "texts")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on 3-word shingles; links where 100 * common >= 90 * union."""
    return jaccard_components(table(spark, sf_dir, "documents"), 3, 90, 100).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """``docs`` with one row of each component: its least doc_id and, within that, least text hash; of repeated rows, one.

    Texts that share a doc_id count each for itself.  Rows with a null doc_id stay.
    """
    found = jaccard_components(docs, n, num, den).where("doc_id = component_id AND text_hash = component_hash").select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                      F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_hash"))
    kept = own.join(found, ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"]).select("_id", "_hash", "row")
    return kept.union(own.where("_id IS NULL").select("_id", "_hash", "row")).select("row.*")
