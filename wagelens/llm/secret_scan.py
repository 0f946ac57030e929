"""Secret scan: fixed patterns, and a character convolutional network beside them.

Base spans (leftmost, non-overlapping within a kind; a match that fails its
length is dropped after it was consumed): ``assign``, ``access`` and ``hex``.
The network sees every candidate, a run of 16 or more token characters, in a
window of ``WINDOW`` characters with its surroundings (a longer candidate is
seen by windows over all of it, the highest counts).  It is trained in numpy
on labelled findings (a candidate that overlaps a base span is positive),
calibrated by Platt scaling on findings it was not trained on, and its
threshold is the highest, to ``1 / BINS`` of a logit, that keeps a recall of
``RECALL`` there.  Candidates over the threshold that overlap no base span are
added as kind ``model``; base spans always stay.

All documents are read for findings.  A quarter of the findings, by hash, is
held apart; of the others the ``SAMPLE`` of least hash a label train the
network (equal findings of equal rows once).  Calibration and threshold come
from histograms of the scores of all findings held apart, over all their
windows, which Spark adds up.

Defined cases: null text is empty and has no spans; very long texts are read
whole; without findings of both labels no span is added; repeated rows give
equal rows; an empty table gives an empty result; other columns are not read.
Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared, small_batches, table

#: the base patterns (fixed values)
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
KINDS = ("assign", "access", "hex", "model")

#: every access or hex span lies inside such a run
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")

#: findings a label that train the network
SAMPLE = 2000
WINDOW, BEFORE = 64, 20
WIDTH, FILTERS, EMBED = 5, 16, 8
RECALL = 0.95
#: bins a logit of the score histograms, and the greatest logit told apart
BINS, MOST_LOGIT = 1000, 60
EPOCHS, BATCH, RATE = 8, 64, 0.01
#: windows scored at once, and all that a task holds of them
SCORED = 2048


def base_spans(text: str, candidates: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base findings."""
    out = []
    if "=" in text or ":" in text:
        for m in ASSIGN.finditer(text):
            if len(m.group(2)) >= LEAST_ASSIGN:
                out.append((m.start(), 0, m.end()))
    for a, b in candidates:
        token = text[a:b]
        if "AKIA" in token:
            out += [(a + m.start(), 1, a + m.end()) for m in ACCESS.finditer(token) if m.end() - m.start() >= LEAST_ACCESS]
        if b - a >= LEAST_HEX:
            out += [(a + m.start(), 2, a + m.end()) for m in HEX.finditer(token) if m.end() - m.start() >= LEAST_HEX]
    out.sort()
    return out


def candidates_of(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text)]


def windows_of(text: str, a: int, b: int) -> list[np.ndarray]:
    """Code points (128 for any beyond ASCII, 0 outside the text) around and all over a candidate."""
    return list(each_window(text, a, b))


def each_window(text: str, a: int, b: int):
    """The windows of ``windows_of``, one after the other."""
    step = WINDOW - 2 * BEFORE
    for at in range(a - BEFORE, max(a - BEFORE, b + BEFORE - WINDOW) + step, step):
        piece = text[max(0, at):max(0, at + WINDOW)]
        code = np.frombuffer(piece.encode("utf-32-le", "replace"), np.uint32)
        line = np.zeros(WINDOW, np.uint8)
        left = max(0, -at)
        line[left:left + len(code)] = np.minimum(code, 128)
        yield line
        if at + WINDOW >= b + BEFORE:
            break


class CharNet:
    """Embedding, one convolution, maximum over places, one logit; and its calibration."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w = {"e": rng.normal(0, 0.5, (129, EMBED)), "c": rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)),
                  "b": np.zeros(FILTERS), "o": rng.normal(0, FILTERS ** -0.5, FILTERS), "z": np.zeros(1)}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 2.0

    def forward(self, x: np.ndarray):
        places = WINDOW - WIDTH + 1
        e = self.w["e"][x]
        cols = np.concatenate([e[:, j:j + places] for j in range(WIDTH)], axis=2)
        h = cols @ self.w["c"] + self.w["b"]
        at = h.argmax(axis=1)
        top = np.take_along_axis(h, at[:, None], 1)[:, 0]
        return np.maximum(top, 0) @ self.w["o"] + self.w["z"][0], (cols, at, top)

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.w.items()}
        square = {k: np.zeros_like(v) for k, v in self.w.items()}
        weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum())) * len(y)
        t = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for i in range(0, len(x), BATCH):
                rows = order[i:i + BATCH]
                logit, (cols, at, top) = self.forward(x[rows])
                d = (1 / (1 + np.exp(-logit)) - y[rows]) * weight[rows] / len(rows)
                act = np.maximum(top, 0)
                grad = {"o": act.T @ d, "z": np.array([d.sum()])}
                dtop = d[:, None] * self.w["o"] * (top > 0)
                grad["b"] = dtop.sum(0)
                picked = np.take_along_axis(cols, at[:, :, None], 1)  # row, filter, input
                grad["c"] = np.einsum("rf,rfi->if", dtop, picked)
                dcols = np.einsum("rf,if->rfi", dtop, self.w["c"]).reshape(len(rows), FILTERS, WIDTH, EMBED)
                grad["e"] = np.zeros_like(self.w["e"])
                for j in range(WIDTH):
                    np.add.at(grad["e"], x[rows][np.arange(len(rows))[:, None], at + j], dcols[:, :, j])
                t += 1
                for k in self.w:
                    mean[k] += 0.1 * (grad[k] - mean[k])
                    square[k] += 0.001 * (grad[k] ** 2 - square[k])
                    self.w[k] -= RATE * (mean[k] / (1 - 0.9 ** t)) / (np.sqrt(square[k] / (1 - 0.999 ** t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Calibration and threshold from windows, each a finding."""
        logit, _ = self.forward(x)
        self.settle(logit, y, np.ones(len(y)))

    def settle(self, logit: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
        """Platt scaling on ``n`` findings a logit, then the highest of these logits with the recall asked for."""
        n = n / n.sum()
        a, b = 1.0, 0.0
        for _ in range(500):
            p = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
            a -= 0.05 * float(((p - y) * logit * n).sum()) / (1 + float((logit ** 2 * n).sum()))
            b -= 0.5 * float(((p - y) * n).sum())
        self.scale, self.shift = max(a, 1e-3), b
        order = np.argsort(logit[y == 1], kind="stable")
        below = np.cumsum(n[y == 1][order])
        least = logit[y == 1][order][np.searchsorted(below, (1 - RECALL) * below[-1], "right")]
        self.threshold = float(self.scaled(np.array([least]))[0])

    def scaled(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logit + self.shift, -30, 30)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        logit, _ = self.forward(x)
        return self.scaled(logit)


def overlapping(spans):
    """Whether (a, b) overlaps one of the spans, which are in order of start: a search, not a pass over them."""
    starts, reach = [s for s, _, _ in spans], list(accumulate((e for _, _, e in spans), max))

    def overlaps(a: int, b: int) -> bool:
        i = bisect_left(starts, b)
        return i > 0 and reach[i - 1] > a
    return overlaps


def _found(batch):
    """(label, order, windows, held apart) of all findings of a batch."""
    for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
        text = text or ""
        cands = candidates_of(text)
        if not cands:
            continue
        overlaps = overlapping(base_spans(text, cands))
        for a, b in cands:
            order = hashlib.md5(f"{doc_id}:{a}:{text[max(0, a - BEFORE):a + WINDOW]}".encode("utf-8", "replace")).hexdigest()
            yield int(overlaps(a, b)), order, (text, a, b), int(order[-8:], 16) % 4 == 0


def _least(batches):
    """The findings of least hash a label among those that train, of the task's documents."""
    kept: list[dict] = [{}, {}]
    bound = ["~", "~"]
    for batch in batches:
        for label, order, place, apart in _found(batch):
            if not apart and order < bound[label]:
                kept[label][order] = windows_of(*place)[0].tobytes()
                if len(kept[label]) >= 2 * SAMPLE:
                    first = sorted(kept[label])[:SAMPLE]
                    kept[label], bound[label] = {o: kept[label][o] for o in first}, first[-1]
    rows = [(label, o, kept[label][o]) for label in (0, 1) for o in sorted(kept[label])[:SAMPLE]]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()),
                                      pa.array([r[2] for r in rows], pa.binary())], names=["label", "o", "code"])


def _histogram(sent):
    """(label, bin, n): the highest logits of all findings held apart."""
    def run(batches):
        net, total = sent.value, {}
        labels, tops, owner, lines = [], [], [], []

        def scored():
            if lines:
                for at, x in zip(owner, net.forward(np.array(lines))[0]):
                    tops[at] = max(tops[at], x)
            owner.clear()
            lines.clear()

        for batch in batches:
            for label, _, place, apart in _found(batch):
                if not apart:
                    continue
                if len(labels) == SCORED:
                    scored()
                    _add(total, labels, tops)
                    labels.clear()
                    tops.clear()
                labels.append(label)
                tops.append(-np.inf)
                for line in each_window(*place):
                    owner.append(len(tops) - 1)
                    lines.append(line)
                    if len(lines) == SCORED:
                        scored()
        scored()
        _add(total, labels, tops)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total], pa.int32()),
                                          pa.array(list(total.values()), pa.int64())], names=["label", "bin", "n"])
    return run


def _add(total: dict, labels, logits) -> None:
    for label, x in zip(labels, logits):
        key = label, int(np.floor(np.clip(x, -MOST_LOGIT, MOST_LOGIT) * BINS))
        total[key] = total.get(key, 0) + 1


def train(docs: DataFrame) -> CharNet | None:
    """A network from the findings of all documents, or None without both labels on both sides."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = shared(rows.mapInArrow(_least, "label int, o string, code binary"), "findings").dropDuplicates(["label", "o"])
    kept = found.where("label = 1").orderBy("o").limit(SAMPLE).union(found.where("label = 0").orderBy("o").limit(SAMPLE)).collect()
    kept.sort(key=lambda r: (-r["label"], r["o"]))
    x = np.array([np.frombuffer(bytes(r["code"]), np.uint8) for r in kept]).reshape(-1, WINDOW)
    y = np.array([r["label"] for r in kept])
    if min(y.sum(), (1 - y).sum()) < 1:
        return None
    net = CharNet()
    net.fit(x, y)
    sent = docs.sparkSession.sparkContext.broadcast(net)
    apart = rows.mapInArrow(_histogram(sent), "label int, bin int, n long").groupBy("label", "bin").agg(F.sum("n").alias("n")).collect()
    y = np.array([r["label"] for r in apart])
    if min(y.sum(), (1 - y).sum()) < 1:
        return None
    net.settle(np.array([r["bin"] for r in apart]) / BINS, y, np.array([r["n"] for r in apart], float))
    return net


def _scan(sent):
    def run(batches):
        net = sent.value
        for batch in batches:
            ids, texts = batch["doc_id"], [t or "" for t in batch["text"].to_pylist()]
            all_base, asked, lines = [], [], []
            added: dict[int, set] = {}

            def scored():
                for (i, a, b), q in zip(asked, net.probability(np.array(lines)) if lines else ()):
                    if q >= net.threshold:
                        added.setdefault(i, set()).add((a, 3, b))
                asked.clear()
                lines.clear()

            for i, text in enumerate(texts):
                cands = candidates_of(text)
                base = base_spans(text, cands)
                all_base.append(base)
                if net is None:
                    continue
                overlaps = overlapping(base)
                for a, b in cands:
                    if overlaps(a, b):  # a base span says it already
                        continue
                    for line in each_window(text, a, b):
                        asked.append((i, a, b))
                        lines.append(line)
                        if len(lines) == SCORED:
                            scored()
            scored()
            say = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
            yield pa.RecordBatch.from_arrays(
                [ids, *[pa.array([sum(k == kind for _, k, _ in s) for s in all_base], pa.int64()) for kind in range(3)],
                 pa.array([hashlib.sha256(say(s).encode()).hexdigest() for s in all_base], pa.string()),
                 pa.array([say(sorted([*s, *added.get(i, ())])) for i, s in enumerate(all_base)], pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
    return run


def scan(docs: DataFrame, net: CharNet | None) -> DataFrame:
    """Spans of every row of (doc_id, text)."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(net)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _scan(sent), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(docs))
