"""Language-model scores from a causal self-attention model on subword ids.

A text is its words (A-Z lowered) and one end.  Words are cut into subwords by
longest match against a public byte-level vocabulary (a file whose path is a
parameter; nothing of it is trained or copied).  The probability of a word is

    P(class | context) * P(word | class)

A class is a set of leading subwords (``CLASSES``, one of them the end).  The
first factor is a causal self-attention model over the leading subword ids of
the words before, trained in numpy; texts are scored in windows of ``WINDOW``
positions that overlap by ``OVERLAP``, so each token is scored once, with
``OVERLAP`` tokens of context at least, in batches with a causal mask.  The
second factor comes from counts over all training documents: a frequent word
by its share of its class, any other word by the class's share of infrequent
words and a bigram model of its subwords.  All factors are (sub)normalised, so
``score`` is a log10 probability.

Counts are of all tokens; they are added up in each task and then by Spark.
The ``TABLE`` most frequent words and subword pairs are broadcast (a fixed
bound); the counts of all other words, which the base score needs, and of all
other pairs meet the texts in a shuffle of packed keys.  The attention weights are learned from all training documents:
the tasks step through all their windows from the same weights, and Spark adds up what they arrive at (``fit``).
A softmax over classes is one over ``GROUPS`` groups and one over the classes of a group.

Defined cases: null text is empty and scores its end; a null doc_id is never
held out and never learned from; without training documents every count is 0
and the model is uniform; repeated rows give equal rows; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import copy
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, chunks_of, shared, signed, small_batches, table, text_bytes
from .language_id import held_out

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
FOLDS = 10
TABLE = 1 << 18
CLASSES, GROUPS, INPUTS, WIDTH = 192, 12, 512, 16
WINDOW, OVERLAP = 32, 8
ROUNDS, STEPS, BATCH, RATE = 3, 120, 256, 0.01
FIXED = 1 << 20  # parts of a weight that sums keep
LONGEST = 8  # bytes of the longest subword used
START, STOP = 65534, 65535
SLICE = 2_000_000
_MASKS = [np.uint64((1 << (8 * n)) - 1) for n in range(1, 8)] + [np.uint64(2 ** 64 - 1)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Subwords:
    """Longest-match segmentation against a vocabulary file (lines: base64 bytes, id)."""

    def __init__(self, path: str):
        by_length: dict[int, list] = {n: [] for n in range(1, LONGEST + 1)}
        with open(path, "rb") as f:
            for line in f:
                piece, ident = line.split()
                piece = base64.b64decode(piece)
                if len(piece) <= LONGEST:
                    by_length[len(piece)].append((int.from_bytes(piece, "little"), int(ident)))
        self.tables = []
        for n in range(LONGEST, 0, -1):
            rows = sorted(by_length[n])
            self.tables.append((n, np.array([k for k, _ in rows], np.uint64), np.array([i for _, i in rows], np.int64)))

    def step(self, at: np.ndarray, end: np.ndarray, eight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id and length of the longest subword at each place."""
        ids, size = np.zeros(len(at), np.int64), np.ones(len(at), np.int64)
        open_ = np.arange(len(at))
        for n, keys, values in self.tables:
            if not len(open_):
                break
            if not len(keys):
                continue
            key = eight[at[open_]] & _MASKS[n - 1]
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = (keys[place] == key) & (end[open_] - at[open_] >= n)
            ids[open_[hit]] = values[place[hit]]
            size[open_[hit]] = n
            open_ = open_[~hit]
        return ids, size


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one little-endian number."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), "<u8", padded, 0, (1,)).copy()


def segments(sub: Subwords, start, end, eight):
    """(word, id, is first) in steps: the k-th subword of each word that has one."""
    word, at = np.arange(len(start)), start.copy()
    first = True
    while len(word):
        ids, size = sub.step(at, end[word], eight)
        yield word, ids, first
        at = at + size
        more = at < end[word]
        word, at, first = word[more], at[more], False


class Chunk:
    """Words of some texts with their distinct words."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        low = _LOWER[data]
        self.words = Words(low, off, lower=False)
        self.eight = eight_bytes(low)
        # by a sort that need not be stable: any place of a word serves
        order = np.argsort(self.words.hash)
        ordered = self.words.hash[order]
        new = np.ones(len(ordered), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        first = np.flatnonzero(new)
        self.hash, at, self.count = ordered[first], order[first], np.diff(first, append=len(ordered))
        self.back = np.empty(len(ordered), np.int64)
        self.back[order] = np.cumsum(new) - 1
        self.start, self.end = self.words.start[at], self.words.end[at]


def _pieces(batch, most=2_000_000):
    data, off = text_bytes(batch["text"])
    for i, j in chunks_of(data, off, most):
        yield i, j, Chunk(data[off[i]:off[j]], off[i:j + 1] - off[i])


# -- counts ------------------------------------------------------------------

def _count(sent):
    def rows(kind, key, n, lead, blob=None):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(n), pa.array(lead), pa.array([blob] * len(key), pa.binary())],
                                          names=["kind", "key", "n", "lead", "blob"])

    def merged(parts):
        h = np.concatenate([p[0] for p in parts])
        u, at, back = np.unique(h, return_index=True, return_inverse=True)
        return u, np.bincount(back, weights=np.concatenate([p[1] for p in parts]), minlength=len(u)).astype(np.int64), np.concatenate([p[2] for p in parts])[at]

    def run(batches):
        sub, held, size, docs, pairs = sent.value, [], 0, 0, np.zeros(0, np.int64)
        piece = TaskContext.get().partitionId()
        pair_n = np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            for batch in batches:
                docs += batch.num_rows
                for _, _, c in _pieces(batch):
                    lead = np.zeros(len(c.hash), np.int64)
                    before = np.full(len(c.hash), START)
                    keys, times = [], []
                    for word, ids, first in segments(sub, c.start, c.end, c.eight):
                        if first:
                            lead[word] = ids
                        keys.append(before[word] * 65536 + ids)
                        times.append(c.count[word])
                        before[word] = ids
                    keys.append(before * 65536 + STOP)
                    times.append(c.count)
                    sizes = np.diff(c.words.first)
                    yield rows(3, np.array([piece % ROUNDS]), np.array([len(sizes)]), np.zeros(1, np.int64),
                               sizes.astype(np.int32).tobytes() + lead[c.back].astype(np.uint16).tobytes())
                    piece += 1
                    got = np.concatenate([pairs, *keys])
                    pairs, back = np.unique(got, return_inverse=True)
                    pair_n = np.bincount(back, weights=np.concatenate([pair_n, *times]), minlength=len(pairs)).astype(np.int64)
                    held.append((c.hash, c.count, lead))
                    size += len(c.hash)
                    if size > 1_500_000:
                        held = [merged(held)]
                        size = len(held[0][0])
                        if size > 1_000_000:
                            yield rows(0, signed(held[0][0]), held[0][1], held[0][2])
                            held, size = [], 0
        if held:
            u, n, lead = merged(held)
            yield rows(0, signed(u), n, lead)
        yield rows(1, pairs, pair_n, np.zeros(len(pairs), np.int64))
        yield rows(2, np.zeros(1, np.int64), np.array([docs], np.int64), np.zeros(1, np.int64))
    return run


def _frequent(counts: DataFrame, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, count and lead of the rows over the least count that at most TABLE rows reach; sorted by unsigned key."""
    own = counts.where(f"kind = {kind}")
    total, least = 0, None
    for r in own.groupBy("n").agg(F.count("*").alias("rows")).orderBy(F.desc("n")).limit(TABLE).collect():
        if total + r["rows"] > TABLE:
            break
        total, least = total + r["rows"], r["n"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    t = own.where(F.col("n") >= least).select("key", "n", "lead").toArrow()
    key = t["key"].to_numpy().view(np.uint64)
    order = np.argsort(key)
    return key[order], t["n"].to_numpy()[order], t["lead"].to_numpy()[order]


def _exp(z: np.ndarray) -> np.ndarray:
    """exp in place, of values kept between -40 and 40: sums of them stay finite and above 0 without a search for the greatest."""
    return np.exp(np.clip(z, -40, 40, out=z), out=z)


def by_group(target: np.ndarray) -> np.ndarray:
    """Places of the targets in order of their groups."""
    return np.argsort((target // (CLASSES // GROUPS)).astype(np.int8), kind="stable")


class Attention:
    """One causal self-attention layer with residual, and a softmax over groups of classes and over the classes of a group."""

    def __init__(self, prior: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        g = lambda *s: rng.normal(0, 0.3 / math.sqrt(s[0] if s[0] < 100 else 1), s).astype(np.float32)
        of_group = prior.reshape(GROUPS, -1)
        self.w = {"e": g(INPUTS + 1, WIDTH), "p": 0.1 * g(WINDOW, WIDTH), "q": g(WIDTH, WIDTH), "k": g(WIDTH, WIDTH), "v": g(WIDTH, WIDTH),
                  "o": g(WIDTH, WIDTH), "g": g(WIDTH, GROUPS), "h": np.log(of_group.sum(1)).astype(np.float32),
                  "c": g(WIDTH, CLASSES).reshape(WIDTH, GROUPS, -1).transpose(1, 0, 2).copy(),
                  "b": np.log(of_group / of_group.sum(1, keepdims=True)).astype(np.float32)}
        self.past = np.tril(np.ones((WINDOW, WINDOW), np.float32))
        self.restart()

    def restart(self) -> None:
        """Forget the averages of earlier steps, not the weights."""
        self.steps, self.mean, self.square = 0, *({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))

    def hidden(self, x: np.ndarray):
        w, n = self.w, len(x)
        e = w["e"][x]
        e += w["p"]
        scaled = w["q"] * np.float32(1 / math.sqrt(WIDTH))
        qkv = (e.reshape(-1, WIDTH) @ np.concatenate([scaled, w["k"], w["v"]], axis=1)).reshape(n, WINDOW, 3 * WIDTH)
        q, k, v = np.split(qkv, 3, axis=2)
        s = _exp(q @ k.transpose(0, 2, 1))
        s *= self.past
        total = s @ np.ones((WINDOW, 1), np.float32)
        o = s @ v
        o /= total
        return e + (o.reshape(-1, WIDTH) @ w["o"]).reshape(e.shape), (e, q, k, v, s, total, o)

    def levels(self, h: np.ndarray, target: np.ndarray):
        """(group, rows, logits, target among them) of the two softmaxes: first the groups (-1) of all rows, then each group's own rows.

        Rows come in order of their target's group.
        """
        group, member = np.divmod(target, CLASSES // GROUPS)
        yield -1, slice(None), h @ self.w["g"] + self.w["h"], group
        ends = np.searchsorted(group, np.arange(GROUPS + 1))
        for j in range(GROUPS):
            rows = slice(ends[j], ends[j + 1])
            if ends[j] < ends[j + 1]:
                yield j, rows, h[rows] @ self.w["c"][j] + self.w["b"][j], member[rows]

    def log10(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        order = by_group(target)
        found, out = np.ones(len(h), np.float64), np.zeros(len(h))
        for _, rows, z, own in self.levels(h[order], target[order]):
            z = _exp(z)
            found[rows] *= z[np.arange(len(z)), own] / (z @ np.ones(z.shape[1], np.float32))
        out[order] = np.log10(found)
        return out

    def step(self, x: np.ndarray, y: np.ndarray) -> None:
        """A step of Adam on windows of input ids and target classes (-1: no target)."""
        w, flat = self.w, lambda m: m.reshape(-1, m.shape[-1])
        h, (e, q, k, v, s, total, o) = self.hidden(x)
        ok = np.flatnonzero(y.ravel() >= 0)
        if not len(ok):
            return
        ok = ok[by_group(y.ravel()[ok])]
        own_h = flat(h)[ok]
        grad = {"c": np.zeros_like(w["c"]), "b": np.zeros_like(w["b"])}
        for j, rows, d, own in self.levels(own_h, y.ravel()[ok]):
            d = _exp(d)
            d /= d @ np.ones((d.shape[1], 1), np.float32)
            d[np.arange(len(d)), own] -= 1
            d *= np.float32(1 / len(ok))
            if j < 0:
                grad["g"], grad["h"] = own_h.T @ d, d.sum(0)
                d_own = d @ w["g"].T
            else:
                grad["c"][j], grad["b"][j] = own_h[rows].T @ d, d.sum(0)
                d_own[rows] += d @ w["c"][j].T
        dh = np.zeros_like(h)
        flat(dh)[ok] = d_own
        grad["o"] = flat(o).T @ flat(dh)
        do = (flat(dh) @ w["o"].T).reshape(o.shape)
        s /= total
        ds = do @ v.transpose(0, 2, 1)
        ds -= (do * o) @ np.ones((WIDTH, 1), np.float32)
        ds *= s
        scale = np.float32(1 / math.sqrt(WIDTH))
        back = flat(np.concatenate([ds @ k * scale, ds.transpose(0, 2, 1) @ q, s.transpose(0, 2, 1) @ do], axis=2))
        grad["q"], grad["k"], grad["v"] = np.split(flat(e).T @ back, 3, axis=1)
        de = dh + (back @ np.concatenate([w["q"], w["k"], w["v"]], axis=1).T).reshape(e.shape)
        grad["p"] = de.sum(0)
        grad["e"] = np.zeros_like(w["e"])
        order = np.argsort(x.ravel().astype(np.int16), kind="stable")
        ids = x.ravel()[order]
        at = np.flatnonzero(np.diff(ids, prepend=-1))
        grad["e"][ids[at]] = np.add.reduceat(flat(de)[order], at, axis=0)
        self.steps += 1
        for name in w:
            self.mean[name] += np.float32(0.1) * (grad[name] - self.mean[name])
            self.square[name] += np.float32(0.01) * (grad[name] ** 2 - self.square[name])
            w[name] -= np.float32(RATE) * (self.mean[name] / np.float32(1 - 0.9 ** self.steps)) / (np.sqrt(self.square[name] / np.float32(1 - 0.99 ** self.steps)) + np.float32(1e-8))

    def packed(self) -> np.ndarray:
        """All weights as one row."""
        return np.concatenate([self.w[name].ravel() for name in self.w])

    def unpack(self, weights: np.ndarray) -> None:
        at = np.cumsum([v.size for v in self.w.values()])[:-1]
        for name, part in zip(self.w, np.split(weights.astype(np.float32), at)):
            self.w[name] = part.reshape(self.w[name].shape)
        self.restart()


def windows(sizes: np.ndarray, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, inside, scored) of the windows over sequences laid end to end.

    Places past a sequence's end repeat its last place and are not inside.
    """
    step = WINDOW - overlap
    n = 1 + np.maximum(0, -(-(sizes - WINDOW) // step))
    start = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    seq = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(len(seq)) - np.repeat(np.cumsum(n) - n, n)
    rel = k[:, None] * step + np.arange(WINDOW)
    inside = rel < sizes[seq][:, None]
    places = start[seq][:, None] + np.minimum(rel, sizes[seq][:, None] - 1)
    return places, inside, inside & ((k == 0)[:, None] | (np.arange(WINDOW) >= overlap))


def sequences(inputs: np.ndarray, cls: np.ndarray, sizes: np.ndarray):
    """Input ids (a start, then the words) and target classes (the words, then the end) of texts of so many words."""
    x = np.full(len(inputs) + len(sizes), INPUTS)
    y = np.full(len(x), CLASSES - 1)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    x[np.arange(len(inputs)) + doc + 1] = inputs
    y[np.arange(len(inputs)) + doc] = cls
    return x, y, sizes + 1, doc


class Model:
    """Tables and weights; all of bounded size."""

    def __init__(self, sub: Subwords, words, pairs, lead_totals: dict[int, int], prev_totals, next_totals, n_words, n_distinct, n_docs,
                 begin_totals=None, n_pairs: int | None = None):
        self.sub = sub
        self.keys, self.counts, leads = words
        self.n = n_words + n_docs
        self.v = n_distinct + (n_docs > 0)
        self.docs = n_docs
        ranked = sorted(lead_totals, key=lambda i: (-lead_totals[i], i))
        self.class_of = np.arange(65536) % 8 + (CLASSES - 9)  # infrequent leads share the last eight classes
        self.class_of[ranked[:CLASSES - 9]] = np.arange(min(len(ranked), CLASSES - 9))
        self.input_of = np.full(65536, INPUTS - 1)
        self.input_of[ranked[:INPUTS - 1]] = np.arange(min(len(ranked), INPUTS - 1))
        totals = np.bincount(self.class_of[ranked], weights=[lead_totals[i] for i in ranked], minlength=CLASSES) if ranked else np.zeros(CLASSES)
        own = np.bincount(self.class_of[leads], weights=self.counts, minlength=CLASSES) if len(leads) else np.zeros(CLASSES)
        totals[CLASSES - 1] = n_docs
        rare = np.maximum(0, totals - own)
        rare_share = (rare + 1) / (totals + 2)
        self.rare_log = np.log10(rare_share)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.word_log = np.log10((1 - rare_share)[self.class_of[leads]] * self.counts / own[self.class_of[leads]])
        self.base = np.log10((self.counts + 0.1) / (self.n + 0.1 * (self.v + 1)))
        self.pair_keys, self.pair_counts = pairs[0], pairs[1]
        # pairs beyond the table have counts that only the shuffle knows
        self.more_pairs = n_pairs is not None and n_pairs > len(self.pair_keys)
        self.prev = np.zeros(65536)
        self.prev[list(prev_totals)] = list(prev_totals.values())
        self.next = np.full(65536, 0.1)
        for i, n in next_totals.items():
            self.next[i] += n
        self.next /= self.next.sum()
        # the first subword is drawn among those of its class
        begin = np.full(65536, 0.1)
        for i, n in (begin_totals or {}).items():
            begin[i] += n
        self.begin_log = np.log10(begin / np.bincount(self.class_of, weights=begin, minlength=CLASSES)[self.class_of])
        self.attention = Attention((totals + 1) / (totals + 1).sum())

    def smoothed(self, before: np.ndarray, after: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log10 P(after | before) of pairs with counts ``n``."""
        return np.log10((n + 5 * self.next[after]) / (self.prev[before] + 5))

    def pair_log(self, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 P(after | before); and which pairs the shuffle has to look up (0 here)."""
        key = (before * 65536 + after).astype(np.uint64)
        n, hit = np.zeros(len(key)), np.zeros(len(key), bool)
        if len(self.pair_keys):
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            hit = self.pair_keys[at] == key
            n = np.where(hit, self.pair_counts[at], 0)
        open_ = ~hit & self.more_pairs
        return np.where(open_, 0.0, self.smoothed(before, after, n)), open_

    def words(self, c: Chunk):
        """Per distinct word: input id, class, log10 P(word | class), place in the table or -1.

        ``log`` lacks the pairs in ``asked``: (word, key) of those that the shuffle looks up.
        """
        at = np.zeros(len(c.hash), np.int64) - 1
        if len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, c.hash), len(self.keys) - 1)
            at = np.where(self.keys[place] == c.hash, place, -1)
        lead, _ = self.sub.step(c.start, c.end, c.eight)
        cls = self.class_of[lead]
        log = np.where(at >= 0, self.word_log[at] if len(self.keys) else 0.0, 0.0)
        rare = np.flatnonzero(at < 0)
        spelled, before = np.zeros(len(rare)), np.zeros(len(rare), np.int64)
        asked = [np.zeros((2, 0), np.int64)]

        def follow(word, ids):
            more, open_ = self.pair_log(before[word], ids)
            spelled[word] += more
            asked.append(np.stack([rare[word[open_]], before[word[open_]] * 65536 + ids[open_]]))

        for word, ids, first in segments(self.sub, c.start[rare], c.end[rare], c.eight):
            if first:
                spelled[word] += self.begin_log[ids]
            else:
                follow(word, ids)
            before[word] = ids
        follow(np.arange(len(rare)), np.full(len(rare), STOP))
        log[rare] = self.rare_log[cls[rare]] + spelled
        self.asked = np.concatenate(asked, axis=1)
        return self.input_of[lead], cls, log, at

    def class_scores(self, x, y, sizes) -> np.ndarray:
        places, _, scored = windows(sizes)
        out = np.zeros(len(x))
        for i in range(0, len(places), 256):
            h, _ = self.attention.hidden(x[places[i:i + 256]])
            take = scored[i:i + 256]
            at = places[i:i + 256][take]
            out[at] = self.attention.log10(h[take], y[at])
        return out


def _train(sent):
    """Steps over all windows of a task's texts; then the weights times the number of windows, in whole numbers, so that sums of them agree."""
    def run(batches):
        input_of, class_of, start = sent.value
        net, rng = copy.deepcopy(start), np.random.default_rng(TaskContext.get().partitionId())
        rest, kept, seen, some = [np.zeros((0, WINDOW), np.int16)] * 2, [], 0, 0
        for batch in batches:
            for blob, docs in zip(batch["blob"], batch["n"].to_pylist()):
                data = np.frombuffer(blob.as_buffer(), np.uint8)
                leads = data[4 * docs:].view(np.uint16)
                x, y, sizes, _ = sequences(input_of[leads], class_of[leads], data[:4 * docs].view(np.int32))
                places, inside, _ = windows(sizes, 0)
                order = rng.permutation(len(places))
                found = [x.astype(np.int16)[places[order]], np.where(inside, y[places], -1).astype(np.int16)[order]]
                rest = [np.concatenate(p) for p in zip(rest, found)]
                seen += len(places)
                if some < STEPS * BATCH:
                    kept.append(found)
                    some += len(places)
                whole = len(rest[0]) // BATCH * BATCH
                for i in range(0, whole, BATCH):
                    net.step(*[p[i:i + BATCH] for p in rest])
                rest = [p[whole:] for p in rest]
        if not seen:
            return
        if len(rest[0]):
            net.step(*rest)
        # few windows: all of them again, up to the least number of steps
        x, y = [np.concatenate(p) for p in zip(*kept)]
        at = 0
        while net.steps < STEPS:
            net.step(x[at:at + BATCH], y[at:at + BATCH])
            at = at + BATCH if at + BATCH < len(x) else 0
        total = np.rint(net.packed().astype(np.float64) * seen * FIXED).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total), dtype=np.int32)), pa.array(np.concatenate([[seen], total]))], names=["place", "total"])
    return run


def fit(model: Model, leads: DataFrame) -> int:
    """Learn the attention weights from the leading subwords of all training texts; the number of windows learned from.

    The pieces of the texts are dealt into ``ROUNDS`` rounds.  In a round every task starts from the same weights and steps
    through all its windows; the round's weights are the mean of the tasks', by their windows.
    """
    spark, learned = leads.sparkSession, 0
    for i in range(ROUNDS):
        sent = spark.sparkContext.broadcast((model.input_of, model.class_of, model.attention))
        sums = (leads.where(F.col("key") == i).select("n", "blob").mapInArrow(_train(sent), "place int, total long")
                .groupBy("place").agg(F.sum("total").alias("total")).orderBy("place").toArrow())
        if sums.num_rows:
            total = sums["total"].to_numpy()
            model.attention.unpack(total[1:] / FIXED / total[0])
            learned += int(total[0])
        sent.unpersist()
    return learned


def learn(docs: DataFrame, vocabulary: str = VOCABULARY) -> tuple[Model, DataFrame]:
    """The model and the table of all counts (kind, key, n, lead)."""
    spark = docs.sparkSession
    small_batches(spark)
    sub = Subwords(vocabulary)
    known = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), FOLDS)).select("doc_id", F.col("text").cast("string").alias("text"))
    told = shared(known.select("text").mapInArrow(_count(spark.sparkContext.broadcast(sub)), "kind int, key long, n long, lead long, blob binary"), "told")
    counts = shared(told.where("kind < 3").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.max("lead").alias("lead")), "counts")
    words, pairs = counts.where("kind = 0"), counts.where("kind = 1")
    whole = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total_by = lambda df, c: {r["i"]: r["n"] for r in df.groupBy(c.alias("i")).agg(F.sum("n").alias("n")).collect()}  # noqa: E731  a row a subword
    model = Model(sub, _frequent(counts, 0), _frequent(counts, 1), total_by(words, F.col("lead")),
                  total_by(pairs, F.shiftright("key", 16)), total_by(pairs, F.col("key") % 65536),
                  whole["n"] or 0, whole["v"], counts.where("kind = 2").agg(F.sum("n")).first()[0] or 0,
                  total_by(pairs.where(F.shiftright("key", 16) == START), F.col("key") % 65536), pairs.count())
    model.windows = fit(model, told.where("kind = 3"))
    return model, counts


# -- scores ------------------------------------------------------------------

SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, slice int, blob binary"


def _score(sent, slices: int):
    def run(batches):
        model = sent.value
        row = TaskContext.get().partitionId() << 33
        end_base = math.log10((model.docs + 0.1) / (model.n + 0.1 * (model.v + 1)))
        rare_h, rare_r, pair_k, pair_r, held = [], [], [], [], 0

        def packed():
            h, r = np.concatenate([*rare_h, *pair_k]), np.concatenate([*rare_r, *pair_r])
            where = (h % np.uint64(slices)).astype(np.int64)
            pairs = len(h) - sum(map(len, pair_k))
            where[pairs:] = slices + pair_slice(h[pairs:].astype(np.int64), slices)
            order = np.argsort(where, kind="stable")
            h, r, where = h[order], r[order], where[order]
            at = np.flatnonzero(np.diff(where, prepend=-1))
            spans = list(zip(at, [*at[1:], len(where)]))
            none = lambda kind: pa.nulls(len(spans), kind)
            return pa.RecordBatch.from_arrays(
                [none(pa.int64()), none(pa.int64()), none(pa.bool_()), none(pa.int64()), none(pa.int64()), none(pa.float64()), none(pa.float64()),
                 pa.array(where[at].astype(np.int32)), pa.array([h[a:b].tobytes() + r[a:b].tobytes() for a, b in spans], pa.binary())],
                names=[f.split()[0] for f in SCORED.split(", ")])

        with np.errstate(over="ignore"):
            for batch in batches:
                parts = []
                for i, j, c in _pieces(batch):
                    inputs, cls, log, at = model.words(c)
                    x, y, sizes, doc = sequences(inputs[c.back], cls[c.back], np.diff(c.words.first))
                    n = j - i
                    score = np.bincount(np.repeat(np.arange(n), sizes), weights=model.class_scores(x, y, sizes), minlength=n)
                    score += np.bincount(doc, weights=log[c.back], minlength=n)
                    known = at[c.back] >= 0
                    base = np.bincount(doc[known], weights=model.base[at[c.back][known]] if known.any() else None, minlength=n) + end_base
                    parts.append((sizes, np.bincount(doc[known], minlength=n) + (model.docs > 0), base, score))
                    rare_h.append(c.words.hash[~known])
                    rare_r.append(row + i + doc[~known])
                    held += int((~known).sum())
                    if model.asked.shape[1]:
                        # every occurrence of a word asks for all its open pairs
                        order = np.argsort(model.asked[0], kind="stable")
                        word, key = model.asked[0][order], model.asked[1][order]
                        first, n_open = np.searchsorted(word, c.back), np.searchsorted(word, c.back, "right")
                        n_open = n_open - first
                        at_pair = np.repeat(first - (np.cumsum(n_open) - n_open), n_open) + np.arange(n_open.sum())
                        pair_k.append(key[at_pair].astype(np.uint64))
                        pair_r.append(row + i + np.repeat(doc, n_open))
                        held += len(at_pair)
                sums = [np.concatenate(p) for p in zip(*parts)] if parts else [np.zeros(0)] * 4
                m = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(m)), batch["doc_id"], batch["held_out"], pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)),
                     pa.array(sums[2].astype(np.float64)), pa.array(sums[3].astype(np.float64)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())],
                    names=[f.split()[0] for f in SCORED.split(", ")])
                row += m
                if held > 1_000_000:
                    yield packed()
                    rare_h, rare_r, pair_k, pair_r, held = [], [], [], [], 0
            if held:
                yield packed()
    return run


def pair_slice(key, slices: int):
    """Slice of a pair; the same for numpy integers and for Spark columns (no overflow: keys are below 2 ** 32)."""
    mixed = key * 1640531527
    return (F.shiftright(mixed, 20) if isinstance(mixed, Column) else mixed >> 20) % slices


def _rare(sent, slices: int):
    def run(blobs: pa.Table, counts: pa.Table) -> pa.Table:
        parts = [np.frombuffer(b, np.uint64) for b in blobs["blob"].to_pylist()]
        h = np.concatenate([np.zeros(0, np.uint64), *[p[:len(p) // 2] for p in parts]])
        rid = np.concatenate([np.zeros(0, np.uint64), *[p[len(p) // 2:] for p in parts]]).view(np.int64)
        key, c = counts["key"].to_numpy().view(np.uint64), counts["n"].to_numpy()
        order = np.argsort(key)
        key, c = key[order], c[order]
        found = np.zeros(len(h), np.int64)
        if len(key) and len(h):
            at = np.minimum(np.searchsorted(key, h), len(key) - 1)
            found = np.where(key[at] == h, c[at], 0)
        ids, back = np.unique(rid, return_inverse=True)
        model, none = sent.value, np.zeros(len(h))
        if len(h) and blobs["slice"][0].as_py() >= slices:  # pairs
            pair = h.astype(np.int64)
            known, base, score = none, none, model.smoothed(pair >> 16, pair & 65535, found)
        else:
            known, base, score = found > 0, np.log10((found + 0.1) / (model.n + 0.1 * (model.v + 1))), none
        total = lambda x: pa.array(np.bincount(back, weights=x, minlength=len(ids)).astype(np.float64))
        return pa.table({"rid": pa.array(ids), "more_known": total(known).cast(pa.int64()), "more_base": total(base), "more_score": total(score)})
    return run


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    slices = max(64, math.ceil(model.n / SLICE))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), FOLDS).alias("held_out"), F.col("text").cast("string").alias("text"))
    sent = spark.sparkContext.broadcast(model)
    done = shared(rows.mapInArrow(_score(sent, slices), SCORED), "scored")
    # counts of the infrequent words; unsigned modulus, as in the tasks
    part = F.pmod(F.pmod(F.col("key"), F.lit(slices).cast("long")) + F.when(F.col("key") < 0, F.lit(2 ** 64 % slices)).otherwise(F.lit(0)), F.lit(slices))
    own = counts.where("kind = 0").select(part.cast("int").alias("part"), "key", "n")
    if model.more_pairs:
        own = own.union(counts.where("kind = 1").select((F.lit(slices) + pair_slice(F.col("key"), slices)).cast("int").alias("part"), "key", "n"))
    more = (done.where("blob IS NOT NULL").select("slice", "blob").groupBy("slice")
            .cogroup(own.groupBy("part")).applyInArrow(_rare(sent, slices), "rid long, more_known long, more_base double, more_score double")
            .groupBy("rid").agg(*[F.sum(x).alias(x) for x in ("more_known", "more_base", "more_score")]))
    return (done.where("rid IS NOT NULL").drop("slice", "blob").join(more, "rid", "left")
            .select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
                    F.lit(model.n).cast("long").alias("train_tokens"),
                    (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
                    (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score")))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, *learn(docs))
