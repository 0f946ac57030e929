"""Round 2 advice, op9: findings of all documents train the network and set its threshold."""

import random

import numpy as np

from wagelens.llm import secret_scan


def test_rare_secrets_train_the_network(spark):
    """30 secrets in 60,000 documents: a sample of 20,000 documents before looking held about ten."""
    rng = random.Random(31)
    secret = set(rng.sample(range(60_000), 30))
    rows = [(i, f"order password={rng.getrandbits(80):020x} end" if i in secret else f"see item-number-{i:08d}-of-list" if i % 50 == 0 else "plain words")
            for i in range(60_000)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    net = secret_scan.train(table)
    assert net is not None
    # the threshold keeps the recall over all findings held apart, by the highest of their windows
    best = []
    for i, t in rows:
        for label, _, place, apart in secret_scan._found({"doc_id": Column([i]), "text": Column([t])}):
            if label and apart:
                best.append(net.probability(np.array(secret_scan.windows_of(*place))).max())
    assert len(best) and (np.array(best) >= net.threshold).mean() >= secret_scan.RECALL


class Column(list):
    def to_pylist(self):
        return self


def test_threshold_has_no_floor():
    net = secret_scan.CharNet()
    logit = np.concatenate([np.linspace(-3, 3, 100), np.linspace(-6, 2, 1000)])
    y = np.array([1] * 100 + [0] * 1000)
    net.settle(logit, y, np.ones(len(y)))
    assert (net.scaled(logit[y == 1]) >= net.threshold).mean() >= secret_scan.RECALL and net.threshold < 0.5


def test_histogram_takes_the_highest_of_all_windows():
    import pyarrow as pa

    net = secret_scan.CharNet()
    rng = random.Random(32)
    texts = ["x " + "".join(rng.choices("abcdef0123456789-", k=n)) + " y" for n in (20, 60, 200, 5000, 120_000) for _ in range(8)]
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)})

    class Sent:
        value = net

    want: dict = {}
    for label, _, place, apart in secret_scan._found(batch):
        if apart:
            secret_scan._add(want, [label], [net.forward(np.array(secret_scan.windows_of(*place)))[0].max()])
    (got,) = secret_scan._histogram(Sent)([batch])
    got = {(r["label"], r["bin"]): r["n"] for r in got.to_pylist()}
    assert sum(got.values()) == sum(want.values()) and all(any((k, b + d) in got for d in (-1, 0, 1)) for k, b in want)
