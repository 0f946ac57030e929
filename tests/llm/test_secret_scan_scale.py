"""op9 on many findings and long tokens: same spans as a plain pass, in time that grows with the text."""

import random
import time

import pyarrow as pa

from wagelens.llm import secret_scan as S


class Sent:
    def __init__(self, net):
        self.value = net


def _scan(texts, net):
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    (out,) = S._scan(Sent(net))([batch])
    return out.to_pylist()


def test_overlap_search_equals_a_pass_over_all_spans():
    rng = random.Random(5)
    for _ in range(400):
        spans = sorted((s, rng.randrange(3), s + rng.randrange(1, 30)) for s in (rng.randrange(100) for _ in range(rng.randrange(8))))
        found = S.overlapping(spans)
        for a in range(0, 110, 3):
            b = a + rng.randrange(1, 20)
            assert found(a, b) == any(s < b and a < e for s, _, e in spans)


def test_spans_equal_a_plain_pass():
    rng = random.Random(6)
    token = lambda n: "".join(rng.choices("abcdefABCDEF0123456789-_/", k=n))
    texts = [" ".join(rng.choice([f"password={token(12)}", token(rng.randrange(16, 400)), "AKIA" + "A1" * 9, "f0" * 20, "word"])
                      for _ in range(60)) for _ in range(6)] + [None, "", token(60_000)]
    net, seen = S.CharNet(), []
    for text in texts:
        cands = S.candidates_of(text or "")
        base = S.base_spans(text or "", cands)
        seen.append((base, [(a, b, max(net.probability(w[None])[0] for w in S.windows_of(text, a, b)))
                            for a, b in cands if not any(s < b and a < e for s, _, e in base)]))
    scores = sorted(q for _, found in seen for _, _, q in found)
    net.threshold = (scores[len(scores) // 2 - 1] + scores[len(scores) // 2]) / 2  # an untrained network: half of them
    said = [",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in sorted([*base, *((a, 3, b) for a, b, q in found if q >= net.threshold)]))
            for base, found in seen]
    got = _scan(texts, net)
    assert [r["spans"] for r in got] == said and any("model" in x for x in said)
    assert sum(r["n_assign"] for r in got) > 0 and got[-3]["spans"] == got[-2]["spans"] == ""


def test_time_grows_with_the_findings():
    def seconds(n):
        text = " ".join(f"password=abcdefgh{i:08d}" for i in range(n))
        start = time.process_time()
        for _ in S._found(pa.record_batch({"doc_id": [1], "text": [text]})):
            pass
        return time.process_time() - start
    seconds(1000)
    small, large = min(seconds(4000) for _ in range(3)), min(seconds(32000) for _ in range(3))
    assert large < 24 * small  # 8 times the findings; the pass over all pairs took 64 times as long
