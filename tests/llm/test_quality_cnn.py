import zlib

import numpy as np
import pytest

from kinsum.llm import quality_cnn as qc


@pytest.fixture(scope="module")
def corpus(make, spark):
    import pyarrow.parquet as pq

    d = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    lab = pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pydict()
    docs = make(list(zip(d["doc_id"], d["text"], strict=True)))
    labels = spark.createDataFrame(list(zip(lab["doc_id"], lab["quality"], strict=True)), "doc_id long, quality int")
    return docs, labels, dict(zip(lab["doc_id"], lab["quality"], strict=True))


def test_held_out_accuracy(corpus):
    docs, labels, truth = corpus
    rows = qc.quality(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(r.score, r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    good, bad = [s for s, _, y in held if y == 1], [s for s, _, y in held if y == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([p == y for _, p, y in held]) > 0.93


def test_score_is_the_network(real):
    """Pair tables and slices give what a direct convolution gives."""
    rng = np.random.default_rng(0)
    m = qc.fit([b"ab cd ef", b"!!! ???"], np.array([1.0, 0.0]))
    texts = [b"", b"a", b"x" * 127, b"x" * 128, b"y" * 129, bytes(rng.integers(0, 256, 40_000, dtype=np.uint8)), *[t.encode() for _, t in real[:30]]]
    got = qc.Scorer(m).scores(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    t = m.table()
    for text, p in zip(texts, got, strict=True):
        n = max(1, -(-len(text) // qc.BLOCK))
        x = np.frombuffer(text.ljust(n * qc.BLOCK + qc.WIDTH, b"\0"), np.uint8)
        conv = sum(t[k][x[k : k + n * qc.BLOCK]] for k in range(qc.WIDTH))
        ends = [(j * qc.BLOCK, min(n, j + 2) * qc.BLOCK) for j in range(max(1, n - 1))]
        c = np.maximum(np.array([conv[a:b].max(0) for a, b in ends]) + m.bias, 0)
        z = c.mean(0) @ m.mean + c.max(0) @ m.peak + c.min(0) @ m.trough + m.offset[0]
        assert abs(1 / (1 + np.exp(-z)) - p) < 1e-5


def test_gradients():
    rng = np.random.default_rng(1)
    samples = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in (3, 200, 700)]
    y = np.array([1.0, 0.0, 1.0])
    m = qc.Model(rng.normal(0, 1, (256, qc.EMBED)), rng.normal(0, 0.3, (qc.WIDTH, qc.EMBED, qc.FILTERS)), rng.normal(0, 0.1, qc.FILTERS), rng.normal(0, 0.1, qc.FILTERS), rng.normal(0, 0.1, qc.FILTERS), rng.normal(0, 0.1, qc.FILTERS), np.zeros(1))

    def loss():
        p = qc.Scorer(m).scores(np.frombuffer(b"".join(samples), np.uint8), np.array([0, 3, 203, 903]))
        w = np.where(y > 0.5, 1, qc.REJECT_WEIGHT)
        return -(w * np.where(y > 0.5, np.log(p), np.log(1 - p))).mean()

    grads = qc.gradients(m, samples, y)
    for p, g in zip(m.params(), grads, strict=True):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old, eps = p[at], 2e-2
        p[at] = old + eps
        up = loss()
        p[at] = old - eps
        down = loss()
        p[at] = old
        assert abs((up - down) / (2 * eps) - g[at]) < 0.15 * abs(g[at]) + 2e-3


def test_odd_texts_and_missing_labels(make, odd, spark):
    docs = make([*enumerate(odd), (None, "x")])
    empty = spark.createDataFrame([], "doc_id long, quality int")
    rows = qc.quality(docs, empty).collect()
    assert len(rows) == len(odd) + 1 and all(r.score == 1 and r.predicted == 1 for r in rows)
    some = spark.createDataFrame([(0, None), (None, 1), (5, 1), (6, 0), (6, 0)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in qc.quality(docs, some).collect())
    assert qc.quality(make([]), some).collect() == []
