"""Quality classifier: a byte-level convolutional network in numpy (operator 7).

Bytes are embedded and convolved with FILTERS learned filters of WIDTH bytes.  The text,
padded with zero bytes to whole blocks, is covered by chunks of two blocks that overlap by
one; each chunk is max-pooled, and the mean, the maximum and the minimum of the
rectified chunk vectors give one probability by a logistic unit (the minimum tells a
monotonous chunk, on which few filters respond).  Bias and rectifier are monotone, so
they are applied after pooling.

Scoring runs on every byte of every text.  As the input is discrete, the
convolution is a sum of table rows: one table for each pair of byte positions.

Training takes a bounded number of rows: of the labelled ones whose crc32(doc_id) mod 5 is
not 0, the SAMPLE with the smallest hash of the id, each with its whole text.  It goes
through them EPOCHS times, or as often as makes LEAST_STEPS steps (all three are parameters of
:func:`train`).  Only bytes of the text and the quality label are used.  The model (some
10 KB) is fitted on the driver by Adam and sent to the workers; long texts are convolved in slices.

Null text counts as empty and gets a score like any other (the padding is scored);
null labels and ids are not trained on; repeated rows are scored each; without any
usable label every score is 1 (nothing is rejected).  An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsum.llm.common import Batches, batch, crc_mod, raw_bytes, texts

FILTERS, WIDTH, EMBED, BLOCK = 16, 6, 8, 128
#: Most rows that training takes.
SAMPLE = 4000
EPOCHS, BATCH, RATE, SEED = 12, 24, 0.01, 7
#: Least number of steps: few rows are gone through more often.
LEAST_STEPS = 900
#: Weight of a rejected text in training; they are the rarer class.
REJECT_WEIGHT = 3.0
THRESHOLD = 0.3
#: Blocks convolved at once.
SLICE = 128

OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


@dataclass
class Model:
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # WIDTH x EMBED x FILTERS
    bias: np.ndarray  # FILTERS
    mean: np.ndarray  # FILTERS
    peak: np.ndarray  # FILTERS
    trough: np.ndarray  # FILTERS
    offset: np.ndarray  # 1

    def params(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.mean, self.peak, self.trough, self.offset]

    def table(self) -> np.ndarray:
        """WIDTH x 256 x FILTERS: what a byte adds at each place of the filters."""
        return np.einsum("be,kef->kbf", self.embed, self.filters).astype(np.float32)


def layout(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """First block of each text (and the end) when texts are padded to blocks."""
    blocks = np.maximum(1, -(-lengths // BLOCK))
    first = np.concatenate([[0], np.cumsum(blocks)])
    return first, int(first[-1])


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts padded to blocks with an empty block behind each, so that no filter reaches
    into the next text; the first block of each text (and the end) without the empty
    ones; the places of the texts' blocks."""
    first, n = layout(np.diff(offsets))
    texts_ = len(offsets) - 1
    out = np.zeros((n + texts_) * BLOCK, np.uint8)
    for i in range(texts_):
        a, b = offsets[i], offsets[i + 1]
        at = (first[i] + i) * BLOCK
        out[at : at + b - a] = data[a:b]
    return out, first, np.arange(n) + np.repeat(np.arange(texts_), np.diff(first))


def chunked(blocks: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Max of neighbouring blocks of one text; a text of one block has one chunk.
    Gives the chunks (block j with j + 1) and the first chunk of each text."""
    n = np.diff(first)
    last = np.zeros(len(blocks), bool)
    last[first[1:] - 1] = True
    follow = np.concatenate([blocks[1:], blocks[-1:]])
    both = np.where(last[:, None], blocks, np.maximum(blocks, follow))
    keep = ~last
    keep[first[:-1][n == 1]] = True
    start = np.concatenate([[0], np.cumsum(np.maximum(1, n - 1))])
    return both[keep], start


def probability(model: Model, blocks: np.ndarray, first: np.ndarray) -> np.ndarray:
    chunks, start = chunked(blocks, first)
    c = np.maximum(chunks + model.bias, 0)
    size = np.diff(start)[:, None]
    at = start[:-1]
    z = (np.add.reduceat(c, at, axis=0) / size) @ model.mean + np.maximum.reduceat(c, at, axis=0) @ model.peak + np.minimum.reduceat(c, at, axis=0) @ model.trough + model.offset[0]
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Scorer:
    """Scores whole texts with the pair tables of a model."""

    def __init__(self, model: Model):
        t = model.table()
        self.model = model
        self.pairs = [(t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, WIDTH, 2)]

    def pooled(self, x: np.ndarray, n: int) -> np.ndarray:
        out = np.empty((n, FILTERS), np.float32)
        for b in range(0, n, SLICE):
            e = min(n, b + SLICE)
            m = (e - b) * BLOCK
            part = np.zeros(m + WIDTH, np.uint16)
            some = x[b * BLOCK : e * BLOCK + WIDTH]
            part[: len(some)] = some
            pair = (part[:-1] << 8) | part[1:]
            conv = self.pairs[0].take(pair[:m], axis=0)
            for k in range(1, WIDTH // 2):
                conv += self.pairs[k].take(pair[2 * k : 2 * k + m], axis=0)
            out[b:e] = conv.reshape(e - b, BLOCK, FILTERS).max(axis=1)
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x, first, at = padded(data, offsets)
        return probability(self.model, self.pooled(x, len(x) // BLOCK)[at], first)


def fit(samples: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, least_steps: int = LEAST_STEPS) -> Model | None:
    """Adam on the cross-entropy; None without samples."""
    if not samples:
        return None
    rng = np.random.default_rng(SEED)
    rate = float(np.clip(labels.mean(), 0.01, 0.99))
    m = Model(
        rng.normal(0, 0.5, (256, EMBED)), rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH, EMBED, FILTERS)), np.zeros(FILTERS),
        rng.normal(0, 0.1, FILTERS), rng.normal(0, 0.1, FILTERS), rng.normal(0, 0.1, FILTERS), np.array([np.log(rate / (1 - rate))]),
    )
    mom = [(np.zeros_like(p), np.zeros_like(p)) for p in m.params()]
    step, per_epoch = 0, -(-len(samples) // BATCH)
    epochs = max(epochs, -(-least_steps // per_epoch))
    for _ in range(epochs):
        order = rng.permutation(len(samples))
        for i in range(0, len(order), BATCH):
            at = order[i : i + BATCH]
            step += 1
            grads = gradients(m, [samples[j] for j in at], labels[at])
            lr = RATE * 0.5 ** (4 * step / (epochs * per_epoch))
            for p, g, (a, b) in zip(m.params(), grads, mom, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return m


def block_maxima(t: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest filter responses of n blocks and where they are, SLICE blocks at a time."""
    top, arg = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.int64)
    for b in range(0, n, SLICE):
        e = min(n, b + SLICE)
        lo, size = b * BLOCK, (e - b) * BLOCK
        conv = t[0][x[lo : lo + size]]
        for k in range(1, WIDTH):
            conv += t[k][x[lo + k : lo + k + size]]
        conv = conv.reshape(-1, BLOCK, FILTERS)
        arg[b:e] = conv.argmax(axis=1)
        top[b:e] = np.take_along_axis(conv, arg[b:e, None, :], 1)[:, 0]
    return top, arg


def gradients(m: Model, samples: list[bytes], y: np.ndarray) -> list[np.ndarray]:
    data = np.frombuffer(b"".join(samples), np.uint8)
    x, first, at = padded(data, np.concatenate([[0], np.cumsum([len(s) for s in samples])]))
    n = len(x)
    x = np.concatenate([x, np.zeros(WIDTH, np.uint8)])
    blocks, arg = block_maxima(m.table(), x, n // BLOCK)
    blocks, arg = blocks[at], arg[at]
    pos = at[:, None] * BLOCK + arg
    # chunk maxima and where they are
    chunks, start = chunked(blocks, first)
    where = chunked_positions(blocks, pos, first)
    c = np.maximum(chunks + m.bias, 0)
    size = np.diff(start)
    mean = np.add.reduceat(c, start[:-1], axis=0) / size[:, None]
    peak = np.maximum.reduceat(c, start[:-1], axis=0)
    trough = np.minimum.reduceat(c, start[:-1], axis=0)
    z = mean @ m.mean + peak @ m.peak + trough @ m.trough + m.offset[0]
    d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * np.where(y > 0.5, 1, REJECT_WEIGHT) / len(y)
    doc = np.repeat(np.arange(len(y)), size)

    def shared(hit):  # ties share the gradient
        return hit / np.maximum(1, np.add.reduceat(hit.astype(float), start[:-1], axis=0))[doc]

    dc = d[doc][:, None] * (m.mean / size[doc][:, None] + m.peak * shared(c == peak[doc]) + m.trough * shared(c == trough[doc])) * (c > 0)
    dt = np.zeros((WIDTH, 256, FILTERS))
    f = np.broadcast_to(np.arange(FILTERS), where.shape)
    for k in range(WIDTH):
        np.add.at(dt[k], (x[where + k], f), dc)
    return [np.einsum("kbf,kef->be", dt, m.filters), np.einsum("kbf,be->kef", dt, m.embed), dc.sum(0), d @ mean, d @ peak, d @ trough, np.array([d.sum()])]


def chunked_positions(blocks: np.ndarray, pos: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions of the maxima that :func:`chunked` gives."""
    n = np.diff(first)
    last = np.zeros(len(blocks), bool)
    last[first[1:] - 1] = True
    follow, fpos = np.concatenate([blocks[1:], blocks[-1:]]), np.concatenate([pos[1:], pos[-1:]])
    both = np.where(last[:, None] | (blocks >= follow), pos, fpos)
    keep = ~last
    keep[first[:-1][n == 1]] = True
    return both[keep]


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` rows (doc_id, label, bytes of the whole text)."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).where("y is not null and doc_id is not null")
    known = known.where(crc_mod(F.col("doc_id"), 5) != 0)
    some = known.orderBy(F.xxhash64("doc_id"), "y").limit(sample)
    t = texts(docs, binary=True).join(F.broadcast(some), "doc_id").select("doc_id", "y", "text")
    return t.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(sample)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS, least_steps: int = LEAST_STEPS) -> Model | None:
    rows = training_rows(docs, labels, sample).collect()
    return fit([bytes(r.text) for r in rows], np.array([r.y for r in rows]), epochs, least_steps)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document."""
    model = train(docs, labels)

    def run(batches: Batches) -> Batches:
        scorer = Scorer(model) if model else None
        for b in batches:
            if b.num_rows:
                data, offsets = raw_bytes(b.column(1))
                s = scorer.scores(data, offsets) if scorer else np.ones(b.num_rows)
                yield batch(OUT, doc_id=b.column(0), score=s)

    scored = texts(docs, binary=True).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text is not rejected."""
    model = train(docs, labels)
    at = docs.columns.index("text")

    def run(batches: Batches) -> Batches:
        scorer = Scorer(model) if model else None
        for b in batches:
            if b.num_rows and scorer:
                data, offsets = raw_bytes(b.column(at).cast(pa.large_string()).fill_null(""))
                b = b.filter(pa.array(scorer.scores(data, offsets) >= THRESHOLD))
            yield b

    return docs.mapInArrow(run, docs.schema)
