"""Language-model scoring by prediction by partial matching (operator 4).

The model is a byte-context trie, pretrained on all training documents (crc32(doc_id) mod
7 is not 2).  A text, A-Z lower-cased, is coded byte by byte up to its end mark (byte 0xFF).
A byte's context is the up to ORDER bytes before it, across white space, back to the mark
(0x20) that stands before the text.

A symbol is coded in the longest context that the trie knows.  If the context has not seen
it, an escape is coded and the next shorter one asked, where the symbols of the longer one
are excluded; below order 0 all 256 bytes are equally likely.  Escapes are estimated
by method C: the number of distinct symbols against the counts.

Counts cover all training text and no context is dropped.  The trie is a table: a gram is a
byte with its whole context, as a number; each distinct gram of the corpus (of held-out
texts too, with count 0) is a leaf, and the nodes at depth k are the grams cut to their last
k context bytes.  ``gram_codes`` goes down the trie depth by depth: a node joins the one
above it, whose code it needs for escapes, and a window over a context's symbols (at most
256 rows) gives its counts.  So the model grows with the corpus and is nowhere held whole.
A text's score is the sum of its grams' codes: the most frequent grams, at most 1 / LEAST of
them, go to the workers; the others are counted per text and joined by shuffle, where no
gram is frequent.

The words of the base score are counted and looked up in the same way: those with at least
LEAST of all tokens go to the workers (again at most 1 / LEAST), the others are joined.

Null text counts as empty (one end token); a null id counts as empty text in crc32;
repeated rows are scored each (and counted each in training).  Without training
documents all counts are zero and every byte costs log10(256).  An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinsum.llm.common import Batches, batch, crc_mod, cut, raw_bytes, texts

ORDER = 5
LEAST = 1e-6
MARK, END = ord(" "), b"\xff"
#: Entries a worker counts before it passes them on; bytes whose grams it counts and looks
#: up at once.
COUNTED, COUNTED_BYTES, CHUNK = 300_000, 1 << 22, 1 << 18
MULT = np.uint64(0x9E3779B97F4A7C15)

COUNT = pa.schema([("k", pa.binary()), ("n", pa.int64())])
GRAMS = pa.schema([("key", pa.int64()), ("n", pa.int64())])
RARE = pa.list_(pa.struct([("k", pa.binary()), ("n", pa.int32())]))
SCORED = pa.schema(
    [("uid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rare", RARE)]
    + [("keys", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))]
)
SCORED_DDL = "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare array<struct<k: binary, n: int>>, keys array<long>, times array<int>"


def units(text: bytes) -> list[bytes]:
    """The stretches of a text that contexts stay in: one, with the end mark."""
    return [text.lower() + END]


def passed_on(counts: dict[bytes, int]) -> pa.RecordBatch:
    return batch(COUNT, k=list(counts), n=list(counts.values()))


def count_words(batches: Batches) -> Batches:
    """Words with their training occurrences (0 for words of held-out texts alone)."""
    counts: dict[bytes, int] = {}
    for b in batches:
        for t, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for w, n in Counter(t.lower().split()).items():
                counts[w] = counts.get(w, 0) + (0 if held else n)
            if len(counts) > COUNTED:
                yield passed_on(counts)
                counts = {}
    yield passed_on(counts)


def gram_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The gram of every byte: from high to low its context's length, the ORDER bytes before
    it (the nearest first, zeros beyond the mark) and the byte itself."""
    return keys_at(data, np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets)))


def keys_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """:func:`gram_keys` of bytes at the places ``at`` of their texts."""
    wide = data.astype(np.int64)
    out = wide | (np.minimum(at + 1, ORDER) << (8 * ORDER + 8))
    near = np.flatnonzero(at < ORDER)
    for j in range(1, ORDER + 1):
        before = np.zeros(len(data), np.int64)
        before[j:] = wide[:-j]
        before[near[at[near] < j]] = 0
        before[near[at[near] == j - 1]] = MARK
        out |= before << (8 * (ORDER + 1 - j))
    return out


def key_chunks(column: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, gram) of every byte of texts that end with the mark, ``size`` bytes at a time."""
    data, offsets = raw_bytes(column)
    rows = np.arange(len(offsets) - 1)
    for a in range(0, len(data), size):
        b, low = min(len(data), a + size), max(0, a - ORDER)
        row = np.repeat(rows, np.diff(np.clip(offsets, low, b)))
        part = data[low:b]
        part = np.where((part >= 65) & (part <= 90), part + np.uint8(32), part)
        yield row[a - low :], keys_at(part, np.arange(low, b) - offsets[row])[a - low :]


def count_grams(batches: Batches) -> Batches:
    """Distinct grams of the texts with their training occurrences."""
    seen, new, held = [], [], 0

    def passed() -> Batches:
        if seen:
            k, n = np.unique(np.concatenate(seen), return_counts=True)
            yield batch(GRAMS, key=k, n=n)
        if new:
            k = np.unique(np.concatenate(new))
            yield batch(GRAMS, key=k, n=np.zeros(len(k), np.int64))

    for b in batches:
        out = b.column(1).to_numpy(zero_copy_only=False)
        for row, keys in key_chunks(b.column(0), CHUNK):
            other = out[row]
            seen.append(keys[~other])
            new.append(keys[other])
            held += len(keys)
            if held >= COUNTED_BYTES:
                yield from passed()
                seen, new, held = [], [], 0
    yield from passed()


class Codes:
    """Hash table (linear probing) of grams and their codes."""

    def __init__(self, keys: np.ndarray, codes: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.codes = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits)
        at, left = self.slots(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == -1]
            self.keys[at[free]] = keys[free]  # of several the last one stays
            self.codes[at[free]] = codes[free]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & self.mask

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * MULT) >> self.shift).astype(np.int64)

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, which are known); the code of an unknown gram is 0."""
        at = self.slots(keys)
        there = self.keys[at]
        known = there == keys
        left = np.flatnonzero(~known & (there != -1))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            there = self.keys[at[left]]
            known[left] = there == keys[left]
            left = left[(there != keys[left]) & (there != -1)]
        return np.where(known, self.codes[at], 0.0), known


def gram_codes(grams: DataFrame) -> DataFrame:
    """(key, code) of every gram of ``grams`` (key, n): log10 of the byte's probability in
    its context, learnt from the counts n."""
    bits = F.col("key").bitwiseAND(F.lit((1 << (8 * ORDER + 8)) - 1))
    length = F.shiftright("key", 8 * ORDER + 8)
    log = lambda x: F.log10(F.greatest(x, F.lit(1)))

    def nodes(k: int) -> DataFrame:
        """Counts of (context of k bytes, symbol)."""
        x = F.shiftright(bits, 8 * (ORDER + 1 - k))
        return grams.where(length >= k).groupBy(x.alias("x"), bits.bitwiseAND(F.lit(255)).alias("s")).agg(F.sum("n").alias("n"))

    root = nodes(0)
    all_ = root.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t"), F.count(F.when(F.col("n") > 0, 1)).alias("d")).first()
    t, d = all_["t"], all_["d"]
    new = -math.log10(max(256 - d, 1))
    seen = F.log10("n") - math.log10(max(t + d, 1))
    unseen = F.lit(math.log10(d / (t + d)) + new if t else new)
    above = root.select("x", "s", "n", F.lit(t).alias("t"), F.lit(d).alias("d"), F.when(F.col("n") > 0, seen).otherwise(unseen).alias("code"), F.lit(new).alias("escaped"))
    of_context, known = Window.partitionBy("x"), F.col("n") > 0
    out = []
    for k in range(1, ORDER + 1):
        # u*: the same symbol in the next shorter context; escaped: its code there and
        # further up, without the symbols of this context
        up = above.select(F.col("x").alias("ux"), F.col("s").alias("us"), F.col("n").alias("un"), F.col("t").alias("ut"), F.col("d").alias("ud"), F.col("code").alias("ucode"), F.col("escaped").alias("uescaped"))
        here = nodes(k)
        met = here.join(up, (F.shiftright(here["x"], 8) == up["ux"]) & (here["s"] == up["us"]))
        met = met.withColumns({
            "t": F.sum("n").over(of_context),
            "d": F.count(F.when(known, 1)).over(of_context),
            "rest": F.col("ut") - F.coalesce(F.sum(F.when(known, F.col("un"))).over(of_context), F.lit(0)),
        })
        others = F.col("ud") - F.col("d")
        met = met.withColumn("escaped", F.when(F.col("un") > 0, log(F.col("un")) - log(F.col("rest") + others)).otherwise(log(others) - log(F.col("rest") + others) + F.col("uescaped")))
        total = log(F.col("t") + F.col("d"))
        code = F.when(F.col("t") == 0, F.col("ucode")).when(known, log(F.col("n")) - total).otherwise(log(F.col("d")) - total + F.col("escaped"))
        above = cut(met.select("x", "s", "n", "t", "d", code.alias("code"), "escaped"), f"trie-{k}")
        whole = above if k == ORDER else above.where(F.col("x").bitwiseAND(F.lit(255)) == MARK)
        key = F.lit(k << (8 * ORDER + 8)).bitwiseOR(F.shiftleft("x", 8 * (ORDER + 1 - k))).bitwiseOR(F.col("s"))
        out.append(whole.select(key.alias("key"), "code"))
    return reduce(DataFrame.unionAll, out)


def frequent_codes(codes: DataFrame) -> tuple[Codes, int]:
    """The most frequent grams, at most 1 / LEAST, and the count from which they are."""
    level = F.floor(F.log2("n") * 8).cast("int")
    least, left = 1 << 62, int(1 / LEAST)
    for r in codes.where("n > 1").groupBy(level.alias("level")).agg(F.count("*").alias("grams"), F.min("n").alias("n")).orderBy(F.desc("level")).collect():
        left -= r["grams"]
        if left < 0:
            break
        least = r["n"]
    often = codes.where(F.col("n") >= least).select("key", "code").toArrow()
    return Codes(often.column(0).to_numpy(), often.column(1).to_numpy()), least


def ppm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = texts(docs, binary=True).withColumn("held_out", crc_mod(F.col("doc_id"), 7) == 2)
    whole = F.concat("text", F.lit(END)).alias("whole")
    words = cut(rows.select("text", "held_out").mapInArrow(count_words, "k binary, n long").groupBy("k").agg(F.sum("n").alias("c")), "words")
    size = words.agg(F.count(F.when(F.col("c") > 0, 1)).alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    ends = rows.where(~F.col("held_out")).count()
    n_train, distinct = size["n"] + ends, size["v"] + (ends > 0)
    grams = cut(rows.select(whole, "held_out").mapInArrow(count_grams, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "grams")
    codes = cut(gram_codes(grams).join(grams, "key"), "gram-codes")
    table, least = frequent_codes(codes)
    often = F.col("c") >= max(2, math.ceil(LEAST * n_train))
    frequent = words.where(often).toArrow()
    others = words.where(~often)
    known_words = {k: math.log10(c + 1) for k, c in zip(*(x.to_pylist() for x in frequent.columns), strict=True)}
    sent = spark.sparkContext.broadcast((known_words, table))

    def gram_scores(column: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Score of the frequent grams of each text; the others and their counts."""
        n = len(column)
        score, rows_, keys_ = np.zeros(n), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for row, keys in key_chunks(column, CHUNK):
            code, known = sent.value[1].of(keys)
            score += np.bincount(row, code, n)
            rows_.append(row[~known])
            keys_.append(keys[~known])
        row, key = np.concatenate(rows_), np.concatenate(keys_)
        order = np.lexsort((key, row))
        row, key = row[order], key[order]
        first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])])) if len(row) else row
        times = np.diff(np.concatenate([first, [len(row)]]))
        ends_ = pa.array(np.searchsorted(row[first], np.arange(n + 1)), pa.int32())
        return score, pa.ListArray.from_arrays(ends_, pa.array(key[first])), pa.ListArray.from_arrays(ends_, pa.array(times, pa.int32()))

    def score(batches: Batches) -> Batches:
        get, end = sent.value[0].get, math.log10(ends + 1)
        uid = TaskContext.get().partitionId() << 40
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                base, known, tokens, rare = end, int(ends > 0), 1, []
                for w, n in Counter(t[:-1].lower().split()).items():
                    tokens += n
                    x = get(w)
                    if x is None:
                        rare.append({"k": w, "n": n})
                    else:
                        base += n * x
                        known += n
                out.append((uid, tokens, known, base, rare))
                uid += 1
            u, n, k, s, r = zip(*out, strict=True) if out else ((),) * 5
            p, keys, times = gram_scores(b.column(1))
            yield batch(SCORED, uid=u, doc_id=b.column(0), held_out=b.column(2), n_tokens=n, known=k, base=s, score=p, rare=r, keys=keys, times=times)

    scored = cut(rows.select("doc_id", whole, "held_out").mapInArrow(score, SCORED_DDL), "scored")
    rare = scored.select("uid", F.explode("rare").alias("r")).select("uid", "r.k", F.col("r.n").alias("times"))
    added = rare.join(others.hint("shuffle_hash"), "k").groupBy("uid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times"))).alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("logs")
    )
    pairs = scored.select("uid", F.explode(F.arrays_zip("keys", "times")).alias("g")).select("uid", F.col("g.keys").alias("key"), "g.times")
    points = pairs.join(codes.where(F.col("n") < least).select("key", "code"), "key").groupBy("uid").agg(F.sum(F.col("times") * F.col("code")).alias("points"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = scored.drop("rare", "keys", "times").join(added, "uid", "left").join(points, "uid", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + zero("more")).cast("long").alias("n_known"), F.lit(int(n_train)).cast("long").alias("train_tokens"),
        (F.col("base") + zero("logs") - F.col("n_tokens") * F.lit(math.log10(n_train + distinct + 1))).alias("base_score"), (F.col("score") + zero("points")).alias("score"),
    )
