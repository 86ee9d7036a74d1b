"""Benchmark decontamination by spaced-seed hashing (operator 1).

A seed is the hash of the words that a fixed mask selects from consecutive positions; the
ignored positions may differ, so a substituted word spoils only some seeds.

1. Seeds of all masks at all positions of the benchmark go into a table, and into
   a Bloom bitmap of fixed size.
2. Documents emit only seeds that pass the bitmap, with REACH words on either
   side; hits that lie close share one region.
3. Hits join the seed table (Spark broadcasts it or shuffles both sides by size) and give
   alignments: document region, item and diagonal.
4. On each diagonal the words around the hits are compared; the overlap is the segment
   with the best score (+1 a match, -2 a substitution).  A document overlaps an item if
   the segment has at least min(WORDS, SHARE percent of the item's words) matches and
   they are at least SHARE percent of it.

Items of fewer than LONG words may differ in at most one word (two of ten) by that
rule, so SHORT masks at some of their positions find every overlap: the parts an item is cut
into, of which one is intact, or all words but one.  Documents emit seeds only for the short
masks that the lengths of the benchmark's items call for.

Words are cut at 0x20 and 0x09-0x0D, A-Z lower-cased, punctuation at either end ignored.
A benchmark passage that very many documents hold is a hot seed and item: its side of the
joins has few rows and the other is split by adaptive execution.

Null and empty texts and items have no seeds; items of fewer than LEAST words are no
passages and overlap with nothing.  Rows are told apart by (id, hash of the text), null ids
included, in both tables: a row is contaminated by its own text only, rows that repeat both are
treated alike, and benchmark rows that share an id count as items of their own.  Empty
tables give no contamination; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsum.llm.common import Batches, batch, cut, texts
from kinsum.llm.words import MULT, Bloom, WordHashes, bloom, mix

#: Selected positions of each mask.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 2, 4, 7, 8), (0, 1, 4, 6, 9, 10), (0, 2, 3, 7, 8, 10))
#: Masks of short items, and where an item of that many words has them: (mask, position).
SHORT = ((0, 1, 2), (0, 1, 2, 3), (0, 1, 2, 3, 4), (0, 2, 3, 4), (0, 1, 3, 4), (0, 1, 2, 4))
PLACES = {
    3: ((0, 0),), 4: ((1, 0),), 5: ((1, 0), (1, 1), (3, 0), (4, 0), (5, 0)), 6: ((0, 0), (0, 3)),
    7: ((0, 0), (1, 3)), 8: ((1, 0), (1, 4)), 9: ((1, 0), (2, 4)), 10: ((0, 0), (0, 3), (1, 6)),
}
LEAST, LONG = min(PLACES), max(PLACES) + 1
REACH = 48
WORDS, SHARE = 13, 80

EDGES = b".,;:!?\"'`()[]{}<>*_-|/\\"

SEED = pa.schema([("seed", pa.int64()), ("item_id", pa.int64()), ("pos", pa.int32()), ("mask", pa.int32())])
ITEM = pa.schema([("item_id", pa.int64()), ("item", pa.binary())])
HIT = pa.struct([("pos", pa.int32()), ("seed", pa.int64())])
REGION = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("start", pa.int32()), ("words", pa.binary()), ("hits", pa.list_(HIT))])
REGION_DDL = "doc_id long, t long, start int, words binary, hits array<struct<pos: int, seed: long>>"
OVERLAP = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("item_id", pa.int64()), ("matches", pa.int64()), ("length", pa.int64())])


class BareHashes(WordHashes):
    """Hashes of words without the punctuation at their ends."""

    def __missing__(self, word: bytes) -> int:
        bare = word.strip(EDGES) or word
        return self.remember(word, xxhash.xxh3_64_intdigest(bare))


HASHES = BareHashes()


def seeds(words: np.ndarray, ends: np.ndarray, masks):
    """For each of the masks (their numbers; SHORT ones follow on MASKS) the mask, seed hashes and
    positions of texts that lie one after the other; ``ends`` has the end of its text
    for each word."""
    n = len(words)
    for k in masks:
        m = (*MASKS, *SHORT)[k]
        span = m[-1] + 1
        if n < span:
            continue
        at = np.flatnonzero(np.arange(span, n + 1) <= ends[: n - span + 1])
        h = np.full(len(at), k + 1, np.uint64)
        for i in m:
            h = mix(h * MULT + words[at + i])
        yield k, h.view(np.int64), at


def has_seed(k: int, length: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Does an item of that length have a seed of mask k at that position?"""
    if k < len(MASKS):
        return length >= LONG
    out = np.zeros(len(pos), bool)
    for n, places in PLACES.items():
        for mask, p in places:
            if mask == k - len(MASKS):
                out |= (length == n) & (pos == p)
    return out


def flat(texts_: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all words, end of the text for each word, first word of each text and the end)."""
    each = [HASHES.of(t) for t in texts_]
    first = np.concatenate([[0], np.cumsum([len(w) for w in each], dtype=np.int64)]).astype(np.int64)
    words = np.concatenate(each) if each else np.zeros(0, np.uint64)
    return words, np.repeat(first[1:], np.diff(first)), first


def best_segment(same: np.ndarray) -> tuple[int, int]:
    """(matches, length) of the segment with the largest sum of +1 and -2; of several
    the one with most matches."""
    s = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
    low = np.minimum.accumulate(s)
    top = np.flatnonzero(s - low == (s - low).max())
    begin = np.searchsorted(-low, -low[top], "left")  # where the least sum so far is first reached
    length = int((top - begin).max())
    return (int((s - low).max()) + 2 * length) // 3, length


def bench_seeds(bench: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seed, item_id, pos, mask) and (item_id, item words) of the benchmark, where item_id is a
    hash of the row's id and text."""

    def table(batches: Batches) -> Batches:
        for b in batches:
            words, ends, first = flat(b.column(1).to_pylist())
            ids, size = b.column(0).to_numpy(), np.diff(first)
            for k, h, at in seeds(words, ends, range(len(MASKS) + len(SHORT))):
                text = np.searchsorted(first, at, "right") - 1
                pos = at - first[text]
                ok = has_seed(k, size[text], pos)
                yield batch(SEED, seed=h[ok], item_id=ids[text[ok]], pos=pos[ok].astype(np.int32), mask=np.full(ok.sum(), k, np.int32))

    def items(batches: Batches) -> Batches:
        for b in batches:
            yield batch(ITEM, item_id=b.column(0), item=[HASHES.of(t).tobytes() for t in b.column(1).to_pylist()])

    rows = texts(bench, "item_id", binary=True)
    rows = rows.select(F.xxhash64("doc_id", F.col("doc_id").isNull(), "text").alias("doc_id"), "text").dropDuplicates(["doc_id"])
    return rows.mapInArrow(table, "seed long, item_id long, pos int, mask int").distinct(), rows.mapInArrow(items, "item_id long, item binary")


def named(docs: DataFrame) -> DataFrame:
    """doc_id, text, t: whole texts with their hash, which with the id names a row."""
    return texts(docs, binary=True).withColumn("t", F.xxhash64("text"))


def regions(docs: DataFrame, present: Bloom, masks: list[int]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(present)

    def run(batches: Batches) -> Batches:
        for b in batches:
            words, ends, first = flat(b.column(1).to_pylist())
            found = [(at[ok], h[ok]) for _, h, at in seeds(words, ends, masks) if (ok := shared.value.may_hold(h)).any()]
            if not found:
                continue
            at, h = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(at, kind="stable")
            at, h = at[order], h[order]
            ids, names = b.column(0).to_pylist(), b.column(2).to_pylist()
            text = np.searchsorted(first, at, "right") - 1
            cuts = np.flatnonzero((np.diff(text) != 0) | (np.diff(at) > REACH)) + 1
            rows = []
            for g in np.split(np.arange(len(at)), cuts):
                t = text[g[0]]
                s, e = max(first[t], at[g[0]] - REACH), min(first[t + 1], at[g[-1]] + REACH + MASKS[-1][-1])
                rows.append((ids[t], names[t], int(s - first[t]), words[s:e].tobytes(), [{"pos": int(p - first[t]), "seed": int(x)} for p, x in zip(at[g], h[g], strict=True)]))
            d, n, s, w, hits = zip(*rows, strict=True)
            yield batch(REGION, doc_id=d, t=n, start=s, words=w, hits=hits)

    return named(docs).mapInArrow(run, REGION_DDL)


def overlaps(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, t, item_id, matches, length: the best overlap of each document and item that have
    one (t: hash of the document's text)."""
    seeds_, items = bench_seeds(bench)
    seeds_ = cut(seeds_, "seeds")
    masks = sorted(r[0] for r in seeds_.select("mask").distinct().collect())  # at most the number of masks
    found = cut(regions(docs, bloom(seeds_, F.col("seed")), masks), "regions")
    hits = found.select("doc_id", "t", "start", F.explode("hits").alias("h")).select("doc_id", "t", "start", F.col("h.pos").alias("at"), "h.seed")
    lines = cut(hits.join(seeds_, "seed").select("doc_id", "t", "start", "item_id", (F.col("at") - F.col("pos")).alias("diagonal")).distinct(), "diagonals")

    def verify(batches: Batches) -> Batches:
        for b in batches:
            out = []
            for doc, name, start, item, diagonal, w, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w, x = np.frombuffer(w, np.uint64), np.frombuffer(x, np.uint64)
                lo, hi = max(0, start - diagonal), min(len(x), start + len(w) - diagonal)
                matches, length = best_segment(w[lo + diagonal - start : hi + diagonal - start] == x[lo:hi])
                if matches >= min(WORDS, -(-SHARE * len(x) // 100)) and 100 * matches >= SHARE * length:
                    out.append((doc, name, item, matches, length))
            yield batch(OVERLAP, **{f.name: [o[k] for o in out] for k, f in enumerate(OVERLAP)})

    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.t") == F.col("r.t")) & (F.col("l.start") == F.col("r.start"))
    # rows that repeat id and text have the same regions
    once = found.drop("hits").dropDuplicates(["doc_id", "t", "start"])
    near = lines.alias("l").join(once.alias("r"), same).select("l.doc_id", "l.t", "l.start", "item_id", "diagonal", "words")
    each = near.join(items, "item_id").select("doc_id", "t", "start", "item_id", "diagonal", "words", "item").mapInArrow(verify, "doc_id long, t long, item_id long, matches long, length long")
    best = F.max(F.struct("matches", (-F.col("length")).alias("shorter")))
    return each.groupBy("doc_id", "t", "item_id").agg(best.alias("b")).select("doc_id", "t", "item_id", "b.matches", (-F.col("b.shorter")).alias("length"))


def decontaminate(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, n_items, best_overlap (words), contaminated: one row per document."""
    per = cut(overlaps(docs, bench).groupBy("doc_id", "t").agg(F.count("*").alias("n"), F.max("matches").alias("m")).select(F.col("doc_id").alias("_id"), F.col("t").alias("_t"), "n", "m"), "contaminated")
    rows = named(docs).select("doc_id", "t")
    out = rows.join(per, rows["doc_id"].eqNullSafe(per["_id"]) & (rows["t"] == per["_t"]), "left")
    return out.select(
        "doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_items"), F.coalesce("m", F.lit(0)).cast("long").alias("best_overlap"), F.col("n").isNotNull().alias("contaminated")
    )


def clean(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """``docs`` without the rows that are contaminated."""
    bad = cut(overlaps(docs, bench).select(F.col("doc_id").alias("_id"), F.col("t").alias("_t")).distinct(), "contaminated")
    name = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary"))
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["_id"]) & (name == bad["_t"]), "left_anti")
