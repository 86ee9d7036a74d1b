"""SimHash near-dedup by meet-in-the-middle ball hashing (operator 11).

A fingerprint has bit b when over half of a text's shingle hashes (XXH64, seed 42,
repeats included) have it.  Two texts are linked when their fingerprints differ in at most
RADIUS = 3 bits.

1. Texts with one fingerprint form a class, so copies cost one row from here on.
2. Half the radius is one bit and a half.  The bits are cut into three blocks, and for each
   block every class emits its fingerprint without that block, as it is and with each one of
   the other bits flipped (all variants within one bit: 131 keys of 42 or 43 bits).  Of
   three differing bits one lies in some block; without that block at most two remain,
   and the pair meets half-way in the variant that has one of them flipped.  So
   every linked pair shares a key.
3. Variants are shuffled and sorted by key and read in one pass.  Pairs in runs of up to
   SMALL classes are compared bit by bit.  A run of up to LARGE classes gives a spanning
   forest of its links: each class reached is compared with those not reached yet, so a dense
   cluster costs little more than one comparison a class.  The links are deduplicated.
4. Only where a comparison with the whole run would cost more than the variants within two
   bits number (2,081), in runs longer than LARGE, do the members
   emit all those variants of the whole fingerprint.  In a run of one variant all
   members lie within two bits of it, so when one of them, the centre, lies within one bit,
   it is linked with every other: a star, not all pairs.  A pair at one to three
   bits always has a variant within one bit of one and two of the other.  This costs a
   constant a class, however large the cluster is.
5. Components of the links are found in rounds of joins.

No group is collected: runs are streamed with up to LARGE rows carried over.

Texts without words (null, empty, blank) have fingerprint zero and are linked like any
other.  A text with fewer than three words is one shingle.  Rows are told apart by
(id, fingerprint): rows that repeat both are alike, rows that share only the id are not linked by
it.  A row with a null id takes part, but gives no component its name; without any id
reached the component is null.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsum.llm.common import Batches, batch, cut, texts
from kinsum.llm.graph import components

WIDTH, SEED, RADIUS = 3, 42, 3
#: Bits of the three blocks of which one is left out of a key.
BLOCKS = (22, 21, 21)
#: Classes of one key that are compared pair by pair, by streaming offsets.
SMALL = 16
#: Classes of one key that are linked by a spanning forest; members of longer runs emit their variants.
LARGE = 2048
#: Shingle hashes whose bits are spread out at a time.
SPREAD = 8192

PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """SimHash of a UTF-8 text: A-Z lower-cased, words cut at 0x20 and 0x09-0x0D."""
    w = text.lower().split()
    if not w:
        return 0
    k = min(width, len(w))
    n = len(w) - k + 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(b" ".join(s), SEED) for s in zip(*[w[i:] for i in range(k)], strict=False)), np.uint64, n)
    set_in = np.zeros(64, np.int64)
    for i in range(0, n, SPREAD):
        part = h[i : i + SPREAD].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        set_in += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, fp (signed) of every row."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], np.uint64)
            yield batch(PRINTS, doc_id=b.column(0), fp=fp.view(np.int64))

    return texts(docs, binary=True).mapInArrow(run, "doc_id long, fp long")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masked_variants(fps: DataFrame) -> DataFrame:
    """(key, fp): for each block left out, the rest and all its one-bit variants."""
    masks, start = [], 0
    for number, size in enumerate(BLOCKS):
        gone = ((1 << size) - 1) << start
        start += size
        keep = (1 << 64) - 1 - gone
        flips = [0, *(1 << i for i in range(64) if keep >> i & 1)]
        masks += [F.struct(F.lit(number).alias("block"), F.lit(signed(keep)).alias("keep"), F.lit(signed(f)).alias("flip")) for f in flips]
    each = fps.select("fp", F.explode(F.array(*masks)).alias("m"))
    return each.select(F.xxhash64("m.block", F.col("fp").bitwiseXOR(F.col("m.flip")).bitwiseAND(F.col("m.keep"))).alias("key"), "fp")


def ball_variants(fps: DataFrame) -> DataFrame:
    """(key, far, fp): all variants within two bits of the whole fingerprint; far = 2 bits."""
    bits = "transform(sequence(0, 63), i -> transform(sequence(i, 63), j -> shiftleft(1L, i) | shiftleft(1L, j)))"
    each = fps.select("fp", F.explode(F.expr(f"concat(array(0L), flatten({bits}))")).alias("m"))
    return each.select(F.col("fp").bitwiseXOR(F.col("m")).alias("key"), (F.bit_count("m") == 2).alias("far"), "fp")


def unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs (a < b)."""
    if not len(a):
        return a, b
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return both[:, 0], both[:, 1]


def near_pairs(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one key that differ in at most RADIUS bits; keys are sorted."""
    a, b = [fp[:0]], [fp[:0]]
    for step in range(1, SMALL):
        at = np.flatnonzero(key[step:] == key[:-step])
        if not len(at):
            break
        x, y = fp[at], fp[at + step]
        ok = (np.bitwise_count((x ^ y).view(np.uint64)) <= RADIUS) & (x != y)
        a.append(x[ok])
        b.append(y[ok])
    return unique_pairs(np.concatenate(a), np.concatenate(b))


def forest(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a < b) that connect all fingerprints within RADIUS bits, fewer than there are fingerprints."""
    left = np.unique(fp)
    a, b = [left[:0]], [left[:0]]
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            x = reached.pop()
            near = np.bitwise_count((left ^ x).view(np.uint64)) <= RADIUS
            if near.any():
                found, left = left[near], left[~near]
                a.append(np.minimum(found, x))
                b.append(np.maximum(found, x))
                reached.extend(found)
    return np.concatenate(a), np.concatenate(b)


def compare_runs(batches: Batches, large: int = LARGE) -> Batches:
    """Sorted (key, fp) -> links (a < b); members of runs over ``large`` come out as (fp, fp)."""
    key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
    long_run = None  # the key of an open run that is known to be long

    def settle(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(starts, len(key)))
        over = (size > large) | (key[starts] == long_run if long_run is not None else False)
        small, big = np.repeat((size <= SMALL) & ~over, size), np.repeat(over, size)
        found = [near_pairs(key[small], fp[small])]
        found += [forest(fp[i : i + n]) for i, n in zip(starts[(size > SMALL) & ~over], size[(size > SMALL) & ~over], strict=True)]
        a, b = unique_pairs(*(np.concatenate(side) for side in zip(*found, strict=True)))
        members = np.unique(fp[big])
        return batch(PAIRS, a=np.concatenate([a, members]), b=np.concatenate([b, members]))

    for rows in batches:
        key = np.concatenate([key, rows.column(0).to_numpy()])
        fp = np.concatenate([fp, rows.column(1).to_numpy()])
        if not len(key):
            continue
        first = int(np.searchsorted(key, key[-1]))  # the last run may go on
        if len(key) - first > large or key[-1] == long_run:
            if long_run != key[-1]:
                yield settle(key[:first], fp[:first])
                long_run, key, fp = key[-1], key[first:], fp[first:]
            yield settle(key, fp)
            key, fp = key[:0], fp[:0]
        elif first:
            yield settle(key[:first], fp[:first])
            key, fp = key[first:], fp[first:]
    yield settle(key, fp)


def centre_stars(batches: Batches) -> Batches:
    """Sorted (key, far, fp) -> links of a run's first row, if that is not far, with the others."""
    last, centre, near = None, 0, False
    for rows in batches:
        key, far, fp = rows.column(0).to_numpy(), rows.column(1).to_numpy(zero_copy_only=False), rows.column(2).to_numpy()
        if not len(key):
            continue
        starts = np.flatnonzero(np.concatenate([[key[0] != last], key[1:] != key[:-1]]))
        run = np.searchsorted(starts, np.arange(len(key)), "right")  # 0: goes on from the batch before
        heads = np.concatenate([[centre], fp[starts]])
        open_ = np.concatenate([[near], ~far[starts]])
        ok = open_[run] & (heads[run] != fp)
        a, b = unique_pairs(heads[run][ok], fp[ok])
        yield batch(PAIRS, a=a, b=b)
        last, centre, near = key[-1], heads[run[-1]], bool(open_[run[-1]])


def links(fps: DataFrame, large: int = LARGE) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within RADIUS bits."""
    found = masked_variants(fps).repartition("key").sortWithinPartitions("key", "fp").mapInArrow(partial(compare_runs, large=large), "a long, b long")
    found = cut(found.distinct(), "links")
    pairs, members = found.where("a <> b"), found.where("a = b").select(F.col("a").alias("fp"))
    if members.isEmpty():
        return pairs
    stars = ball_variants(members).repartition("key").sortWithinPartitions("key", "far", "fp").mapInArrow(centre_stars, "a long, b long")
    return pairs.unionByName(cut(stars.distinct(), "links"))


def simhash_dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per document."""
    rows = cut(fingerprints(docs, width), "fingerprints")
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    comps = components(links(classes.select("fp")))
    rooted = cut(classes.join(comps.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "low", F.coalesce("comp", "fp").alias("root")), "roots")
    names = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = cut(rooted.join(names, "root").select("fp", "component_id"), "names")
    out = rows.join(named.hint("merge"), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
