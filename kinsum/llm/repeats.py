"""Removal of repeated byte strings by merging shard Burrows-Wheeler transforms
(operator 10).

Every byte that is covered by a LENGTH-byte string (a window) that starts anywhere else
too is removed.

1. Anchors.  Of the hashes of the GRAM-byte strings in a window the smallest is the
   window's anchor.  Equal windows have equal anchors at the same place, so a window
   whose anchor occurs once in the corpus is not repeated.  Counts are pre-aggregated
   and go into a Bloom bitmap of bounded size.
2. Windows with a repeated anchor are grouped by the anchor's 128-bit hash.  What lies
   between the windows' first and last byte, with the anchor itself as ONE symbol, is a
   short string (a segment): up to LENGTH - GRAM bytes, the anchor, up to LENGTH - GRAM
   bytes.  Equal segments are aggregated first; all windows of one that occurs
   twice are repeated.
3. The distinct segments of groups with several of them are dealt out by group.  Each
   task sorts small shards of them into Burrows-Wheeler transforms and merges the shards
   by interleave refinement: in each round the interleave, known for the first h
   symbols, is stably distributed by the transforms' symbols, which gives it for h + 1
   symbols, and block borders travel along, which gives the common prefixes.  After
   LENGTH - GRAM + 1 rounds a block of two or more suffixes is a repeated window.  No
   suffix is compared or sorted again.
4. Repeated offsets (a bit mask per segment) go back to the documents by segment.

A group whose segments exceed HOT (the borders of a passage that very many documents
share) is cut into pieces by window offset: pieces are keyed by the bytes all
their windows hold.  Where the group of a piece still exceeds HOT its offsets are halved, down
to one offset, whose key is the whole window: equal pieces are counted then.  So no
task gathers a group of more than HOT distinct segments or pieces.

Null text counts as empty; rows that repeat id and text are windows that start elsewhere,
so all of a text of LENGTH bytes or more goes when its row is repeated.  Null
ids are passed on.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsum.llm.common import Batches, batch, cut, raw_bytes, texts
from kinsum.llm.words import Bloom, bloom, mix

LENGTH, GRAM = 200, 144
#: Offsets of an anchor in a window: 0 to REACH.
REACH = LENGTH - GRAM
HOT = 5000
#: Symbols merged at once, and in one shard; groups merged at once.
SYMBOLS, SHARD, GROUPS = 400_000, 100_000, 60_000
FIRST_ID = -(1 << 63)
PARTS = ((0, 0), (1, 1), (2, 3), (4, 7), (8, 15), (16, 31), (32, REACH))

BYTE = np.random.default_rng(10).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes hashed at once; powers of an odd multiplier and of its inverse for them.
CHUNK = 1 << 16
MULT = np.uint64(0x9E3779B97F4A7C15)


def powers(base: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(CHUNK, base, np.uint64))])


UP, DOWN = powers(int(MULT)), powers(pow(int(MULT), -1, 1 << 64))

SEGMENT = pa.schema(
    [("id", pa.int64()), ("t", pa.int64()), ("p", pa.int32()), ("c1", pa.int64()), ("c2", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("key", pa.binary()), ("left", pa.binary()), ("right", pa.binary())]
)
SEGMENT_DDL = "id long, t long, p int, c1 long, c2 long, lo int, hi int, key binary, left binary, right binary"
MASK = pa.schema([("c1", pa.int64()), ("c2", pa.int64()), ("mask", pa.int64())])


# --- anchors -----------------------------------------------------------------------


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """Hashes of all strings of GRAM bytes in up to CHUNK bytes: differences of one
    running sum of powers, so the cost does not depend on GRAM."""
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(BYTE[b] * UP[: len(b)], out=sums[1:])
    h = (sums[GRAM:] - sums[: len(sums) - GRAM]) * DOWN[: len(b) - GRAM + 1]
    return mix(h)


def chunk_anchors(b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position p of an anchor, its hash, first and last window start that it has) of
    texts that lie one after the other; ``ends`` has where they end.  Of equal
    minima in a window the last one is the anchor."""
    h = gram_hashes(b)
    n = len(b) - LENGTH + 1
    low32 = np.uint64(0xFFFFFFFF)
    w = REACH + 1
    x = np.full(-(-len(h) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    x[: len(h)] = (h & ~low32) | (low32 - np.arange(len(h), dtype=np.uint64))
    x = x.reshape(-1, w)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    behind = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    p = (low32 - (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & low32)).astype(np.int64)
    inside = np.ones(n, bool)  # windows within one text
    for e in ends[:-1].tolist():
        inside[max(0, e - LENGTH + 1) : e] = False
    s = np.flatnonzero(inside)
    new = np.ones(len(s), bool)
    new[1:] = (np.diff(p[s]) != 0) | (np.diff(s) != 1)
    first = np.flatnonzero(new)
    at = p[s[first]]
    return at, h[at], s[first], s[np.concatenate([first[1:], [len(s)]]) - 1] if len(s) else s


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """:func:`chunk_anchors` of all texts in ``data`` (``off``: where they begin and the
    end), a chunk at a time; longer texts in chunks that overlap by LENGTH - 1 bytes."""
    out, i, texts_ = [], 0, len(off) - 1
    while i < texts_:
        j = i + 1
        while j < texts_ and off[j + 1] - off[i] <= CHUNK:
            j += 1
        a, e = int(off[i]), int(off[j])
        for c in range(a, max(a + 1, e - LENGTH + 1), CHUNK - LENGTH + 1):
            d = min(e, c + CHUNK)
            if d - c >= LENGTH:
                ends = off[i + 1 : j + 1] - c if d == e else np.array([d - c])
                out.append([x if k == 1 else x + c for k, x in enumerate(chunk_anchors(data[c:d], ends))])
        i = j
    if not out:
        none = np.zeros(0, np.int64)
        return none, none.view(np.uint64), none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def anchor_counts(docs: DataFrame) -> DataFrame:
    """a (anchor hash) of the anchors that occur at least twice."""
    schema = pa.schema([("a", pa.int64()), ("n", pa.int32())])

    def run(batches: Batches) -> Batches:
        for b in batches:
            h, n = np.unique(anchors(*raw_bytes(b.column(1)))[1], return_counts=True)
            yield batch(schema, a=h.view(np.int64), n=np.minimum(n, 2).astype(np.int32))

    return texts(docs, binary=True).mapInArrow(run, "a long, n int").groupBy("a").agg(F.sum("n").alias("n")).where("n > 1").select("a")


def keyed(docs: DataFrame) -> DataFrame:
    """id, text (binary), t: id and t name a text."""
    rows = texts(docs, binary=True)
    return rows.select(F.coalesce("doc_id", F.lit(FIRST_ID)).alias("id"), "text", F.xxhash64("text").alias("t"))


def pairs(digests: list[bytes]) -> np.ndarray:
    """128-bit digests as rows of two signed 64-bit integers."""
    return np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)


def segments(docs: DataFrame, present: Bloom) -> DataFrame:
    """A row for every anchor that may be repeated: where it is (id, t, p) and its
    segment's hash (c1, c2); the segment itself with the first such row of a batch."""
    shared = docs.sparkSession.sparkContext.broadcast(present)

    def run(batches: Batches) -> Batches:
        digest = xxhash.xxh3_128_digest
        for b in batches:
            data, off = raw_bytes(b.column(1))
            at, h, first, last = anchors(data, off)
            ok = shared.value.may_hold(h)
            at, first, last = at[ok], first[ok], last[ok]
            doc = np.searchsorted(off, first, "right") - 1
            raw = data.tobytes()
            seen, names, where, new = set(), [], [], []
            for k, (p, s0, s1) in enumerate(zip(at.tolist(), first.tolist(), last.tolist(), strict=True)):
                c = digest(raw[s0 : s1 + LENGTH], p - s0)  # the seed tells where the anchor is
                names.append(c)
                if c not in seen:
                    seen.add(c)
                    where.append(k)
                    new.append((digest(raw[p : p + GRAM]), raw[s0:p], raw[p + GRAM : s1 + LENGTH]))
            c = pairs(names)
            place = np.full(len(at), -1, np.int64)
            place[where] = np.arange(len(where))
            take = pa.array(place, mask=place < 0)
            more = [pa.array([r[j] for r in new], pa.binary()).take(take) for j in range(3)]
            ints = [pa.array(x.astype(np.int32)) for x in (at - off[doc], at - last, at - first)]
            cols = [b.column(0).take(pa.array(doc)), b.column(2).take(pa.array(doc)), ints[0], pa.array(c[:, 0]), pa.array(c[:, 1]), *ints[1:], *more]
            yield pa.RecordBatch.from_arrays(cols, schema=SEGMENT)

    return keyed(docs).mapInArrow(run, SEGMENT_DDL)


# --- transforms ----------------------------------------------------------------------


def rotations_sorted(sym: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Order of the rotations of a shard's strings, by prefix doubling."""
    _, rank = np.unique(sym, return_inverse=True)
    jump, groups = nxt, 0
    while True:
        key = rank.astype(np.int64) * (len(sym) + 1) + rank[jump]
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(len(sym), np.int64)
        rank[order] = new
        if new[-1] == groups or new[-1] == len(sym) - 1:
            return order
        groups, jump = new[-1], jump[jump]


def interleave(bwt: np.ndarray, sizes: list[int], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge the transforms of shards (one after the other in ``bwt``): (shard at each
    place of the merged order, block at each place) where a block holds the
    suffixes that agree in the first ``rounds`` symbols."""
    z = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
    block = np.zeros(len(bwt), np.int64)
    seq = np.empty_like(bwt)
    blocks = 0
    for _ in range(rounds):
        seq[np.argsort(z, kind="stable")] = bwt  # each shard's symbols in its own order
        order = np.argsort(seq, kind="stable")
        s, b = seq[order], block[order]
        block = np.concatenate([[0], np.cumsum((s[1:] != s[:-1]) | (b[1:] != b[:-1]))])
        z = z[order]
        if block[-1] == blocks:  # no block was split: none will be
            break
        blocks = block[-1]
    return z, block


def repeated_offsets(found: list[tuple[int, int, int, bytes, bytes]]) -> list[int]:
    """For distinct segments (group, lo, hi, left, right): the offsets at which a window
    of LENGTH bytes occurs in another segment, as a bit mask."""
    lengths = np.array([len(f[3]) + len(f[4]) + 2 for f in found])
    start = np.concatenate([[0], np.cumsum(lengths)])
    n = int(start[-1])
    sym = np.zeros(n, np.uint16)  # 0: end of a string, 1 to 256: bytes, from 257: anchors
    raw = b"".join(f[3] + b"\0" + f[4] + b"\0" for f in found)
    sym[:] = np.frombuffer(raw, np.uint8).astype(np.uint16) + 1
    core = start[:-1] + [len(f[3]) for f in found]
    sym[core] = np.array([f[0] for f in found]) + 257
    sym[start[1:] - 1] = 0
    nxt = np.arange(1, n + 1)
    nxt[start[1:] - 1] = start[:-1]
    prev = np.arange(-1, n - 1)
    prev[start[:-1]] = start[1:] - 1
    # shards of whole strings
    cuts = [0]
    for i in range(1, len(found) + 1):
        if i == len(found) or start[i + 1] - start[cuts[-1]] > SHARD:
            cuts.append(i)
    places, sizes = [], []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        s, e = start[a], start[b]
        places.append(s + rotations_sorted(sym[s:e], nxt[s:e] - s))
        sizes.append(int(e - s))
    suffix = np.concatenate(places)
    z, block = interleave(sym[prev[suffix]], sizes, REACH + 1)
    size = np.bincount(block)
    again = np.zeros(n, bool)
    again[suffix] = size[block[np.argsort(z, kind="stable")]] > 1
    out = []
    for (_, lo, hi, _, _), c in zip(found, core.tolist(), strict=True):
        bits = again[c - hi : c - lo + 1][::-1]  # offsets lo to hi
        out.append(int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little") << lo)
    return out


ALL_OFFSETS = "(shiftleft(1L, hi + 1) - 1) ^ (shiftleft(1L, lo) - 1)"


def masks(batches: Batches) -> Batches:
    """Segments sorted by group -> (c1, c2, mask of repeated offsets)."""
    todo: list[tuple] = []  # (c1, c2, group, lo, hi, left, right)
    group, key, symbols = -1, None, 0

    def flush():
        size = np.bincount([r[2] for r in todo]) if todo else []
        some = [r for r in todo if size[r[2]] > 1]
        found = zip(some, repeated_offsets([r[2:] for r in some]), strict=True) if some else ()
        out = [(r[0], r[1], m) for r, m in found if m]
        return batch(MASK, c1=[r[0] for r in out], c2=[r[1] for r in out], mask=[r[2] for r in out])

    for b in batches:
        for c1, c2, lo, hi, k, left, right in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if k != key:
                if symbols >= SYMBOLS or group >= GROUPS:
                    yield flush()
                    todo, group, symbols = [], -1, 0
                group, key = group + 1, k
            todo.append((c1, c2, group, lo, hi, left, right))
            symbols += len(left) + len(right) + 2
    yield flush()


CONTENT = ["c1", "c2", "lo", "hi", "key", "left", "right"]
CONTENT_DDL = "c1 long, c2 long, lo int, hi int, key binary, left binary, right binary"


def merged(contents: DataFrame) -> DataFrame:
    """(c1, c2, mask) from the transforms of distinct segments, by group."""
    rows = contents.select(CONTENT).repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(masks, "c1 long, c2 long, mask long")


def twice(rows: DataFrame) -> DataFrame:
    """(c1, c2, mask) of segments that occur twice: all their windows are repeated."""
    each = rows.groupBy("c1", "c2").agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.min("hi").alias("hi"))
    return each.where("n > 1").select("c1", "c2", F.expr(ALL_OFFSETS).alias("mask"))


def halves(first: int, last: int) -> tuple[tuple[int, int], ...]:
    middle = (first + last) // 2
    return ((first, middle), (middle + 1, last))


def pieces(batches: Batches) -> Batches:
    """Segments of very large groups, or pieces of them, cut by window offset; (c1, c2) is
    the piece, (of1, of2) the segment, first and last the offsets its group stands for."""
    schema = pa.schema([(c, pa.int64()) for c in ("of1", "of2")] + [(c, pa.int32()) for c in ("first", "last")] + [SEGMENT.field(c) for c in CONTENT])
    for b in batches:
        rows = []
        for of1, of2, f, t, lo, hi, key, left, right in zip(*(c.to_pylist() for c in b.columns), strict=True):
            for first, last in PARTS if f is None else halves(f, t):
                a, z = max(first, lo), min(last, hi)
                if a <= z:
                    k = xxhash.xxh3_128_digest(b"%b|%d|" % (key, first) + left[len(left) - first :] + b"|" + right[: REACH - last])
                    rows.append((of1, of2, first, last, a, z, k, left[len(left) - z :], right[: REACH - a]))
        if rows:
            q = pairs([xxhash.xxh3_128_digest(b"%b|%d|%d|%d|" % (k, a, z, len(x)) + x + y) for *_, a, z, k, x, y in rows])
            of1, of2, first, last, *rest = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((of1, of2, first, last, q[:, 0], q[:, 1], *rest), schema, strict=True)], schema=schema)


PIECE_DDL = "of1 long, of2 long, first int, last int, " + CONTENT_DDL


def distinct(pieces_: DataFrame) -> DataFrame:
    return pieces_.groupBy("c1", "c2").agg(*[F.first(x).alias(x) for x in CONTENT[2:]])


def cut_up(segments_: DataFrame) -> DataFrame:
    """Pieces of ``segments_`` whose groups have at most HOT distinct ones."""
    none = F.lit(None).cast("int")
    todo = segments_.select(F.col("c1").alias("of1"), F.col("c2").alias("of2"), none.alias("first"), none.alias("last"), *CONTENT[2:])
    done = []
    while True:
        now = cut(todo.mapInArrow(pieces, PIECE_DDL), "pieces")
        # the pieces of a group at one offset are all equal
        large = cut(distinct(now.where("first < last")).groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > HOT).select("key"), "large-pieces")
        if large.isEmpty():
            return reduce(DataFrame.unionAll, [*done, now])
        done.append(now.join(large, "key", "left_anti").select(now.columns))
        todo = now.join(large, "key", "left_semi").select("of1", "of2", "first", "last", *CONTENT[2:])


def of_several(rows: DataFrame) -> DataFrame:
    """Distinct segments of groups that have several: their bytes alone are shuffled (a
    bitmap of the groups lets few others through)."""
    bytes_ = rows.where("key is not null")
    c = F.struct("c1", "c2")
    several = cut(bytes_.groupBy("key").agg(F.min(c).alias("a"), F.max(c).alias("b")).where("a <> b").select("key"), "several")
    bits = bitmap_bits(several)
    shared = rows.sparkSession.sparkContext.broadcast(bloom(several, F.xxhash64("key"), bits))

    def run(batches: Batches) -> Batches:
        for b in batches:
            yield pa.RecordBatch.from_arrays(b.filter(pa.array(shared.value.may_hold(b.column(7).to_numpy()))).columns[:7], names=CONTENT)

    some = bytes_.select(*CONTENT, F.xxhash64("key").alias("h")).mapInArrow(run, CONTENT_DDL)
    return some.groupBy("c1", "c2").agg(*[F.first(x).alias(x) for x in CONTENT[2:]])


def bitmap_bits(keys: DataFrame) -> int:
    return max(20, min(28, math.ceil(math.log2(keys.count() + 1)) + 5))


def repeated(docs: DataFrame) -> DataFrame:
    """(id, t, marks): of each text with repeated windows, array<struct<p, mask>>: bit o of
    the mask is set if the window that starts at p - o is repeated."""
    again = cut(anchor_counts(docs), "anchors")
    rows = cut(segments(docs, bloom(again, F.col("a"), bitmap_bits(again))), "segments")
    contents = cut(of_several(rows), "contents")
    large = cut(contents.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > HOT).select("key"), "large")
    found = twice(rows)
    if large.isEmpty():
        found = found.unionByName(merged(contents))
    else:
        found = found.unionByName(merged(contents.join(large, "key", "left_anti")))
        cutup = cut_up(contents.join(large, "key", "left_semi"))
        got = cut(twice(cutup).unionByName(merged(distinct(cutup))), "piece-masks")
        found = found.unionByName(cutup.select("of1", "of2", "c1", "c2").join(got, ["c1", "c2"]).select(F.col("of1").alias("c1"), F.col("of2").alias("c2"), "mask"))
    known = cut(found.groupBy("c1", "c2").agg(F.bit_or("mask").alias("mask")), "masks")
    marks = rows.select("id", "t", "p", "c1", "c2").join(known, ["c1", "c2"])
    return marks.groupBy("id", "t").agg(F.collect_list(F.struct("p", "mask")).alias("marks"))


def covered(n: int, p: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Which of n bytes lie in a marked window."""
    bits = np.unpackbits(mask.astype(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    i, o = np.nonzero(bits)
    last = np.full(n, -LENGTH, np.int64)
    starts = p[i] - o
    last[starts] = starts
    return np.arange(n) - np.maximum.accumulate(last) < LENGTH


OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
OUT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per document."""
    marks = cut(repeated(docs), "marks")
    touched = docs.sparkSession.sparkContext.broadcast(bloom(marks, F.xxhash64("id", "t"), 24))

    def split(batches: Batches) -> Batches:
        """Untouched texts only need their hash; the others go on whole."""
        schema = pa.schema([("id", pa.int64()), ("t", pa.int64()), ("n_bytes", pa.int64()), ("sha", pa.string()), ("text", pa.binary())])
        for b in batches:
            hit = touched.value.may_hold(b.column(3).to_numpy())
            x = b.column(1).to_pylist()
            sha = [None if h else hashlib.sha256(y).hexdigest() for y, h in zip(x, hit, strict=True)]
            yield batch(schema, id=b.column(0), t=b.column(2), n_bytes=[len(y) for y in x], sha=sha, text=[y if h else None for y, h in zip(x, hit, strict=True)])

    def finish(batches: Batches) -> Batches:
        for b in batches:
            rows = []
            for i, n, sha, text, ps, ms in zip(*(c.to_pylist() for c in b.columns), strict=True):
                gone = spans = 0
                if sha is None:
                    c = covered(n, np.array(ps or [], np.int64), np.array(ms or [], np.int64))
                    gone, spans = int(c.sum()), int((np.diff(np.concatenate([[0], c.astype(np.int8)])) == 1).sum())
                    sha = hashlib.sha256(np.frombuffer(text, np.uint8)[~c].tobytes()).hexdigest()
                rows.append((i, n, gone, spans, sha))
            d, n, g, s, h = zip(*rows, strict=True) if rows else ((),) * 5
            yield batch(OUT, doc_id=d, n_bytes=n, n_removed=g, n_spans=s, kept_sha256=h)

    each = keyed(docs).withColumn("h", F.xxhash64("id", "t")).mapInArrow(split, "id long, t long, n_bytes long, sha string, text binary")
    both = each.join(marks.hint("merge"), ["id", "t"], "left")
    out = both.select(F.when(F.col("id") != FIRST_ID, F.col("id")).alias("id"), "n_bytes", "sha", "text", F.col("marks.p").alias("ps"), F.col("marks.mask").alias("ms"))
    return out.mapInArrow(finish, OUT_DDL)
