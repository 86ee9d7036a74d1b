"""Cross-tokenizer alignment with external spill counting (operator 12).

Every text is encoded by two tokenizers, A on a space and the text, B on the text (which adds
that space itself).  Byte offsets where tokens of both end cut the text into groups; two tokens are
linked when their byte ranges overlap.  An id pair's count is the number of documents of
the corpus that hold it linked; the best pairs of an A id are those with its highest count.

1. A task encodes its texts and gathers pair-document records (A id, B id, document, links).
   At RUN_RECORDS records it closes a run: they are sorted side-major (A, then B, then
   document), cut into RADIX parts by A id, and every part becomes one row with two zstd
   frames: the pairs with the number of their documents, and the documents behind each.  A frequent
   pair is one entry of a run, however many documents hold it.  One more row holds the
   documents' own columns.
2. Each part's runs are merged, up to FANIN at a time and level by level, by a k-way heap over their
   A ids: the slices of the least A id are summed by B id.  Since entries come side-major,
   an A id's maximum is known as soon as its slices are summed, and the last level
   writes each pair with its count and whether it is a best one: the part's table.
3. The table streams back to the runs of its part (tables are sorted before runs, and for
   many runs a part is dealt into lanes with a copy of the table each): each run adds up its
   documents' contributions by position and sends one array a part, which are summed by run
   and laid beside the documents' own columns.

Only compressed runs are shuffled, a group never holds more than FANIN of them, a
worker's memory is bounded by RUN_RECORDS, FANIN times one part, and one part's table (whose
size is bounded by the vocabularies).  Documents are told apart by run and position, so repeated and
null ids are rows like any other.

Null and empty texts, and texts whose A or B bytes differ from a space and the text, have no
tokens: zeros and an empty groups column.  Special strings inside texts are plain text.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsum.llm.bpe_codec import byte_letters
from kinsum.llm.common import Batches, batch, cut, texts

#: Records of a run, parts by A id, runs that are merged at a time, runs of a lane.
RUN_RECORDS, RADIX, FANIN, LANE = 1_000_000, 32, 32, 256
#: Texts that are encoded at a time, and their characters.
AT_ONCE, CHARS = 64, 400_000

#: Part of the rows with the documents' own columns.
HEAD = -1
RUNS = pa.schema([("part", pa.int32()), ("run", pa.int64()), ("pairs", pa.binary()), ("docs", pa.binary())])
RUNS_DDL = "part int, run long, pairs binary, docs binary"
OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())]
)
OUT_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def pack(*arrays: np.ndarray) -> bytes:
    """One zstd frame of int64 arrays; sorted ones are best stored as differences."""
    head = struct.pack(f"<{len(arrays)}q", *map(len, arrays))
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(a, "<i8").tobytes() for a in arrays))


def unpack(blob: bytes, n: int) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = struct.unpack_from(f"<{n}q", raw)
    data = np.frombuffer(raw, "<i8", offset=8 * n)
    return np.split(data, np.cumsum(sizes)[:-1])


def differences(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=0)


# ---------------------------------------------------------------- encoding


#: Fixed value: the published splitting pattern of byte-level vocabularies of this kind.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longest text that is split by a backtracking pattern.
SPLIT_CHARS = 200_000


def tokenizer(path: str):
    """Ids of a space and each text by the tokenizers library, special strings as plain text."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_truncation()
    t.no_padding()
    return lambda some: [x.ids for x in t.encode_batch_fast([" " + x for x in some], add_special_tokens=False)]


def ranked(spec: dict, entries: list[bytes], path: str):
    """The same ids by tiktoken, three times as fast, if the file is a plain byte-level one whose
    ids rise with the merges, so that an id is its rank; else None.  Very long texts go to the
    tokenizers library."""
    import tiktoken

    model, split = spec["model"], spec["pre_tokenizer"] or {}
    vocab = model["vocab"]
    merges = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
    ids = [vocab[u + v] for u, v in merges]
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec["normalizer"]
    if not plain or any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")) or ids != sorted(set(ids)):
        return None
    fast = tiktoken.Encoding("ranked", pat_str=SPLIT, mergeable_ranks={x: i for i, x in enumerate(entries) if x}, special_tokens={})
    slow = tokenizer(path)
    return lambda some: [fast.encode_ordinary(" " + x) if len(x) <= SPLIT_CHARS else slow([x])[0] for x in some]


class Sides:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece

        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = {c: i for i, c in enumerate(byte_letters())}
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["id"] for t in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        self.a_bytes = [b""] * (max([*vocab.values(), *special], default=-1) + 1)
        for t, i in vocab.items():
            if i not in special:
                self.a_bytes[i] = bytes(byte_of[c] for c in t)
        self.a = ranked(spec, self.a_bytes, a_path) or tokenizer(a_path)
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.b_bytes = [piece(i) for i in range(self.b.get_piece_size())]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        self.decimals = decimals(max(len(self.a_bytes), len(self.b_bytes)))

    def encode(self, some: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Token ids of both sides; none where the bytes are not those of the text."""
        full = [t for t in some if t]
        both = iter(zip(self.a(full), self.b.encode(full, num_threads=1), strict=True))
        for t in some:
            if t:
                a, b = next(both)
                want = b" " + t.encode()
                if b"".join(map(self.a_bytes.__getitem__, a)) == want and b"".join(map(self.b_bytes.__getitem__, b)) == want:
                    yield np.array(a, np.int64), np.array(b, np.int64)
                    continue
            yield np.zeros(0, np.int64), np.zeros(0, np.int64)


def decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ASCII digits of 0 .. n-1, left-aligned in rows, and their numbers."""
    width = len(str(max(n - 1, 0)))
    rows = np.frombuffer(b"".join(str(i).encode().ljust(width) for i in range(n)), np.uint8).reshape(n, width)
    return rows, (rows != ord(" ")).sum(1)


def align(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token numbers (of A, of B) of every link, and the ends that both sides share."""
    ends = np.union1d(a_ends, b_ends)
    shared = np.intersect1d(a_ends, b_ends, assume_unique=True)
    return np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends), shared


def groups_text(a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, digits: tuple[np.ndarray, np.ndarray]) -> bytes:
    """a1,a2|b1;a3|b2,b3 of the ids and the group numbers of their tokens."""
    a_at = np.arange(len(a)) + np.searchsorted(b_group, a_group, "left")
    b_at = np.arange(len(b)) + np.searchsorted(a_group, b_group, "right")
    ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[a_at], ids[b_at] = a, b
    mark[a_at[np.append(a_group[1:] != a_group[:-1], True)]] = ord("|")
    mark[b_at[np.append(b_group[1:] != b_group[:-1], True)]] = ord(";")
    rows, size = digits[0][ids], digits[1][ids]
    field = np.concatenate([rows, np.zeros((len(ids), 1), np.uint8)], axis=1)
    field[np.arange(len(ids)), size] = mark
    return field[np.arange(field.shape[1]) <= size[:, None]].tobytes()[:-1]


class Aligned:
    """A text's counts, its digest, and its distinct pairs with their numbers of links."""

    def __init__(self, sides: Sides, a: np.ndarray, b: np.ndarray):
        self.n_a, self.n_b = len(a), len(b)
        if not len(a):
            self.n_groups, self.n_links, self.digest = 0, 0, ""
            self.pairs = self.links = np.zeros(0, np.int64)
            return
        a_ends, b_ends = np.cumsum(sides.a_sizes[a]), np.cumsum(sides.b_sizes[b])
        i, j, shared = align(a_ends, b_ends)
        self.n_groups, self.n_links = len(shared), len(i)
        self.digest = hashlib.sha256(groups_text(a, b, np.searchsorted(shared, a_ends), np.searchsorted(shared, b_ends), sides.decimals)).hexdigest()
        self.pairs, self.links = np.unique(a[i] << 32 | b[j], return_counts=True)


@lru_cache(maxsize=2)
def sides(a_path: str, b_path: str) -> Sides:
    return Sides(a_path, b_path)


# ---------------------------------------------------------------- runs


def part_of(pairs: np.ndarray) -> np.ndarray:
    """The radix part of a pair: A ids are dealt by a multiplicative hash."""
    return ((pairs >> 32).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % RADIX


class Run:
    """Records gathered by a task until they are sorted and written out as a run."""

    def __init__(self, number: int):
        self.number, self.records = number, 0
        self.ids: list[int | None] = []
        self.docs: list[Aligned] = []

    def add(self, doc_id: int | None, found: Aligned) -> None:
        self.ids.append(doc_id)
        self.docs.append(found)
        self.records += len(found.pairs) + 1

    def rows(self) -> pa.RecordBatch:
        if not self.docs:
            return pa.RecordBatch.from_pylist([], schema=RUNS)
        pairs, links = np.concatenate([d.pairs for d in self.docs]), np.concatenate([d.links for d in self.docs])
        doc = np.repeat(np.arange(len(self.docs)), [len(d.pairs) for d in self.docs])
        own = pa.table(
            {"doc_id": pa.array(self.ids, pa.int64()), **{c: pa.array([getattr(d, c) for d in self.docs], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")}, "groups_sha256": [d.digest for d in self.docs]}
        )
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, own.schema) as w:
            w.write_table(own)
        out = [(HEAD, self.number, zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes()), b"")]
        order = np.argsort(pairs, kind="stable")  # documents stay in order within a pair
        pairs, links, doc = pairs[order], links[order], doc[order]
        part = part_of(pairs)
        for p in range(RADIX):
            at = np.flatnonzero(part == p)
            if len(at):
                keys, held = np.unique(pairs[at], return_counts=True)
                out.append((p, self.number, pack(differences(keys), held, np.zeros(0)), pack(doc[at], links[at])))
        return batch(RUNS, **{f.name: [o[k] for o in out] for k, f in enumerate(RUNS)})


def runs(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """part, run, pairs, docs: the zstd runs of all documents (part HEAD: their own columns)."""

    def chunks(batches: Batches):
        for b in batches:
            ids, some, size = [], [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                some.append(t)
                size += len(t)
                if len(some) >= AT_ONCE or size >= CHARS:
                    yield ids, some
                    ids, some, size = [], [], 0
            yield ids, some

    def task(batches: Batches) -> Batches:
        both = sides(a_path, b_path)
        number = TaskContext.get().partitionId() << 24
        run = Run(number)
        for ids, some in chunks(batches):
            for i, (a, b) in zip(ids, both.encode(some), strict=True):
                run.add(i, Aligned(both, a, b))
                if run.records >= RUN_RECORDS:
                    yield run.rows()
                    run = Run(run.number + 1)
        yield run.rows()

    return texts(docs).mapInArrow(task, RUNS_DDL)


# ---------------------------------------------------------------- merging


def side_major(blobs: list[bytes]):
    """(A id, B ids, counts) in order of A id over all runs, by a heap of the runs'
    next A ids; the slices of one A id are summed by B id."""
    keys, held, starts, heap = [], [], [], []
    for k, blob in enumerate(blobs):
        d, n, _ = unpack(blob, 3)
        keys.append(np.cumsum(d))
        held.append(n)
        a = keys[-1] >> 32
        starts.append(np.append(np.flatnonzero(np.diff(a, prepend=-1)), len(a)))
        heap.append((int(a[0]), k, 0))
    heapify(heap)
    while heap:
        a, slices = heap[0][0], []
        while heap and heap[0][0] == a:
            _, k, at = heappop(heap)
            lo, hi = starts[k][at], starts[k][at + 1]
            slices.append((keys[k][lo:hi], held[k][lo:hi]))
            if hi < len(keys[k]):
                heappush(heap, (int(keys[k][hi] >> 32), k, at + 1))
        if len(slices) == 1:
            yield a, *slices[0]
        else:
            b, at = np.unique(np.concatenate([s[0] for s in slices]), return_inverse=True)
            yield a, b, np.bincount(at, np.concatenate([s[1] for s in slices])).astype(np.int64)


def merged(blobs: list[bytes]) -> bytes:
    """One longer run of the runs' pairs, with the summed counts and the best ones marked."""
    keys, counts, best = [], [], []
    for _, k, n in side_major(blobs):
        keys.append(k)
        counts.append(n)
        best.append(n == n.max())
    return pack(differences(np.concatenate(keys)), np.concatenate(counts), np.concatenate(best))


def merge_level(rows: DataFrame, lanes: int) -> DataFrame:
    """(part, run, pairs): every lane's runs of a part become one."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [g["part"].iloc[0]], "run": [g["lane"].iloc[0]], "pairs": [merged(list(g["pairs"]))]})

    lane = rows.withColumn("lane", F.pmod("run", F.lit(lanes)))
    return lane.groupBy("part", "lane").applyInPandas(run, "part int, run long, pairs binary")


def tables(rows: DataFrame, left: int) -> DataFrame:
    """(part, pairs): each part's pairs with counts and best marks over the whole corpus;
    ``left``: the number of runs."""
    lanes = max(1, -(-left // FANIN))
    # runs have any numbers; those of merged runs are dense from the first level on
    level = rows.select("part", F.pmod(F.xxhash64("run"), F.lit(lanes)).alias("run"), "pairs")
    while True:
        level = cut(merge_level(level, lanes), "merged")
        if lanes == 1:
            return level.select("part", "pairs")
        lanes = -(-lanes // FANIN)


# ---------------------------------------------------------------- contributions


def contributions(rows: DataFrame, found: DataFrame, left: int) -> DataFrame:
    """(run, sums): the contributions of each part to the documents of a run."""
    schema = pa.schema([("run", pa.int64()), ("sums", pa.binary())])
    lanes = max(1, -(-left // LANE))

    def task(batches: Batches) -> Batches:
        keys = counts = best = None
        for b in batches:
            out: tuple[list, list] = ([], [])
            for kind, run, pairs, docs in zip(*(b.column(k).to_pylist() for k in range(2, 6)), strict=True):
                if kind == 0:
                    d, counts, best = unpack(pairs, 3)
                    keys = np.cumsum(d)
                    continue
                d, held, _ = unpack(pairs, 3)
                doc, links = unpack(docs, 2)
                at = np.repeat(np.searchsorted(keys, np.cumsum(d)), held)
                some, place = np.unique(doc, return_inverse=True)
                sums = np.zeros((2, len(some)), np.int64)
                np.add.at(sums[0], place, links * best[at])
                np.add.at(sums[1], place, links * counts[at])
                out[0].append(run)
                out[1].append(pack(differences(some), *sums))
            yield batch(schema, run=out[0], sums=out[1])

    lane = F.pmod(F.xxhash64("run"), F.lit(lanes)).cast("int")
    leaves = rows.select("part", lane.alias("lane"), F.lit(1).alias("kind"), "run", "pairs", "docs")
    copies = found.select("part", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("run"), "pairs", F.lit(None).cast("binary").alias("docs"))
    both = leaves.unionByName(copies).repartition("part", "lane").sortWithinPartitions("part", "lane", "kind")
    return both.mapInArrow(task, "run long, sums binary")


def summed(heads: DataFrame, sums: DataFrame) -> DataFrame:
    """The documents' rows with the contributions of all parts of their run."""

    def task(batches: Batches) -> Batches:
        own = total = None

        def done():
            columns = {c: own.column(c) for c in own.schema.names}
            return batch(OUT, **columns, n_best=total[0], count_sum=total[1])

        for b in batches:
            for kind, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if kind == 0:
                    if own is not None:
                        yield done()
                    own = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all().combine_chunks()
                    total = np.zeros((2, own.num_rows), np.int64)
                else:
                    d, best, counts = unpack(blob, 3)
                    at = np.cumsum(d)  # distinct within a part
                    total[0, at] += best
                    total[1, at] += counts
        if own is not None:
            yield done()

    both = heads.select("run", F.lit(0).alias("kind"), F.col("pairs").alias("blob")).unionByName(sums.select("run", F.lit(1).alias("kind"), F.col("sums").alias("blob")))
    return both.repartition("run").sortWithinPartitions("run", "kind").mapInArrow(task, OUT_DDL)


def cross_alignment(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 per document."""
    all_rows = cut(runs(docs, a_path, b_path), "runs")
    heads, rows = all_rows.where(f"part = {HEAD}"), all_rows.where(f"part <> {HEAD}")
    n = heads.count()
    return summed(heads, cut(contributions(rows, tables(rows, n), n), "contributions"))


def pair_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """a, b, n_docs, best: the corpus-wide counts themselves, one row per linked id pair."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n_docs", pa.int64()), ("best", pa.bool_())])

    def task(batches: Batches) -> Batches:
        for b in batches:
            for blob in b.column(0).to_pylist():
                d, counts, best = unpack(blob, 3)
                keys = np.cumsum(d)
                yield batch(schema, a=keys >> 32, b=keys & 0xFFFFFFFF, n_docs=counts, best=best.astype(bool))

    all_rows = cut(runs(docs, a_path, b_path), "runs")
    found = tables(all_rows.where(f"part <> {HEAD}"), all_rows.where(f"part = {HEAD}").count())
    return found.select("pairs").mapInArrow(task, "a long, b long, n_docs long, best boolean")
