"""Token counts by heap-and-linked-list pair merging (operator 3).

A text's symbols form a doubly linked list; a heap holds the adjacent pairs whose
concatenation is a piece of the vocabulary, ordered by rank and then position.  The
lowest-ranked pair is merged until none is left, so the count is the initial symbols
minus the merges.  No identifiers are made.

No piece holds a space mark behind another character, so merges never cross from
a non-space into a space: the text falls apart into independent segments there,
and each worker keeps the counts of the short segments it has seen.  A symbol that is
no piece itself counts as its UTF-8 bytes (byte fallback).

The vocabulary is read from the model file on each worker; the file's place is a
parameter.  Null text counts as empty (0 bytes, 0 tokens), an empty table gives an
empty result, repeated rows are counted each, a null id is passed on, other columns
are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from kinsum.llm.common import Batches, batch, texts

SPACE = "▁"
#: Segments a worker remembers, and the longest one it does remember.
CACHE, CACHED_CHARS = 400_000, 40
SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
OUT_DDL = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class Counter:
    """Counts tokens of a byte-fallback pair-merging model with identity
    normalisation and a space mark before the text."""

    def __init__(self, ranks: dict[str, float]):
        self.ranks = ranks  # piece -> rank, lower merges first
        assert not any(SPACE in p.lstrip(SPACE) for p in ranks), "a piece crosses a space"
        self.known: dict[str, int] = {}

    @classmethod
    def load(cls, path: str) -> Counter:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        skip = (m.is_control, m.is_unknown, m.is_byte, m.is_unused)
        return cls({m.id_to_piece(i): -m.get_score(i) for i in range(m.get_piece_size()) if not any(f(i) for f in skip)})

    def merge(self, s: str) -> int:
        """Tokens of one segment."""
        ranks = self.ranks
        n = len(s)
        sym: list[str] = list(s)
        heap = []
        for i in range(n - 1):
            r = ranks.get(s[i : i + 2])
            if r is not None:
                heap.append((r, i, 2))
        heapify(heap)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = 0
        while heap:
            _, i, size = heappop(heap)
            left = sym[i]
            if not left:
                continue
            j = nxt[i]
            if j >= n or len(left) + len(sym[j]) != size:
                continue  # one of the two has been merged since
            sym[i] = both = left + sym[j]
            sym[j] = ""
            merges += 1
            j = nxt[i] = nxt[j]
            if j < n:
                prv[j] = i
                r = ranks.get(both + sym[j])
                if r is not None:
                    heappush(heap, (r, i, size + len(sym[j])))
            h = prv[i]
            if h >= 0:
                r = ranks.get(sym[h] + both)
                if r is not None:
                    heappush(heap, (r, h, size + len(sym[h])))
        more = sum(len(c.encode()) - 1 for c in sym if len(c) == 1 and c not in ranks)
        return n - merges + more

    def segment(self, s: str) -> int:
        k = self.known.get(s)
        if k is None:
            k = self.merge(s)
            if len(s) <= CACHED_CHARS:
                if len(self.known) >= CACHE:
                    self.known.clear()
                self.known[s] = k
        return k

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = SPACE + text.replace(" ", SPACE)
        known, segment = self.known.get, self.segment
        total = 0
        for s in SEGMENT.findall(marked):
            k = known(s)
            total += segment(s) if k is None else k
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter.load(path)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) per document."""

    def run(batches: Batches) -> Batches:
        c = counter(model_path)
        for b in batches:
            t = b.column(1).to_pylist()
            n = [c.count(x) for x in t]
            yield batch(OUT, doc_id=b.column(0), n_bytes=[len(x.encode()) for x in t], n_tokens=n, over_limit=[k > limit for k in n])

    return texts(docs).mapInArrow(run, OUT_DDL)
