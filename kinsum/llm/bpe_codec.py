"""BPE encoding and decoding with a tokenization automaton (operator 6).

The merges are compiled, in rank order, into a deterministic automaton over tokens.
It starts as one state with a loop for every base symbol.  The gadget of a merge (u, v)
does three things: the state that u leads to loses its arc v; wherever v's arc stood
behind u, an arc uv leads on; and the state that uv leads to starts as a copy of the
one v leads to at that time.  All arcs with one label lead to one state, so a state is
named by its last token.  Copies are stored as inheritance: a state holds its parent, the
step at which it was copied, and the arcs it has lost itself with their step; an arc
uv refers to its first part u and the step that made it.  ``arc`` works out whether
a state has an arc by walking these (short) chains, once for each pair that is met.

The arcs are spelled out over symbols: the tokens form a trie, each of whose nodes has a transition
for every symbol (where the trie ends, that of the longest suffix that is a node), and the tokens
that end at a node are chained from the longest to the shortest.  A word has
exactly one path in the automaton.  It is found in one walk of the transition table from left to
right: the state after each prefix is the token of the chain whose arc leaves the state before it.
Decoding walks the identifiers and emits the labels of their arcs.

Text is cut at the special strings, normalised (NFC, runs of white space to a space,
lower case) and pre-split as the tokenizer file says.  Null text counts as empty (0
tokens), an empty table gives an empty result, repeated rows are encoded each, a null
id is passed on, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from kinsum.llm.common import Batches, batch, texts

#: Words a worker remembers and the longest one it does; arcs and transitions it remembers.
CACHE, CACHED_CHARS, ARCS = 200_000, 40, 500_000

OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
OUT_DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> list[str]:
    """The printable letter of each byte: itself where it is printable Latin-1, else
    the next free one from 256 on."""
    out, free = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


def make_room(known: dict, limit: int) -> None:
    """Drop the older half of a full table."""
    if len(known) >= limit:
        for k in list(islice(known, limit // 2)):
            del known[k]


class Automaton:
    """Token automaton of a merge list.  States and arcs are token numbers; the
    start state is -1 and has an arc for every token."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        size = max(vocab.values(), default=-1) + 1
        self.labels: list[str] = [""] * size
        for t, i in vocab.items():
            self.labels[i] = t
        never = len(merges) + 1
        self.parent = [-1] * size  # state this one was copied from
        self.copied = [never] * size  # at which step
        self.first = [-1] * size  # first part of an arc that a gadget made
        self.made = [never] * size
        self.lost: dict[tuple[int, int], int] = {}  # (state, arc) -> step
        for step, (u, v) in enumerate(merges):
            self.gadget(step, vocab[u], vocab[v], vocab[u + v])
        self.table: dict[int, bool] = {}
        self.spell(vocab, merges)

    def spell(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        """The trie of the tokens over symbols, with suffix links."""
        made = {u + v for u, v in merges}
        self.symbols = {t: k for k, t in enumerate(t for t in vocab if t not in made)}
        parts = {t: (k,) for t, k in self.symbols.items()}
        for u, v in merges:
            parts[u + v] = parts[u] + parts[v]
        self.size = [0] * len(self.labels)  # symbols of each token
        self.width = len(self.symbols)
        self.step: dict[int, int] = {}  # node * width + symbol -> node: the trie and what was worked out since
        self.ends = [-1]  # token of each node
        edges: list[tuple[int, int, int]] = []
        for t, symbols in parts.items():
            at = 0
            for k in symbols:
                new = self.step.get(at * self.width + k)
                if new is None:
                    new = self.step[at * self.width + k] = len(self.ends)
                    self.ends.append(-1)
                    edges.append((at, k, new))
                at = new
            self.ends[at] = vocab[t]
            self.size[vocab[t]] = len(symbols)
        self.trie = len(self.step)
        self.suffix = [0] * len(self.ends)  # longest proper suffix that is a node
        self.shorter = [0] * len(self.ends)  # longest proper suffix that is a token
        below: list[list[tuple[int, int]]] = [[] for _ in self.ends]
        for at, k, new in edges:
            below[at].append((k, new))
        level = [0]
        while level:  # by depth, so a suffix is done before what it is a suffix of
            deeper = []
            for at in level:
                for k, new in below[at]:
                    s = self.suffix[new] = self.move(self.suffix[at], k) if at else 0
                    self.shorter[new] = s if self.ends[s] >= 0 else self.shorter[s]
                    deeper.append(new)
            level = deeper

    def move(self, node: int, symbol: int) -> int:
        """The transition of a node; one that is not in the trie is remembered."""
        at = node * self.width + symbol
        known = self.step.get(at)
        if known is None:
            known = self.move(self.suffix[node], symbol) if node else 0
            if len(self.step) - self.trie >= ARCS:
                for k in list(islice(self.step, self.trie, self.trie + ARCS // 2)):
                    del self.step[k]
            self.step[at] = known
        return known

    def gadget(self, step: int, u: int, v: int, uv: int) -> None:
        self.lost.setdefault((u, v), step)
        if self.first[uv] < 0:
            self.parent[uv], self.copied[uv] = v, step
            self.first[uv], self.made[uv] = u, step

    def arc(self, state: int, token: int) -> bool:
        """Has the state an arc for the token?  It has not if the arc, or the one it was
        made from, was lost by the state, or by one it was copied from, before the copy."""
        at = state * len(self.parent) + token
        known = self.table.get(at)
        if known is not None:
            return known
        lost, ok = self.lost, True
        a, until = state, len(self.parent) + 10**9
        while a >= 0 and ok:
            t, within = token, until
            while t >= 0:
                # the leftmost pair merges first, so on equal steps the right side yields
                s = lost.get((a, t))
                if s is not None and s < until and s <= within:
                    ok = False
                    break
                within = self.made[t]
                t = self.first[t]
            until = self.copied[a]
            a = self.parent[a]
        make_room(self.table, ARCS)
        self.table[at] = ok
        return ok

    def path(self, symbols: list[str]) -> list[int]:
        """Tokens of the one path that spells the symbols."""
        number, step, width, ends, shorter, size = self.symbols, self.step, self.width, self.ends, self.shorter, self.size
        table, states = self.table, len(self.parent)
        last = [-1]  # state after each prefix
        node = 0
        for j, s in enumerate(symbols, 1):
            k = number[s]
            to = step.get(node * width + k)
            node = self.move(node, k) if to is None else to
            at = node if ends[node] >= 0 else shorter[node]
            while at:
                t = ends[at]
                i = j - size[t]
                if not i:
                    break
                ok = table.get(last[i] * states + t)
                if self.arc(last[i], t) if ok is None else ok:
                    break
                at = shorter[at]
            else:
                raise ValueError(f"no path spells {''.join(symbols)!r}")
            last.append(t)
        out = []
        n = len(symbols)
        while n:
            out.append(last[n])
            n -= size[last[n]]
        return out[::-1]


class Codec:
    def __init__(self, spec: dict):
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges)
        self.labels = dict(enumerate(self.automaton.labels))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels.update({i: s for s, i in self.special.items()})
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.letters = byte_letters()
        (split,) = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.words = regex.compile(split)
        self.known: dict[str, tuple[int, str, str]] = {}

    @classmethod
    def load(cls, path: str) -> Codec:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def normalise(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no word-final form
        return text.lower()

    def word_ids(self, word: str) -> list[int]:
        symbols = [self.letters[b] for b in word.encode()]
        symbols[-1] += self.suffix
        return self.automaton.path(symbols)

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.labels.__getitem__, ids))

    def word(self, w: str) -> tuple[int, str, str]:
        """Number of tokens, identifiers as text, decoded text of a word."""
        e = self.known.get(w)
        if e is None:
            ids = self.word_ids(w)
            e = (len(ids), " ".join(map(str, ids)), self.decode(ids))
            if len(w) <= CACHED_CHARS:
                make_room(self.known, CACHE)
                self.known[w] = e
        return e

    def pieces(self, text: str):
        """The entries of a text's words and special strings, in order."""
        known, word = self.known.get, self.word
        for k, part in enumerate(self.cut_special.split(text) if "<|" in text else [text]):
            if k % 2:
                i = self.special[part]
                yield 1, str(i), part
            else:
                for w in self.words.findall(self.normalise(part)):
                    yield known(w) or word(w)

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.pieces(text) for i in ids.split(" ")]

    def digest(self, text: str) -> tuple[int, str, str]:
        found = list(self.pieces(text))
        sha = lambda k: hashlib.sha256(" ".join([f[k] for f in found]).encode()).hexdigest()
        return sum(f[0] for f in found), sha(1), sha(2)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec.load(path)


def bpe_codec(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per document."""

    def run(batches: Batches) -> Batches:
        c = codec(path)
        for b in batches:
            found = [c.digest(x) for x in b.column(1).to_pylist()]
            yield batch(OUT, doc_id=b.column(0), n_tokens=[f[0] for f in found], ids_sha256=[f[1] for f in found], decoded_sha256=[f[2] for f in found])

    return texts(docs).mapInArrow(run, OUT_DDL)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>, decoded string: the real encoding."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Batches) -> Batches:
        c = codec(path)
        for b in batches:
            ids = [c.encode(x) for x in b.column(1).to_pylist()]
            yield batch(schema, doc_id=b.column(0), ids=ids, decoded=[c.decode(i) for i in ids])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
