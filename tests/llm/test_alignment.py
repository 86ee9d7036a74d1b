"""Cross-tokenizer alignment against the two libraries and a plain count of pairs."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from kinsum.llm import alignment as al

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
HARD = ["▁", "a ▁ b", "<|endoftext|> x", "<s> </s> <unk> <0x0A>", "  two  spaces ", "tab\tnew\nline\r", "é ﬁ Å", "日本語 123", "🙂🙃 don't 'S", "a" * 3000, "\x00", "�", "x" * 50 + " " * 50]


class Plain:
    def __init__(self):
        self.a = tokenizers.Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        # the byte alphabet of the vocabulary file, by encoding each byte's letter back
        letters = {}
        free = 256
        for x in range(256):
            if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255:
                letters[chr(x)] = x
            else:
                letters[chr(free)], free = x, free + 1
        self.byte = letters

    def a_token(self, i):
        return bytes(self.byte[c] for c in self.a.id_to_token(i))

    def b_token(self, i):
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()

    def tokens(self, t):
        a = self.a.encode(" " + t, add_special_tokens=False).ids
        b = self.b.encode(t)
        a, b = [(i, self.a_token(i)) for i in a], [(i, self.b_token(i)) for i in b]
        want = (" " + t).encode()
        ok = t and b"".join(x for _, x in a) == want and b"".join(x for _, x in b) == want
        return (a, b) if ok else ([], [])


def spans(tokens):
    out, at = [], 0
    for i, x in tokens:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def brute(rows):
    plain, found, docs = Plain(), [], defaultdict(int)
    for _, t in rows:
        a, b = map(spans, plain.tokens(t or ""))
        links, j0 = Counter(), 0
        for i, s, e in a:
            while j0 < len(b) and b[j0][2] <= s:
                j0 += 1
            j = j0
            while j < len(b) and b[j][1] < e:
                links[i, b[j][0]] += 1
                j += 1
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, lo = [], 0
        for hi in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if lo <= s and e <= hi) for side in (a, b)))
            lo = hi
        for p in links:
            docs[p] += 1
        found.append((len(a), len(b), cuts, links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    best = defaultdict(int)
    for (i, _), n in docs.items():
        best[i] = max(best[i], n)
    out = []
    for (d, _), (n_a, n_b, cuts, links, sha) in zip(rows, found, strict=True):
        out.append((d, n_a, n_b, len(cuts), sum(links.values()), sum(k for p, k in links.items() if docs[p] == best[p[0]]), sum(k * docs[p] for p, k in links.items()), sha))
    return sorted(out, key=repr), dict(docs), best


def got(df):
    return sorted((tuple(r) for r in df.select(*al.OUT.names).collect()), key=repr)


@pytest.fixture(scope="module")
def cases(odd, real):
    rnd = random.Random(1)
    mixed = ["".join(rnd.choice("aabcdeinrst <>|▁éñß 1!'\n") for _ in range(rnd.randint(1, 40))) for _ in range(60)]
    rows = [*enumerate([*odd, *HARD, *mixed, *[t for _, t in real[:80]]])]
    return [*rows, (None, "a null id"), (None, None), (None, "a null id"), (2, "a repeated id"), (2, "a repeated id"), (2, "another text")]


@pytest.mark.parametrize("records,fanin,lane", [(1_000_000, 32, 256), (700, 3, 4)])
def test_brute_force(make, monkeypatch, cases, records, fanin, lane):
    """One run a task, and many small runs merged over several levels and lanes."""
    monkeypatch.setattr(al, "RUN_RECORDS", records)
    monkeypatch.setattr(al, "FANIN", fanin)
    monkeypatch.setattr(al, "LANE", lane)
    want, counts, best = brute(cases)
    docs = make(cases)
    assert got(al.cross_alignment(docs, A, B)) == want
    rows = al.pair_counts(docs, A, B).collect()
    assert {(r.a, r.b): r.n_docs for r in rows} == counts and len(rows) == len(counts)
    assert all(r.best == (r.n_docs == best[r.a]) for r in rows)


def test_clashing_columns_and_empty(make):
    docs = make([(1, "some words"), (2, "Some words")])
    clash = docs.withColumns({c: F.lit("x") for c in ("part", "run", "pairs", "docs", "kind", "lane", "sums", "n_a")})
    assert got(al.cross_alignment(clash, A, B)) == got(al.cross_alignment(docs, A, B)) == brute([(1, "some words"), (2, "Some words")])[0]
    assert al.cross_alignment(make([]), A, B).collect() == []
    assert got(al.cross_alignment(make([None, ""]), A, B)) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (0, 1)]


def test_heap_merge_sums_runs():
    rnd = np.random.default_rng(0)
    want, blobs = Counter(), []
    for _ in range(7):
        keys = np.unique(rnd.integers(0, 20, 60) << 32 | rnd.integers(0, 9, 60))
        n = rnd.integers(1, 5, len(keys))
        want.update(dict(zip(keys.tolist(), n.tolist(), strict=True)))
        blobs.append(al.pack(al.differences(keys), n, np.zeros(0)))
    d, n, best = al.unpack(al.merged(blobs), 3)
    keys = np.cumsum(d)
    assert dict(zip(keys.tolist(), n.tolist(), strict=True)) == want and (np.diff(keys) > 0).all()
    top = defaultdict(int)
    for k, c in want.items():
        top[k >> 32] = max(top[k >> 32], c)
    assert best.tolist() == [want[k] == top[k >> 32] for k in keys.tolist()]
    # merging merged runs gives the same
    again = al.unpack(al.merged([al.merged(blobs[:3]), al.merged(blobs[3:])]), 3)
    assert all((x == y).all() for x, y in zip(again, (d, n, best), strict=True))
