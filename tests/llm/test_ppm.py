import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from kinsum.llm import ppm


def training(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2


def brute_base(rows):
    toks = [(i, [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), None]) for i, t in rows]
    c = Counter(w for i, ws in toks if training(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, not training(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in toks]


def brute_score(rows):
    """The definition, symbol by symbol: contexts down from ORDER, escapes with exclusion."""
    follow = defaultdict(Counter)
    split = lambda t: [b" " + u for u in ppm.units((t or "").encode())]
    for i, t in rows:
        if training(i):
            for x in split(t):
                for k in range(1, len(x)):
                    for a in range(max(0, k - ppm.ORDER), k + 1):
                        follow[x[a:k]][x[k]] += 1
    return [sum(code(follow, x, k) for x in split(t) for k in range(1, len(x))) for _, t in rows]


def code(follow, x, k):
    p, gone = 0.0, set()
    for a in range(max(0, k - ppm.ORDER), k + 1):
        left = {s: n for s, n in follow.get(x[a:k], {}).items() if s not in gone}
        if left:
            den = sum(left.values()) + len(left)
            if x[k] in left:
                return p + math.log10(left[x[k]] / den)
            p += math.log10(len(left) / den)
            gone |= set(left)
    return p - math.log10(256 - len(gone))


def test_base_and_score(make, odd, real):
    rows = [*enumerate([t for t in odd if t is None or len(t) < 9000]), *[(50 + i, t[:1500]) for i, t in real[:60]], (None, "Null id text"), (3, "again again")]
    out = ppm.ppm_scores(make(rows)).collect()
    key = lambda r: (repr(r[0]), r[2], r[5])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in out), key=key)
    want = sorted(((*b, s) for b, s in zip(brute_base(rows), brute_score(rows), strict=True)), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-6)


def test_contexts_cross_white_space(make, real, monkeypatch):
    """The score depends on the order of words, and is that of whole texts."""
    monkeypatch.setattr(ppm, "CHUNK", 37)
    rows = [(i, t[:600]) for i, t in real[:30]]
    held, text = next((i, t) for i, t in rows if not training(i) and len(t.split(" ")) > 20)
    new = next(i for i in range(10**6, 10**6 + 100) if not training(i))
    rows.append((new, " ".join(sorted(text.split(" ")))))
    out = {r.doc_id: r for r in ppm.ppm_scores(make(rows)).collect()}
    follow, want = defaultdict(Counter), {}
    for i, t in rows:
        x = b" " + t.encode().lower() + b"\xff"
        for k in range(1, len(x)) if training(i) else ():
            for a in range(max(0, k - 5), k + 1):
                follow[x[a:k]][x[k]] += 1
    for i, t in rows:
        x = b" " + t.encode().lower() + b"\xff"
        want[i] = sum(code(follow, x, k) for k in range(1, len(x)))
    assert {i: r.score for i, r in out.items()} == pytest.approx(want, rel=1e-9)
    assert out[held].score != pytest.approx(out[new].score, rel=1e-6)


def test_rare_words_join(make, monkeypatch, real):
    """With a high bound nearly all words and grams go by the joins."""
    monkeypatch.setattr(ppm, "LEAST", 0.002)
    rows = [(i, t[:800]) for i, t in real[:50]]
    out = {r.doc_id: r for r in ppm.ppm_scores(make(rows)).collect()}
    for b, s in zip(brute_base(rows), brute_score(rows), strict=True):
        r = out[b[0]]
        assert (r.n_tokens, r.n_known, r.train_tokens) == b[2:5]
        assert (r.base_score, r.score) == pytest.approx((b[5], s), rel=1e-9)


def test_probabilities_sum_to_one(spark):
    """Over all 256 symbols, in contexts that are known in full, in part or not at all."""
    seen, asked = Counter(), []
    for u in [b"the ", b"then ", b"to ", b"a ", b"the\xff", b"t ", b"theatres "] * 3:
        seen.update(grams(u))
    for prefix in (b"", b"t", b"th", b"the", b"q", b"heatre", b"xyztheatr"):
        asked.append([grams(prefix + bytes((s,)))[-1] for s in range(256)])
        seen.update(dict.fromkeys(asked[-1], 0))
    got = {r.key: r.code for r in ppm.gram_codes(spark.createDataFrame(list(seen.items()), "key long, n long")).collect()}
    assert set(got) == set(seen)
    for keys in asked:
        assert sum(10 ** got[k] for k in keys) == pytest.approx(1)


def grams(unit):
    return ppm.gram_keys(np.frombuffer(unit, np.uint8), np.array([0, len(unit)])).tolist()


def test_model_prefers_text_to_noise(make, real):
    rows = [(i, t) for i, t in real]
    held = next(i for i, t in real if not training(i) and len(t) > 500)
    text = dict(real)[held]
    noise = "".join(sorted(text))
    new = next(i for i in range(10**6, 10**6 + 100) if not training(i))
    out = {r.doc_id: r for r in ppm.ppm_scores(make([*rows, (new, noise)])).collect()}
    assert out[held].held_out and out[new].held_out and out[held].score > out[new].score


def test_empty(make):
    assert ppm.ppm_scores(make([])).collect() == []
    only = next(i for i in range(100) if not training(i))
    (r,) = ppm.ppm_scores(make([(only, "a b")])).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)
    assert r.score == pytest.approx(-4 * math.log10(256))
