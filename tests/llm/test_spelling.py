import random
import re
import zlib
from collections import Counter

import pytest

from kinsum.llm import spelling as sp

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


def is_near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long_ = sorted((a, b), key=len)
    return len(long_) - len(short) == 1 and any(long_[:i] + long_[i + 1 :] == short for i in range(len(long_)))


def brute(rows):
    n = Counter()
    for i, t in rows:
        for w in LETTERS.findall(t or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    form, near = {}, {}
    for w in n:
        near[w] = [v for v in n if abs(len(v) - len(w)) <= 1 and v != w and is_near(v, w)]
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        r = w
        while form[r] is not None:
            r = form[r]
        out.append((w, form[w], r, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def got(docs):
    rows = sp.spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()
    return sorted(tuple(r) for r in rows)


def edited(rnd, w):
    i, c = rnd.randrange(len(w)), rnd.choice("aberéÿ")
    return rnd.choice([w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :], w])


def test_brute_force(make, odd, real):
    rnd = random.Random(3)
    bases = ["letter", "Llama", "aaaaa", "aaaaaa", "aaaaaaa", "abababab", "été-Étéré", "balloon", "x" * 60, "xy" * 30, "Übergröße"]
    noisy = [" ".join(edited(rnd, edited(rnd, rnd.choice(bases))) for _ in range(120)) for _ in range(60)]
    long_ = ["q" * 3000, "q" * 2999 + "r", "q" * 3001] * 4
    texts = [*odd, *odd, *noisy, *long_, *[t for _, t in real[:80]]]
    rows = [*enumerate(texts), (None, noisy[0]), (None, None), (7, noisy[1]), (7, noisy[1])]
    want = brute(rows)
    assert got(make(rows)) == want
    assert any(r[1] and r[2] != r[1] for r in want) and any(r[4] > 3 for r in want)


def test_chain_ties_and_clashing_columns(make):
    from pyspark.sql import functions as F

    words = {"bcdefg": 3, "bcdefgh": 7, "bcdefghi": 15, "bcdefghij": 40, "bcdefx": 7, "zzzzz": 4, "zzzzza": 8, "zzzzzb": 8}
    docs = make([(i, " ".join(w for w, k in words.items() if i < k)) for i in range(40)])
    rows = [(i, " ".join(w for w, k in words.items() if i < k)) for i in range(40)]
    clash = docs.withColumns({c: F.lit(1) for c in ("word", "n", "id", "key", "form", "root", "to")})
    assert got(clash) == got(docs) == brute(rows)
    (tie,) = [r for r in got(docs) if r[0] == "zzzzz"]
    assert tie[1] == "zzzzza"


def test_empty(make):
    assert got(make([])) == []
    assert got(make([None, "", "12 34"])) == []


def test_words_lose_letters():
    """About one occurrence in 97 is hit, and the letter is the one of the rule."""
    hit = 0
    for i in range(3000):
        (w, _), = sp.typed(str(i), Counter(["variant"])).items()
        h = zlib.crc32(f"{i}:variant".encode())
        assert w == ("variant" if h % 97 else "variant"[: h % 7] + "variant"[h % 7 + 1 :])
        hit += w != "variant"
    assert 10 < hit < 60


@pytest.mark.parametrize("exact", [0, 5, 48])
def test_groups_hold_exactly_the_near_words(monkeypatch, exact):
    """The rotations of all short strings: two share an open entry, or one is open where
    the other is whole, exactly if they are near, and indels are counted once."""
    monkeypatch.setattr(sp, "EXACT", exact)
    words = [w for n in range(1, 6) for w in map("".join, __import__("itertools").product("ab", repeat=n))]
    groups = {}
    for i, w in enumerate(words):
        for key, role in sp.rotations(w):
            groups.setdefault(key, []).append((role, i, 10 + i))
    near = Counter()
    for g in groups.values():
        assert len(g) <= 3
        for i, n, *_ in sp.group_neighbours(g):
            near[i] += n
    for i, w in enumerate(words):
        assert near[i] == sum(is_near(w, v) for v in words if v != w and abs(len(v) - len(w)) <= 1), w
