import random

import numpy as np
import pytest

from kinsum.llm import near_dedup as nd
from kinsum.llm.graph import components


def words(t):
    return (t or "").encode().lower().split()


def sets(t, k):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k=4, percent=80):
    s = [sets(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same_id = rows[i][0] == rows[j][0]
            both = len(s[i] & s[j])
            if rows[i][0] is not None and rows[j][0] is not None and (same_id or both and 100 * both >= percent * len(s[i] | s[j])):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s[i]), least.get(find(i)) if d is not None else None) for i, (d, _) in enumerate(rows)), key=repr)


def got(df):
    rows = df.collect()
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in rows)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=repr)


def variants(rnd, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_brute_force(make, odd, real):
    rnd = random.Random(2)
    texts = [*odd, "one two three", "one TWO three", "one two", "a b c d", *[t for _, t in real[:120]]]
    for size in (30, 60, 200):
        base = [f"w{rnd.randrange(500)}" for _ in range(size)]
        texts += variants(rnd, base, 15, size // 20)
    rows = [*enumerate(texts), (None, texts[-1]), (None, None), (3, "")]
    assert got(nd.near_dedup(make(rows), 4)) == brute(rows)


@pytest.mark.parametrize("small", [2, 8])
def test_large_buckets(make, monkeypatch, small):
    """Groups of copies and a passage shared by unrelated documents overfill every
    bucket; stars, exact blocks and components still find what brute force finds."""
    monkeypatch.setattr(nd, "SMALL", small)
    monkeypatch.setattr(nd, "BLOCK", 15)
    rnd = random.Random(4)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join(passage + [f"u{rnd.randrange(10**6)}" for _ in range(25)]) for _ in range(60)]
    texts += variants(rnd, [f"w{i}" for i in range(90)], 60, 3)
    texts += variants(rnd, passage + [f"v{i}" for i in range(30)], 30, 2)
    rows = list(enumerate(texts))
    assert got(nd.near_dedup(make(rows), 4)) == brute(rows)


def test_empty(make):
    assert nd.near_dedup(make([])).collect() == []


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(0)
    for shared in (0.5, 0.8, 0.95):
        n, k = 1000, 0
        x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
        both = int(round(2 * n * shared / (1 + shared)))
        a, b = x[:n], x[n - both : 2 * n - both]
        ra, rb = nd.registers(a), nd.registers(b)
        assert (nd.merge(ra, rb) == nd.registers(np.union1d(a, b))).all()
        est = nd.likely_similarity(ra[None], rb[None], np.array([n]), np.array([n]))[k]
        assert abs(est - shared) < 0.16


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(1)
    e = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(200 + rnd.randrange(30), 200 + rnd.randrange(30)) for _ in range(25)]
    got_ = {r.v: r.comp for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    low = {v: v for p in e for v in p}
    for _ in range(100):
        for a, b in e:
            low[a] = low[b] = min(low[a], low[b])
    looped = {v for a, b in e if a != b for v in (a, b)}
    assert got_ == {v: c for v, c in low.items() if v in looped}


@pytest.mark.parametrize("bound", [nd.FILTERED, 3])
def test_sets_by_bitmap_or_join(spark, make, monkeypatch, bound):
    monkeypatch.setattr(nd, "FILTERED", bound)
    rows = [(i, f"a{i} b c d{i} e f") for i in range(300)] + [(None, "a b c d"), (7, "x y z w v"), (9, None)]
    ids = spark.createDataFrame([(i,) for i in (1, 5, 5, 7, 9, 299, 1000)], "doc_id long")
    out = nd.shingle_sets(make(rows), ids, 4).join(ids.distinct(), "doc_id").collect()
    want = sorted((i, len(sets(t, 4))) for i, t in rows if i in (1, 5, 7, 9, 299))
    assert sorted((r.doc_id, len(r.shingles) // 8) for r in out) == want


def test_join_in_place_of_the_bitmap(make, monkeypatch):
    monkeypatch.setattr(nd, "FILTERED", 0)
    rnd = random.Random(4)
    base = [f"w{rnd.randrange(900)}" for _ in range(120)]
    rows = list(enumerate(variants(rnd, base, 60, 8)))
    assert got(nd.near_dedup(make(rows), width=4)) == brute(rows)
