import random

import numpy as np
import pytest
import xxhash

from kinsum.llm import simhash as sh


def slow_print(t):
    w = (t or "").encode().lower().split()
    k = min(3, len(w))
    h = [xxhash.xxh64(b" ".join(w[i : i + k]), seed=42).intdigest() for i in range(len(w) - k + 1)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(prints):
    """Component number of each of the distinct fingerprints."""
    fps = sorted(set(prints))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin(a ^ b).count("1") <= 3:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def brute(rows):
    prints = [slow_print(t) for _, t in rows]
    comp = reach(prints)
    low = {}
    for (i, _), f in zip(rows, prints, strict=True):
        if i is not None:
            low[comp[f]] = min(i, low.get(comp[f], i))
    return sorted(((i, f"{f:016x}", low.get(comp[f])) for (i, _), f in zip(rows, prints, strict=True)), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=repr)


def near_copies(rnd, size, n):
    base = [f"w{rnd.randrange(300)}" for _ in range(size)]
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(size)] = f"e{rnd.randrange(10**6)}"
        yield " ".join(w)


def test_brute_force(make, odd, real):
    rnd = random.Random(5)
    texts = [*odd, "one two", "One TWO", "one", *[t for _, t in real[:100]], *near_copies(rnd, 400, 40), *near_copies(rnd, 60, 30)]
    rows = [*enumerate(texts), (None, texts[-1]), (None, None), (None, "only here without an id"), (3, "a repeated id"), (3, "a repeated id"), (-(1 << 63), "lowest")]
    assert got(sh.simhash_dedup(make(rows))) == brute(rows)


def test_extra_columns_and_empty(make, spark):
    from pyspark.sql import functions as F

    docs = make([(1, "a b c"), (2, "a b c")])
    clash = docs.withColumns({c: F.lit("x") for c in ("fp", "key", "a", "b", "component_id", "fingerprint", "low")})
    assert got(sh.simhash_dedup(clash)) == got(sh.simhash_dedup(docs)) == [(i, f"{slow_print('a b c'):016x}", 1) for i in (1, 2)]
    assert sh.simhash_dedup(make([])).collect() == []


@pytest.mark.parametrize("small", [2, 16])
def test_links_connect_clusters(spark, monkeypatch, small):
    """Dense clusters, chains at exactly three bits and unrelated fingerprints: the
    links connect what lies within three bits, and nothing else."""
    monkeypatch.setattr(sh, "SMALL", small)
    rnd = random.Random(small)
    flip = lambda f, n: f ^ sum(1 << b for b in rnd.sample(range(64), n))
    fps = {rnd.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1}
    for f in list(fps)[:6]:
        fps |= {flip(f, rnd.randint(1, 3)) for _ in range(60)}  # dense
        for _ in range(25):  # chains
            f = flip(f, 3)
            fps.add(f)
        fps |= {flip(f, 4) for _ in range(20)}
    want = reach(fps)
    df = spark.createDataFrame([(sh.signed(f),) for f in fps], "fp long").repartition(4)
    pairs = [(r.a % (1 << 64), r.b % (1 << 64)) for r in sh.links(df).collect()]
    assert all(bin(a ^ b).count("1") <= 3 for a, b in pairs)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    groups = lambda of: {frozenset(f for f in fps if of(f) == r) for r in {of(f) for f in fps}}
    assert groups(find) == groups(want.__getitem__)


def test_runs_across_batches():
    """However the sorted rows are cut into batches, the same links come out."""
    import pyarrow as pa

    rnd = np.random.default_rng(1)
    key = np.sort(rnd.integers(0, 12, 200))
    fp = rnd.integers(0, 16, 200)
    order = np.lexsort((fp, key))
    key, fp = key[order], fp[order]
    far = rnd.integers(0, 2, 200).astype(bool)
    deal = lambda n, *c: [pa.RecordBatch.from_arrays([pa.array(x[i : i + n]) for x in c], names=list("abc")[: len(c)]) for i in range(0, 200, n)]
    pairs = lambda out: {p for b in out for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    order = np.lexsort((fp, far, key))
    for n in (1, 7, 50):
        assert pairs(sh.compare_runs(deal(n, key, fp))) == pairs(sh.compare_runs(deal(200, key, fp)))
        assert pairs(sh.centre_stars(deal(n, key[order], far[order], fp[order]))) == pairs(sh.centre_stars(deal(200, key[order], far[order], fp[order])))


def connected(pairs, fps):
    """The groups of ``fps`` that ``pairs`` connect."""
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    return {frozenset(f for f in fps if find(f) == r) for r in map(find, fps)}


def test_long_runs_emit_no_variants(spark, monkeypatch):
    """A cluster of several hundred near copies is linked by its runs, with fewer links than classes in
    each; the same groups come out of the variants that longer runs emit."""
    rnd = random.Random(11)
    flip = lambda f, n: f ^ sum(1 << b for b in rnd.sample(range(64), n))
    core = rnd.getrandbits(64)
    fps = {core} | {flip(core, rnd.randint(1, 3)) for _ in range(400)} | {flip(core, 5) for _ in range(60)}
    want = {}
    for f, r in reach(fps).items():
        want.setdefault(r, set()).add(f)
    want = {frozenset(g) for g in want.values()}
    df = spark.createDataFrame([(sh.signed(f),) for f in fps], "fp long").repartition(4)
    called = []
    ball = sh.ball_variants
    monkeypatch.setattr(sh, "ball_variants", lambda members: called.append(members.count()) or ball(members))
    links = lambda *large: [(r.a % (1 << 64), r.b % (1 << 64)) for r in sh.links(df, *large).collect()]
    assert connected(links(), fps) == want
    assert not called
    assert connected(links(40), fps) == want
    assert called


def test_forest():
    rnd = np.random.default_rng(3)
    fp = (rnd.integers(0, 1 << 12, 300) << 52).astype(np.int64)
    fps = set(fp.tolist())
    a, b = sh.forest(fp)
    assert all(bin((x ^ y) % (1 << 64)).count("1") <= 3 for x, y in zip(a.tolist(), b.tolist(), strict=True))
    near = [(x, y) for x in fps for y in fps if bin((x ^ y) % (1 << 64)).count("1") <= 3]
    assert connected(zip(a.tolist(), b.tolist(), strict=True), fps) == connected(near, fps) and len(a) < len(fps)
    assert len(sh.forest(fp[:0])[0]) == 0
