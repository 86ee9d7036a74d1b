import hashlib
import random
from collections import defaultdict

from kinsum.llm import exact_dedup as ed


def low(t):
    return (t or "").encode().lower()


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[low(t)] if x is not None]
        keep = max(ids, default=None)
        out.append((i, keep, len(groups[low(t)]), i is not None and i == keep, hashlib.sha256(low(t)).hexdigest(), len(low(t))))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_brute_force(make, odd, real):
    rows = list(enumerate(odd)) + [(100 + i, t) for i, t in real] + [(5000 + i, t.upper()) for i, t in real[:40]]
    rows += [(None, "only null"), (None, "same text here"), (7, "same text here"), (7, "same text here")]
    assert got(ed.exact_dedup(make(rows))) == brute(rows)


def test_hot_group_over_many_partitions(make):
    rows = [(i, "Hot Text") for i in range(600)] + [(1000 + i, f"cold {i}") for i in range(900)]
    assert got(ed.exact_dedup(make(rows, 12))) == brute(rows)


def test_empty_and_clashing_columns(make, spark):
    assert ed.exact_dedup(make([])).collect() == []
    df = spark.createDataFrame([(1, "a", "x", "y", 2, 3), (2, "A", None, None, 2, 3)], "doc_id long, text string, n_bytes string, digest string, owner int, n int")
    assert [(r.doc_id, r.keep_id, r.group_size) for r in ed.exact_dedup(df).orderBy("doc_id").collect()] == [(1, 2, 2), (2, 2, 2)]


def test_texts_of_one_partition_are_told_apart_by_their_bytes(make, monkeypatch):
    """Without any hash in the key, all texts of a length share a trie; hot ones are salted
    and met again by their bytes."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("aB") for _ in range(rnd.choice([3, 9, 40]))) for _ in range(300)]
    rows = [(i, w) for i, w in enumerate(words)] + [(i + 300, w.swapcase()) for i, w in enumerate(words[:50])]
    rows += [(1000 + i, "x" * 39 + "yz"[i % 2]) for i in range(400)] + [(None, "x" * 39 + "y")] * 3
    for hot in (1000, 20):
        monkeypatch.setattr(ed, "HOT_ROWS", hot)
        df = make(rows, 9)
        assert got(ed.exact_dedup(df, hash_bytes=0)) == brute(rows)
        keyed = df.selectExpr("doc_id", "cast(text as binary) text").mapInArrow(ed.keys, ed.KEY_DDL)
        assert len(ed.hot_salts(keyed)) == (0 if hot == 1000 else 2)


def test_finished_subtrees_are_spilled():
    """Equal entries in order: every text comes out once, and at most a path is held."""
    rnd = random.Random(7)
    texts = sorted({bytes(rnd.choice(b"ab\xff") for _ in range(12)) for _ in range(900)})
    entries = [(12, b"", -1, t, i, 1) for i, t in enumerate(texts) for _ in range(1 + i % 3)]
    cols = {f.name: [e[j] for e in entries] for j, f in enumerate(ed.ENTRY)}
    out = list(ed.owners(iter([ed.batch(ed.ENTRY, **cols)])))
    assert max(map(len, out)) <= 2 * 12 and len(out) > 100
    assert sorted((v[3], v[4], v[5]) for vs in out for v in vs) == [(t, i, 1 + i % 3) for i, t in enumerate(texts)]


def test_trie_splits_edges():
    rnd = random.Random(3)
    words = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 40))) for _ in range(800)]
    trie, seen = ed.PatriciaTrie(), {}
    for w in words:
        v = trie.insert(w, lambda w=w: [w, 0])
        v[1] += 1
        seen[w] = seen.get(w, 0) + 1
    assert sorted(map(tuple, trie.spill())) == sorted(seen.items())
    assert trie.spill() == []
    assert ed.common_prefix(b"x" * 1000 + b"a", b"x" * 1000 + b"b") == 1000
