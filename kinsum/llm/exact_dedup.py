"""Exact dedup with Patricia-trie owners (operator 2).

1. Each Arrow batch folds its own equal texts into one entry, so that a text
   held by a third of all rows crosses the shuffle once per batch.
2. Entries are partitioned by (length, the first bytes of the content hash) and sorted by
   those and the text; each task inserts the full byte strings into a compressed
   radix trie, whose terminal nodes keep the owner id and the number of rows.  Texts are
   told apart by their bytes in the trie, never by the hash.  As they come in order, a subtree
   that the next text does not enter is complete: it is spilled to the task's
   output and freed, and a task holds the nodes of one path.
3. A text with more rows than an average shuffle partition is hot.  Hot texts are fewer than
   the shuffle partitions, so their keys may be broadcast.  Their entries are salted,
   by the root of their number, and the terminals of the salts, with
   their texts, go through a second trie that merges them by their bytes.
4. The terminals (no texts any more) join the documents on (length, hash).  One
   class may hold a third of the documents: the class side has one row a key, so
   adaptive execution splits the document side of that join.

Texts are equal when identical after lower-casing A-Z; null counts as empty.
Rows with a null id belong to their group and are never its owner unless all ids
of the group are null (keep_id is then null and no row is kept by id: ``kept`` is
false).  Rows that repeat an id all carry ``kept`` = true if that id is the owner.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsum.llm.common import Batches, batch, cut, texts

#: Bytes of the content hash in the partition key of a text.
HASH_BYTES = 2
#: A text of fewer rows is never salted.
HOT_ROWS = 1000

ENTRY = pa.schema([("n_bytes", pa.int64()), ("part", pa.binary()), ("salt", pa.int32()), ("text", pa.binary()), ("owner", pa.int64()), ("n", pa.int64())])
ENTRY_DDL = "n_bytes long, part binary, salt int, text binary, owner long, n long"
TERMINAL = pa.schema([("n_bytes", pa.int64()), ("part", pa.binary()), ("salt", pa.int32()), ("text", pa.binary()), ("digest", pa.binary()), ("owner", pa.int64()), ("n", pa.int64())])
TERMINAL_DDL = "n_bytes long, part binary, salt int, text binary, digest binary, owner long, n long"
KEY = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.binary())])
KEY_DDL = "doc_id long, n_bytes long, digest binary"


def later(a: int | None, b: int | None) -> int | None:
    """The larger id; a null id loses."""
    return b if a is None else a if b is None else max(a, b)


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by doubling and then bisecting slices."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, step = 0, 16
    while a[lo : lo + step] == b[lo : lo + step]:
        lo += step
        step *= 2
    hi = min(n, lo + step)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class Node:
    __slots__ = ("edge", "kids", "value")

    def __init__(self, edge: bytes, value=None):
        self.edge, self.kids, self.value = edge, {}, value


class PatriciaTrie:
    """Compressed radix trie over byte strings.  ``insert`` gives the value of the
    terminal node of a string, made by ``new`` when the string is new."""

    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, new):
        node, at = self.root, 0
        while True:
            if at == len(key):
                if node.value is None:
                    node.value = new()
                return node.value
            kid = node.kids.get(key[at])
            if kid is None:
                node.kids[key[at]] = leaf = Node(key[at:], new())
                return leaf.value
            rest = key[at : at + len(kid.edge)]
            if rest != kid.edge:
                p = common_prefix(kid.edge, key[at:])
                upper = Node(kid.edge[:p])
                node.kids[key[at]] = upper
                kid.edge = kid.edge[p:]
                upper.kids[kid.edge[0]] = kid
                kid = upper
                at += p
            else:
                at += len(kid.edge)
            node = kid

    def spill(self, upcoming: bytes | None = None) -> list:
        """Free all that ``upcoming`` (None: no key) will not pass and give the values of its
        terminals; complete if keys are inserted in order and it is the next one."""
        out, todo, node, at = [], [], self.root, 0
        while node is not None:
            kid = None
            if upcoming is not None and at < len(upcoming):
                kid = node.kids.get(upcoming[at])
            todo.extend(k for k in node.kids.values() if k is not kid)
            node.kids = {upcoming[at]: kid} if kid is not None else {}
            if kid is not None and upcoming[at : at + len(kid.edge)] != kid.edge:
                break  # an edge is split here: it stays whole
            at += len(kid.edge) if kid is not None else 0
            node = kid
        while todo:
            node = todo.pop()
            if node.value is not None:
                out.append(node.value)
            todo.extend(node.kids.values())
        if upcoming is None and self.root.value is not None:
            out.append(self.root.value)
            self.root = Node(b"")
        return out


def fold(hot: dict, hash_bytes: int):
    """Equal texts of a batch become one entry; ``hot`` holds the salts of hot texts.
    Salt -1 is no salt."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            found: dict[bytes, list] = {}
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = raw.lower()  # bytes: A-Z only
                e = found.get(text)
                if e is None:
                    found[text] = [i, 1]
                else:
                    e[0] = later(e[0], i)
                    e[1] += 1
            digests = [hashlib.sha256(t).digest() for t in found]
            salts = []
            for d, t, (owner, _) in zip(digests, found, found.values(), strict=True):
                of = hot.get((len(t), d))
                salts.append(-1 if of is None else (owner or 0) // 7 % of)
            yield batch(ENTRY, n_bytes=[len(t) for t in found], part=[d[:hash_bytes] for d in digests], salt=salts, text=list(found), owner=[e[0] for e in found.values()], n=[e[1] for e in found.values()])

    return run


def keys(batches: Batches) -> Batches:
    for b in batches:
        low = [t.lower() for t in b.column(1).to_pylist()]
        yield batch(KEY, doc_id=b.column(0), n_bytes=[len(t) for t in low], digest=[hashlib.sha256(t).digest() for t in low])


def owners(batches: Batches):
    """Entries sorted by (length, part, text) into tries, one a key: lists of finished
    terminals [n_bytes, part, salt, text, owner, n].  One text, of any number of entries,
    is one terminal."""
    trie, key, last, value = PatriciaTrie(), None, None, None
    for b in batches:
        for n_bytes, part, salt, text, owner, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (n_bytes, part, salt) != key or text != last:
                done = trie.spill(text if (n_bytes, part, salt) == key else None)
                if done:
                    yield done
                key, last = (n_bytes, part, salt), text
                value = trie.insert(text, lambda: [n_bytes, part, salt, text, None, 0])  # noqa: B023  called at once
            value[4] = later(value[4], owner)
            value[5] += n
    if done := trie.spill():
        yield done


def terminals(batches: Batches) -> Batches:
    """Terminals of the tries; only salted ones, which meet again, keep their texts."""
    held, size = [], 0

    def flush():
        return batch(TERMINAL, **{f.name: [v[i] for v in held] for i, f in enumerate(TERMINAL)})

    for done in owners(batches):
        for n_bytes, part, salt, text, owner, n in done:
            held.append((n_bytes, part, salt, text if salt >= 0 else None, hashlib.sha256(text).digest(), owner, n))
            size += 1 if salt < 0 else 1 + n_bytes // 1000
        if size >= 10_000:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def hot_salts(rows: DataFrame) -> dict:
    """(n_bytes, digest) -> number of salts of the texts that have more rows than an average
    shuffle partition; they are fewer than the partitions."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = max(HOT_ROWS, rows.count() // partitions)
    many = rows.groupBy("n_bytes", "digest").agg(F.count("*").alias("n")).where(F.col("n") > least)
    return {(r.n_bytes, bytes(r.digest)): math.isqrt(r.n) for r in many.collect()}


def classes(docs: DataFrame, rows: DataFrame, hash_bytes: int = HASH_BYTES) -> DataFrame:
    """One row per distinct normalised text: n_bytes, digest, owner, n."""
    hot = hot_salts(rows)
    entries = texts(docs, binary=True).mapInArrow(fold(hot, hash_bytes), ENTRY_DDL)
    dealt = entries.repartition("n_bytes", "part", "salt").sortWithinPartitions("n_bytes", "part", "salt", "text")
    done = cut(dealt.mapInArrow(terminals, TERMINAL_DDL), "exact-terminals")
    whole = done.where("salt < 0")
    if hot:
        met = done.where("salt >= 0").select("n_bytes", "part", F.lit(-1).alias("salt"), "text", "owner", "n")
        met = met.repartition("n_bytes", "part").sortWithinPartitions("n_bytes", "part", "text")
        whole = whole.unionByName(met.mapInArrow(terminals, TERMINAL_DDL))
    return whole.select("n_bytes", "digest", "owner", "n")


def exact_dedup(docs: DataFrame, hash_bytes: int = HASH_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_bytes: one row per document."""
    rows = cut(texts(docs, binary=True).mapInArrow(keys, KEY_DDL), "exact-keys")
    owned = classes(docs, rows, hash_bytes)
    return rows.join(owned.hint("merge"), ["n_bytes", "digest"], "left").select(
        "doc_id",
        F.col("owner").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.coalesce(F.col("doc_id") == F.col("owner"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "n_bytes",
    )


EXACT_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.x) AS text_sha256,
       CAST(octet_length(encode(t.x)) AS BIGINT) AS n_bytes
FROM t JOIN g ON t.x = g.x
"""
