"""Spelling variant grouping with permuterm rotations (operator 13).

Words are counted per task and then over all tasks, and numbered in code-point order.
A word w with the end mark $ has the rotations w[i:]$w[:i].  The edit of character i shows in the
rotation that ends with it, w[i+1:]$w[:i]w[i]: without its last character it is a prefix
that all words share which differ there only (replacement), and it is itself a rotation of the word
without that character (deletion, seen from the other side an insertion).  So each word enters

* every such prefix under its edited character ("open"), and
* each of its own whole rotations ("whole"),

the entries are sorted by prefix, and one scan over the groups finds all neighbours: words open
in a group are near each other, and those are near the word that is whole in it.  A group
holds one whole word and one word a character, so it is bounded by the alphabet (90
letters) whatever the corpus.  The scan emits, for each word of a group, its number
of neighbours there and the best of them, never the pairs; these rows are combined by word.
Deleting any letter of a doubled one gives the same word, so only the first of such a run
is open to it.

Rotations of over EXACT characters are sorted by a 122-bit polynomial digest, worked out
from prefix sums, so a word of any length costs a constant an entry.  Words travel as
numbers.  Forms have at least twice the count, so the chain of forms has no cycle, and its
end is found by doubling in a few rounds of joins.

Null texts have no words, a null id counts as empty text, ties go to the smallest word in
code-point order, repeated rows count each, an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsum.llm.common import Batches, batch, cut, texts

RUN = re.compile("[A-Za-zÀ-ÿ]+")
TYPO, LETTERS, LEAST = 97, 5, 3
#: Different words a task counts before it emits them.
HELD = 200_000
#: Longest rotation that is sorted as it is.
EXACT = 48
END = "$"
P, BASES = (1 << 61) - 1, (0x1F3D5B79A2C4E681 % ((1 << 61) - 1), 0x0A7C3E91B5D2F468 % ((1 << 61) - 1))

COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
ENTRIES = pa.schema([("key", pa.string()), ("role", pa.int8()), ("id", pa.int64()), ("n", pa.int64())])
NEAR = pa.schema([("id", pa.int64()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.int64())])
#: Of an entry: the word itself, open to a deletion as well, open to replacements only.
WHOLE, OPEN, AGAIN = 0, 1, 2


def typed(doc: str, found: Counter) -> Counter:
    """Counts of a text's words where one in TYPO occurrences' words has lost a letter."""
    out: Counter = Counter()
    start = zlib.crc32(f"{doc}:".encode())
    for word, n in found.items():
        h = zlib.crc32(word.encode(), start)
        if h % TYPO == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        out[word] += n
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: words of at least LETTERS letters with at least LEAST occurrences."""

    def run(batches: Batches) -> Batches:
        held: Counter = Counter()

        def flush():
            out = batch(COUNTS, word=list(held), n=list(held.values()))
            held.clear()
            return out

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lowered = text.lower().decode()  # of bytes: A-Z only
                for w, n in typed("" if doc is None else str(doc), Counter(RUN.findall(lowered))).items():
                    if len(w) >= LETTERS:
                        held[w] += n
                if len(held) >= HELD:
                    yield flush()
        yield flush()

    counted = texts(docs, binary=True).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


class Digests:
    """Digests of the substrings of a string by prefix sums (polynomials modulo P)."""

    def __init__(self, s: str):
        self.sums = [[0] for _ in BASES]
        self.powers = [[1] for _ in BASES]
        for b, sums, powers in zip(BASES, self.sums, self.powers, strict=True):
            h, p = 0, 1
            for c in s:
                h, p = (h * b + ord(c) + 1) % P, p * b % P
                sums.append(h)
                powers.append(p)

    def of(self, i: int, j: int) -> str:
        parts = [(s[j] - s[i] * p[j - i]) % P for s, p in zip(self.sums, self.powers, strict=True)]
        return f"{j - i}{END}" + "".join(f"{x:016x}" for x in parts)


def rotations(word: str):
    """(key, role) of the entries of a word."""
    size = len(word)
    ring = word + END + word  # the rotation that starts at i is ring[i:i + size + 1]
    if size > EXACT + 1:
        key = Digests(ring).of
    else:
        key = lambda i, j: ring[i:j] if j - i <= EXACT else Digests(ring).of(i, j)
    for i in range(size + 1):
        yield key(i, i + size + 1), WHOLE
    for i in range(size):
        yield key(i + 1, i + size + 1), AGAIN if i and word[i] == word[i - 1] else OPEN


def entries(words: DataFrame) -> DataFrame:
    def run(batches: Batches) -> Batches:
        for b in batches:
            key, role, ids, ns = [], [], [], []
            for i, w, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for k, r in rotations(w):
                    key.append(k)
                    role.append(r)
                    ids.append(i)
                    ns.append(n)
                if len(key) > 50_000:
                    yield batch(ENTRIES, key=key, role=role, id=ids, n=ns)
                    key, role, ids, ns = [], [], [], []
            yield batch(ENTRIES, key=key, role=role, id=ids, n=ns)

    return words.select("id", "word", "n").mapInArrow(run, "key string, role byte, id long, n long")


def group_neighbours(group: list[tuple[int, int, int]]):
    """(id, near, best_n, best) of the words of one prefix from its (role, id, n)."""

    def told(rows, of):
        """The best and the second of the neighbours serve every member."""
        top = sorted(rows, key=lambda r: (-r[2], r[1]))[:2]
        for m in of:
            own = m in rows
            best = next((t for t in top if t != m), None)
            if best is not None:
                yield m[1], len(rows) - own, best[2], best[1]

    opened = [m for m in group if m[0] != WHOLE]
    whole = [m for m in group if m[0] == WHOLE]
    yield from told(opened, opened)
    once = [m for m in opened if m[0] == OPEN]
    yield from told(once, whole)
    yield from told(whole, once)


def scan(batches: Batches) -> Batches:
    """Sorted entries -> a word's neighbours in each group."""
    last, group = None, []
    for b in batches:
        out = []
        for key, role, i, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key != last:
                if len(group) > 1:
                    out.extend(group_neighbours(group))
                last, group = key, []
            group.append((role, i, n))
        yield batch(NEAR, **{f.name: [o[k] for o in out] for k, f in enumerate(NEAR)})
    out = list(group_neighbours(group))
    yield batch(NEAR, **{f.name: [o[k] for o in out] for k, f in enumerate(NEAR)})


def neighbours(words: DataFrame) -> DataFrame:
    """id, n_near, form_n, form: count and best of all near words (words with any)."""
    found = entries(words).repartition("key").sortWithinPartitions("key").mapInArrow(scan, "id long, near long, best_n long, best long")
    best = F.max(F.struct(F.col("best_n").alias("n"), (-F.col("best")).alias("before")))  # ties: the smaller word
    return found.groupBy("id").agg(F.sum("near").alias("n_near"), best.alias("t")).select("id", "n_near", F.col("t.n").alias("form_n"), (-F.col("t.before")).alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """id, root for the rows (id, to): the end of each chain, by doubling."""
    at = forms
    while True:
        ahead = at.select(F.col("id").alias("to"), F.col("to").alias("next"))
        new = cut(at.join(ahead, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "roots")
        at = new.select("id", "to")
        if new.where("moved").isEmpty():
            return at.withColumnRenamed("to", "root")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word."""
    # numbers in code-point order: the sort is by range, the numbers rise with partition and row
    words = cut(cut(word_counts(docs), "words").orderBy("word").withColumn("id", F.monotonically_increasing_id()), "numbered")
    near = cut(neighbours(words), "near")
    own = words.join(near, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.expr("if(form_n >= 2 * n, form, null)").alias("to"), F.expr("if(form_n >= 2 * n, form_n, null)").alias("form_n"))
    own = cut(own, "forms")
    ends = roots(own.where("to is not null").select("id", "to"))
    name = lambda key, what: words.select(F.col("id").alias(key), F.col("word").alias(what))
    out = own.join(ends, "id", "left").join(name("to", "form"), "to", "left").join(name("root", "end"), "root", "left")
    return out.select("word", "form", F.coalesce("end", "word").alias("root"), "n", "n_near", "form_n")
