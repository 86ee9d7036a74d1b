"""Near dedup with SetSketch registers (operator 9).

A document's set is its distinct word shingles.  Each of M registers keeps the minimum
of exponentially distributed hashes of the set, on an exponential scale of base B:
K = floor(1 - log_B(min)), truncated to [0, Q + 1].  Registers of a union are the maxima
of the parts' registers (:func:`merge`), and two sets agree in a register with about
their Jaccard similarity.

1. Documents with the same set form a class; its smallest id stands for it.
2. BANDS bands of ROWS registers are the bucket keys.  At similarity 0.8 a pair shares a
   bucket with probability 1 - (1 - 0.8^5)^32 = 1 - 3e-6.
3. In each bucket every member is paired with the smallest one (a star, not all pairs).
   Pairs are screened by the joint maximum-likelihood estimate of the similarity from
   the registers, with a slack of five standard deviations, and verified on full
   shingle sets; the links give first components.
4. Only pairs in different components are of interest from here on.  In a bucket of up
   to SMALL members that lie in several components all such pairs are tested; in a
   larger one two centres are tested against all members of other components.
5. Buckets that are then still large and of several components (unlike documents that
   share a long passage, or copies at the very threshold) are compared exactly, in blocks:
   every member outside a bucket's largest component meets all others in groups of
   at most about two times BLOCK members, where shared shingles are counted by an
   inverted index and only the links come out.

Groups of copies collapse in 1, hot buckets are aggregated before they are shuffled and
joined with a table that has one row a key (adaptive execution splits such joins); no
group is collected beyond SMALL or two times BLOCK members.

Null, empty and blank texts have an empty set: they are linked with nothing.  Rows with
a null id get a null component and are not kept.  Rows with the same id are one vertex.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsum.llm.common import Batches, batch, cut, texts
from kinsum.llm.graph import components
from kinsum.llm.words import HASHES, MULT, bloom, mix, shingles

BANDS, ROWS = 32, 5
M = BANDS * ROWS
B, RATE, Q = 1.001, 20.0, 65_534
SMALL, BLOCK = 16, 500
#: Up to so many ids (16 MB of bitmap) texts are picked by a bitmap of BITS_AN_ID bits an id.
FILTERED, BITS_AN_ID = 8_000_000, 16
#: Below the threshold by five standard deviations of a register count at 0.8.
SLACK = 0.16

FACTORS = np.random.default_rng(9).integers(0, 1 << 63, M, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SKETCH = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("sketch", pa.binary())])
SKETCH_DDL = "doc_id long, n long, k1 long, k2 long, sketch binary"
SETS = pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary())])


def registers(sets: np.ndarray) -> np.ndarray:
    """M register values (uint16) of a set of well-mixed 64-bit hashes."""
    low = np.full(M, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(sets), 512):
        np.minimum(low, (FACTORS[:, None] * sets[None, i : i + 512]).min(axis=1), out=low)
    h = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64 * (1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(B)), 0, Q + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def likely_similarity(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood Jaccard estimates of pairs (rows of a and b) from the
    numbers of larger, smaller and equal registers and the known set sizes."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    tiny = 1e-12
    best, at = np.full(len(a), -np.inf), np.zeros(len(a))
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)
    for j in np.linspace(0, 1, 201):
        pm, pl = p(u - v * j), p(v - u * j)
        ll = more * np.log(np.maximum(pm, tiny)) + less * np.log(np.maximum(pl, tiny)) + same * np.log(np.maximum(1 - pm - pl, tiny))
        ll[j > np.minimum(u / v, v / u) + 1e-9] = -np.inf
        better = ll > best
        best[better], at[better] = ll[better], j
    return at


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """BANDS bucket keys for each row of registers."""
    r = sketch.reshape(len(sketch), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), r.shape[:2])
    for i in range(ROWS):
        h = mix(h * MULT + r[:, :, i])
    return h.view(np.int64)


def unpack(column: pa.Array, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Batches) -> Batches:
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                s = shingles(HASHES.of(t), width)
                with np.errstate(over="ignore"):
                    k1, k2 = int(mix(s ^ MULT).sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(mix(s + MULT), initial=np.uint64(0)))
                out.append((len(s), k1 - (1 << 63), k2 - (1 << 63), registers(s).tobytes() if len(s) else b""))
            n, k1, k2, sk = zip(*out, strict=True) if out else ((), (), (), ())
            yield batch(SKETCH, doc_id=b.column(0), n=n, k1=k1, k2=k2, sketch=sk)

    return texts(docs, binary=True).mapInArrow(run, SKETCH_DDL)


def buckets(reps: DataFrame) -> DataFrame:
    """(key, rep): the buckets of every representative."""
    schema = pa.schema([("key", pa.int64()), ("rep", pa.int64())])

    def run(batches: Batches) -> Batches:
        for b in batches:
            keys = band_keys(unpack(b.column(1), np.uint16, M))
            yield batch(schema, key=keys.ravel(), rep=np.repeat(b.column(0).to_numpy(), BANDS))

    return reps.select("rep", "sketch").mapInArrow(run, "key long, rep long")


def screened(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose estimated similarity is at least ``least``."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Batches) -> Batches:
        for b in batches:
            if b.num_rows:
                sa, sb = unpack(b.column(4), np.uint16, M), unpack(b.column(5), np.uint16, M)
                keep = likely_similarity(sa, sb, b.column(2).to_numpy(), b.column(3).to_numpy()) >= least
                yield batch(schema, a=b.column(0).to_numpy()[keep], b=b.column(1).to_numpy()[keep])

    left = reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def shingle_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """doc_id, shingles (sorted uint64) of the documents in ``ids``, written once for all that
    read it.  Up to FILTERED ids a bitmap sized by their number picks the texts where they are
    read and lets some others through, which the caller's joins drop; more ids are joined."""
    ids = cut(ids.distinct(), "wanted")
    n = ids.count()
    rows = texts(docs.where(docs["doc_id"].isNotNull()), binary=True)
    wanted = None
    if n > FILTERED:
        rows = rows.join(ids, "doc_id", "left_semi")
    else:
        bits = max(16, (n * BITS_AN_ID).bit_length())
        wanted = docs.sparkSession.sparkContext.broadcast(bloom(ids, F.xxhash64("doc_id"), bits))

    def run(batches: Batches) -> Batches:
        for b in batches:
            at = np.arange(b.num_rows) if wanted is None else np.flatnonzero(wanted.value.may_hold(b.column(2).to_numpy()))
            for i in range(0, len(at), 200):
                some = b.take(pa.array(at[i : i + 200]))
                yield batch(SETS, doc_id=some.column(0), shingles=[shingles(HASHES.of(t), width).tobytes() for t in some.column(1).to_pylist()])

    return cut(rows.withColumn("h", F.xxhash64("doc_id")).mapInArrow(run, "doc_id long, shingles binary"), "sets")


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union of their full sets."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches: Batches) -> Batches:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch(schema, a=b.column(0).filter(pa.array(keep, pa.bool_())), b=b.column(1).filter(pa.array(keep, pa.bool_())))

    own = shingle_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), width)
    a, b = own.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), own.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def mixed_buckets(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """Members (key, rep, c) of buckets that lie in several components, with the size
    of the bucket and two of its members in different components as centres."""
    named = rows.join(comps.withColumnRenamed("v", "rep"), "rep", "left").select("key", "rep", F.coalesce("comp", "rep").alias("c"))
    members = cut(named, "members")
    one = F.struct("c", "rep")
    stats = members.groupBy("key").agg(F.count("*").alias("size"), F.min(one).alias("r0"), F.max(one).alias("r1")).where("r0.c <> r1.c")
    return cut(members.join(cut(stats, "buckets"), "key"), "mixed")


def small_pairs(mixed: DataFrame) -> DataFrame:
    """All pairs in different components, from buckets of up to SMALL members."""
    whole = mixed.where(f"size <= {SMALL}").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rep", "c"))).alias("m"))
    others = f"filter(slice(m, i + 2, {SMALL}), y -> y.c <> x.c)"
    each = F.expr(f"flatten(transform(m, (x, i) -> transform({others}, y -> struct(x.rep as a, y.rep as b))))")
    return whole.select(F.explode(each).alias("p")).select("p.a", "p.b")


def star_pairs(mixed: DataFrame) -> DataFrame:
    """The centres of larger buckets with the members of other components."""
    large = mixed.where(f"size > {SMALL}")
    ends = [large.where(f"{r}.c <> c").select(F.least(f"{r}.rep", "rep").alias("a"), F.greatest(f"{r}.rep", "rep").alias("b")) for r in ("r0", "r1")]
    return ends[0].unionByName(ends[1])


def shared_counts(query: np.ndarray, tokens: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """How many shingles of ``query`` each of n sets holds; ``tokens`` is sorted."""
    lo, hi = np.searchsorted(tokens, query, "left"), np.searchsorted(tokens, query, "right")
    size = hi - lo
    at = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    return np.bincount(owners[at], minlength=n)


def block_links(percent: int):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        m, q = g[g.role == 1], g[g.role == 0]
        sets = [np.frombuffer(x, np.uint64) for x in m.shingles]
        size, reps, comp = np.array([len(x) for x in sets], np.int64), m.rep.to_numpy(), m.c.to_numpy()
        a, b = [], []
        if len(sets):
            tokens, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
            order = np.argsort(tokens, kind="stable")
            tokens, owners = tokens[order], owners[order]
            for rep, c, x in zip(q.rep, q.c, q.shingles, strict=True):
                x = np.frombuffer(x, np.uint64)
                both = shared_counts(x, tokens, owners, len(sets))
                hit = np.flatnonzero((comp != c) & (both > 0) & (100 * both >= percent * (len(x) + size - both)))
                _, first = np.unique(comp[hit], return_index=True)  # one link to each component
                a.extend([rep] * len(first))
                b.extend(reps[hit[first]])
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return run


def rest_links(docs: DataFrame, large: DataFrame, width: int, percent: int) -> DataFrame:
    """All links between different components within the buckets (key, rep, c)."""
    each = large.groupBy("key", "c").agg(F.count("*").alias("n"))
    top = F.max(F.struct("n", "c"))
    stats = cut(each.groupBy("key").agg(top["c"].alias("top"), F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"), F.ceil((F.sum("n") - top["n"]) / BLOCK).cast("int").alias("asking")), "sizes")
    rows = large.select("key", "rep", "c").join(stats, "key")
    mine = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = rows.select("key", "rep", "c", F.lit(1).alias("role"), every("asking").alias("i"), mine("blocks").alias("j"))
    asks = rows.where("c <> top").select("key", "rep", "c", F.lit(0).alias("role"), mine("asking").alias("i"), every("blocks").alias("j"))
    sets = shingle_sets(docs, large.select(F.col("rep").alias("doc_id")), width).withColumnRenamed("doc_id", "rep")
    return asked.unionByName(asks).join(sets, "rep").groupBy("key", "i", "j").applyInPandas(block_links(percent), "a long, b long")


def links(docs: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """Components (v, comp) of the verified links between class representatives."""
    rows = buckets(reps)
    stats = cut(rows.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("r0")).where("size > 1"), "buckets")
    members = cut(rows.join(stats, "key"), "members")

    def tested(pairs: DataFrame) -> DataFrame:
        close = cut(screened(pairs.distinct(), reps, percent / 100 - SLACK), "screened")
        return cut(verified(close, docs, width, percent), "links")

    found = tested(members.where("rep <> r0").select(F.col("r0").alias("a"), F.col("rep").alias("b")))
    comps = components(found)
    mixed = mixed_buckets(members.select("key", "rep"), comps)
    found = found.unionByName(tested(small_pairs(mixed).unionByName(star_pairs(mixed))))
    comps = components(found)
    large = mixed_buckets(mixed.where(f"size > {SMALL}").select("key", "rep"), comps)
    if large.isEmpty():
        return comps
    return components(found.unionByName(cut(rest_links(docs, large, width, percent).distinct(), "links")))


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document."""
    rows = cut(sketches(docs, width), "sketches")
    named = rows.where("doc_id is not null")
    reps = cut(
        named.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")),
        "reps",
    )
    comps = links(docs, reps, width, percent)
    classes = cut(reps.join(comps.withColumnRenamed("v", "rep"), "rep", "left").select("n", "k1", "k2", F.coalesce("comp", "rep").alias("comp")), "classes")
    out = rows.select("doc_id", "n", "k1", "k2").join(classes.hint("merge"), ["n", "k1", "k2"], "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(comp == F.col("doc_id"), F.lit(False)).alias("kept"))


def near_sql(width: int, percent: int) -> str:
    """The same rows in DuckDB: shared shingles counted, then reachability."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS x FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, CASE WHEN len(x) < {width} THEN array_to_string(x, ' ') ELSE array_to_string(x[i:i + {width - 1}], ' ') END AS sh
      FROM w, LATERAL (SELECT unnest(range(1, greatest(len(x) - {width - 1}, 1) + 1)) AS i) WHERE len(x) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT list_sort(list(sh)) AS key, doc_id FROM s GROUP BY doc_id),
c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY key) AS rep FROM k),
r AS (SELECT s.doc_id, s.sh FROM s JOIN c ON s.doc_id = c.doc_id AND c.doc_id = c.rep),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM r a JOIN r b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * i >= {percent} * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
t AS (SELECT rep AS v, rep AS u FROM c WHERE doc_id = rep UNION SELECT t.v, e.b FROM t JOIN e ON e.a = t.u),
m AS (SELECT v, min(u) AS comp FROM t GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.comp, d.doc_id) AS component_id, coalesce(m.comp, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN m ON m.v = c.rep
"""
