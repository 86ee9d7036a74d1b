"""Line dedup by winnowing over line hashes (operator 8), with DataFrame functions only.

A later repeated run is deleted: a line goes when a window that holds it occurs earlier, in
the order of doc_id and then of position.  A window is RUN lines, or the first fewer
lines from its start that hold WORDS words, so a repeated passage of one or two long lines
goes too, also in texts of fewer than RUN lines.  (``words=None`` leaves the latter out.)

1. Each window of RUN line hashes selects its minimum as a fingerprint.  Selection looks at
   the window alone, so a window that two texts share selects the same
   fingerprint in both.
2. Positions of fingerprints are joined by hash (through their first and last position,
   which partial aggregation gives without gathering a group): windows whose
   fingerprint occurs at one position only are done.
3. From the others the match is extended both ways, to every window that holds
   the fingerprint: equal windows (by 128 bits of hash) find their first occurrence.
4. Later windows are merged into runs per text, and the text is put together from
   the lines between the runs.

A hot line or passage is one key of an aggregation or of a join whose other side has
one row a key and comes from files, which adaptive execution splits.

Lines end at \\n only; null text counts as empty (one empty line).  Words are cut at 0x20 and
0x09-0x0D.  Rows are told apart by id and text: rows that repeat both are one row for
"earlier", and are treated alike; a null id comes before all others and is no other id.  An
empty table gives an empty result.  All columns of the input are passed on as they are, whatever
their names; what is added gets further underscores where a name is taken (:func:`added`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsum.llm.common import cut

RUN = 3
#: Words of a passage that is a run whatever its number of lines.
WORDS = 50
WORD = "[^ \\t\\n\\x0B\\f\\r]+"
NEWLINE = "\n"
STATS = ("_n_lines", "_n_removed", "_n_runs")


def added(docs: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many more underscores in front as make it new to ``docs``."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


def row_id(docs: DataFrame) -> Column:
    """The id as a value that sorts null first and keeps it apart from every id."""
    return F.struct(docs["doc_id"].isNotNull().alias("known"), F.coalesce(docs["doc_id"].cast("long"), F.lit(0)).alias("id"))


def keyed(docs: DataFrame) -> DataFrame:
    """Row key (_id, _t) and lines of every text."""
    t = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(row_id(docs).alias("_id"), F.xxhash64(t).alias("_t"), F.split(t, NEWLINE).alias("_lines"))


def windows(docs: DataFrame, run: int, words: int | None) -> DataFrame:
    """_id, _t, pos, size (lines), f (fingerprint), fpos (its position), k1, k2 (window hash)."""
    rows = keyed(docs) if words else keyed(docs).where(F.size("_lines") >= run)
    hashed = rows.select(
        "_id", "_t", F.transform("_lines", lambda x: F.xxhash64(x)).alias("h"), F.transform("_lines", lambda x: F.xxhash64(F.lit(1), x)).alias("g"),
        *[F.transform("_lines", lambda x: F.regexp_count(x, F.lit(WORD))).alias("c")] * bool(words),
    )

    def sizes(i):
        """Lines of the windows that start at line i; null for one that the text cannot hold."""
        whole = F.when(i + run <= F.size("h"), run)
        held, short = F.lit(0), F.lit(None).cast("int")
        for n in range(1, run):
            held = held + F.get("c", i + (n - 1))  # null beyond the last line
            short = F.coalesce(short, F.when(held >= words, n))
        return F.array(short, whole)

    def window(w):
        i, n = w["pos"], w["size"]
        h, g = F.slice("h", i + 1, n), F.slice("g", i + 1, n)
        f = F.array_min(h)
        return F.struct(
            i.alias("pos"), n.alias("size"), f.alias("f"), (i + F.array_position(h, f).cast("int") - 1).alias("fpos"), F.xxhash64(h, g).alias("k1"), F.xxhash64(F.lit(2), g, h).alias("k2")
        )

    if words:
        starts = F.flatten(F.transform(F.sequence(F.lit(0), F.size("h") - 1), lambda i: F.transform(F.array_compact(sizes(i)), lambda n: F.struct(i.alias("pos"), n.alias("size")))))
    else:
        starts = F.transform(F.sequence(F.lit(0), F.size("h") - run), lambda i: F.struct(i.alias("pos"), F.lit(run).alias("size")))
    each = F.transform(starts, window)
    return hashed.select("_id", "_t", F.explode(each).alias("w")).select("_id", "_t", "w.*")


def later_windows(docs: DataFrame, run: int, words: int | None) -> DataFrame:
    """_id, _t, pos, size of the windows that occur earlier."""
    rows = cut(windows(docs, run, words), "windows")
    at = F.struct("_id", "_t", "fpos")
    repeated = cut(rows.groupBy("f").agg(F.min(at).alias("a"), F.max(at).alias("b")).where("a <> b").select("f"), "fingerprints")
    some = cut(rows.join(repeated, "f").select("_id", "_t", "pos", "size", "k1", "k2"), "matches")
    at = F.struct("_id", "_t", "pos")
    first = cut(some.groupBy("k1", "k2").agg(F.min(at).alias("a"), F.max(at).alias("b")).where("a <> b").select("k1", "k2", "a"), "first")
    return some.join(first, ["k1", "k2"]).where(at > F.col("a")).select("_id", "_t", "pos", "size").distinct()


def runs(later: DataFrame) -> DataFrame:
    """_id, _t, runs: the merged line ranges array<struct<s, e>> (e exclusive), sorted."""
    order = "partition by _id, _t order by pos"
    before = f"max(pos + size) over ({order} rows between unbounded preceding and 1 preceding)"
    parts = later.select("*", F.expr(f"case when pos <= {before} then 0 else 1 end").alias("fresh"))
    parts = parts.select("_id", "_t", "pos", "size", F.expr(f"sum(fresh) over ({order})").alias("part"))
    ranges = parts.groupBy("_id", "_t", "part").agg(F.min("pos").alias("s"), F.max(F.col("pos") + F.col("size")).alias("e"))
    return ranges.groupBy("_id", "_t").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("_runs"))


def line_dedup(docs: DataFrame, run: int = RUN, words: int | None = WORDS) -> DataFrame:
    """``docs`` with the shortened ``text`` and, under the names _n_lines, _n_removed
    and _n_runs, what was done to it.  Texts that lose nothing stay as they are."""
    i, t, lines, gone = added(docs, "_id", "_t", "_lines", "_runs")
    found = runs(later_windows(docs, run, words)).withColumnsRenamed({"_id": i, "_t": t, "_runs": gone})
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumns({i: row_id(docs), t: F.xxhash64(text)})
    rows = rows.join(found.hint("merge"), [i, t], "left").withColumn(lines, F.split(text, NEWLINE))
    n = F.size(lines)
    kept = F.expr(
        f"flatten(transform({gone}, (r, i) -> slice({lines}, if(i = 0, 1, get({gone}, i - 1).e + 1), r.s - if(i = 0, 0, get({gone}, i - 1).e))))"
    )
    tail = F.expr(f"slice({lines}, element_at({gone}, -1).e + 1, size({lines}) - element_at({gone}, -1).e)")
    left = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.concat(kept, tail), NEWLINE))
    removed = F.coalesce(F.expr(f"aggregate({gone}, 0, (a, r) -> a + r.e - r.s)"), F.lit(0)).cast("long")
    stats = [n.cast("long"), removed, F.greatest(F.coalesce(F.size(F.col(gone)), F.lit(0)), F.lit(0)).cast("long")]
    own = [left.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return rows.select(*own, *[v.alias(c) for v, c in zip(stats, added(docs, *STATS), strict=True)])


def line_digest(docs: DataFrame, run: int = RUN, words: int | None = WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the remaining lines joined by \\n)."""
    out = line_dedup(docs.select("doc_id", "text"), run, words)
    return out.select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


def line_sql(run: int = RUN) -> str:
    """The same rows without the rule of WORDS in DuckDB (ids are unique there)."""
    return f"""
WITH x AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
w AS (SELECT doc_id, i, array_to_string(l[i:i + {run - 1}], chr(10)) AS w FROM x, LATERAL (SELECT unnest(range(1, len(l) - {run - 2})) AS i)),
f AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM w),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM f, (SELECT unnest(range(0, {run})) AS j) WHERE k > 1),
e AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM x)
SELECT e.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed,
       sha256(coalesce(string_agg(e.line, chr(10) ORDER BY e.i) FILTER (WHERE gone.i IS NULL), '')) AS kept_sha256
FROM e LEFT JOIN gone ON e.doc_id = gone.doc_id AND e.i = gone.i GROUP BY e.doc_id
"""


def passage_sql(run: int = RUN, words: int = WORDS) -> str:
    """:func:`line_digest` in DuckDB (ids are unique there)."""
    return f"""
WITH x AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
y AS (SELECT doc_id, l, list_transform(l, lambda z: len(regexp_extract_all(z, '[^ \\t\\n\\x0B\\f\\r]+'))) AS c FROM x),
p AS (SELECT doc_id, l, c, unnest(range(1, len(l) + 1)) AS i FROM y),
n AS (SELECT doc_id, i, l, n, n = {run} OR (list_sum(c[i:i + n - 1]) >= {words} AND (n = 1 OR list_sum(c[i:i + n - 2]) < {words})) AS ok
      FROM p, (SELECT unnest(range(1, {run + 1})) AS n) WHERE i + n - 1 <= len(l)),
w AS (SELECT doc_id, i, n, array_to_string(l[i:i + n - 1], chr(10)) AS w FROM n WHERE ok),
f AS (SELECT *, row_number() OVER (PARTITION BY w, n ORDER BY doc_id, i) AS k FROM w),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM f WHERE k > 1),
e AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM x)
SELECT e.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed,
       sha256(coalesce(string_agg(e.line, chr(10) ORDER BY e.i) FILTER (WHERE gone.i IS NULL), '')) AS kept_sha256
FROM e LEFT JOIN gone ON e.doc_id = gone.doc_id AND e.i = gone.i GROUP BY e.doc_id
"""
