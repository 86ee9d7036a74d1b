"""Secret scans with corpus-wide ownership frequency (operator 5), with DataFrame
functions only.

1. Base spans: the kinds assign, access and hex are found by regular expressions.
   Positions come from the gaps between matches: a text splits into gap, match,
   gap, ..., and running sums of their lengths give the starts.
2. Candidates are the base spans' secrets and long letter-and-digit tokens (bare) that
   overlap no base span.
3. Ownership: for the 128-bit hash of each candidate's value the distinct owners (sources)
   and repositories (different texts of an owner; copies of a document are one) are
   counted, pre-aggregated per owner.  A value of more than MAX_OWNERS owners or of more than
   MAX_REPOSITORIES repositories is a widely copied example, so one that a single large owner
   repeats in many texts is one too; others look live.
4. Base spans stay; bare candidates are added as spans if they look live.

A value that very many documents hold is one key of an aggregation and of a join with a
table that has one row a value and comes from files; adaptive execution splits it.

Positions count code points, the end is exclusive; letters are ASCII (the pattern is not
case-sensitive where stated).  Null text counts as empty; a null source is an owner like
others; a null id is no other id; rows that repeat id and text get the same result and count once.  An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinsum.llm.common import cut

#: The kinds in their order, their patterns, and the least length of the part
#: that holds the secret (group 2 of assign).
KINDS = ("assign", "access", "hex", "bare")
PATTERNS = {
    "assign": r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "bare": r"[A-Za-z0-9+_=-]{20,}",
}
ASSIGN_LEAST = 6
MAX_OWNERS, MAX_REPOSITORIES = 3, 10

FOUND = T.ArrayType(T.StructType([T.StructField("gap", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("value", T.StringType())]))


def matches(text: Column, kind: str) -> Column:
    """array<struct<gap, size, value>>: each match with the length of the gap before it."""
    pattern = PATTERNS[kind]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else whole
    each = F.arrays_zip(whole.alias("m"), F.split(text, pattern, -1).alias("g"), value.alias("v"))
    made = F.transform(
        F.filter(each, lambda x: x["m"].isNotNull()), lambda x: F.struct(F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("size"), x["v"].alias("value"))
    )
    return F.when(F.regexp_like(text, F.lit(pattern)), made).otherwise(F.array().cast(FOUND))


def row_id(docs: DataFrame) -> Column:
    """The id as a value that keeps null apart from every id."""
    return F.struct(docs["doc_id"].isNotNull().alias("known"), F.coalesce(docs["doc_id"].cast("long"), F.lit(0)).alias("id"))


def spans(docs: DataFrame) -> DataFrame:
    """id, t, source, kind (its place in KINDS), s, e, value: base spans, and bare ones that
    overlap none."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(
        row_id(docs).alias("id"), F.xxhash64(text).alias("t"), docs["source"].cast("string").alias("source"), text.alias("text")
    )
    each = rows.select("id", "t", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), matches(F.col("text"), name).alias("m")) for k, name in enumerate(KINDS)])).alias("k"))
    found = cut(each.where(F.size("k.m") > 0).select("id", "t", "source", "k.kind", F.posexplode("k.m").alias("i", "m")).select("id", "t", "source", "kind", "i", "m.*").distinct(), "matches")
    order = "partition by id, t, source, kind order by i rows between unbounded preceding and"
    start = F.expr(f"sum(gap) over ({order} current row) + coalesce(sum(size) over ({order} 1 preceding), 0)")
    placed = found.withColumn("s", start.cast("int")).withColumn("e", F.col("s") + F.col("size"))
    good = F.expr(
        f"case kind when 0 then length(value) >= {ASSIGN_LEAST} when 3 then value rlike '[0-9]' and value rlike '[A-Za-z]' else true end"
    )
    placed = placed.where(good)
    # a bare token overlaps a base span that starts before its end and ends after its start
    near = placed.withColumns(
        {
            "before": F.expr("max(if(kind < 3, e, null)) over (partition by id, t, source order by s range between unbounded preceding and current row)"),
            "after": F.expr("min(if(kind < 3, s, null)) over (partition by id, t, source order by s range between current row and unbounded following)"),
        }
    )
    clear = (F.col("kind") < 3) | (F.coalesce(F.col("before") <= F.col("s"), F.lit(True)) & F.coalesce(F.col("after") >= F.col("e"), F.lit(True)))
    return near.where(clear).select("id", "t", "source", "kind", "s", "e", "value")


def ownership(found: DataFrame) -> DataFrame:
    """h1, h2 (hash of a value), owners, repositories."""
    per_owner = found.groupBy("h1", "h2", "source", "t").agg(F.lit(1).alias("one")).groupBy("h1", "h2", "source").agg(F.count("*").alias("n"))
    return per_owner.groupBy("h1", "h2").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def scan(docs: DataFrame) -> DataFrame:
    """id, t, kind, s, e, owners, repositories, live: base spans and live bare ones."""
    hashed = spans(docs).withColumns({"h1": F.xxhash64("value"), "h2": F.xxhash64(F.lit(1), "value")}).drop("value")
    found = cut(hashed, "spans")
    owned = cut(ownership(found), "owners")
    out = found.join(owned, ["h1", "h2"]).withColumn("live", (F.col("owners") <= MAX_OWNERS) & (F.col("repositories") <= MAX_REPOSITORIES))
    return out.where("kind < 3 or live").select("id", "t", "kind", "s", "e", "owners", "repositories", "live").distinct()


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, and n_bare, n_live,
    n_example: one row per document."""
    names = F.array(*[F.lit(k) for k in KINDS])
    label = lambda x: F.concat(F.element_at(names, x["kind"] + 1), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))
    count = lambda c: F.count(F.when(c, 1))
    per = scan(docs).groupBy("id", "t").agg(
        *[count(F.col("kind") == k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        count(F.col("live")).alias("n_live"),
        count(~F.col("live")).alias("n_example"),
        F.array_sort(F.collect_list(F.struct("s", "kind", "e"))).alias("all"),
    )
    joined = per.select(
        "*",
        F.array_join(F.transform("all", label), ",").alias("spans"),
        F.sha2(F.array_join(F.transform(F.filter("all", lambda x: x["kind"] < 3), label), ","), 256).alias("base_sha256"),
    )
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), row_id(docs).alias("id"), F.xxhash64(text).alias("t"))
    out = rows.join(joined.hint("merge"), ["id", "t"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(
        "doc_id", zero("n_assign"), zero("n_access"), zero("n_hex"), F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
        zero("n_bare"), zero("n_live"), zero("n_example"),
    )
