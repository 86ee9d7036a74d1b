"""Skew-safe equi-join for a side with unique keys, and key sets of a batch.

Adaptive execution splits a skewed sort-merge-join partition only when both
join inputs come straight from their own shuffle.  When one input reuses the
partitioning of an aggregation (e.g. per-donor totals grouped by the join
key), no split happens and a key holding a third of the rows lands in one
task.  :func:`hot_split_join` salts such keys:

1. one partially aggregated count finds the ``top_k`` most frequent keys of the
   big side (by default as many as there are shuffle partitions, so every other
   key has fewer rows than an average partition);
2. each of them is dealt into parts of at most 1/``top_k`` of their rows.  The
   parts number at most 2 x ``top_k`` in all, a proven bound, so this small
   table is broadcast to both sides;
3. the big side is read once more, each row with a part of its key chosen by a
   hash of the row; the small side repeats a hot key's only row for each part.

No row is dropped or duplicated: a big row has one part and meets exactly the
small row it would meet in the plain join.
"""

from __future__ import annotations

from contextvars import ContextVar

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hot_keys(big: DataFrame, key: str, top_k: int) -> DataFrame:
    """``(_hot_key, _parts)``: of the ``top_k`` keys with the most rows in ``big``,
    those with more rows than a ``top_k``-th of them all, and their number of parts."""
    counts = big.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_hot_key")).agg(F.count(F.lit(1)).alias("_n"))
    top = counts.orderBy(F.col("_n").desc(), F.col("_hot_key")).limit(top_k)
    share = F.ceil(F.col("_n") * top_k / F.sum("_n").over(Window.partitionBy()))  # over at most top_k rows
    return top.select("_hot_key", share.cast("int").alias("_parts")).where("_parts > 1")


def hot_split_join(
    big: DataFrame, small: DataFrame, big_key: str, small_key: str, how: str = "inner", top_k: int | None = None
) -> DataFrame:
    """``big.join(small, big[big_key] == small[small_key], how)`` for a
    ``small`` side with at most one row per key, safe against hot keys in
    ``big``.  ``how`` is "inner" or "left" (``big`` preserved)."""
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    top_k = top_k or int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.broadcast(hot_keys(big, big_key, top_k))
    row = F.xxhash64(*big.columns)
    # rows without a key meet nothing: they are dealt over all partitions
    parts = F.when(big[big_key].isNull(), F.lit(top_k)).otherwise(F.coalesce("_parts", F.lit(1)))
    dealt = big.join(hot, big[big_key] == hot["_hot_key"], "left").withColumn("_part", F.pmod(row, parts).cast("int")).drop("_hot_key", "_parts")
    each = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    copies = small.join(hot, small[small_key] == hot["_hot_key"], "left").withColumn("_copy", each).drop("_hot_key", "_parts")
    on = (dealt[big_key] == copies[small_key]) & (dealt["_part"] == copies["_copy"])
    return dealt.join(copies, on, how).drop("_part", "_copy")


# Small key sets persisted while an incremental batch runs.  Each thread of the driver
# (each stream runs its batches in one) has its own list, so releasing one job's sets
# leaves those of another alone.
_PERSISTED: ContextVar[list | None] = ContextVar("persisted_key_sets", default=None)
SMALL_MAX_ROWS = 100_000


def small_side(df: DataFrame, max_rows: int = SMALL_MAX_ROWS) -> DataFrame:
    """Materialise a key set derived from an incremental batch once, and
    broadcast it when its counted size is at most ``max_rows``.

    A join is planned as a broadcast join only from sizes known at planning
    time; adaptive execution converts a shuffle join later, after the big
    side has already been shuffled.  Counting the (persisted) set first lets
    the big side of every join with it stay unshuffled.  The count is a Spark job
    that runs while the plan is being built."""
    return small_side_checked(df, max_rows)[0]


def small_side_checked(df: DataFrame, max_rows: int = SMALL_MAX_ROWS) -> tuple[DataFrame, bool]:
    """:func:`small_side` plus whether the set was small enough to broadcast."""
    df = df.persist()
    if _PERSISTED.get() is None:
        _PERSISTED.set([])
    _PERSISTED.get().append(df)
    small = df.count() <= max_rows  # every partition is persisted anyway; a limit would send its rows to one task
    return (F.broadcast(df) if small else df), small


def release_small_sides() -> None:
    """Unpersist the key sets that this thread made."""
    for df in _PERSISTED.get() or ():
        df.unpersist()
    _PERSISTED.set(None)
