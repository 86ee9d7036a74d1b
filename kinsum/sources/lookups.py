"""Lookups (SRC2, SRC3) and id-list resolution (FLT2, FLT3).

An id list given in the config becomes an ``IN (...)`` predicate that Catalyst
pushes into the scan.  A missing list means "every id the lookup table knows":
that is resolved as a join flag against the distinct lookup ids, so nothing is
collected to the driver and the lookup may be of any size.

Lookup joins carry no broadcast hint: the planner broadcasts a lookup whose
estimated size is under ``spark.sql.autoBroadcastJoinThreshold`` and adaptive
execution converts the join once it has measured it; otherwise it stays a
shuffle join.  Sides derived from an incremental batch are counted first
(:func:`kinsum.functions.joins.small_side`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsum.sources.crm import MissingTable, Sources

def option_lookup(src: Sources, group_name: str) -> DataFrame:
    """SRC2: ``(value, label)`` of one option group; empty when the component
    (its option tables) is missing."""
    og = src["option_group"].where(F.col("name") == group_name).select(F.col("id").alias("_gid"))
    ov = src["option_value"]
    return ov.join(og, ov["option_group_id"] == og["_gid"], "left_semi").select(
        "value", "label"
    )


def relationship_type_labels(src: Sources) -> DataFrame:
    """SRC3: ``(id, label)`` with ``label = label_a_b/label_b_a``; rows whose
    ``name_a_b`` is empty (PHP ``empty()``: NULL, '' or '0') are skipped, NULL
    labels print as ''."""
    rt = src["relationship_type"]
    return rt.where(~F.coalesce(F.col("name_a_b"), F.lit("")).isin("", "0")).select(
        F.col("id"),
        F.concat(F.coalesce("label_a_b", F.lit("")), F.lit("/"), F.coalesce("label_b_a", F.lit(""))).alias(
            "label"
        ),
    )


def known_ids(src: Sources, kind: str) -> DataFrame:
    """Distinct ids currently known for one of the seven id lists (FLT3).  Without
    the lookup table "all known ids" has no meaning: that is an error, not an
    empty list."""
    needs = {"grant_status": ("option_group", "option_value"), "grant_type": ("option_group", "option_value")}.get(kind, (kind,))
    gone = [t for t in needs if t in src.absent]
    if gone:
        raise MissingTable(f"no {kind} ids are configured and the lookup {', '.join(gone)} is absent")
    if kind == "financial_type":
        df = src["financial_type"].select(F.col("id").cast("long").alias("id"))
    elif kind == "relationship_type":
        df = relationship_type_labels(src).select(F.col("id").cast("long").alias("id"))
    elif kind in ("grant_status", "grant_type"):
        v = option_lookup(src, kind)
        df = v.select(F.expr("try_cast(value AS double)").alias("v")).where(
            F.col("v").isNotNull() & (F.col("v") == F.floor("v"))
        ).select(F.col("v").cast("long").alias("id"))
    elif kind == "participant_status":
        df = src["participant_status"].select(F.col("id").cast("long").alias("id"))
    elif kind == "event_type":
        df = src["event_type"].select(F.col("id").cast("long").alias("id"))
    else:
        raise ValueError(kind)
    return df.where(F.col("id").isNotNull()).distinct()


@dataclass(frozen=True)
class IdFilter:
    """Membership test of one column in one configured id list."""

    ids: tuple[int, ...] | None
    kind: str

    def apply(self, df: DataFrame, src: Sources, column: str, flag: str) -> DataFrame:
        """``df`` plus boolean ``flag`` = ``column IN (ids)``.  With no explicit
        list the flag comes from a left join on the known ids (NULL and unknown
        ids give false)."""
        if self.ids is not None:
            return df.withColumn(flag, F.coalesce(F.col(column).isin(list(self.ids)), F.lit(False)))
        known = known_ids(src, self.kind).select(F.col("id").alias(f"_{flag}_id"))
        joined = df.join(known, F.col(column).cast("long") == F.col(f"_{flag}_id"), "left")
        return joined.withColumn(flag, F.col(f"_{flag}_id").isNotNull()).drop(f"_{flag}_id")

    def restrict(self, df: DataFrame, src: Sources, column: str) -> DataFrame:
        """Keep only rows whose ``column`` is in the list (pushed down when the
        list is explicit, semi-join otherwise)."""
        if self.ids is not None:
            return df.where(F.col(column).isin(list(self.ids)))
        known = known_ids(src, self.kind).select(F.col("id").alias("_known_id"))
        return df.join(known, F.col(column).cast("long") == F.col("_known_id"), "left_semi")

