"""Grant family G1-G3.  Population: every contact in ``grant``; a grant
matches when its status and its type are both listed.

* G1 count of matching grants (0 if none)
* G2 Σ amount_granted of matching grants (0 if none)
* G3 distinct labels of the matching grants' types, sorted, ", "-joined, from
  the ``grant_type`` option group; the option value is text and is compared
  numerically with the integer type id.  NULL when no label.

Plan: grants are first counted and summed by (contact, status, type), a hash aggregate
with partial aggregation; only those few rows meet the lookups (so no raw grant is
shuffled on a status or type, of which there are a handful) and are combined per
contact.  The option lookup has one row per type id with its sorted label array, so
duplicate option rows cannot fan out the counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsum.config import RollupConfig
from kinsum.functions.aggregates import restrict, sum_or_zero
from kinsum.sources.crm import Sources
from kinsum.sources.lookups import IdFilter, option_lookup

KEYS = ["grant_count_received", "grant_total_received", "grant_types_received"]


def type_labels(src: Sources) -> DataFrame:
    """``(_type_num double, _labels array<string>)`` for the grant_type group."""
    ov = option_lookup(src, "grant_type")
    return (
        ov.select(F.expr("try_cast(value AS double)").alias("_type_num"), "label")
        .where(F.col("_type_num").isNotNull() & F.col("label").isNotNull())
        .groupBy("_type_num")
        .agg(F.array_sort(F.collect_set("label")).alias("_labels"))
    )


def _nocase_distinct(labels):
    """Sorted ignoring case (ties in binary order), then one spelling per
    case-insensitive label: the first, i.e. the smallest in binary order."""
    def cmp(a, b):
        la, lb = F.lower(a), F.lower(b)
        return (F.when(la < lb, -1).when(la > lb, 1).when(a < b, -1).when(a > b, 1).otherwise(0))

    s = F.array_sort(labels, cmp)
    return F.filter(s, lambda x, i: (i == 0) | (F.lower(x) != F.lower(F.element_at(s, i))))


def build(src: Sources, cfg: RollupConfig, keys=None, contacts=None) -> DataFrame:
    keys = list(keys or KEYS)
    g = restrict(src["grant"], "contact_id", contacts).where("contact_id is not null")
    g = g.groupBy("contact_id", "status_id", "grant_type_id").agg(F.count(F.lit(1)).alias("_n"), F.sum("amount_granted").alias("_amount"))
    g = IdFilter(cfg.grant_status_ids, "grant_status").apply(g, src, "status_id", "_st_ok")
    g = IdFilter(cfg.grant_type_ids, "grant_type").apply(g, src, "grant_type_id", "_ty_ok")
    ok = F.col("_st_ok") & F.col("_ty_ok")
    if "grant_types_received" in keys:
        lab = type_labels(src)
        g = g.join(lab, g["grant_type_id"].cast("double") == lab["_type_num"], "left")
    aggs = []
    for k in keys:
        if k == "grant_count_received":
            aggs.append(F.coalesce(F.sum(F.when(ok, F.col("_n"))), F.lit(0)).cast("long").alias(k))
        elif k == "grant_total_received":
            aggs.append(sum_or_zero(ok, F.col("_amount")).alias(k))
        elif k == "grant_types_received":
            s = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(ok, F.col("_labels"))))))
            if cfg.label_order == "nocase":
                s = _nocase_distinct(s)
            aggs.append(F.when(F.size(s) > 0, F.array_join(s, ", ")).alias(k))
        else:
            raise KeyError(k)
    return g.groupBy(F.col("contact_id").alias("entity_id")).agg(*aggs)
