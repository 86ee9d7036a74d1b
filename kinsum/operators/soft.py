"""Soft-credit family S1-S3 (and the total of this fiscal year).  Σ soft.amount whose parent donation is completed,
of a listed own financial type and received in the window (``IN (SELECT id
...)``).  Population: every contact with a soft-credit row; 0 when nothing
matches.

Plan: the filtered parent donations are projected to ``id`` plus one boolean
per window (status/type filters and the window bounds reach the scan), then
left-joined to the soft rows on the unique ``id`` and summed per contact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsum.config import RollupConfig
from kinsum.functions import periods
from kinsum.functions.aggregates import restrict, sum_or_zero
from kinsum.functions.joins import small_side
from kinsum.sources.crm import Sources
from kinsum.sources.lookups import IdFilter

# type of the totals, here and in the fused refresh
TOTAL = "decimal(30,2)"
KEYS = ["soft_total_this_calendar_year", "soft_total_last_calendar_year", "soft_total_last_fiscal_year", "soft_total_this_year"]


def windows(cfg: RollupConfig) -> dict:
    return {
        "soft_total_this_calendar_year": periods.calendar_year(cfg, 0),
        "soft_total_last_calendar_year": periods.calendar_year(cfg, 1),
        "soft_total_last_fiscal_year": periods.fiscal_year(cfg, 1),
        "soft_total_this_year": periods.fiscal_year(cfg, 0),
    }


def build(src: Sources, cfg: RollupConfig, keys=None, contacts=None) -> DataFrame:
    keys = list(keys or KEYS)
    win = windows(cfg)
    c = src["contribution"].where(F.col("contribution_status_id") == 1)
    c = IdFilter(cfg.financial_type_ids, "financial_type").restrict(c, src, "financial_type_id")
    any_window = None
    for k in keys:
        w = win[k].contains("receive_date")
        any_window = w if any_window is None else any_window | w
    parents = c.where(any_window).select(
        F.col("id").alias("_pid"), *[win[k].contains("receive_date").alias(f"_in_{i}") for i, k in enumerate(keys)]
    )
    soft = restrict(src["contribution_soft"], "contact_id", contacts)
    if contacts is not None:
        # incremental: only the parents the restricted soft rows point at
        ids = small_side(soft.select(F.col("contribution_id").alias("_sid")).distinct())
        parents = parents.join(ids, parents["_pid"] == ids["_sid"], "left_semi")
    j = soft.join(parents, soft["contribution_id"] == parents["_pid"], "left")
    aggs = [sum_or_zero(F.coalesce(F.col(f"_in_{i}"), F.lit(False)), F.col("amount")).alias(k) for i, k in enumerate(keys)]
    return j.where("contact_id is not null").groupBy(F.col("contact_id").alias("entity_id")).agg(*aggs)
