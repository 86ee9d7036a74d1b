"""E1 ``event_first_attended_date``: earliest ``start_date`` of an event the
contact attended with a listed participant status and a listed event type.
``ORDER BY start_date ASC LIMIT 1`` puts NULL first (MySQL), so a matching event
without a date yields NULL.  Population: every contact in ``participant``.

Plan: participants left-joined to the type-filtered events (the type filter
reaches the event scan; the join is left so unmatched participants stay in the
population), then min + "any NULL" per contact.  No per-contact sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsum.config import RollupConfig
from kinsum.functions.aggregates import restrict
from kinsum.functions.joins import small_side
from kinsum.sources.crm import Sources
from kinsum.sources.lookups import IdFilter

KEYS = ["event_first_attended_date"]


def build(src: Sources, cfg: RollupConfig, keys=None, contacts=None) -> DataFrame:
    p = IdFilter(cfg.participant_status_ids, "participant_status").apply(
        restrict(src["participant"], "contact_id", contacts), src, "status_id", "_status_ok"
    )
    e = IdFilter(cfg.event_type_ids, "event_type").restrict(src["event"], src, "event_type_id")
    e = e.select(F.col("id").alias("_eid"), F.col("start_date"))
    if contacts is not None:
        # incremental: only the events the restricted participants attended
        ids = small_side(p.select(F.col("event_id").alias("_pe")).distinct())
        e = e.join(ids, e["_eid"] == ids["_pe"], "left_semi")
    j = p.join(e, (p["event_id"] == e["_eid"]) & p["_status_ok"], "left")
    matched = F.col("_eid").isNotNull()
    return j.where("contact_id is not null").groupBy(F.col("contact_id").alias("entity_id")).agg(
        F.when(
            F.max((matched & F.col("start_date").isNull()).cast("int")) == 1, F.lit(None).cast("timestamp_ntz")
        )
        .otherwise(F.min(F.when(matched, F.col("start_date"))))
        .alias("event_first_attended_date")
    )
