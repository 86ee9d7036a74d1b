"""Contribution family C1-C5.  Population: every contact with a row in
``contribution`` (unfiltered), so the filters sit inside the aggregates.  A NULL contact
is nobody: it is in no population, here and in the other families.

Plan: one conditional aggregation of the plain contribution rows and one of the C5 credit
rows (see :func:`_credit_rows`), both keyed on ``contact_id``: there are more credit rows than
donations, and they have a few of the sums only.  In a fused refresh the latter
serves the soft-credit family too (:func:`fused`).  Each shuffles by contact, and their union
keeps that partitioning, so one row per contact is made of both without another
shuffle; when the distinct-year count (C4) is requested Spark first merges
partial results by (contact, year), a second shuffle of already-combined
rows.  That is preferred to ``size(collect_set(year))``, whose object-hash
aggregate falls back to sorting the raw rows once a task sees many contacts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsum.config import RollupConfig
from kinsum.functions import periods
from kinsum.functions.aggregates import MONEY, halves, restrict, sum_halves_if
from kinsum.functions.joins import small_side
from kinsum.operators import soft
from kinsum.sources.crm import Sources
from kinsum.sources.lookups import IdFilter

#: Key -> window of its total, as a function of the configuration.
WINDOWS = {
    "contribution_total_this_calendar_year": lambda cfg: periods.calendar_year(cfg, 0),
    "contribution_total_last_calendar_year": lambda cfg: periods.calendar_year(cfg, 1),
    "contribution_total_calendar_year_before_last": lambda cfg: periods.calendar_year(cfg, 2),
    "contribution_total_this_year": lambda cfg: periods.fiscal_year(cfg, 0),
    "contribution_total_last_year": lambda cfg: periods.fiscal_year(cfg, 1),
    "contribution_total_year_before_last": lambda cfg: periods.fiscal_year(cfg, 2),
}
KEYS = [*WINDOWS, "contribution_count_distinct_years", "hard_and_soft"]


def completed_in_list(src: Sources, cfg: RollupConfig, ids, flag: str = "_ok", c: DataFrame | None = None) -> DataFrame:
    """contribution + ``flag`` = completed (FLT1) and financial type listed (FLT2)."""
    c = src["contribution"] if c is None else c
    c = IdFilter(ids, "financial_type").apply(c, src, "financial_type_id", "_type_ok")
    return c.withColumn(flag, (F.col("contribution_status_id") == 1) & F.col("_type_ok")).drop("_type_ok")


def rollup(src: Sources, cfg: RollupConfig, keys, related_windows=(), contacts=None, soft_keys=()) -> DataFrame:
    """One aggregation over contribution (and one over the C5 fan-out rows) grouped by
    contact: ``contact_id``, the requested C keys and, for the related family,
    ``w_<window>`` = Σ completed donations of a listed *related* financial type
    in the window (NULL when none).  Every contact in ``contribution`` gets a
    row (the batch population of both families).

    With ``soft_keys`` (S keys) also every contact with a soft credit: each family's
    keys are NULL outside its population, which ``_in_contributions`` and ``_in_soft``
    (true or NULL) tell."""
    c = completed_in_list(src, cfg, cfg.financial_type_ids)
    if related_windows:
        c = completed_in_list(src, cfg, cfg.related_financial_type_ids, "_rok", c)
    else:
        c = c.withColumn("_rok", F.lit(False))
    # money is two longs from here on
    upper, lower = halves(F.col("total_amount"))
    own = c.withColumns({"_upper": upper, "_lower": lower}).select(
        F.col("contact_id"),
        F.col("_ok"),
        F.col("_rok"),
        F.col("_upper"),
        F.col("_lower"),
        F.col("receive_date"),
        *[F.when(F.col("_ok"), F.col(x)).alias(f"_hs{x}") for x in ("_upper", "_lower")],
    )
    soft_windows = {k: w for k, w in soft.windows(cfg).items() if k in soft_keys}
    none = F.lit(0).cast(MONEY)

    def by_contact(rows, aggs):
        return restrict(rows, "contact_id", contacts).where("contact_id is not null").groupBy("contact_id").agg(*aggs)

    def total(cond):
        return sum_halves_if(cond, F.col("_upper"), F.col("_lower"))

    ok = F.col("_ok")
    hard_and_soft = sum_halves_if(F.lit(True), F.col("_hs_upper"), F.col("_hs_lower")).alias("hard_and_soft")
    aggs = [F.lit(True).alias("_in_contributions")]
    for k in keys:
        if k in WINDOWS:
            p = WINDOWS[k](cfg)
            aggs.append(F.coalesce(total(ok & p.contains("receive_date")), none).alias(k))
        elif k == "contribution_count_distinct_years":
            aggs.append(F.count_distinct(F.when(ok, F.year(F.to_date("receive_date")))).alias(k))
        elif k == "hard_and_soft":
            aggs.append(hard_and_soft)
        else:
            raise KeyError(k)
    for w in related_windows:
        aggs.append(total(F.col("_rok") & periods.named(cfg, w).contains("receive_date")).alias(f"w_{w}"))
    out = by_contact(own, aggs)
    if "hard_and_soft" in keys or soft_windows:
        aggs = [F.coalesce(total(F.col("_soft") & w.contains("receive_date")), none).cast(soft.TOTAL).alias(k) for k, w in soft_windows.items()]
        if soft_windows:
            aggs.append(F.max(F.when(F.col("_soft"), True)).alias("_in_soft"))
        if "hard_and_soft" in keys:
            aggs.append(hard_and_soft)
        credits = by_contact(_credit_rows(src, c, contacts, bool(soft_windows)), aggs)
        none_of = lambda df, k: F.lit(None).cast(df.schema[k].dataType)
        left = out.select("*", *[none_of(credits, k).alias(k) for k in credits.columns if k not in out.columns])
        both = left.unionAll(credits.select([k if k in credits.columns else none_of(left, k).alias(f"_no_{i}") for i, k in enumerate(left.columns)]))
        # each side has one row per contact, and only the credits are in both
        one = lambda k: F.coalesce(F.sum(k).cast("decimal(38,2)"), none) if k == "hard_and_soft" else F.max(k)
        out = both.groupBy("contact_id").agg(*[one(k).alias(k) for k in both.columns if k != "contact_id"])
    if not soft_windows:
        return out.where("_in_contributions").drop("_in_contributions")
    outside = {k: F.when(F.col("_in_contributions"), F.col(k)) for k in keys}
    outside |= {k: F.when(F.col("_in_soft"), F.col(k)) for k in soft_windows}
    return out.withColumns(outside).where("_in_contributions or _in_soft")


def fused(src: Sources, cfg: RollupConfig, keys, soft_keys) -> DataFrame:
    """C, R, P and S keys of a whole refresh from two reads of contribution: one for the rows
    by contact, one for the donations that soft credits point at.  ``entity_id``, the keys
    and the population flags ``_in_contributions`` and ``_in_soft``."""
    from kinsum.operators import related

    ckeys = [k for k in keys if k in KEYS]
    rkeys = [k for k in keys if k in related.KEYS]
    if rkeys:
        return related.build(src, cfg, rkeys, extra_keys=ckeys, soft_keys=list(soft_keys), one_pass=True)
    return rollup(src, cfg, ckeys, soft_keys=list(soft_keys)).withColumnRenamed("contact_id", "entity_id")


def build(src: Sources, cfg: RollupConfig, keys=None, contacts=None) -> DataFrame:
    """C keys; R/P keys given here are computed from the same aggregation."""
    from kinsum.operators import related

    keys = list(keys or KEYS)
    ckeys = [k for k in keys if k in KEYS]
    rkeys = [k for k in keys if k in related.KEYS]
    if rkeys:
        return related.build(src, cfg, rkeys, contacts, extra_keys=ckeys).select("entity_id", *keys)
    return rollup(src, cfg, ckeys, (), contacts).select(F.col("contact_id").alias("entity_id"), *ckeys)


def _credit_rows(src: Sources, c: DataFrame, contacts: DataFrame | None = None, soft_totals: bool = False) -> DataFrame:
    """C5 credits beyond the donor's plain total, and the soft totals.

    C5 sums total_amount over rows of ``contribution ⟕ soft`` (fan-out kept)
    where the contact is the donor or the soft-credited contact; a row where
    the contact is both counts once.  With n = soft rows of a donation and m =
    its soft rows for contact k:

    * the donor is credited total x max(n, 1) = total (carried by the plain
      contribution rows, no join) + total x (n - 1) when n >= 1;
    * each soft contact k other than the donor is credited total x m.

    Each soft row is tagged twice, for its contact and for the whole donation, and counted
    per (donation, contact) before the one join with the completed donations on the
    donation id: the donations are read once for both credits and for the soft totals
    (``soft_totals``: a soft contact's row carries its amount and the donation's date), and no
    donation's fan-out is materialised.
    Without soft totals the join only needs donations that have soft credits (a
    selective side for Spark's runtime bloom filter)."""
    upper, lower = halves(F.col("total_amount"))
    ok = c.where("_ok").select("id", "contact_id", upper.alias("_total_upper"), lower.alias("_total_lower"), "receive_date")
    soft_rows = src["contribution_soft"]
    if contacts is not None:
        # incremental: the donations of the contacts and the donations that
        # soft-credit them - all their soft rows (for n), and only them
        ids = (
            restrict(ok, "contact_id", contacts).select(F.col("id").alias("_k"))
            .unionAll(restrict(soft_rows, "contact_id", contacts).select(F.col("contribution_id").alias("_k")))
            .distinct()
        )
        ids = small_side(ids)
        soft_rows = soft_rows.join(ids, soft_rows["contribution_id"] == ids["_k"], "left_semi")
        ok = ok.join(ids, ok["id"] == ids["_k"], "left_semi")
    none = F.lit(None).cast("long")
    amount = halves(F.col("amount")) if soft_totals else (none, none)
    each = F.struct(F.col("contact_id").alias("_sc"), F.lit(False).alias("_all"), amount[0].alias("_upper"), amount[1].alias("_lower"))
    whole = F.struct(none.alias("_sc"), F.lit(True).alias("_all"), none.alias("_upper"), none.alias("_lower"))
    tagged = soft_rows.withColumn("_tags", F.array(each, whole)).select(F.col("contribution_id").alias("_cid"), F.inline("_tags"))
    sums = [F.sum(x).alias(x) for x in ("_upper", "_lower")]
    counted = tagged.groupBy("_cid", "_sc", "_all").agg(F.count(F.lit(1)).alias("_m"), *sums)
    credited = counted.join(ok, counted["_cid"] == ok["id"], "left" if soft_totals else "inner")
    # a donation without donor credits all its soft contacts
    times = F.when(F.col("_all"), F.col("_m") - 1).when(~F.col("_sc").eqNullSafe(F.col("contact_id")), F.col("_m"))
    return credited.select(
        F.when(F.col("_all"), F.col("contact_id")).otherwise(F.col("_sc")).alias("contact_id"),
        F.col("_upper"),
        F.col("_lower"),
        (F.col("receive_date") if soft_totals else F.lit(None).cast("timestamp_ntz")).alias("receive_date"),
        *[(F.col(f"_total{x}") * times).alias(f"_hs{x}") for x in ("_upper", "_lower")],
        (~F.col("_all")).alias("_soft"),
    )
