"""Related-contact family R1-R6 and "plus me" P1-P6 (12 metrics, one plan).

For contact X: Σ donations of every contact joined to X by an active edge of a
listed type, either direction, completed and of a listed *related* financial
type, in the window.  Batch semantics: an edge counts once per row (parallel
edges count twice, a self-edge twice: once per direction), NULL when nothing
matches (AG3).  P = related + own, NULL only when both are NULL.

Plan (cost |edges| + |contributions|, never |edges| x |donations|):

1. ``donor_totals``: completed donations of a listed type (filters pushed to
   the scan) grouped by donor, one conditional sum per window (NULL when the
   donor has nothing in it).
2. ``symmetric_edges``: filtered edges, each emitting both directions, which
   replaces the reference's OR-join (that would plan as a nested-loop join).
3. ``edges ⋈ donor_totals`` on the other endpoint, grouped by ``src``: partial
   aggregation before the shuffle.  The donor side keeps its aggregation's
   partitioning, which AQE's skew-join split cannot work with, so the hottest
   partners (a hub contact) are salted
   (:func:`kinsum.functions.joins.hot_split_join`): the edges are read twice, once
   to count, and the donors are aggregated once.
4. left-joined onto the shared contribution rollup (the population, and the
   contact's own totals for the plus-me metrics); both sides are already
   partitioned by contact, so this join adds no exchange.

``related_population="edges"`` also gives a row to every contact with an active listed
edge who is not found in ``contribution`` (a non-donating spouse): step 3 then keeps
the edges without a donor and step 4 is a full join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsum.config import RollupConfig
from kinsum.functions import periods
from kinsum.functions.aggregates import halves, restrict, sum_halves_if, sum_if
from kinsum.functions.joins import hot_split_join, small_side
from kinsum.session import written
from kinsum.sources.crm import Sources
from kinsum.sources.lookups import IdFilter

WINDOW_NAMES = [
    "this_fiscal_year",
    "last_fiscal_year",
    "this_calendar_year",
    "last_calendar_year",
    "year_before_last_calendar_year",
    "alltime",
]
RELATED_KEYS = [f"relatedcontrib_{w}" for w in WINDOW_NAMES]
PLUSME_KEYS = [f"relatedcontrib_plusme_{w}" for w in WINDOW_NAMES]
KEYS = RELATED_KEYS + PLUSME_KEYS
# output type of the sums: wide enough that no total can overflow (ANSI mode
# would raise rather than wrap)
TOTAL = "decimal(38,2)"


def window_of(key: str) -> str:
    return key.removeprefix("relatedcontrib_").removeprefix("plusme_")


def donor_totals(src: Sources, cfg: RollupConfig, windows, donors: DataFrame | None = None) -> DataFrame:
    """``(donor, w_<window>...)``: per-window sums over completed donations of a
    listed related financial type; NULL where nothing falls in the window."""
    c = src["contribution"].where(F.col("contribution_status_id") == 1)
    c = IdFilter(cfg.related_financial_type_ids, "financial_type").restrict(c, src, "financial_type_id")
    c = restrict(c, "contact_id", donors)
    aggs = []
    for w in windows:
        p = periods.named(cfg, w)
        aggs.append(
            (F.sum("total_amount") if p.unbounded else sum_if(p.contains("receive_date"), F.col("total_amount"))).alias(
                f"w_{w}"
            )
        )
    return c.groupBy(F.col("contact_id").alias("donor")).agg(*aggs)


def active_edges(src: Sources, cfg: RollupConfig, relationship: DataFrame | None = None, *more: str) -> DataFrame:
    """``(a, b)`` (and ``more`` columns) of active edges of a listed type (FLT8, FLT2);
    edge dates are not consulted; NULL ``is_active`` drops the edge."""
    r = relationship if relationship is not None else src["relationship"]
    r = r.where(F.col("is_active"))
    r = IdFilter(cfg.relationship_type_ids, "relationship_type").restrict(r, src, "relationship_type_id")
    return r.select(F.col("contact_id_a").alias("a"), F.col("contact_id_b").alias("b"), *more)


def symmetric_edges(edges: DataFrame, *more: str) -> DataFrame:
    """SO1: both directions, duplicates kept: ``(src, dst)``.  Each edge row
    emits its two directed rows (``explode``), so the edge table is read once
    instead of once per UNION ALL leg; a self-edge yields (x, x) twice."""
    both = F.array(
        F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), *more),
        F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), *more),
    )
    return edges.select(F.inline(both))


def related_totals(
    src: Sources,
    cfg: RollupConfig,
    windows,
    donors: DataFrame | None = None,
    sym: DataFrame | None = None,
    hot_split: bool = True,
    how: str = "inner",
) -> DataFrame:
    """``(entity_id, r_<window>...)`` for every contact with at least one
    matched (edge, donor) pair; with ``how="left"`` for every contact with an edge."""
    donors = donors if donors is not None else donor_totals(src, cfg, windows)
    sym = sym if sym is not None else symmetric_edges(active_edges(src, cfg))
    # a donor's totals are made two longs each once, and added as such for every edge
    parts = [x.alias(f"{n}_{w}") for w in windows for n, x in zip(("_upper", "_lower"), halves(F.col(f"w_{w}")))]
    donors = donors.select("donor", *parts)
    if hot_split:
        # donors is partitioned by its own aggregation, so AQE cannot split a
        # hub's skewed join partition: salt the hottest partners explicitly
        j = hot_split_join(sym, donors, "dst", "donor", how)
    else:
        j = sym.join(donors, sym["dst"] == donors["donor"], how)
    sums = [sum_halves_if(F.lit(True), F.col(f"_upper_{w}"), F.col(f"_lower_{w}")).alias(f"r_{w}") for w in windows]
    return j.groupBy(F.col("src").alias("entity_id")).agg(*sums)


def build(
    src: Sources, cfg: RollupConfig, keys=None, contacts: DataFrame | None = None, extra_keys=(), soft_keys=(), one_pass=False
) -> DataFrame:
    """R/P keys (plus any contribution-family ``extra_keys``, computed by the
    same aggregation).  With ``contacts``, only their rows: edges are cut to
    those contacts first and only their neighbours' donations are summed.

    With ``one_pass`` (a whole refresh) the shared rollup, one row per contact, is written and
    read back as the donor totals and as the population, so the donations are not read for
    the donors; the result has the ``soft_keys`` and the population flags."""
    from kinsum.operators import contributions

    keys = list(keys or KEYS)
    windows = [w for w in WINDOW_NAMES if any(window_of(k) == w for k in keys)]
    sym = restrict(symmetric_edges(active_edges(src, cfg)), "src", contacts)
    needed = None  # donors whose totals are needed (all of them in batch)
    if contacts is not None:
        # the restricted contacts and their neighbours (whose totals they need)
        needed = small_side(sym.select(F.col("dst").alias("entity_id")).unionAll(contacts.select("entity_id")).distinct())
    # donor totals for the edge join come from their own aggregation over the
    # completed, listed donations only (those filters reach the scan); the
    # population and the "own" part come from the shared contribution rollup
    plus_me = any(k in PLUSME_KEYS for k in keys)
    base = contributions.rollup(src, cfg, list(extra_keys), windows if plus_me or one_pass else (), contacts, soft_keys)
    if one_pass:
        base = written(base, "rollup")
        totals = [f"w_{w}" for w in windows]
        donors = base.where(F.coalesce(*totals).isNotNull()).select(F.col("contact_id").alias("donor"), *totals)
    else:
        donors = donor_totals(src, cfg, windows, needed)
    # restricted to given contacts (an incremental batch), a partner's edge
    # rows number at most the batch's contacts times their parallel edges, so
    # the plain join is safe there and saves the hot-key pass
    hot_split = contacts is None
    by_edge = cfg.related_population == "edges"
    if by_edge:
        rel = related_totals(src, cfg, windows, donors, sym.where(F.col("src").isNotNull()), hot_split, "left")
    else:
        rel = related_totals(src, cfg, windows, donors, sym, hot_split)
    rel_p = rel
    if cfg.dedupe_donors and plus_me:
        # Q2 DISTINCT form for the plus-me metrics: one row per (contact, donor)
        rel_p = related_totals(src, cfg, windows, donors, sym.distinct(), hot_split)
        rel_p = rel_p.select("entity_id", *[F.col(f"r_{w}").alias(f"rp_{w}") for w in windows])
    out = base.join(rel, base["contact_id"] == rel["entity_id"], "full" if by_edge else "left")
    if by_edge:
        out = out.withColumn("contact_id", F.coalesce("contact_id", "entity_id"))
    inside = F.lit(True)
    if soft_keys:
        inside = F.col("_in_contributions")
        if by_edge:
            inside = F.when(inside | F.col("entity_id").isNotNull(), True)
    out = out.withColumn("_in_contributions", inside).drop("entity_id")
    if rel_p is not rel:
        out = out.join(rel_p, out["contact_id"] == rel_p["entity_id"], "left").drop("entity_id")
    cols = []
    for k in keys:
        w = window_of(k)
        r = F.col(f"r_{w}")
        if k in PLUSME_KEYS:
            if rel_p is not rel:
                r = F.col(f"rp_{w}")
            o = F.col(f"w_{w}")
            v = F.when(r.isNull() & o.isNull(), F.lit(None).cast(TOTAL)).otherwise(
                F.coalesce(r, F.lit(0)) + F.coalesce(o, F.lit(0))
            )
        else:
            v = r
        if cfg.related_empty == "zero":
            v = F.coalesce(v, F.lit(0))
        cols.append((F.when(F.col("_in_contributions"), v) if soft_keys else v).cast(TOTAL).alias(k))
    flags = ["_in_contributions", *(["_in_soft"] if soft_keys else [])] if one_pass else []
    return out.select(F.col("contact_id").alias("entity_id"), *list(extra_keys), *cols, *soft_keys, *flags)


def neighbours(src: Sources, cfg: RollupConfig) -> DataFrame:
    """AG7/JN6: distinct ``(entity_id, related_contact_id)`` over active listed
    edges in either direction."""
    sym = symmetric_edges(active_edges(src, cfg))
    return sym.select(F.col("src").alias("entity_id"), F.col("dst").alias("related_contact_id")).distinct()
