"""Registered non-metric queries over the testdata views: lookups (SRC2,
SRC3), the contact graph (AG7/JN6), affected-contact derivation (I1-I7), the
incremental path end to end (I8-I10), upsert (SNK1) and contracts (K1-K5).

Change feeds are derived from the tables themselves: donations received from
the start of the current fiscal year are the "new" rows of an incremental run,
inactive edges are edges that were just deactivated, link opens are new mail
events.  Every query runs over the whole tables.
"""

from __future__ import annotations

import datetime as dt
import os
import uuid

from pyspark.sql import functions as F

from kinsum.functions.joins import release_small_sides
from kinsum.functions.periods import fiscal_year_bounds
from kinsum.operators import contracts as K
from kinsum.operators import contributions, related, soft
from kinsum.operators.related import neighbours
from kinsum.plans.affected import affected
from kinsum.plans.refresh import public, refresh, wide
from kinsum.plans.registry import Registry, RollupSpec, default_registry, sql_family
from kinsum.plans import deltas, partials
from kinsum.plans.store import Store
from kinsum.plans.upsert import upsert
from kinsum.session import checkpoint_dir, configure, drop_parquet, store_parquet
from kinsum.sources.lookups import option_lookup, relationship_type_labels
from kinsum.sources.testdata import AFTER_YEAR_ENDS, BEFORE_YEAR_ENDS, BETWEEN_YEAR_ENDS, MAIL_CONFIG, OTHER_DATE, TESTDATA_CONFIG, crm_sources
from kinsum.streaming import incremental as inc

CFG = TESTDATA_CONFIG
# the incremental split: donations from the start of the current fiscal year are new
SPLIT = fiscal_year_bounds(CFG, 0)[0]


def _src(spark, sf_dir):
    configure(spark)
    release_small_sides()  # key sets kept for a previous query's result
    return crm_sources(spark, sf_dir)


def _new_donations(src):
    return src["contribution"].where(F.col("receive_date") >= F.lit(dt.datetime.combine(SPLIT, dt.time())).cast("timestamp_ntz"))


def q_relationship_type_labels(spark, sf_dir):
    return relationship_type_labels(_src(spark, sf_dir))


def q_option_lookup(spark, sf_dir):
    return option_lookup(_src(spark, sf_dir), "grant_type")


def q_neighbours(spark, sf_dir):
    return neighbours(_src(spark, sf_dir), CFG)


def q_affected_by_contribution(spark, sf_dir):
    src = _src(spark, sf_dir)
    return affected(src, CFG, "contribution", inc.inserts(_new_donations(src)))


def q_affected_by_relationship(spark, sf_dir):
    src = _src(spark, sf_dir)
    inactive = src["relationship"].where(~F.col("is_active"))
    # each inactive edge arrives as the update that deactivated it
    before = inactive.withColumn("is_active", F.lit(True))
    return affected(src, CFG, "relationship", inc.updates(before, {"is_active": F.lit(False)}))


def q_affected_by_mail_event(spark, sf_dir):
    src = _src(spark, sf_dir)
    return affected(src, MAIL_CONFIG, "mailing_url_open", inc.inserts(src["mailing_url_open"]))


def q_incremental_equals_batch(spark, sf_dir):
    """Batch over the base before the new donations, then the incremental
    refresh for the inserts; must equal the batch over the whole base."""
    src1 = _src(spark, sf_dir)
    new = _new_donations(src1)
    old_rows = src1["contribution"].join(new.select("id"), "id", "left_anti")
    src0 = src1.replace(contribution=old_rows)
    stored, _ = refresh(src0, CFG, membership=True)
    return public(inc.refresh_affected(stored, src1, CFG, "contribution", inc.inserts(new)))


def q_incremental_relationship_equals_batch(spark, sf_dir):
    """I3/I4 end to end: the base before the inactive edges were deactivated
    (they were active), the deactivating updates as the change feed, then the
    incremental refresh; must equal the batch over the whole base."""
    src1 = _src(spark, sf_dir)
    rel1 = src1["relationship"]
    rel0 = rel1.select(
        "contact_id_a", "contact_id_b", "relationship_type_id",
        F.when(F.col("is_active") == F.lit(False), F.lit(True)).otherwise(F.col("is_active")).alias("is_active"),
    )
    src0 = src1.replace(relationship=rel0)
    stored, _ = refresh(src0, CFG, membership=True)
    before = rel1.where(~F.col("is_active")).withColumn("is_active", F.lit(True))
    changes = inc.updates(before, {"is_active": F.lit(False)})
    return public(inc.refresh_affected(stored, src1, CFG, "relationship", changes))


def q_incremental_mail_equals_batch(spark, sf_dir):
    """I5-I7 end to end: the base without any link opens, then every link
    open arrives as an insert; must equal the batch over the whole base."""
    src1 = _src(spark, sf_dir)
    opens = src1["mailing_url_open"]
    src0 = src1.replace(mailing_url_open=src1.empty("mailing_url_open"))  # before any link was opened
    stored, _ = refresh(src0, MAIL_CONFIG, membership=True)
    return public(inc.refresh_affected(stored, src1, MAIL_CONFIG, "mailing_url_open", inc.inserts(opens)))


def q_incremental_delete_equals_batch(spark, sf_dir):
    """I10: the base also held a second donation of half the amount for every donation
    that does not count; all of them are deleted, which only their old images tell."""
    src1 = _src(spark, sf_dir)
    gifts = src1["contribution"]
    extra = gifts.where("contribution_status_id <> 1").select(
        (-F.col("id") - 1).alias("id"), "contact_id", (F.col("total_amount") / 2).cast("decimal(20,2)").alias("total_amount"), "receive_date",
        F.lit(1).alias("contribution_status_id"), "financial_type_id",
    )
    stored, _ = refresh(src1.replace(contribution=gifts.unionAll(extra)), CFG, membership=True)
    return public(inc.refresh_affected(stored, src1, CFG, "contribution", inc.deletes(extra)))


def q_incremental_moved_equals_batch(spark, sf_dir):
    """Q3: the donations of the current fiscal year stood with another contact and are
    moved to their own; both contacts change."""
    src1 = _src(spark, sf_dir)
    moved = _new_donations(src1)
    before = moved.withColumn("contact_id", F.col("contact_id") + 1)
    rest = src1["contribution"].join(moved.select("id"), "id", "left_anti").select(before.columns)
    stored, _ = refresh(src1.replace(contribution=rest.unionAll(before)), CFG, membership=True)
    return public(inc.refresh_affected(stored, src1, CFG, "contribution", inc.updates(before, {"contact_id": F.col("contact_id") - 1})))


VISITS = "user_visits"


def q_user_metric_incremental(spark, sf_dir):
    """X1/X2: a metric declared as SQL over a user's own table (visits per contact up to
    the date), with its own change rule, kept fresh for the visits that arrive."""
    src1 = _src(spark, sf_dir)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    visits = events.select(F.col("user_id").cast("long").alias("visitor"), F.col("ts").alias("at"), F.col("event_type").alias("kind"))
    reg = Registry(families={"visits": sql_family(
        f"SELECT visitor AS entity_id, count(*) AS visit_count FROM {{{VISITS}}} WHERE CAST(at AS DATE) <= :as_of GROUP BY visitor", (VISITS,))})
    rule = lambda src, ch: ch.select(F.explode(F.array("old.visitor", "new.visitor")).alias("entity_id"))
    reg.register(RollupSpec("visit_count", "Visits", "Visits", "Int", "visits", {VISITS: rule}))
    new = visits.where("kind = 'click'")
    before = src1.replace(**{VISITS: visits.where("kind <> 'click'")})
    stored, _ = refresh(before, MAIL_CONFIG, reg, membership=True)
    return public(inc.refresh_affected(stored, src1.replace(**{VISITS: visits}), MAIL_CONFIG, VISITS, inc.inserts(new), reg))


UPSERT_KEYS = ["contribution_total_this_calendar_year", "relatedcontrib_alltime", "mail_openrate_last12months"]
UPSERT_REL_CFG = CFG.with_(relationship_type_ids=(5, 6, 7))


def q_upsert_patch(spark, sf_dir):
    """SNK1 twice: a related total under other edge types (NULL patches
    overwrite), then the 12-month open rate at a later date (contacts outside
    the new window keep the old value, Q5)."""
    src = _src(spark, sf_dir)
    old, _ = refresh(src, CFG, keys=UPSERT_KEYS)
    from kinsum.operators import mailings, related

    p1 = related.build(src, UPSERT_REL_CFG, ["relatedcontrib_alltime"])
    p2 = mailings.build(src, MAIL_CONFIG, ["mail_openrate_last12months"])
    return upsert(upsert(old, p1), p2)


# --- contracts over the raw tables -----------------------------------------
LINEITEM_CONTRACT = K.TableContract(
    "lineitem",
    (
        K.ColumnSpec("l_orderkey", "bigint", required=True),
        K.ColumnSpec("l_linenumber", "int", required=True),
        K.ColumnSpec("l_returnflag", "char(1)", required=True, default="N"),
        K.ColumnSpec("l_linestatus", "char(1)", required=True, default="O"),
        K.ColumnSpec("l_extendedprice", "decimal(7,2)", required=True),
        K.ColumnSpec("l_quantity", "decimal(4,1)"),
    ),
    primary_key=("l_orderkey", "l_linenumber"),
    foreign_keys=(("l_partkey", "customer", "c_custkey"), ("l_orderkey", "orders", "o_orderkey")),
)


def _lineitem_with_gaps(spark, sf_dir):
    """lineitem with NULLs derived by ``nullif`` (the tables have none)."""
    li = spark.read.parquet(os.path.join(sf_dir, "lineitem.parquet"))
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice",
        F.nullif(F.col("l_returnflag"), F.lit("A")).alias("l_returnflag"),
        F.nullif(F.col("l_linestatus"), F.lit("F")).alias("l_linestatus"),
    )


def q_contract_not_null(spark, sf_dir):
    configure(spark)
    return K.not_null_violations(_lineitem_with_gaps(spark, sf_dir), LINEITEM_CONTRACT)


def q_contract_defaults(spark, sf_dir):
    configure(spark)
    df = _lineitem_with_gaps(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return K.apply_defaults(df, LINEITEM_CONTRACT)


def q_contract_unique(spark, sf_dir):
    configure(spark)
    li = spark.read.parquet(os.path.join(sf_dir, "lineitem.parquet"))
    return K.unique_violations(li, LINEITEM_CONTRACT.primary_key)


def q_contract_fk(spark, sf_dir):
    configure(spark)
    li = spark.read.parquet(os.path.join(sf_dir, "lineitem.parquet"))
    cu = spark.read.parquet(os.path.join(sf_dir, "customer.parquet"))
    return K.fk_violations(li, "l_partkey", cu, "c_custkey")


def q_contract_types(spark, sf_dir):
    configure(spark)
    li = spark.read.parquet(os.path.join(sf_dir, "lineitem.parquet"))
    _, fails = K.conform(li, LINEITEM_CONTRACT)
    return fails


def q_contract_quarantine(spark, sf_dir):
    """K1-K5 in the pass that writes lineitem: the rows it puts in quarantine, with what they fail."""
    configure(spark)
    li = _lineitem_with_gaps(spark, sf_dir)
    parents = {t: spark.read.parquet(os.path.join(sf_dir, f"{t}.parquet")) for t in ("customer", "orders")}
    path = f"{checkpoint_dir(spark).rstrip('/')}/kinsum-contract-{uuid.uuid4().hex}"
    K.write_checked(li, LINEITEM_CONTRACT, path, parents)
    return K.quarantined_rows(spark, path).select("l_orderkey", "l_linenumber", "l_returnflag", F.array_join("_errors", ";").alias("errors"))


def q_population_all(spark, sf_dir):
    """POP1: one metric over the union of every metric's population."""
    from kinsum.plans.refresh import metric

    return metric(_src(spark, sf_dir), CFG, "grant_types_received", population="all")


def q_plusme_distinct_donors(spark, sf_dir):
    """SO3 / Q2: plus-me all-time with each (contact, donor) pair counted once."""
    from kinsum.operators import related

    return related.build(_src(spark, sf_dir), CFG.with_(dedupe_donors=True), ["relatedcontrib_plusme_alltime"])


def q_related_empty_zero(spark, sf_dir):
    """Q1: the related totals in the reference's incremental form (0, not
    NULL, when nothing matches)."""
    from kinsum.operators import related

    return related.build(_src(spark, sf_dir), CFG.with_(related_empty="zero"), ["relatedcontrib_this_fiscal_year"])


EDGE_KEYS = ["relatedcontrib_alltime", "relatedcontrib_plusme_this_calendar_year", "relatedcontrib_plusme_alltime"]


def q_related_population_edges(spark, sf_dir):
    """Related totals of everyone with an active edge or a donation."""
    from kinsum.operators import related

    return related.build(_src(spark, sf_dir), CFG.with_(related_population="edges"), EDGE_KEYS)


def q_incremental_edge_population(spark, sf_dir):
    """The edge population kept fresh: the base before the inactive edges were deactivated,
    then those updates; contacts whose only edges they were leave the table."""
    cfg = CFG.with_(related_population="edges")
    src1 = _src(spark, sf_dir)
    rel1 = src1["relationship"]
    before = rel1.where(~F.col("is_active")).withColumn("is_active", F.lit(True)).select(rel1.columns)
    src0 = src1.replace(relationship=rel1.where("is_active is distinct from false").unionAll(before))
    stored, _ = refresh(src0, cfg, keys=EDGE_KEYS, membership=True)
    return public(inc.refresh_affected(stored, src1, cfg, "relationship", inc.updates(before, {"is_active": F.lit(False)})))


def q_mail_clickrate_distinct_links(spark, sf_dir):
    """M3 option: emails instead of link-multiplied rows."""
    from kinsum.operators import mailings

    return mailings.build(_src(spark, sf_dir), MAIL_CONFIG.with_(distinct_links=True), ["mail_clickrate_alltime"])


def q_hard_and_soft_anonymous(spark, sf_dir):
    """C5 where the donations of one type have no donor: they credit their soft contacts only."""
    src = _src(spark, sf_dir)
    gifts = src["contribution"]
    gifts = gifts.withColumn("contact_id", F.when(F.col("financial_type_id") != 3, F.col("contact_id"))).select(gifts.columns)
    return contributions.build(src.replace(contribution=gifts), CFG, ["hard_and_soft"])


def _keeper(spark):
    """Stores tables in a new folder of the shared ones, so that what is built from them starts there."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/kinsum-state-{uuid.uuid4().hex}"

    def keep(name, df):
        store_parquet(df.write, spark, keep.at(name))
        return spark.read.schema(df.schema).parquet(keep.at(name))

    keep.at = lambda name: f"{path}/{name}"
    return keep


def q_totals_of_another_date(spark, sf_dir):
    """C and S keys of a date long before the one that the partials were built with."""
    src = _src(spark, sf_dir)
    keys = [k for k in default_registry().keys() if k in contributions.KEYS or k in soft.KEYS]
    frames = partials.values(partials.initial(src, CFG, _keeper(spark)), CFG.with_(as_of=OTHER_DATE), keys)
    return wide(list(frames.values()), keys)


def _mixed_changes(src1):
    """Base tables before, and the changes that lead to ``src1``: donations of the fiscal year are
    inserted, those of the year before move to their contact from the next one, a
    second donation of half the amount goes for each that does not count; edges are deactivated;
    soft credits of the inserted donations are new, and each other one lost a second one of its donation."""
    gifts, soft_rows, edges = src1["contribution"], src1["contribution_soft"], src1["relationship"]
    new = _new_donations(src1)
    begin, end = (dt.datetime.combine(x, dt.time()) for x in (fiscal_year_bounds(CFG, 1)[0], SPLIT))
    in_year = (F.col("receive_date") >= F.lit(begin).cast("timestamp_ntz")) & (F.col("receive_date") < F.lit(end).cast("timestamp_ntz"))
    moved = gifts.where(in_year).withColumn("contact_id", F.col("contact_id") + 1).select(gifts.columns)
    gone = gifts.where("contribution_status_id <> 1").select(
        (-F.col("id") - 1).alias("id"), "contact_id", (F.col("total_amount") / 2).cast("decimal(20,2)").alias("total_amount"), "receive_date",
        F.lit(1).alias("contribution_status_id"), "financial_type_id",
    )
    old_rows = gifts.where(~in_year).join(new.select("id"), "id", "left_anti").select(gifts.columns)
    new_soft = soft_rows.join(new.select(F.col("id").alias("contribution_id")), "contribution_id", "left_semi").select(soft_rows.columns)
    old_soft = soft_rows.join(new.select(F.col("id").alias("contribution_id")), "contribution_id", "left_anti").select(soft_rows.columns)
    gone_soft = old_soft.withColumn("contact_id", F.col("contact_id") + 3).select(soft_rows.columns)
    live = edges.where(~F.col("is_active")).withColumn("is_active", F.lit(True)).select(edges.columns)
    src0 = src1.replace(
        contribution=old_rows.unionAll(moved).unionAll(gone), contribution_soft=old_soft.unionAll(gone_soft),
        relationship=edges.where("is_active is distinct from false").unionAll(live),
    )
    changes = {
        "contribution": inc.inserts(new).unionAll(inc.updates(moved, {"contact_id": F.col("contact_id") - 1})).unionAll(inc.deletes(gone)),
        "contribution_soft": inc.inserts(new_soft).unionAll(inc.deletes(gone_soft)),
        "relationship": inc.updates(live, {"is_active": F.lit(False)}),
    }
    return src0, changes


def q_signed_delta_equals_batch(spark, sf_dir):
    """I1-I4, I10: the state before mixed changes of three tables plus their signed change gives
    what a batch over the tables after them gives."""
    src1 = _src(spark, sf_dir)
    src0, changes = _mixed_changes(src1)
    kept = _keeper(spark)
    state = partials.initial(src0, CFG, kept)
    c = deltas.changed(src1, CFG, changes)
    c = deltas.Changed(**{k: kept(f"changed-{k}", df) for k, df in vars(c).items()})  # each is read by several parts of the step
    change = deltas.step(state, CFG, c, kept)
    own = kept("change-partials", change.partials)
    for name in deltas.SCRATCH:
        drop_parquet(spark, kept.at(name))
    change = partials.State(own, kept("change-near", change.near), c.bonds, c.gifts, c.shares)
    after = partials.merge(state, change)
    keys = [k for k in default_registry().keys() if k in (*contributions.KEYS, *related.KEYS, *soft.KEYS)]
    return wide(list(partials.values(after, CFG, keys).values()), keys)


def _store(spark, src, cfg, buckets=16):
    """A new store in the shared folder."""
    store = Store(spark, f"{checkpoint_dir(spark).rstrip('/')}/kinsum-store-{uuid.uuid4().hex}", buckets)
    store.create(src, cfg)
    return store


def q_bundle_stream_equals_batch(spark, sf_dir):
    """I9: the feeds of three tables, drained by one stream into a bucketed store."""
    src1 = _src(spark, sf_dir)
    src0, changes = _mixed_changes(src1)
    store = _store(spark, src0, CFG)
    feeds = {}
    for table, rows in changes.items():
        feeds[table] = f"{store.path}-feed/{table}"
        store_parquet(rows.write, spark, feeds[table])
    inc.start(spark, feeds, lambda: src1, CFG, store, f"{store.path}-checkpoint").awaitTermination()
    return public(store.current())


def q_advance_over_year_ends(spark, sf_dir):
    """Q7: a store moves over the end of a fiscal year and then of a calendar year."""
    src = _src(spark, sf_dir)
    dates = [CFG.with_(as_of=d) for d in (BEFORE_YEAR_ENDS, BETWEEN_YEAR_ENDS, AFTER_YEAR_ENDS)]
    store = _store(spark, src, dates[0])
    for old, new in zip(dates, dates[1:], strict=False):
        store.advance(src, old, new)
    return public(store.current())


def q_advance_mail_window(spark, sf_dir):
    """Q7: mailings leave the twelve months."""
    src = _src(spark, sf_dir)
    before = CFG.with_(as_of=MAIL_CONFIG.as_of - dt.timedelta(days=8))
    store = _store(spark, src, before)
    store.advance(src, before, CFG.with_(as_of=MAIL_CONFIG.as_of))
    return public(store.current())


def q_lookup_change_equals_batch(spark, sf_dir):
    """FLT3: an added grant status and a removed event type, of lists that are not set."""
    src1 = _src(spark, sf_dir)
    types = spark.read.parquet(os.path.join(sf_dir, "nation.parquet")).where("n_nationkey between 1 and 4")
    types = types.select(F.col("n_nationkey").cast("int").alias("id"), F.col("n_name").alias("name"))
    values = src1["option_value"]
    added = values.where("option_group_id = 2 and value = '2'")
    src1 = src1.replace(event_type=types.where("id <> 4"))
    src0 = src1.replace(event_type=types, option_value=values.exceptAll(added))
    cfg = CFG.with_(event_type_ids=None)
    store = _store(spark, src0, cfg)
    store.apply({"option_value": inc.inserts(added), "event_type": inc.deletes(types.where("id = 4"))}, src1, cfg)
    return public(store.current())


QUERIES = {
    "hard_and_soft_anonymous": q_hard_and_soft_anonymous,
    "totals_of_another_date": q_totals_of_another_date,
    "signed_delta_equals_batch": q_signed_delta_equals_batch,
    "bundle_stream_equals_batch": q_bundle_stream_equals_batch,
    "advance_over_year_ends": q_advance_over_year_ends,
    "advance_mail_window": q_advance_mail_window,
    "lookup_change_equals_batch": q_lookup_change_equals_batch,
    "related_empty_zero": q_related_empty_zero,
    "related_population_edges": q_related_population_edges,
    "incremental_edge_population": q_incremental_edge_population,
    "mail_clickrate_distinct_links": q_mail_clickrate_distinct_links,
    "population_all": q_population_all,
    "plusme_distinct_donors": q_plusme_distinct_donors,
    "relationship_type_labels": q_relationship_type_labels,
    "option_lookup": q_option_lookup,
    "neighbours": q_neighbours,
    "affected_by_contribution": q_affected_by_contribution,
    "affected_by_relationship": q_affected_by_relationship,
    "affected_by_mail_event": q_affected_by_mail_event,
    "incremental_equals_batch": q_incremental_equals_batch,
    "incremental_relationship_equals_batch": q_incremental_relationship_equals_batch,
    "incremental_mail_equals_batch": q_incremental_mail_equals_batch,
    "incremental_delete_equals_batch": q_incremental_delete_equals_batch,
    "incremental_moved_equals_batch": q_incremental_moved_equals_batch,
    "user_metric_incremental": q_user_metric_incremental,
    "upsert_patch": q_upsert_patch,
    "contract_not_null": q_contract_not_null,
    "contract_defaults": q_contract_defaults,
    "contract_unique": q_contract_unique,
    "contract_fk": q_contract_fk,
    "contract_types": q_contract_types,
    "contract_quarantine": q_contract_quarantine,
}
