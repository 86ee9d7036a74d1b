"""Plan checks: no nested-loop/cartesian joins, windows pushed to the scan,
contributions scanned a bounded number of times in the fused refresh."""

import contextlib
import io
import os

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def _plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.skipif(not os.path.isdir(SF), reason="testdata missing")
@pytest.mark.parametrize("name", ["wide_refresh", "relatedcontrib_alltime", "hard_and_soft", "neighbours",
                                  "incremental_equals_batch", "mail_clickrate_alltime"])
def test_no_nested_loop_or_cartesian(spark, name):
    p = _plan(E.queries()[name](spark, SF))
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p


def test_year_window_reaches_scan(spark):
    df = E.queries()["soft_total_last_calendar_year"](spark, SF)
    p = _plan(df)
    assert "GreaterThanOrEqual(o_orderdate,1999-01-01T00:00)" in p and "LessThan(o_orderdate,2000-01-01T00:00)" in p


def test_fused_refresh_scan_count(spark):
    """Scans of the contribution table (orders) in the *executed* plan, where
    adaptive execution has reused identical shuffle stages."""
    df = E.queries()["wide_refresh"](spark, SF)
    df.collect()
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    final = buf.getvalue().split("== Initial Plan ==")[0]
    scans = [line for line in final.splitlines() if "FileScan parquet" in line]
    orders = [line for line in scans if "orders.parquet" in line]
    # event and the relationship view's endpoint lookup; the donations come from the written rollup
    assert scans and "ReusedExchange" in final
    assert len(orders) <= 2, len(orders)


def test_one_rollup_reads_the_donations_twice(spark):
    """By contact and by the donation of a soft credit, for all C, S and own totals."""
    from kinsum.operators import contributions, related, soft
    from kinsum.sources.testdata import TESTDATA_CONFIG, crm_sources

    src = crm_sources(spark, SF)
    df = contributions.rollup(src, TESTDATA_CONFIG, contributions.KEYS, related.WINDOW_NAMES, soft_keys=soft.KEYS)
    df.collect()
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    final = buf.getvalue().split("== Initial Plan ==")[0]
    assert len([x for x in final.splitlines() if "FileScan parquet" in x and "orders.parquet" in x]) == 2


def test_fused_families_equal_the_single_ones(spark):
    """Contacts of one population only, edge populations, empty totals: every key and flag of
    the fused frame is that of its own family."""
    from fixtures import GOLDEN_CFG, golden_sources
    from kinsum.operators import contributions, related, soft

    src = golden_sources(spark)
    keys = [*contributions.KEYS, *related.KEYS]
    for change in ({}, {"related_population": "edges"}, {"related_empty": "zero"}, {"dedupe_donors": True}):
        cfg = GOLDEN_CFG.with_(**change)
        both = {r["entity_id"]: r.asDict() for r in contributions.fused(src, cfg, keys, soft.KEYS).collect()}
        alone = {}
        for build, ks, flag in ((contributions.build, keys, "_in_contributions"), (soft.build, soft.KEYS, "_in_soft")):
            for r in build(src, cfg, ks).collect():
                alone.setdefault(r["entity_id"], {}).update(r.asDict() | {flag: True})
        want = {i: {c: row.get(c) for c in ("entity_id", *keys, *soft.KEYS, "_in_contributions", "_in_soft")} for i, row in alone.items()}
        assert any(w["_in_soft"] is None for w in want.values())
        if "related_population" in change:  # contacts of neither population may have no row alone
            both = {i: r for i, r in both.items() if r["_in_contributions"] or r["_in_soft"]}
        assert both == want


def test_related_edges_are_read_once_and_donors_summed_once(spark):
    """Without any broadcast by size: the count of the hot partners and the join share the
    edges' shuffle (the view joins them from lineitem), and both sides of the join share
    the table of hot partners."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for n in names:
        spark.conf.set(n, "-1")
    try:
        df = E.queries()["relatedcontrib_alltime"](spark, SF)
        df.collect()
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain()
    finally:
        for n in names:
            spark.conf.unset(n)
    final = buf.getvalue().split("== Initial Plan ==")[0]
    scans = [line for line in final.splitlines() if "FileScan parquet" in line]
    assert len([s for s in scans if "lineitem.parquet" in s]) == 1
    # the population, the donors and the endpoint lookup of the relationship view
    assert len([s for s in scans if "orders.parquet" in s]) == 3


@pytest.mark.parametrize("name", ["mail_openrate_last12months", "mail_clickrate_alltime", "mail_clickrate_distinct_links"])
def test_the_mail_queue_is_never_shuffled_by_job(spark, monkeypatch, name):
    """Without any broadcast by size the counted jobs are broadcast; too many of them are salted, with
    the same result."""
    from kinsum.functions import joins

    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    want = sorted(map(tuple, E.queries()[name](spark, SF).collect()))
    for n in names:
        spark.conf.set(n, "-1")
    try:
        exchanges = [x for x in _plan(E.queries()[name](spark, SF)).splitlines() if "Arguments: hashpartitioning" in x]
        assert exchanges and not any("hashpartitioning(job_id" in x for x in exchanges)
        monkeypatch.setattr(joins.small_side_checked, "__defaults__", (0,))
        assert sorted(map(tuple, E.queries()[name](spark, SF).collect())) == want
    finally:
        for n in names:
            spark.conf.unset(n)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns[0] == "entity_id" and len(df.columns) == 32


def test_restricted_refresh_has_no_nested_loop(spark):
    from pyspark.sql import functions as F

    from fixtures import GOLDEN_CFG, golden_sources
    from kinsum.functions.joins import release_small_sides
    from kinsum.plans.refresh import refresh

    contacts = F.broadcast(spark.createDataFrame([(1,), (3,)], "entity_id long"))
    df, _ = refresh(golden_sources(spark), GOLDEN_CFG, contacts=contacts, membership=True)
    p = _plan(df)
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p
    assert {r["entity_id"] for r in df.collect()} <= {1, 3}
    release_small_sides()
