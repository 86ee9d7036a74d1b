"""Periods (FLT4-FLT7), exact rates (SC4) and registry rules (X3, FLT9)."""

import datetime as dt
from decimal import ROUND_HALF_UP, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinsum.config import RollupConfig
from kinsum.functions import periods
from kinsum.functions.rates import rate
from kinsum.plans.registry import RollupSpec, default_registry


def test_fiscal_year_bounds():
    cfg = RollupConfig(as_of=dt.date(2025, 3, 15), fiscal_year_start=(7, 1))
    assert periods.fiscal_year_bounds(cfg, 0) == (dt.date(2024, 7, 1), dt.date(2025, 6, 30))
    assert periods.fiscal_year_bounds(cfg, 1) == (dt.date(2023, 7, 1), dt.date(2024, 6, 30))
    cfg = RollupConfig(as_of=dt.date(2025, 7, 1), fiscal_year_start=(7, 1))
    assert periods.fiscal_year_bounds(cfg, 0)[0] == dt.date(2025, 7, 1)


def test_previous_fiscal_year_clamps_feb_29():
    # FY ends 29 Feb 2024; the previous one is shifted per bound and ends 28 Feb 2023
    cfg = RollupConfig(as_of=dt.date(2024, 1, 10), fiscal_year_start=(3, 1))
    assert periods.fiscal_year_bounds(cfg, 0) == (dt.date(2023, 3, 1), dt.date(2024, 2, 29))
    assert periods.fiscal_year_bounds(cfg, 1) == (dt.date(2022, 3, 1), dt.date(2023, 2, 28))
    # FY ending 28 Feb 2025 shifts to 28 Feb 2024 and so leaves out 29 Feb 2024
    cfg = RollupConfig(as_of=dt.date(2025, 1, 10), fiscal_year_start=(3, 1))
    assert periods.fiscal_year_bounds(cfg, 1) == (dt.date(2023, 3, 1), dt.date(2024, 2, 28))
    assert periods.minus_years(dt.date(2024, 2, 29), 1) == dt.date(2023, 2, 28)


def test_period_edges(spark):
    cfg = RollupConfig(as_of=dt.date(2025, 3, 15), fiscal_year_start=(7, 1))
    df = spark.createDataFrame(
        [(dt.datetime(2024, 12, 31, 23, 59, 59),), (dt.datetime(2025, 1, 1),), (dt.datetime(2025, 6, 30, 23, 59),),
         (dt.datetime(2025, 7, 1),), (None,)],
        "d timestamp_ntz",
    )
    got = df.select(
        periods.calendar_year(cfg, 0).contains("d").alias("cy"),
        periods.fiscal_year(cfg, 0).contains("d").alias("fy"),
        periods.rolling_year(cfg).contains("d").alias("r12"),
    ).collect()
    assert [tuple(r) for r in got] == [
        (False, True, True), (True, True, True), (True, True, True), (True, False, True), (None, None, None)
    ]


def _expected(o, s, b):
    d = s - b
    if d == 0:
        return 0.0
    return float((Decimal(o) / Decimal(d) * 100).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**6), st.integers(0, 10**6), st.integers(0, 10**6)), min_size=1, max_size=40))
def test_rate_is_exact_half_up(spark, rows):
    df = spark.createDataFrame(rows, "o long, s long, b long")
    got = [r[0] for r in df.select(rate(F.col("o"), F.col("s"), F.col("b"))).collect()]
    assert got == [_expected(*r) for r in rows]


def test_rate_ties_and_signs(spark):
    rows = [(1, 8, 0), (1, 200, 0), (1, 3, 0), (2, 3, 0), (1, 0, 8), (1, 0, 200), (0, 1, 2), (5, 5, 5)]
    df = spark.createDataFrame(rows, "o long, s long, b long")
    got = [r[0] for r in df.select(rate(F.col("o"), F.col("s"), F.col("b"))).collect()]
    assert got == [12.5, 0.5, 33.33, 66.67, -12.5, -0.5, 0.0, 0.0]
    assert str(got[6]) == "0.0"


def test_registry_skips_bad_spec_and_keeps_others():
    reg = default_registry()
    n = len(reg.keys())
    assert n == 31  # with the four fiscal-year totals
    assert not reg.register(RollupSpec("bad key", "x", "x", "Money", "contributions"))
    assert not reg.register(RollupSpec("ok_key2", "x", "x", "Blob", "contributions"))
    assert not reg.register(RollupSpec("ok_key", "x", "x", "Money", "nope"))
    assert len(reg.keys()) == n and len(reg.skipped) == 3
    assert [s.key for s in reg.select(["hard_and_soft", "missing"])] == ["hard_and_soft"]
    assert "missing" in reg.skipped


def test_dependents():
    reg = default_registry()
    assert set(reg.dependents("relationship")) == {k for k in reg.keys() if k.startswith("relatedcontrib_")}
    assert "soft_total_last_fiscal_year" in reg.dependents("contribution")  # Q6


def test_custom_family_and_bad_metric_skipped(spark):
    """X1: a user family is registered and computed with the built-ins; X3: a
    failing user metric is reported and the others still refresh."""
    from pyspark.sql import functions as F

    from fixtures import GOLDEN_CFG, golden_sources
    from kinsum.plans.refresh import refresh
    from kinsum.plans.registry import FAMILIES, Registry, _BUILTIN

    def largest_gift(src, cfg, keys, contacts=None):
        c = src["contribution"].where(F.col("contribution_status_id") == 1)
        return c.groupBy(F.col("contact_id").alias("entity_id")).agg(F.max("total_amount").alias(keys[0]))

    def broken(src, cfg, keys, contacts=None):
        return src["contribution"].select(F.col("no_such_column"))

    reg = Registry(_BUILTIN, {**FAMILIES, "largest": largest_gift, "broken": broken})
    assert reg.register(RollupSpec("largest_gift", "custom", "Largest gift", "Money", "largest", ("contribution",)))
    assert reg.register(RollupSpec("bad_metric", "custom", "Bad", "Money", "broken", ("contribution",)))
    df, report = refresh(golden_sources(spark), GOLDEN_CFG, reg, keys=["hard_and_soft", "largest_gift", "bad_metric"])
    assert "bad_metric" in report.skipped and report.computed == ["hard_and_soft", "largest_gift"]
    got = {r["entity_id"]: float(r["largest_gift"]) for r in df.collect() if r["largest_gift"] is not None}
    assert got[1] == 100.0 and got[2] == 200.0


def test_money_added_as_two_longs_is_exact(spark):
    from decimal import Decimal

    from kinsum.functions.aggregates import halves, sum_halves_if

    amounts = ["999999999999999999.99", "-0.01", "-123456789.99", "100000000.00", "0.07", None]
    df = spark.createDataFrame([(i % 2, Decimal(a) if a else None) for i, a in enumerate(amounts * 50)], "k int, x decimal(20,2)")
    up, low = halves(F.col("x"))
    df = df.withColumn("up", up).withColumn("low", low)
    total = sum_halves_if(F.col("k") >= 0, F.col("up"), F.col("low")).alias("total")
    none = sum_halves_if(F.col("k") > 1, F.col("up"), F.col("low")).alias("none")
    got = df.groupBy("k").agg(total, none, F.sum("x").alias("plain"))
    assert got.schema["total"].dataType == got.schema["plain"].dataType
    assert all(r["total"] == r["plain"] and r["none"] is None for r in got.collect())
