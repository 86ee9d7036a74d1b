"""Metamorphic properties: plus-me = own + related, and the
result does not depend on row order or on how the inputs are partitioned."""

from decimal import Decimal

from pyspark.sql import functions as F

from fixtures import GOLDEN_CFG, golden_sources
from kinsum.operators import related
from kinsum.operators.related import PLUSME_KEYS, RELATED_KEYS, WINDOW_NAMES, donor_totals
from kinsum.plans.refresh import refresh
from kinsum.sources.crm import Sources


def test_plusme_is_own_plus_related(spark):
    src = golden_sources(spark)
    rows = {r["entity_id"]: r for r in related.build(src, GOLDEN_CFG).collect()}
    own = {r["donor"]: r.asDict() for r in donor_totals(src, GOLDEN_CFG, WINDOW_NAMES).collect()}
    for cid, r in rows.items():
        for w, rk, pk in zip(WINDOW_NAMES, RELATED_KEYS, PLUSME_KEYS):
            o = own.get(cid, {}).get(f"w_{w}")
            rel = r[rk]
            if rel is None and o is None:
                assert r[pk] is None
            else:
                assert r[pk] == (rel or Decimal(0)) + (o or Decimal(0))


def test_row_order_and_partitioning_do_not_matter(spark):
    src = golden_sources(spark)
    shuffled = Sources(spark, {
        name: df.repartition(7).orderBy(F.rand(seed=11)) for name, df in ((n, src[n]) for n in src)
    })
    single = Sources(spark, {name: src[name].coalesce(1) for name in src})
    want = sorted(map(tuple, refresh(src, GOLDEN_CFG)[0].collect()), key=repr)
    for variant in (shuffled, single):
        got = sorted(map(tuple, refresh(variant, GOLDEN_CFG)[0].collect()), key=repr)
        assert got == want
