"""SRC1 loader over a folder of CRM parquet tables, POP1, lookups."""

from fixtures import GOLDEN_CFG, golden_sources
from kinsum.plans.refresh import metric, refresh
from kinsum.sources.crm import Sources
from kinsum.sources.lookups import option_lookup, relationship_type_labels


def test_parquet_dir_roundtrip(spark, tmp_path):
    src = golden_sources(spark)
    for name in ("contribution", "contribution_soft", "relationship", "mailing_queue", "mailing_delivered",
                 "mailing_opened", "mailing_bounce"):
        # a wider physical file: extra columns are pruned, types are cast to the declared schema
        src[name].selectExpr("*", "'x' AS unused").write.parquet(str(tmp_path / f"{name}.parquet"))
    loaded = Sources.from_parquet_dir(spark, str(tmp_path))
    assert "unused" not in loaded["contribution"].columns
    assert loaded["grant"].count() == 0  # missing optional table -> empty
    src = src.replace(grant=loaded["grant"])
    keys = ["hard_and_soft", "relatedcontrib_alltime", "mail_openrate_alltime"]
    a, _ = refresh(loaded, GOLDEN_CFG, keys=keys)
    b, _ = refresh(src, GOLDEN_CFG, keys=keys)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_population_all(spark):
    src = golden_sources(spark)
    cfg = GOLDEN_CFG.with_(active=("hard_and_soft", "soft_total_this_calendar_year"))
    own = {r[0]: r[1] for r in metric(src, cfg, "soft_total_this_calendar_year").collect()}
    everyone = {r[0]: r[1] for r in metric(src, cfg, "soft_total_this_calendar_year", population="all").collect()}
    assert set(own) == {1, 2, 6} and set(everyone) == {1, 2, 3, 4, 5, 6}
    assert everyone[3] is None and everyone[1] == own[1]


def test_lookups(spark):
    src = Sources.from_rows(
        spark,
        relationship_type=[(1, "a", "Parent", "Child"), (2, "", "x", "y"), (3, "0", "x", "y"), (4, "b", None, "z"), (5, None, "x", "y")],
        option_group=[(1, "grant_type"), (2, "grant_status")],
        option_value=[(1, "1", "A"), (2, "1", "Open")],
    )
    assert sorted(map(tuple, relationship_type_labels(src).collect())) == [(1, "Parent/Child"), (4, "/z")]
    assert [tuple(r) for r in option_lookup(src, "grant_type").collect()] == [("1", "A")]
    # a missing component gives an empty lookup, not an error
    assert option_lookup(Sources(spark, {}), "grant_type").count() == 0


def test_cli_refresh_and_stream(spark, tmp_path):
    import json
    import contextlib
    import io

    from pyspark.sql import functions as F

    from kinsum.__main__ import main
    from kinsum.plans.affected import apply_changes
    from kinsum.plans.refresh import public
    from kinsum.plans.store import Store
    from kinsum.streaming import incremental as inc

    src = golden_sources(spark)
    srcdir = tmp_path / "src"
    for name in ("contribution", "contribution_soft", "relationship"):
        src[name].write.parquet(str(srcdir / f"{name}.parquet"))
    args = ["--sources", str(srcdir), "--store", str(tmp_path / "wide"), "--as-of", "2025-03-15",
            "--fiscal-start", "7-1", "--financial-types", "1,2", "--related-financial-types", "1",
            "--relationship-types", "10", "--metrics", "hard_and_soft,relatedcontrib_alltime", "--buckets", "3"]
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        assert main(["refresh", *args]) == 0
    assert json.loads(out.getvalue())["computed"] == ["hard_and_soft", "relatedcontrib_alltime"]
    # a donation moves to contact 5: the base changes and the change row arrives
    ch = inc.updates(src["contribution"].where("id = 1"), {"contact_id": F.lit(5).cast("long")})
    after = apply_changes(src, "contribution", ch)["contribution"]
    after.write.parquet(str(tmp_path / "src2" / "contribution.parquet"))
    for name in ("contribution_soft", "relationship"):
        src[name].write.parquet(str(tmp_path / "src2" / f"{name}.parquet"))
    ch.write.parquet(str(tmp_path / "feed"))
    args2 = [a if a != str(srcdir) else str(tmp_path / "src2") for a in args]
    assert main(["stream", *args2, "--feed", f"contribution={tmp_path / 'feed'}", "--available-now",
                 "--checkpoint", str(tmp_path / "ckpt")]) == 0
    got = {r["entity_id"]: float(r["relatedcontrib_alltime"] or 0) for r in public(Store(spark, str(tmp_path / "wide"), 3).current()).collect()}
    assert got[2] == 400.0  # contact 1's 100 moved to 5: 2 now gets 2 x 200 (self-edge) only
    args3 = [a if a != "2025-03-15" else "2026-01-01" for a in args2]
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        assert main(["advance", *args3, "--from", "2025-03-15"]) == 0
    assert json.loads(out.getvalue()) == {"ok": True, "as_of": "2026-01-01", "skipped": {}}
