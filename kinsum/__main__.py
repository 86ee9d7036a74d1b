"""Job entry points (X5), for ``spark-submit -m kinsum`` style use.

    python -m kinsum refresh --sources DIR --store DIR --as-of 2025-03-15 [options]
    python -m kinsum advance --sources DIR --store DIR --as-of 2025-03-16 --from 2025-03-15 [options]
    python -m kinsum stream  --sources DIR --store DIR --feed contribution=DIR [--feed ...] [options]

``refresh`` writes the store (wide table and its state) anew and prints the refresh
report as JSON; ``advance`` moves its date; ``stream`` keeps it fresh from change
feeds until the feeds are drained (``--available-now``) or forever.  The session comes from the cluster (master, checkpoint folder).
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from kinsum.config import RollupConfig
from kinsum.plans.store import Store
from kinsum.session import configure
from kinsum.sources.crm import Sources


def _ids(text):
    return None if text in (None, "", "all") else tuple(int(x) for x in text.split(","))


def config_from_args(a) -> RollupConfig:
    month, day = (int(x) for x in a.fiscal_start.split("-"))
    return RollupConfig(
        as_of=a.as_of,
        fiscal_year_start=(month, day),
        financial_type_ids=_ids(a.financial_types),
        related_financial_type_ids=_ids(a.related_financial_types),
        relationship_type_ids=_ids(a.relationship_types),
        grant_status_ids=_ids(a.grant_statuses),
        grant_type_ids=_ids(a.grant_types),
        participant_status_ids=_ids(a.participant_statuses),
        event_type_ids=_ids(a.event_types),
        related_empty=a.related_empty,
        related_population=a.related_population,
        dedupe_donors=a.dedupe_donors,
        distinct_links=a.distinct_links,
        label_order=a.label_order,
        active=tuple(a.metrics.split(",")) if a.metrics else None,
    )


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kinsum")
    sub = p.add_subparsers(dest="cmd", required=True)
    for name in ("refresh", "advance", "stream"):
        s = sub.add_parser(name)
        s.add_argument("--sources", required=True, help="folder of <table>.parquet inputs")
        s.add_argument("--store", required=True, help="folder of the wide table and its state")
        s.add_argument("--buckets", type=int, default=64, help="hash buckets of the store's tables")
        s.add_argument("--as-of", required=True)
        s.add_argument("--fiscal-start", default="1-1", help="MONTH-DAY")
        for opt in ("financial-types", "related-financial-types", "relationship-types", "grant-statuses",
                    "grant-types", "participant-statuses", "event-types"):
            s.add_argument(f"--{opt}", default=None, help="comma-separated ids; omitted = every known id")
        s.add_argument("--metrics", default=None, help="comma-separated metric keys; omitted = all")
        s.add_argument("--related-empty", default="null", choices=["null", "zero"])
        s.add_argument("--related-population", default="donors", choices=["donors", "edges"])
        s.add_argument("--dedupe-donors", action="store_true")
        s.add_argument("--distinct-links", action="store_true")
        s.add_argument("--label-order", default="binary", choices=["binary", "nocase"])
        if name == "advance":
            s.add_argument("--from", dest="from_date", required=True, help="the date that the store has")
        if name == "stream":
            s.add_argument("--feed", action="append", required=True, help="TABLE=FOLDER of change rows")
            s.add_argument("--checkpoint", default=None, help="default: under spark.checkpoint.dir")
            s.add_argument("--available-now", action="store_true", help="drain the feeds and stop")
    return p


def main(argv=None) -> int:
    a = parser().parse_args(argv)
    spark = configure(SparkSession.builder.appName(f"kinsum-{a.cmd}").getOrCreate())
    cfg = config_from_args(a)
    store = Store(spark, a.store, a.buckets)

    def load():
        return Sources.from_parquet_dir(spark, a.sources)

    if a.cmd == "refresh":
        report = store.create(load(), cfg)
        print(json.dumps({"ok": report.ok, "as_of": report.as_of, "rows": report.rows, "filled": report.filled,
                          "computed": report.computed, "skipped": report.skipped}))
        return 0 if report.ok else 1
    if a.cmd == "advance":
        skipped = store.advance(load(), cfg.with_(as_of=a.from_date), cfg)
        print(json.dumps({"ok": not skipped, "as_of": cfg.as_of.isoformat(), "skipped": skipped}))
        return 0 if not skipped else 1
    from kinsum.streaming.incremental import start

    feeds = dict(f.split("=", 1) for f in a.feed)
    trigger = {"availableNow": True} if a.available_now else {"processingTime": "1 minute"}
    start(spark, feeds, load, cfg, store, a.checkpoint, trigger).awaitTermination()
    return 0


if __name__ == "__main__":
    sys.exit(main())
