"""Shuffle bytes and input records of a full refresh vs a one-day
incremental batch, read from Spark's event log (written to a fresh scratch
folder).  Usage: ``python shuffle_report.py [SF_DIR]``.
"""

from __future__ import annotations

import collections
import datetime as dt
import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    scratch = tempfile.mkdtemp(prefix="kinsum-shuffle-")
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from kinsum.plans.refresh import refresh
    from kinsum.plans.store import Store
    from kinsum.session import CONF
    from kinsum.sources.testdata import TESTDATA_CONFIG as CFG
    from kinsum.sources.testdata import crm_sources
    from kinsum.streaming import incremental as inc

    b = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.eventLog.enabled", "true")
        .config("spark.eventLog.dir", scratch).config("spark.eventLog.compress", "false")
    )
    for k, v in CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    src1 = crm_sources(spark, sf)
    cut = F.lit(dt.datetime(2001, 8, 1)).cast("timestamp_ntz")
    new = src1["contribution"].where(F.col("receive_date") >= cut)
    src0 = src1.replace(contribution=src1["contribution"].where(~(F.col("receive_date") >= cut)))
    store = Store(spark, os.path.join(scratch, "store"))
    store.create(src0, CFG)
    spark.sparkContext.setJobGroup("full", "full refresh")
    refresh(src1, CFG, membership=True)[0].write.parquet(os.path.join(scratch, "wide"))
    spark.sparkContext.setJobGroup("incremental", "one-day batch")
    store.apply({"contribution": inc.inserts(new)}, src1, CFG)
    spark.stop()

    stage_group, written, read, out = {}, collections.Counter(), collections.Counter(), collections.Counter()
    logs = [p for p in glob.glob(os.path.join(scratch, "*")) if os.path.isfile(p)]
    logs += sorted(glob.glob(os.path.join(scratch, "eventlog*", "events*")))  # rolling log folders
    for path in logs:
        for line in open(path):
            e = json.loads(line)
            if e["Event"] == "SparkListenerJobStart":
                for s in e["Stage IDs"]:
                    stage_group[s] = e["Properties"].get("spark.jobGroup.id")
            elif e["Event"] == "SparkListenerTaskEnd":
                g = stage_group.get(e["Stage ID"])
                m = e.get("Task Metrics") or {}
                written[g] += m.get("Shuffle Write Metrics", {}).get("Shuffle Bytes Written", 0)
                read[g] += m.get("Input Metrics", {}).get("Records Read", 0)
                out[g] += m.get("Output Metrics", {}).get("Records Written", 0)
    print(json.dumps({g: {"shuffle_bytes_written": written[g], "input_records_read": read[g], "records_written": out[g]} for g in ("full", "incremental")}))


if __name__ == "__main__":
    main()
