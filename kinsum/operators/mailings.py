"""Mailing family M1-M3: per-contact open and click-through rates.

rate = ROUND(COALESCE(o / NULLIF(s - b, 0), 0) * 100, 2) with row counts (not
distinct mailings), so values above 100 and negative values occur.
Population: contacts with at least one *sent* row of the metric.

* M1 s/o/b = delivered/opened/bounce rows of the contact's queue entries.
* M2 same, only queue entries whose job started on/after as_of - 1 year.  The
  reference's batch statement self-joins the queue on contact, multiplying s, o
  and b by the same factor; the ratio is unchanged, so the join is dropped.
* M3 s = delivered x links of the job's mailing, b = bounces x links, o = link
  opens (all), for contacts with deliveries on mailings that have links.
  ``distinct_links=True`` counts emails instead of link-multiplied rows.

Plan: the event tables are tagged and unioned, pre-aggregated per queue id
(the join key, so the shuffle is shared with the queue join), joined to the
queue once, and counted per contact once for all three metrics.  The jobs (one row a
mailing) are counted and broadcast to the queue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsum.config import RollupConfig
from kinsum.functions import periods
from kinsum.functions.aggregates import restrict
from kinsum.functions.joins import hot_split_join, small_side, small_side_checked
from kinsum.functions.rates import rate
from kinsum.sources.crm import Sources

KEYS = ["mail_openrate_alltime", "mail_openrate_last12months", "mail_clickrate_alltime"]


def _tagged(src: Sources, tables: dict[str, str], queue_ids: DataFrame | None = None) -> DataFrame:
    """UNION ALL of event tables as ``(qid, n_<tag>...)`` pre-aggregated per queue id.  With
    ``queue_ids`` (``_qk``; broadcast when small) each event table is restricted to
    them at its scan, before any shuffle."""
    tags = sorted(set(tables.values()))
    legs = []
    for t, tag in tables.items():
        events = src[t]
        if queue_ids is not None:
            events = events.join(queue_ids, events["event_queue_id"] == queue_ids["_qk"], "left_semi")
        legs.append(
            events.select(
                F.col("event_queue_id").alias("qid"),
                *[F.lit(1 if x == tag else 0).alias(f"n_{x}") for x in tags],
            )
        )
    u = legs[0]
    for leg in legs[1:]:
        u = u.unionAll(leg)
    return u.groupBy("qid").agg(*[F.sum(f"n_{x}").alias(f"n_{x}") for x in tags])


def build(src: Sources, cfg: RollupConfig, keys=None, contacts=None) -> DataFrame:
    """All requested mail rates from one plan: the four event tables are tagged
    and pre-aggregated per queue id once, joined to the queue (with the job's
    window flag and link count) once, and counted per contact once.  Each
    metric keeps its own population: its column is NULL outside it, and a
    contact appears when it is in the population of any requested key."""
    keys = list(keys or KEYS)
    for k in keys:
        if k not in KEYS:
            raise KeyError(k)
    q = restrict(src["mailing_queue"].select("id", "contact_id", "job_id"), "contact_id", contacts).where("contact_id is not null")
    tables = {"mailing_delivered": "s", "mailing_bounce": "b"}
    if "mail_openrate_alltime" in keys or "mail_openrate_last12months" in keys:
        tables["mailing_opened"] = "o"
    if "mail_clickrate_alltime" in keys:
        tables["mailing_url_open"] = "u"
    # the queue rows of a batch's contacts are found once; their ids are counted and
    # broadcast when small, so no event table is shuffled for a small batch
    ids = small_side(q.select(F.col("id").alias("_qk"))) if contacts is not None else None
    ev = _tagged(src, tables, ids)
    tags = sorted(set(tables.values()))

    jflags = []
    if keys != ["mail_openrate_alltime"]:  # the only rate that needs no job
        jobs = src["mailing_job"].select(F.col("id").alias("job_id"), "mailing_id", "start_date")
    if "mail_openrate_last12months" in keys:
        jobs = jobs.withColumn("_in_win", periods.rolling_year(cfg).contains("start_date"))
        jflags.append("_in_win")
    if "mail_clickrate_alltime" in keys:
        u = src["mailing_trackable_url"].groupBy("mailing_id").agg(F.count(F.lit(1)).alias("n_links"))
        jobs = jobs.join(u, "mailing_id", "left")
        jflags.append("n_links")
    if jflags:
        # one bulk mailing is one job of very many queue rows: the queue is never shuffled by job.  The
        # jobs are counted and broadcast; too many of them meet a queue whose frequent jobs are dealt out
        jobs, small = small_side_checked(jobs.select("job_id", *jflags))
        if small:
            q = q.join(jobs, "job_id", "left")
        else:
            q = hot_split_join(q, jobs.withColumnRenamed("job_id", "_job"), "job_id", "_job", "left").drop("_job")
    j = ev.join(q, ev["qid"] == q["id"], "inner")

    n = {t: F.col(f"n_{t}") for t in tags}
    aggs = {}
    if "mail_openrate_alltime" in keys:
        aggs.update(s_all=F.sum(n["s"]), o_all=F.sum(n["o"]), b_all=F.sum(n["b"]))
    if "mail_openrate_last12months" in keys:
        win = F.coalesce(F.col("_in_win"), F.lit(False))
        aggs.update(
            s_win=F.sum(F.when(win, n["s"])), o_win=F.sum(F.when(win, n["o"])), b_win=F.sum(F.when(win, n["b"]))
        )
    if "mail_clickrate_alltime" in keys:
        links = F.col("n_links")
        if cfg.distinct_links:
            aggs.update(
                s_clk=F.sum(F.when(links.isNotNull() & (n["s"] > 0), 1)),
                b_clk=F.sum(F.when(links.isNotNull() & (n["b"] > 0), 1)),
                o_clk=F.sum(F.when(n["u"] > 0, 1)),
            )
        else:
            aggs.update(s_clk=F.sum(n["s"] * links), b_clk=F.sum(n["b"] * links), o_clk=F.sum(n["u"]))
    agg = j.groupBy(F.col("contact_id").alias("entity_id")).agg(*[v.alias(k) for k, v in aggs.items()])
    suffix = {"mail_openrate_alltime": "all", "mail_openrate_last12months": "win", "mail_clickrate_alltime": "clk"}
    cols, pops = [], []
    for k in keys:
        x = suffix[k]
        pop = F.coalesce(F.col(f"s_{x}"), F.lit(0)) > 0
        pops.append(pop)
        cols.append(F.when(pop, rate(F.col(f"o_{x}"), F.col(f"s_{x}"), F.col(f"b_{x}"))).alias(k))
    any_pop = pops[0]
    for p in pops[1:]:
        any_pop = any_pop | p
    return agg.where(any_pop).select("entity_id", *cols)
