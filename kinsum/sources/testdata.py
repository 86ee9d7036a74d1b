"""CRM-shaped views over the driver's TPC-H-like parquet tables.

The same projections exist twice: as Spark DataFrames (:func:`crm_sources`) and
as DuckDB SQL (:data:`DUCKDB_VIEWS`) for the independent oracle queries.  Only
columns the rollups read are produced, and every view is a narrow projection or
a filter/semi-join, so Catalyst prunes the TPC-H scans to those columns.
"""

from __future__ import annotations

import datetime as dt
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsum.config import RollupConfig
from kinsum.sources.crm import Sources

# Fixed values of the mapping: the two option groups of the lookup table.
OPTION_GROUPS = [(1, "grant_type"), (2, "grant_status")]

# Configuration the registered queries run with (dates inside the data ranges:
# orders span 1995-2001, mailing events January 2024).
TESTDATA_CONFIG = RollupConfig(
    as_of=dt.date(2000, 9, 15),
    fiscal_year_start=(7, 1),
    financial_type_ids=(1, 2, 3),
    related_financial_type_ids=(1, 2),
    relationship_type_ids=(1, 2, 3, 4),
    grant_status_ids=None,  # FLT3: every status known to the lookup
    grant_type_ids=(1, 2, 3, 5, 6),
    participant_status_ids=(1, 2, 3, 4),
    event_type_ids=(1, 2, 3),
)
MAIL_CONFIG = TESTDATA_CONFIG.with_(as_of=dt.date(2025, 1, 15))
# Dates that queries move to: another one for the same partials, one after the ends of a fiscal and a calendar year.
OTHER_DATE = dt.date(1998, 2, 28)
BEFORE_YEAR_ENDS, BETWEEN_YEAR_ENDS, AFTER_YEAR_ENDS = dt.date(2000, 6, 30), dt.date(2000, 7, 1), dt.date(2001, 1, 1)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


_CACHE: dict = {}


def crm_sources(spark: SparkSession, sf_dir: str) -> Sources:
    """CRM views over ``sf_dir`` (built once per session and folder: the views
    are lazy DataFrames, so reusing them only saves plan construction)."""
    key = (spark.sparkContext.applicationId, id(spark), os.path.abspath(sf_dir))
    if key not in _CACHE:
        _CACHE[key] = _build_sources(spark, sf_dir)
    return _CACHE[key]


def _build_sources(spark: SparkSession, sf_dir: str) -> Sources:
    orders = _read(spark, sf_dir, "orders")
    lineitem = _read(spark, sf_dir, "lineitem")
    nation = _read(spark, sf_dir, "nation")
    events = _read(spark, sf_dir, "events")
    part = _read(spark, sf_dir, "part")

    priority = F.substring("o_orderpriority", 1, 1).cast("int")
    contribution = orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("contact_id"),
        F.col("o_totalprice").cast("decimal(20,2)").alias("total_amount"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("receive_date"),
        F.when(F.col("o_orderstatus") == "F", 1)
        .when(F.col("o_orderstatus") == "O", 2)
        .otherwise(3)
        .alias("contribution_status_id"),
        priority.alias("financial_type_id"),
    )
    soft = (
        lineitem.where(F.col("l_returnflag") == "A")
        .select(
            F.col("l_orderkey").alias("contribution_id"),
            F.col("l_partkey").alias("contact_id"),
            F.col("l_extendedprice").cast("decimal(20,2)").alias("amount"),
        )
    )
    relationship = (
        lineitem.where(F.col("l_returnflag") == "R")
        .join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("o_custkey").alias("contact_id_a"),
            F.col("l_partkey").alias("contact_id_b"),
            F.col("l_linenumber").cast("int").alias("relationship_type_id"),
            (F.col("l_linestatus") == "O").alias("is_active"),
        )
    )
    participant = lineitem.select(
        F.col("l_suppkey").alias("contact_id"),
        F.col("l_orderkey").alias("event_id"),
        F.col("l_linenumber").cast("int").alias("status_id"),
    )
    event = orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("start_date"),
        priority.alias("event_type_id"),
    )
    grant = lineitem.where(F.col("l_returnflag") == "N").select(
        F.col("l_partkey").alias("contact_id"),
        F.when(F.col("l_linestatus") == "O", 1).when(F.col("l_linestatus") == "F", 2).alias("status_id"),
        F.col("l_linenumber").cast("int").alias("grant_type_id"),
        F.col("l_extendedprice").cast("decimal(20,2)").alias("amount_granted"),
    )
    option_group = spark.createDataFrame(OPTION_GROUPS, "id int, name string")
    is_type = F.col("n_nationkey").between(1, 7)
    option_value = nation.select(
        F.when(is_type, 1).otherwise(2).alias("option_group_id"),
        F.when(is_type, F.col("n_nationkey")).otherwise(F.col("n_nationkey") - 7).cast("string").alias("value"),
        F.col("n_name").alias("label"),
    )
    relationship_type = nation.where(is_type).select(
        F.col("n_nationkey").cast("int").alias("id"),
        F.col("n_name").alias("name_a_b"),
        F.col("n_name").alias("label_a_b"),
        F.concat(F.col("n_name"), F.lit(" of")).alias("label_b_a"),
    )
    financial_type = orders.select(
        priority.alias("id"), F.col("o_orderpriority").alias("name")
    ).distinct()
    doy = F.year("ts") * 1000 + F.dayofyear("ts")  # one bulk mailing a day
    mailing_queue = events.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("contact_id"), doy.cast("int").alias("job_id")
    )
    mailing_job = events.select(
        doy.cast("int").alias("id"),
        (doy % 10).cast("int").alias("mailing_id"),
        F.to_date("ts").cast("timestamp_ntz").alias("start_date"),
    ).distinct()
    qid = F.col("event_id").alias("event_queue_id")
    et = F.col("event_type")
    delivered = events.where(et != "signup").select(qid)
    opened = events.where(et.isin("view", "click")).select(qid).unionAll(
        events.where(et == "click").select(qid)
    )
    bounce = events.where(et == "error").select(qid)
    url_open = events.where(et == "click").select(qid)
    trackable = part.select(
        F.col("p_partkey").alias("id"), (F.col("p_size") % 10).cast("int").alias("mailing_id")
    )
    return Sources.from_frames(
        spark,
        contribution=contribution,
        contribution_soft=soft,
        relationship=relationship,
        relationship_type=relationship_type,
        participant=participant,
        event=event,
        grant=grant,
        option_group=option_group,
        option_value=option_value,
        financial_type=financial_type,
        mailing_queue=mailing_queue,
        mailing_job=mailing_job,
        mailing_delivered=delivered,
        mailing_opened=opened,
        mailing_bounce=bounce,
        mailing_url_open=url_open,
        mailing_trackable_url=trackable,
    )


# DuckDB views with the same projections (``crm_*`` names) for the oracle queries.
DUCKDB_VIEWS: dict[str, str] = {
    "crm_contribution": """
        SELECT o_orderkey AS id, o_custkey AS contact_id,
               CAST(o_totalprice AS DECIMAL(20,2)) AS total_amount,
               o_orderdate AS receive_date,
               CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS contribution_status_id,
               CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS financial_type_id
        FROM orders""",
    "crm_soft_credit": """
        SELECT l_orderkey AS contribution_id, l_partkey AS contact_id,
               CAST(l_extendedprice AS DECIMAL(20,2)) AS amount
        FROM lineitem WHERE l_returnflag = 'A'""",
    "crm_relationship": """
        SELECT o_custkey AS contact_id_a, l_partkey AS contact_id_b,
               l_linenumber AS relationship_type_id, (l_linestatus = 'O') AS is_active
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE l_returnflag = 'R'""",
    "crm_relationship_type": """
        SELECT n_nationkey AS id, n_name AS name_a_b, n_name AS label_a_b,
               n_name || ' of' AS label_b_a
        FROM nation WHERE n_nationkey BETWEEN 1 AND 7""",
    "crm_participant": """
        SELECT l_suppkey AS contact_id, l_orderkey AS event_id, l_linenumber AS status_id
        FROM lineitem""",
    "crm_event": """
        SELECT o_orderkey AS id, o_orderdate AS start_date,
               CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS event_type_id
        FROM orders""",
    "crm_grant": """
        SELECT l_partkey AS contact_id,
               CASE l_linestatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 END AS status_id,
               l_linenumber AS grant_type_id,
               CAST(l_extendedprice AS DECIMAL(20,2)) AS amount_granted
        FROM lineitem WHERE l_returnflag = 'N'""",
    "crm_option_group": """
        SELECT * FROM (VALUES (1, 'grant_type'), (2, 'grant_status')) AS t(id, name)""",
    "crm_option_value": """
        SELECT CASE WHEN n_nationkey BETWEEN 1 AND 7 THEN 1 ELSE 2 END AS option_group_id,
               CAST(CASE WHEN n_nationkey BETWEEN 1 AND 7 THEN n_nationkey ELSE n_nationkey - 7 END AS VARCHAR) AS value,
               n_name AS label
        FROM nation""",
    "crm_mail_queue": """
        SELECT event_id AS id, user_id AS contact_id, CAST(year(ts) * 1000 + dayofyear(ts) AS INTEGER) AS job_id
        FROM events""",
    "crm_mail_job": """
        SELECT DISTINCT CAST(year(ts) * 1000 + dayofyear(ts) AS INTEGER) AS id,
               CAST(dayofyear(ts) % 10 AS INTEGER) AS mailing_id,
               CAST(CAST(ts AS DATE) AS TIMESTAMP) AS start_date
        FROM events""",
    "crm_mail_delivered": "SELECT event_id AS event_queue_id FROM events WHERE event_type <> 'signup'",
    "crm_mail_opened": """
        SELECT event_id AS event_queue_id FROM events WHERE event_type IN ('view', 'click')
        UNION ALL SELECT event_id FROM events WHERE event_type = 'click'""",
    "crm_mail_bounce": "SELECT event_id AS event_queue_id FROM events WHERE event_type = 'error'",
    "crm_mail_link_open": "SELECT event_id AS event_queue_id FROM events WHERE event_type = 'click'",
    "crm_mail_link": """
        SELECT p_partkey AS id, CAST(p_size % 10 AS INTEGER) AS mailing_id FROM part""",
}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the CTEs it names (all if none given)."""
    names = names or tuple(n for n in DUCKDB_VIEWS if re.search(rf"\b{n}\b", sql))
    ctes = ",\n".join(f"{n} AS ({DUCKDB_VIEWS[n]})" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
