"""Declared schemas of the CRM tables the rollups read (never inferred)."""

from __future__ import annotations

from pyspark.sql import types as T

L, I, S, B = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType()
MONEY = T.DecimalType(20, 2)
TS = T.TimestampNTZType()


def _s(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SCHEMAS: dict[str, T.StructType] = {
    "contribution": _s(
        ("id", L), ("contact_id", L), ("total_amount", MONEY), ("receive_date", TS),
        ("contribution_status_id", I), ("financial_type_id", I),
    ),
    "contribution_soft": _s(("contribution_id", L), ("contact_id", L), ("amount", MONEY)),
    "relationship": _s(
        ("contact_id_a", L), ("contact_id_b", L), ("relationship_type_id", I), ("is_active", B),
    ),
    "relationship_type": _s(("id", I), ("name_a_b", S), ("label_a_b", S), ("label_b_a", S)),
    "participant": _s(("contact_id", L), ("event_id", L), ("status_id", I)),
    "event": _s(("id", L), ("start_date", TS), ("event_type_id", I)),
    "grant": _s(("contact_id", L), ("status_id", I), ("grant_type_id", I), ("amount_granted", MONEY)),
    "option_group": _s(("id", I), ("name", S)),
    "option_value": _s(("option_group_id", I), ("value", S), ("label", S)),
    "financial_type": _s(("id", I), ("name", S)),
    "participant_status": _s(("id", I), ("name", S)),
    "event_type": _s(("id", I), ("name", S)),
    "mailing_queue": _s(("id", L), ("contact_id", L), ("job_id", I)),
    "mailing_job": _s(("id", I), ("mailing_id", I), ("start_date", TS)),
    "mailing_delivered": _s(("event_queue_id", L)),
    "mailing_opened": _s(("event_queue_id", L)),
    "mailing_bounce": _s(("event_queue_id", L)),
    "mailing_url_open": _s(("event_queue_id", L)),
    "mailing_trackable_url": _s(("id", L), ("mailing_id", I)),
}

# Tables a deployment may lack (the grant component can be disabled, lookup
# tables for the parent's lists may be absent): loaders give an empty frame.
OPTIONAL = {
    "grant", "option_group", "option_value", "relationship_type", "financial_type",
    "participant_status", "event_type",
}
