"""Hand-made golden tables (one edge case per row, see FIXTURES.md §3)."""

import datetime as dt
from decimal import Decimal as D

from kinsum.config import RollupConfig
from kinsum.sources.crm import Sources

T = dt.datetime

GOLDEN_CFG = RollupConfig(
    as_of=dt.date(2025, 3, 15),
    fiscal_year_start=(7, 1),
    financial_type_ids=(1, 2),
    related_financial_type_ids=(1,),
    relationship_type_ids=(10,),
    grant_status_ids=(1,),
    grant_type_ids=(1, 2, 3),
    participant_status_ids=(1, 2),
    event_type_ids=(1,),
)

CONTRIBUTION = [
    (1, 1, D("100.00"), T(2025, 1, 10, 9), 1, 1),
    (2, 1, D("50.00"), T(2024, 6, 30, 23, 59, 59), 1, 2),
    (3, 2, D("200.00"), T(2024, 12, 31), 1, 1),
    (4, 2, D("999.00"), T(2025, 2, 1), 2, 1),
    (5, 3, D("30.00"), T(2023, 1, 5), 1, 1),
    (6, 4, D("70.00"), None, 1, 1),
    (7, 5, D("10.00"), T(2025, 1, 1), 1, 9),
]
SOFT = [(1, 2, D("40")), (1, 1, D("60")), (3, 6, D("25")), (4, 6, D("5"))]
RELATIONSHIP = [
    (1, 2, 10, True), (2, 1, 10, True), (1, 3, 10, True), (3, 4, 10, False),
    (1, 4, 99, True), (2, 2, 10, True), (3, 7, 10, True), (5, 2, 10, None),
]
QUEUE = [(1, 1, 1), (2, 1, 1), (3, 1, 2), (4, 2, 1), (5, 3, 1), (6, 4, 2), (7, 5, 1)]
JOB = [(1, 100, T(2024, 3, 14, 23)), (2, 200, T(2024, 3, 15))]
DELIVERED = [(q,) for q in (1, 2, 3, 4, 5, 7)]
OPENED = [(q,) for q in (1, 3, 5, 6, 7, 7)]
BOUNCE = [(q,) for q in (4, 5, 5)]
URLS = [(1, 100), (2, 100)]
URL_OPEN = [(q,) for q in (1, 1, 2, 7)]
PARTICIPANT = [(1, 10, 1), (1, 11, 1), (2, 12, 1), (2, 10, 3), (3, 13, 2), (4, 14, 1)]
EVENT = [(10, T(2020, 5, 1), 1), (11, T(2019, 1, 1), 2), (12, None, 1), (13, T(2021, 1, 1), 1), (14, T(2018, 1, 1), 5)]
GRANT = [
    (1, 1, 1, D("10.00")), (1, 1, 2, D("5.00")), (1, 1, 2, D("1.00")), (1, 2, 1, D("100.00")),
    (2, 2, 1, D("7.00")), (3, 1, 3, None), (3, 1, 4, D("8.00")),
]
OPTION_GROUP = [(1, "grant_type"), (2, "grant_status")]
OPTION_VALUE = [
    (1, "1", "Beta"), (1, "2", "Alpha"), (1, "2", "Alpha"), (1, "3", "Gamma"), (1, "x", "Junk"),
    (2, "1", "Approved"), (2, "2", "Rejected"),
]


def golden_sources(spark) -> Sources:
    return Sources.from_rows(
        spark,
        contribution=CONTRIBUTION,
        contribution_soft=SOFT,
        relationship=RELATIONSHIP,
        mailing_queue=QUEUE,
        mailing_job=JOB,
        mailing_delivered=DELIVERED,
        mailing_opened=OPENED,
        mailing_bounce=BOUNCE,
        mailing_trackable_url=URLS,
        mailing_url_open=URL_OPEN,
        participant=PARTICIPANT,
        event=EVENT,
        grant=GRANT,
        option_group=OPTION_GROUP,
        option_value=OPTION_VALUE,
    )


def as_dict(df, key):
    return {r["entity_id"]: (None if r[key] is None else float(r[key]) if isinstance(r[key], D) else r[key])
            for r in df.collect()}
