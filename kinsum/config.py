"""Explicit configuration for every rollup.

Nothing here reads global state: the reference date, the fiscal-year start and
all seven id lists are plain values.  An id list of ``None`` (or empty) means
"every id currently known to the matching lookup table" (resolved lazily, as a
semi-join, by :mod:`kinsum.sources.lookups`), which is not the same thing as
"no filter": NULL or unknown ids are still dropped.
"""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass, field, fields, replace


def _ids(v):
    if v is None:
        return None
    v = tuple(int(x) for x in v)
    return v or None


@dataclass(frozen=True)
class RollupConfig:
    as_of: dt.date
    fiscal_year_start: tuple[int, int] = (1, 1)  # (month, day)
    # own financial types (C*, S*)
    financial_type_ids: tuple[int, ...] | None = None
    # related-contact family (R*, P*)
    related_financial_type_ids: tuple[int, ...] | None = None
    relationship_type_ids: tuple[int, ...] | None = None
    # grants (G*)
    grant_status_ids: tuple[int, ...] | None = None
    grant_type_ids: tuple[int, ...] | None = None
    # events (E1)
    participant_status_ids: tuple[int, ...] | None = None
    event_type_ids: tuple[int, ...] | None = None
    # Q1: related metrics give NULL when nothing matches (batch form); "zero"
    # gives the 0 of the reference's incremental statements.
    related_empty: str = "null"
    # who has a related total: "donors" (contacts found in contribution, the batch
    # population) or "edges" (also every contact with an active listed edge)
    related_population: str = "donors"
    # Q2: plus-me metrics count a donor once per edge (batch form); True counts
    # each (contact, donor) pair once, like the reference's contribution-change
    # statements (a self-edge still adds the contact's own total twice)
    dedupe_donors: bool = False
    # M3: the SQL counts link-multiplied rows; True counts emails with links
    distinct_links: bool = False
    # Q8: G3 label DISTINCT/ORDER BY in binary order ("binary") or ignoring
    # case like a case-insensitive collation ("nocase"; keeps the smallest
    # spelling of each label)
    label_order: str = "binary"
    # metric keys to compute (FLT9); None = all registered
    active: tuple[str, ...] | None = None
    extra: dict = field(default_factory=dict, compare=False, hash=False)

    def __post_init__(self):
        as_of = self.as_of
        if isinstance(as_of, str):
            as_of = dt.date.fromisoformat(as_of)
        if isinstance(as_of, dt.datetime):
            as_of = as_of.date()
        object.__setattr__(self, "as_of", as_of)
        for name in (
            "financial_type_ids",
            "related_financial_type_ids",
            "relationship_type_ids",
            "grant_status_ids",
            "grant_type_ids",
            "participant_status_ids",
            "event_type_ids",
        ):
            object.__setattr__(self, name, _ids(getattr(self, name)))
        if self.related_empty not in ("null", "zero"):
            raise ValueError("related_empty must be 'null' or 'zero'")
        if self.related_population not in ("donors", "edges"):
            raise ValueError("related_population must be 'donors' or 'edges'")
        if self.label_order not in ("binary", "nocase"):
            raise ValueError("label_order must be 'binary' or 'nocase'")
        if self.active is not None:
            object.__setattr__(self, "active", tuple(self.active))

    def with_(self, **kw) -> "RollupConfig":
        return replace(self, **kw)

    def settings(self) -> str:
        """The date and options that values depend on, as JSON, to be stored with a table
        (``active`` and ``extra`` choose columns and are left out)."""
        values = {f.name: getattr(self, f.name) for f in fields(self) if f.name not in ("active", "extra")}
        return json.dumps(values, sort_keys=True, default=str)
