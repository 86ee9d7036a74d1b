"""Metric registry (X1-X4, PRJ3, FLT9, POP1).

A metric is declared, not coded into a loop: a :class:`RollupSpec` names its
family builder (which computes any subset of that family's keys in one plan),
its output type and label, and the source tables whose changes affect it.
Users register their own specs; a spec that fails validation is skipped with a
message and the others continue (X3).
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from kinsum.functions.aggregates import restrict
from kinsum.operators import attendance, contributions, grants, mailings, related, soft

log = logging.getLogger(__name__)

DTYPES = {"Money", "Int", "Integer", "Float", "String", "Date"}


@dataclass(frozen=True)
class RollupSpec:
    key: str
    group: str
    label: str
    dtype: str
    family: str
    # source tables whose row changes can change this metric (I1-I8, Q6)
    # - a tuple for the built-in change rules, or a mapping of a table (which may be a
    # user's own) to its rule fn(src, changes) -> DataFrame[entity_id], None for the
    # built-in one
    depends_on: tuple[str, ...] | Mapping[str, Callable | None] = field(default_factory=tuple, hash=False)

    def validate(self, families: dict) -> None:
        if not self.key or not self.key.isidentifier():
            raise ValueError(f"bad metric key {self.key!r}")
        if self.dtype not in DTYPES:
            raise ValueError(f"{self.key}: unknown data type {self.dtype!r}")
        if self.family not in families:
            raise ValueError(f"{self.key}: unknown family {self.family!r}")


# family name -> builder(src, cfg, keys) -> DataFrame[entity_id, keys...]
FAMILIES: dict[str, Callable] = {
    "contributions": contributions.build,
    "soft": soft.build,
    "related": related.build,
    "attendance": attendance.build,
    "grants": grants.build,
    "mailings": mailings.build,
}

# The user-facing labels and option groups of the metrics.  The four totals
# of "this year" and the years before carry the overriding fiscal-year labels (PRJ3).
_OWN = ("contribution", "financial_type")
_CONTRIB = ("contribution", "contribution_soft", "financial_type")
_REL = ("contribution", "relationship", "financial_type", "relationship_type")
_GRANT = ("grant", "option_value", "option_group")
_MAIL = ("mailing_delivered", "mailing_opened", "mailing_bounce", "mailing_queue", "mailing_job")
_CLICK = ("mailing_delivered", "mailing_url_open", "mailing_bounce", "mailing_queue", "mailing_job", "mailing_trackable_url")
_BUILTIN = [
    RollupSpec("contribution_total_this_calendar_year", "fundraising", "Total Contributions this Calendar Year", "Money", "contributions", _OWN),
    RollupSpec("contribution_total_last_calendar_year", "fundraising", "Total Contributions last Calendar Year", "Money", "contributions", _OWN),
    RollupSpec("contribution_total_calendar_year_before_last", "fundraising", "Total Contributions Calendar Year Before Last", "Money", "contributions", _OWN),
    RollupSpec("contribution_total_this_year", "fundraising", "Total Contributions this Fiscal Year", "Money", "contributions", _OWN),
    RollupSpec("contribution_total_last_year", "fundraising", "Total Contributions last Fiscal Year", "Money", "contributions", _OWN),
    RollupSpec("contribution_total_year_before_last", "fundraising", "Total Contributions Fiscal Year Before Last", "Money", "contributions", _OWN),
    RollupSpec("contribution_count_distinct_years", "fundraising", "Number of Years of Contributions", "Integer", "contributions", _OWN),
    RollupSpec("hard_and_soft", "fundraising", "Lifetime contributions + soft credits", "Money", "contributions", _CONTRIB),
    RollupSpec("soft_total_this_calendar_year", "soft", "Total Soft Credits this Calendar Year", "Money", "soft", _CONTRIB),
    RollupSpec("soft_total_last_calendar_year", "soft", "Total Soft Credits last Calendar Year", "Money", "soft", _CONTRIB),
    RollupSpec("soft_total_last_fiscal_year", "soft", "Total Soft Credits last Fiscal Year", "Money", "soft", _CONTRIB),
    RollupSpec("soft_total_this_year", "soft", "Total Soft Credits this Fiscal Year", "Money", "soft", _CONTRIB),
    RollupSpec("relatedcontrib_this_fiscal_year", "relatedcontrib", "Related contact contributions this fiscal year", "Money", "contributions", _REL),
    RollupSpec("relatedcontrib_last_fiscal_year", "relatedcontrib", "Related contact contributions last fiscal year", "Money", "contributions", _REL),
    RollupSpec("relatedcontrib_this_calendar_year", "relatedcontrib", "Related contact contributions this calendar year", "Money", "contributions", _REL),
    RollupSpec("relatedcontrib_last_calendar_year", "relatedcontrib", "Related contact contributions last calendar year", "Money", "contributions", _REL),
    RollupSpec("relatedcontrib_year_before_last_calendar_year", "relatedcontrib", "Related contact contributions year before last calendar year", "Money", "contributions", _REL),
    RollupSpec("relatedcontrib_alltime", "relatedcontrib", "Related contact contributions all time", "Money", "contributions", _REL),
    RollupSpec("relatedcontrib_plusme_this_fiscal_year", "relatedcontrib", "Combined contact & related contact contributions this fiscal year", "Money", "contributions", _REL),
    RollupSpec("relatedcontrib_plusme_last_fiscal_year", "relatedcontrib", "Combined contact & related contact contributions last fiscal year", "Money", "contributions", _REL),
    RollupSpec("relatedcontrib_plusme_this_calendar_year", "relatedcontrib", "Combined contact & related contact contributions this calendar year", "Money", "contributions", _REL),
    RollupSpec("relatedcontrib_plusme_last_calendar_year", "relatedcontrib", "Combined contact & related contact contributions last calendar year", "Money", "contributions", _REL),
    RollupSpec("relatedcontrib_plusme_year_before_last_calendar_year", "relatedcontrib", "Combined contact & related contact contributions year before last calendar year", "Money", "contributions", _REL),
    RollupSpec("relatedcontrib_plusme_alltime", "relatedcontrib", "Combined contact & related contact contributions all time", "Money", "contributions", _REL),
    RollupSpec("event_first_attended_date", "events", "Date of the first attended event", "Date", "attendance", ("participant", "event", "participant_status", "event_type")),
    RollupSpec("grant_count_received", "grants", "Total number of grants received", "Int", "grants", _GRANT),
    RollupSpec("grant_total_received", "grants", "Total amount in grants received", "Money", "grants", _GRANT),
    RollupSpec("grant_types_received", "grants", "Grant types received", "String", "grants", _GRANT),
    RollupSpec("mail_openrate_alltime", "mailings", "Open rate rate all time", "Float", "mailings", _MAIL),
    RollupSpec("mail_openrate_last12months", "mailings", "Open rate rate last 12 months", "Float", "mailings", _MAIL),
    RollupSpec("mail_clickrate_alltime", "mailings", "Click-through rate all time", "Float", "mailings", _CLICK),
]

class Registry:
    def __init__(self, specs=(), families=None):
        self.families = dict(families or FAMILIES)
        self.specs: dict[str, RollupSpec] = {}
        self.skipped: dict[str, str] = {}
        for s in specs:
            self.register(s)

    def register(self, spec: RollupSpec) -> bool:
        try:
            spec.validate(self.families)
        except ValueError as e:
            log.warning("skipping metric: %s", e)
            self.skipped[spec.key] = str(e)
            return False
        self.specs[spec.key] = spec
        return True

    def keys(self) -> list[str]:
        return list(self.specs)

    def select(self, keys=None) -> list[RollupSpec]:
        """FLT9: the active metrics, in registry order; unknown keys are
        reported in ``skipped`` and ignored."""
        if keys is None:
            return list(self.specs.values())
        out = []
        for k in keys:
            if k in self.specs:
                out.append(self.specs[k])
            else:
                self.skipped[k] = "not registered"
        return out

    def by_family(self, keys=None) -> dict[str, list[str]]:
        fam: dict[str, list[str]] = {}
        for s in self.select(keys):
            fam.setdefault(s.family, []).append(s.key)
        return fam

    def change_rules(self, table: str, keys=None) -> list[Callable]:
        """The change rules that active metrics declare for ``table`` (X1)."""
        own = (s.depends_on.get(table) for s in self.select(keys) if isinstance(s.depends_on, Mapping))
        return [fn for fn in own if fn is not None]

    def dependents(self, table: str, keys=None) -> list[str]:
        return [s.key for s in self.select(keys) if table in s.depends_on]


def sql_family(query: str, tables: tuple[str, ...], args: Callable | None = None) -> Callable:
    """X2: a family whose metrics are columns of a SQL query over source tables, written
    ``{table}``, with named parameters: ``:as_of`` and what ``args(cfg)`` gives.  The
    query gives ``entity_id`` and one column per key."""

    def build(src, cfg, keys, contacts=None):
        values = {"as_of": cfg.as_of, **(args(cfg) if args else {})}
        df = src.spark.sql(query, args=values, **{t: src[t] for t in tables})
        return restrict(df.select("entity_id", *keys), "entity_id", contacts)

    return build


def default_registry() -> Registry:
    return Registry(_BUILTIN)
