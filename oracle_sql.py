"""DuckDB oracle queries for the registered Spark queries, written from the metric
definitions.

Donations are classified once (does it count, on which day) and aggregated per contact;
``hard_and_soft`` adds up credits (a donor's own ones and those of soft contacts);
grants are counted by contact and type first; mail rates weigh one tagged list of
events per queue row.  Related-contact sums join live edges, one row a direction, to what
each contact gave.  All run over the ``crm_*`` views of
:data:`kinsum.sources.testdata.DUCKDB_VIEWS`.

Money is cast to DOUBLE (Spark does the same at its boundary).  Rates use
exact integer arithmetic: round_half_up(100 * o / d, 2) = floor((20000 * o + d)
/ (2 * d)) / 100 for d > 0, sign-mirrored for d < 0, and 0 for d = 0.
"""

from __future__ import annotations

import datetime as dt

from kinsum.config import RollupConfig
from kinsum.functions.periods import fiscal_year_bounds
from kinsum.sources.testdata import AFTER_YEAR_ENDS, MAIL_CONFIG, OTHER_DATE, TESTDATA_CONFIG, with_views

# --- building blocks -------------------------------------------------------


def _date(x: dt.date) -> str:
    return f"DATE '{x.isoformat()}'"


def _list(ids) -> str:
    return ", ".join(str(i) for i in ids)


def _fin_types(cfg: RollupConfig, related: bool = False) -> str:
    ids = cfg.related_financial_type_ids if related else cfg.financial_type_ids
    if ids is None:  # every known type: the priorities present in orders
        return "SELECT DISTINCT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) FROM orders"
    return _list(ids)


def _option_ids(cfg: RollupConfig, group: str) -> str:
    ids = cfg.grant_status_ids if group == "grant_status" else cfg.grant_type_ids
    if ids is None:  # every id the option group knows
        return (
            "SELECT TRY_CAST(v.value AS INTEGER) FROM crm_option_value v, crm_option_group g "
            f"WHERE g.id = v.option_group_id AND g.name = '{group}'"
        )
    return _list(ids)


def _edge_types(cfg: RollupConfig) -> str:
    if cfg.relationship_type_ids is None:
        return "SELECT id FROM crm_relationship_type WHERE coalesce(name_a_b, '') NOT IN ('', '0')"
    return _list(cfg.relationship_type_ids)


def _in_window(col: str, cfg: RollupConfig, window: str) -> str:
    """Date test of one named window, written as the plain date predicate."""
    this_year = f"year({_date(cfg.as_of)})"
    fy_begin, fy_end = fiscal_year_bounds(cfg, 0)
    day = f"CAST({col} AS DATE)"
    if window == "this_calendar_year":
        return f"year({day}) = {this_year}"
    if window == "last_calendar_year":
        return f"year({day}) = {this_year} - 1"
    if window == "year_before_last_calendar_year":
        return f"year({day}) = year({_date(cfg.as_of)} - INTERVAL 2 YEAR)"
    if window == "this_fiscal_year":
        return f"{day} BETWEEN {_date(fy_begin)} AND {_date(fy_end)}"
    if window == "last_fiscal_year":
        return f"{day} BETWEEN {_date(fy_begin)} - INTERVAL 1 YEAR AND {_date(fy_end)} - INTERVAL 1 YEAR"
    if window == "fiscal_year_before_last":
        return f"{day} BETWEEN {_date(fy_begin)} - INTERVAL 2 YEAR AND {_date(fy_end)} - INTERVAL 2 YEAR"
    if window == "alltime":
        return "TRUE"
    raise KeyError(window)


# --- contribution and soft-credit metrics ---------------------------------

_CAL = {
    "contribution_total_this_calendar_year": "this_calendar_year",
    "contribution_total_last_calendar_year": "last_calendar_year",
    "contribution_total_calendar_year_before_last": "year_before_last_calendar_year",
    "contribution_total_this_year": "this_fiscal_year",
    "contribution_total_last_year": "last_fiscal_year",
    "contribution_total_year_before_last": "fiscal_year_before_last",
}
_SOFT = {
    "soft_total_this_calendar_year": "this_calendar_year",
    "soft_total_last_calendar_year": "last_calendar_year",
    "soft_total_last_fiscal_year": "last_fiscal_year",
    "soft_total_this_year": "this_fiscal_year",
}


def _own_completed(alias: str, cfg: RollupConfig, related: bool = False) -> str:
    return f"{alias}.contribution_status_id = 1 AND {alias}.financial_type_id IN ({_fin_types(cfg, related)})"


def _gifts(cfg, window="alltime"):
    """Donations with their day and whether they count in a window."""
    return f"""gifts AS (
        SELECT d.id, d.contact_id, d.total_amount AS amount, CAST(d.receive_date AS DATE) AS day,
               coalesce({_own_completed('d', cfg)} AND {_in_window('d.receive_date', cfg, window)}, FALSE) AS counts
        FROM crm_contribution d)"""


def _contribution_total(cfg, key):
    return f"""WITH {_gifts(cfg, _CAL[key])}
        SELECT contact_id AS entity_id, CAST(sum(if(counts, amount, 0)) AS DOUBLE) AS {key} FROM gifts WHERE contact_id IS NOT NULL GROUP BY contact_id"""


def _distinct_years(cfg, key):
    return f"""WITH {_gifts(cfg)},
        per_year AS (SELECT contact_id, year(day) AS y, max(if(counts, 1, 0)) AS hit FROM gifts GROUP BY ALL)
        SELECT contact_id AS entity_id, CAST(sum(if(y IS NULL, 0, hit)) AS BIGINT) AS {key} FROM per_year WHERE contact_id IS NOT NULL GROUP BY contact_id"""


def _hard_and_soft(cfg, key):
    # a donor is credited once for each soft credit of the donation (once without any),
    # another contact once for each of its own
    return f"""WITH {_gifts(cfg)},
        shares AS (SELECT contribution_id, contact_id, count(*) AS n FROM crm_soft_credit GROUP BY ALL),
        per_gift AS (SELECT contribution_id, sum(n) AS n FROM shares GROUP BY contribution_id),
        credits AS (
          SELECT g.contact_id, g.amount * coalesce(p.n, 1) AS credit
          FROM gifts g LEFT JOIN per_gift p ON p.contribution_id = g.id WHERE g.counts
          UNION ALL
          SELECT s.contact_id, g.amount * s.n
          FROM shares s JOIN gifts g ON g.id = s.contribution_id
          WHERE g.counts AND s.contact_id IS DISTINCT FROM g.contact_id),
        per_contact AS (SELECT contact_id, sum(credit) AS credit FROM credits GROUP BY contact_id)
        SELECT p.contact_id AS entity_id, CAST(coalesce(c.credit, 0) AS DOUBLE) AS {key}
        FROM (SELECT contact_id FROM gifts WHERE contact_id IS NOT NULL GROUP BY contact_id) p LEFT JOIN per_contact c ON c.contact_id = p.contact_id"""


def _soft_total(cfg, key):
    return f"""WITH {_gifts(cfg, _SOFT[key])}
        SELECT s.contact_id AS entity_id, CAST(sum(if(coalesce(g.counts, FALSE), coalesce(s.amount, 0), 0)) AS DOUBLE) AS {key}
        FROM crm_soft_credit s LEFT JOIN gifts g ON g.id = s.contribution_id WHERE s.contact_id IS NOT NULL GROUP BY s.contact_id"""


# --- related-contact metrics ----------------------------------------------

_DIRECTED = """(SELECT contact_id_a AS person, contact_id_b AS partner, relationship_type_id AS rtype, is_active AS active
         FROM crm_relationship
         UNION ALL
         SELECT contact_id_b, contact_id_a, relationship_type_id, is_active FROM crm_relationship)"""


def _bonds(cfg):
    """Live edges, one row for each direction."""
    return f"""bond AS (SELECT d.person, d.partner FROM {_DIRECTED} d
                      WHERE d.active AND d.rtype IN ({_edge_types(cfg)}) AND d.person IS NOT NULL)"""


def _given(cfg, **windows):
    """What each contact gave to the related types: one sum for each window."""
    sums = ", ".join(f"sum(total_amount) FILTER (WHERE {_in_window('g.receive_date', cfg, w)}) AS {name}" for name, w in windows.items())
    return f"given AS (SELECT contact_id, {sums} FROM crm_contribution g WHERE {_own_completed('g', cfg, related=True)} GROUP BY contact_id)"


def _either(a, b):
    return f"CASE WHEN {a} IS NOT NULL OR {b} IS NOT NULL THEN coalesce({a}, 0) + coalesce({b}, 0) END"


def _related(cfg, key, window, plus_me, distinct_donors=False):
    pairs = "SELECT DISTINCT person, partner FROM bond" if distinct_donors else "SELECT person, partner FROM bond"
    value = "b.brought"
    if plus_me:
        value = _either("b.brought", "o.sums")
    if cfg.related_empty == "zero":
        value = f"coalesce({value}, 0)"
    return f"""WITH {_bonds(cfg)}, {_given(cfg, sums=window)},
        by_partners AS (SELECT person, sum(sums) AS brought FROM ({pairs}) p JOIN given ON contact_id = partner GROUP BY person),
        donors AS (SELECT contact_id FROM crm_contribution WHERE contact_id IS NOT NULL GROUP BY contact_id)
        SELECT d.contact_id AS entity_id, CAST({value} AS DOUBLE) AS {key}
        FROM donors d LEFT JOIN by_partners b ON b.person = d.contact_id LEFT JOIN given o ON o.contact_id = d.contact_id"""


# --- events and grants ----------------------------------------------------


def _first_attended(cfg, key):
    # the earliest date, or none if an attended event has none
    return f"""WITH attended AS (
          SELECT pa.contact_id, ev.start_date FROM crm_participant pa, crm_event ev
          WHERE ev.id = pa.event_id AND pa.status_id IN ({_list(cfg.participant_status_ids)}) AND ev.event_type_id IN ({_list(cfg.event_type_ids)})),
        firsts AS (SELECT contact_id, if(bool_or(start_date IS NULL), NULL, min(start_date)) AS day FROM attended GROUP BY contact_id)
        SELECT p.contact_id AS entity_id, f.day AS {key}
        FROM (SELECT contact_id FROM crm_participant WHERE contact_id IS NOT NULL GROUP BY contact_id) p LEFT JOIN firsts f ON f.contact_id = p.contact_id"""


def _grant(cfg, key):
    by_type = f"""by_type AS (
          SELECT contact_id, grant_type_id, coalesce(status_id IN ({_option_ids(cfg, 'grant_status')}) AND grant_type_id IN ({_option_ids(cfg, 'grant_type')}), FALSE) AS ok,
                 count(*) AS n, sum(amount_granted) AS amount
          FROM crm_grant WHERE contact_id IS NOT NULL GROUP BY ALL)"""
    if key == "grant_count_received":
        return f"WITH {by_type} SELECT contact_id AS entity_id, CAST(sum(if(ok, n, 0)) AS BIGINT) AS {key} FROM by_type GROUP BY contact_id"
    if key == "grant_total_received":
        return f"WITH {by_type} SELECT contact_id AS entity_id, CAST(sum(if(ok, coalesce(amount, 0), 0)) AS DOUBLE) AS {key} FROM by_type GROUP BY contact_id"
    return f"""WITH {by_type},
        names AS (SELECT TRY_CAST(value AS DOUBLE) AS type_id, label FROM crm_option_value
                  WHERE option_group_id IN (SELECT id FROM crm_option_group WHERE name = 'grant_type')),
        named AS (SELECT DISTINCT b.contact_id, names.label FROM by_type b JOIN names ON names.type_id = b.grant_type_id
                  WHERE b.ok AND names.label IS NOT NULL),
        lists AS (SELECT contact_id, array_to_string(list_sort(list(label)), ', ') AS labels FROM named GROUP BY contact_id)
        SELECT p.contact_id AS entity_id, lists.labels AS {key}
        FROM (SELECT contact_id FROM by_type GROUP BY contact_id) p LEFT JOIN lists ON lists.contact_id = p.contact_id"""


# --- mail rates -----------------------------------------------------------


def _rate_expr(o: str, s: str, b: str) -> str:
    d = f"(coalesce({s}, 0) - coalesce({b}, 0))"
    o = f"coalesce({o}, 0)"
    return (
        f"CASE WHEN {d} = 0 THEN 0.0 "
        f"WHEN {d} > 0 THEN ((20000 * {o} + {d}) // (2 * {d})) / 100.0 "
        f"ELSE (-((20000 * {o} - {d}) // (-2 * {d}))) / 100.0 END"
    )


_TAGGED = """tagged AS (
          SELECT event_queue_id AS id, 'sent' AS kind FROM crm_mail_delivered
          UNION ALL SELECT event_queue_id, 'opened' FROM crm_mail_opened
          UNION ALL SELECT event_queue_id, 'bounced' FROM crm_mail_bounce
          UNION ALL SELECT event_queue_id, 'clicked' FROM crm_mail_link_open)"""


def _rates(key, answer, weight="1", answer_weight="1", once=False):
    """Rate of ``answer`` events per delivered and not bounced mail.  Each queue row weighs
    ``weight`` (an expression over its job and number of links); ``once`` counts a
    queue row at most once for each kind of event."""
    n = "least(count(*), 1)" if once else "count(*)"
    return f"""WITH {_TAGGED},
        per_mail AS (SELECT id, kind, {n} AS n FROM tagged GROUP BY id, kind),
        links AS (SELECT mailing_id, count(*) AS n_links FROM crm_mail_link GROUP BY mailing_id),
        mails AS (
          SELECT q.id, q.contact_id, {weight} AS w, {answer_weight} AS aw
          FROM crm_mail_queue q LEFT JOIN crm_mail_job j ON j.id = q.job_id LEFT JOIN links ON links.mailing_id = j.mailing_id),
        sums AS (
          SELECT m.contact_id, sum(if(kind = 'sent', n * w, 0)) AS s, sum(if(kind = '{answer}', n * aw, 0)) AS o, sum(if(kind = 'bounced', n * w, 0)) AS b
          FROM mails m JOIN per_mail USING (id) GROUP BY m.contact_id)
        SELECT contact_id AS entity_id, {_rate_expr('o', 's', 'b')} AS {key} FROM sums WHERE s > 0 AND contact_id IS NOT NULL"""


def _open_rate_alltime(cfg, key):
    return _rates(key, "opened")


def _open_rate_12m(cfg, key):
    recent = f"if(j.start_date >= {_date(cfg.as_of)} - INTERVAL 1 YEAR, 1, 0)"
    return _rates(key, "opened", recent, recent)


def _click_rate(cfg, key, once=False):
    # a mail counts once for each trackable link of its mailing, an opened link once
    links = "coalesce(n_links, 0)"
    return _rates(key, "clicked", f"least({links}, 1)" if once else links, once=once)


# --- entry points ---------------------------------------------------------


def metric_sql(key: str, cfg: RollupConfig) -> str:
    """Body (without the view prefix) of one metric's oracle query."""
    if key in _CAL:
        return _contribution_total(cfg, key)
    if key == "contribution_count_distinct_years":
        return _distinct_years(cfg, key)
    if key == "hard_and_soft":
        return _hard_and_soft(cfg, key)
    if key in _SOFT:
        return _soft_total(cfg, key)
    if key.startswith("relatedcontrib_plusme_"):
        return _related(cfg, key, key.removeprefix("relatedcontrib_plusme_"), plus_me=True)
    if key.startswith("relatedcontrib_"):
        return _related(cfg, key, key.removeprefix("relatedcontrib_"), plus_me=False)
    if key == "event_first_attended_date":
        return _first_attended(cfg, key)
    if key.startswith("grant_"):
        return _grant(cfg, key)
    if key == "mail_openrate_alltime":
        return _open_rate_alltime(cfg, key)
    if key == "mail_openrate_last12months":
        return _open_rate_12m(cfg, key)
    if key == "mail_clickrate_alltime":
        return _click_rate(cfg, key)
    raise KeyError(key)


def wide_sql(keys, cfg: RollupConfig) -> str:
    """Wide table: every contact of any metric's population, one LEFT JOIN per metric."""
    parts = ",\n".join(f"m{i} AS ({metric_sql(k, cfg)})" for i, k in enumerate(keys))
    everyone = " UNION ".join(f"SELECT entity_id FROM m{i}" for i in range(len(keys)))
    cols = ", ".join(f"m{i}.{k}" for i, k in enumerate(keys))
    joins = " ".join(f"LEFT JOIN m{i} ON m{i}.entity_id = everyone.entity_id" for i in range(len(keys)))
    return f"WITH {parts}\nSELECT everyone.entity_id, {cols} FROM ({everyone}) everyone {joins}"


def metric_oracle(key: str, cfg: RollupConfig | None = None) -> str:
    if cfg is None:
        cfg = MAIL_CONFIG if key.startswith("mail_") else TESTDATA_CONFIG
    return with_views(metric_sql(key, cfg))


def _all_keys():
    from kinsum.plans.registry import default_registry

    return default_registry().keys()


def extra_oracles() -> dict[str, str]:
    cfg = TESTDATA_CONFIG
    keys = list(_all_keys())
    fy_begin = fiscal_year_bounds(cfg, 0)[0]
    out: dict[str, str] = {}
    out["relationship_type_labels"] = with_views("""
        SELECT id, coalesce(label_a_b, '') || '/' || coalesce(label_b_a, '') AS label
        FROM crm_relationship_type WHERE coalesce(name_a_b, '') NOT IN ('', '0')""")
    out["option_lookup"] = with_views("""
        SELECT v.value, v.label FROM crm_option_value v
        WHERE v.option_group_id IN (SELECT id FROM crm_option_group WHERE name = 'grant_type')""")
    out["neighbours"] = with_views(f"WITH {_bonds(cfg)} SELECT person AS entity_id, partner AS related_contact_id FROM bond GROUP BY ALL")
    out["affected_by_contribution"] = with_views(f"""
        WITH {_bonds(cfg)},
        new_gift AS (SELECT id, contact_id FROM crm_contribution WHERE receive_date >= {_date(fy_begin)})
        SELECT contact_id AS entity_id FROM new_gift
        UNION SELECT b.person FROM bond b SEMI JOIN new_gift n ON n.contact_id = b.partner
        UNION SELECT sc.contact_id FROM crm_soft_credit sc SEMI JOIN new_gift n ON n.id = sc.contribution_id""")
    out["affected_by_relationship"] = with_views("""
        SELECT contact_id_a AS entity_id FROM crm_relationship WHERE NOT is_active
        UNION SELECT contact_id_b FROM crm_relationship WHERE NOT is_active""")
    out["affected_by_mail_event"] = with_views("""
        SELECT DISTINCT q.contact_id AS entity_id
        FROM crm_mail_link_open x JOIN crm_mail_queue q ON q.id = x.event_queue_id""")
    out["incremental_equals_batch"] = with_views(wide_sql(keys, cfg))
    out["incremental_relationship_equals_batch"] = with_views(wide_sql(keys, cfg))
    out["incremental_delete_equals_batch"] = with_views(wide_sql(keys, cfg))
    out["incremental_moved_equals_batch"] = with_views(wide_sql(keys, cfg))
    out["user_metric_incremental"] = f"""
        SELECT user_id AS entity_id, count(*) AS visit_count FROM events
        WHERE CAST(ts AS DATE) <= {_date(MAIL_CONFIG.as_of)} GROUP BY user_id"""
    out["incremental_mail_equals_batch"] = with_views(wide_sql(keys, MAIL_CONFIG))
    out["population_all"] = with_views(f"SELECT entity_id, grant_types_received FROM ({wide_sql(keys, cfg)}) w")
    out["plusme_distinct_donors"] = with_views(
        _related(cfg.with_(dedupe_donors=True), "relatedcontrib_plusme_alltime", "alltime", True, distinct_donors=True)
    )
    out["related_empty_zero"] = with_views(
        _related(cfg.with_(related_empty="zero"), "relatedcontrib_this_fiscal_year", "this_fiscal_year", False))
    # everyone with a gift or a live edge, and what each live edge or the person itself brings
    edge_population = with_views(f"""
        WITH {_bonds(cfg)}, {_given(cfg, ever='alltime', this_year='this_calendar_year')},
        by_partners AS (SELECT person, sum(ever) AS ever, sum(this_year) AS this_year
                        FROM bond LEFT JOIN given ON contact_id = partner GROUP BY person),
        people AS (SELECT contact_id FROM crm_contribution UNION SELECT person FROM bond)
        SELECT p.contact_id AS entity_id, CAST(b.ever AS DOUBLE) AS relatedcontrib_alltime,
               CAST({_either('b.this_year', 'o.this_year')} AS DOUBLE) AS relatedcontrib_plusme_this_calendar_year,
               CAST({_either('b.ever', 'o.ever')} AS DOUBLE) AS relatedcontrib_plusme_alltime
        FROM people p LEFT JOIN by_partners b ON b.person = p.contact_id LEFT JOIN given o ON o.contact_id = p.contact_id
        WHERE p.contact_id IS NOT NULL""")
    out["related_population_edges"] = out["incremental_edge_population"] = edge_population
    anonymous = "(SELECT * REPLACE (CASE WHEN financial_type_id = 3 THEN NULL ELSE contact_id END AS contact_id) FROM crm_contribution)"
    out["hard_and_soft_anonymous"] = with_views(_hard_and_soft(cfg, "hard_and_soft").replace("crm_contribution d", f"{anonymous} d"))
    additive = [k for k in keys if k in _CAL or k in _SOFT or k in ("hard_and_soft", "contribution_count_distinct_years")]
    out["totals_of_another_date"] = with_views(wide_sql(additive, cfg.with_(as_of=OTHER_DATE)))
    out["signed_delta_equals_batch"] = with_views(wide_sql([*additive, *[k for k in keys if k.startswith("relatedcontrib")]], cfg))
    out["bundle_stream_equals_batch"] = out["lookup_change_equals_batch"] = with_views(wide_sql(keys, cfg))
    out["advance_over_year_ends"] = with_views(wide_sql(keys, cfg.with_(as_of=AFTER_YEAR_ENDS)))
    out["advance_mail_window"] = with_views(wide_sql(keys, cfg.with_(as_of=MAIL_CONFIG.as_of)))
    # emails (queue rows) instead of link-multiplied rows
    out["mail_clickrate_distinct_links"] = with_views(_click_rate(MAIL_CONFIG, "mail_clickrate_alltime", once=True))
    ukeys = ["contribution_total_this_calendar_year", "relatedcontrib_alltime", "mail_openrate_last12months"]
    patch1 = metric_sql("relatedcontrib_alltime", cfg.with_(relationship_type_ids=(5, 6, 7)))
    patch2 = metric_sql("mail_openrate_last12months", MAIL_CONFIG)
    out["upsert_patch"] = with_views(f"""
        WITH before AS ({wide_sql(ukeys, cfg)}), p1 AS ({patch1}), p2 AS ({patch2}),
        after1 AS (
          SELECT coalesce(b.entity_id, p.entity_id) AS entity_id, b.contribution_total_this_calendar_year,
                 CASE WHEN p.entity_id IS NULL THEN b.relatedcontrib_alltime ELSE p.relatedcontrib_alltime END
                   AS relatedcontrib_alltime,
                 b.mail_openrate_last12months
          FROM before b FULL JOIN p1 p ON p.entity_id = b.entity_id)
        SELECT coalesce(a.entity_id, p.entity_id) AS entity_id, a.contribution_total_this_calendar_year,
               a.relatedcontrib_alltime,
               CASE WHEN p.entity_id IS NULL THEN a.mail_openrate_last12months ELSE p.mail_openrate_last12months END
                 AS mail_openrate_last12months
        FROM after1 a FULL JOIN p2 p ON p.entity_id = a.entity_id""")
    gaps = """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice,
                     nullif(l_returnflag, 'A') AS l_returnflag, nullif(l_linestatus, 'F') AS l_linestatus
              FROM lineitem"""
    required = ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_extendedprice"]
    out["contract_not_null"] = f"WITH g AS ({gaps})\n" + "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS violations FROM g" for c in required
    )
    out["contract_defaults"] = f"""
        WITH g AS ({gaps})
        SELECT l_orderkey, l_linenumber, coalesce(l_returnflag, 'N') AS l_returnflag,
               coalesce(l_linestatus, 'O') AS l_linestatus FROM g"""
    out["contract_unique"] = """
        SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem
        WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL
        GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"""
    out["contract_fk"] = """
        SELECT l_partkey, count(*) AS n_rows FROM lineitem
        WHERE l_partkey IS NOT NULL AND l_partkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey IS NOT NULL)
        GROUP BY l_partkey"""
    failing = {
        "l_orderkey": "TRY_CAST(l_orderkey AS BIGINT) IS NULL",
        "l_linenumber": "TRY_CAST(l_linenumber AS INTEGER) IS NULL",
        "l_returnflag": "length(l_returnflag) > 1",
        "l_linestatus": "length(l_linestatus) > 1",
        "l_extendedprice": "TRY_CAST(l_extendedprice AS DECIMAL(7,2)) IS NULL",
        "l_quantity": "TRY_CAST(l_quantity AS DECIMAL(4,1)) IS NULL",
    }
    out["contract_types"] = "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NOT NULL AND {cond}) AS violations FROM lineitem"
        for c, cond in failing.items()
    )
    checks = [f"CASE WHEN {c} IS NOT NULL AND {cond} THEN 'type:{c}' END" for c, cond in failing.items()]
    checks += [f"CASE WHEN {c} IS NULL THEN 'null:{c}' END" for c in ("l_orderkey", "l_linenumber", "l_extendedprice")]
    checks += [
        "CASE WHEN l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL AND count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 THEN 'unique:l_orderkey,l_linenumber' END",
        "CASE WHEN l_partkey IS NOT NULL AND l_partkey NOT IN (SELECT c_custkey FROM customer) THEN 'foreign:l_partkey' END",
        "CASE WHEN l_orderkey IS NOT NULL AND l_orderkey NOT IN (SELECT o_orderkey FROM orders) THEN 'foreign:l_orderkey' END",
    ]
    out["contract_quarantine"] = f"""
        WITH g AS ({gaps}), j AS (SELECT *, concat_ws(';', {', '.join(checks)}) AS errors FROM g)
        SELECT l_orderkey, l_linenumber, coalesce(l_returnflag, 'N') AS l_returnflag, errors FROM j WHERE errors <> ''"""
    return out
