"""Randomised check against a plain-Python brute force that follows the
row-level semantics literally (per contact: scan every row, UNION ALL both
edge directions, fan-out of the soft-credit join), on small random tables
with self-edges, parallel edges, inactive/NULL edges, NULL dates and
unlisted types and statuses."""

import datetime as dt
import random
from decimal import Decimal as D

import pytest

from fixtures import GOLDEN_CFG
from kinsum.functions.periods import fiscal_year_bounds
from kinsum.operators import contributions, related, soft
from kinsum.sources.crm import Sources

CFG = GOLDEN_CFG  # as_of 2025-03-15, FY from 1 July, own types {1,2}, related {1}, edge types {10}


def random_tables(seed):
    r = random.Random(seed)
    contacts = list(range(1, 13))
    dates = [None, dt.datetime(2022, 12, 31, 23), dt.datetime(2023, 3, 1), dt.datetime(2024, 2, 29),
             dt.datetime(2024, 6, 30, 23, 59), dt.datetime(2024, 7, 1), dt.datetime(2024, 12, 31),
             dt.datetime(2025, 1, 1), dt.datetime(2025, 6, 30, 12), dt.datetime(2025, 7, 1)]
    contrib = [
        (i, r.choice(contacts), D(r.randint(1, 500)), r.choice(dates), r.choice([1, 1, 1, 2]), r.choice([1, 1, 2, 3]))
        for i in range(1, 41)
    ]
    soft_rows = [(r.randint(1, 40), r.choice(contacts), D(r.randint(1, 50))) for _ in range(30)]
    edges = [(r.choice(contacts), r.choice(contacts), r.choice([10, 10, 10, 99]), r.choice([True, True, False, None]))
             for _ in range(25)]
    edges += [edges[0], (5, 5, 10, True)]  # a parallel edge and a self-edge
    return contrib, soft_rows, edges


def window_tests(cfg):
    y = cfg.as_of.year
    b0, e0 = fiscal_year_bounds(cfg, 0)
    b1, e1 = fiscal_year_bounds(cfg, 1)

    def day(d):
        return None if d is None else d.date()

    return {
        "this_calendar_year": lambda d: d is not None and d.year == y,
        "last_calendar_year": lambda d: d is not None and d.year == y - 1,
        "year_before_last_calendar_year": lambda d: d is not None and d.year == y - 2,
        "this_fiscal_year": lambda d: d is not None and b0 <= day(d) <= e0,
        "last_fiscal_year": lambda d: d is not None and b1 <= day(d) <= e1,
        "alltime": lambda d: True,
    }


def brute(contrib, soft_rows, edges, cfg):
    win = window_tests(cfg)
    own_ok = lambda c: c[4] == 1 and c[5] in cfg.financial_type_ids
    rel_ok = lambda c: c[4] == 1 and c[5] in cfg.related_financial_type_ids
    out = {}
    for x in sorted({c[1] for c in contrib}):
        m = {}
        for k, w in (("contribution_total_this_calendar_year", "this_calendar_year"),
                     ("contribution_total_last_calendar_year", "last_calendar_year"),
                     ("contribution_total_calendar_year_before_last", "year_before_last_calendar_year")):
            m[k] = sum((c[2] for c in contrib if c[1] == x and own_ok(c) and win[w](c[3])), D(0))
        m["contribution_count_distinct_years"] = len({c[3].year for c in contrib if c[1] == x and own_ok(c) and c[3]})
        # contribution LEFT JOIN soft: one row per soft row, or one with NULLs
        hs = D(0)
        for c in contrib:
            if not own_ok(c):
                continue
            softs = [s for s in soft_rows if s[0] == c[0]] or [None]
            for s in softs:
                if c[1] == x or (s is not None and s[1] == x):
                    hs += c[2]
        m["hard_and_soft"] = hs
        # UNION ALL of both directions, then the filters, grouped by "me"
        directed = [(a, b, t, act) for a, b, t, act in edges] + [(b, a, t, act) for a, b, t, act in edges]
        for w in win:
            rows = [c[2] for me, other, t, act in directed if me == x and act and t in cfg.relationship_type_ids
                    for c in contrib if c[1] == other and rel_ok(c) and win[w](c[3])]
            own = [c[2] for c in contrib if c[1] == x and rel_ok(c) and win[w](c[3])]
            m[f"relatedcontrib_{w}"] = sum(rows, D(0)) if rows else None
            m[f"relatedcontrib_plusme_{w}"] = sum(rows + own, D(0)) if rows or own else None
        out[x] = m
    soft_out = {}
    for x in sorted({s[1] for s in soft_rows}):
        m = {}
        for k, w in (("soft_total_this_calendar_year", "this_calendar_year"),
                     ("soft_total_last_calendar_year", "last_calendar_year"),
                     ("soft_total_last_fiscal_year", "last_fiscal_year")):
            ids = {c[0] for c in contrib if own_ok(c) and win[w](c[3])}
            m[k] = sum((s[2] for s in soft_rows if s[1] == x and s[0] in ids), D(0))
        soft_out[x] = m
    return out, soft_out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    contrib, soft_rows, edges = random_tables(seed)
    src = Sources.from_rows(spark, contribution=contrib, contribution_soft=soft_rows, relationship=edges)
    want, want_soft = brute(contrib, soft_rows, edges, CFG)
    got = {r["entity_id"]: r.asDict() for r in contributions.build(src, CFG, contributions.KEYS + related.KEYS).collect()}
    assert set(got) == set(want)
    for x, m in want.items():
        for k, v in m.items():
            g = got[x][k]
            assert (g is None and v is None) or (g is not None and v is not None and D(g) == D(v)), (seed, x, k, g, v)
    got_soft = {r["entity_id"]: r.asDict() for r in soft.build(src, CFG).collect()}
    assert set(got_soft) == set(want_soft)
    for x, m in want_soft.items():
        for k, v in m.items():
            assert D(got_soft[x][k]) == v, (seed, x, k)


def _round_half_up(o, d):
    if d == 0:
        return 0.0
    q = (D(o) / D(d) * 100).quantize(D("0.01"), rounding="ROUND_HALF_UP")
    return float(q) + 0.0


@pytest.mark.parametrize("seed", [4, 5])
def test_mail_rates_against_brute_force(spark, seed):
    from kinsum.operators import mailings

    r = random.Random(seed)
    contacts = list(range(1, 9))
    jobs = [(j, r.choice([100, 200, 300]), r.choice([dt.datetime(2024, 3, 14, 23), dt.datetime(2024, 3, 15), dt.datetime(2025, 1, 1)]))
            for j in range(1, 5)]
    queue = [(q, r.choice(contacts), r.randint(1, 5)) for q in range(1, 30)]  # job 5 does not exist
    pick = lambda n: [(r.randint(1, 32),) for _ in range(n)]  # noqa: E731 - some ids have no queue row
    delivered, opened, bounce, url_open = pick(25), pick(20), pick(8), pick(12)
    links = [(1, 100), (2, 100), (3, 300)]
    src = Sources.from_rows(spark, mailing_queue=queue, mailing_job=jobs, mailing_delivered=delivered,
                            mailing_opened=opened, mailing_bounce=bounce, mailing_url_open=url_open,
                            mailing_trackable_url=links)
    since = dt.datetime(CFG.as_of.year - 1, CFG.as_of.month, CFG.as_of.day)
    job = {j[0]: j for j in jobs}
    n_links = {m: sum(1 for l in links if l[1] == m) for m in (100, 200, 300)}

    def per_contact(events, keep=lambda q: True, weight=lambda q: 1):
        out = {}
        for (qid,) in events:
            for q in queue:
                if q[0] == qid and keep(q):
                    out[q[1]] = out.get(q[1], 0) + weight(q)
        return out

    in_window = lambda q: q[2] in job and job[q[2]][2] >= since
    with_links = lambda q: q[2] in job and n_links[job[q[2]][1]] > 0
    link_weight = lambda q: n_links[job[q[2]][1]]
    cases = {
        "mail_openrate_alltime": (per_contact(delivered), per_contact(opened), per_contact(bounce)),
        "mail_openrate_last12months": (per_contact(delivered, in_window), per_contact(opened, in_window), per_contact(bounce, in_window)),
        "mail_clickrate_alltime": (per_contact(delivered, with_links, link_weight), per_contact(url_open),
                                   per_contact(bounce, with_links, link_weight)),
    }
    for key, (s, o, b) in cases.items():
        want = {x: _round_half_up(o.get(x, 0), s[x] - b.get(x, 0)) for x in s if s[x] > 0}
        got = {row["entity_id"]: row[key] for row in mailings.build(src, CFG, [key]).collect()}
        assert got == want, (seed, key)


@pytest.mark.parametrize("seed", [6, 7])
def test_events_and_grants_against_brute_force(spark, seed):
    from kinsum.operators import attendance, grants

    r = random.Random(seed)
    contacts = list(range(1, 9))
    events = [(e, r.choice([None, dt.datetime(2019, 1, 1), dt.datetime(2020, 5, 1), dt.datetime(2021, 1, 1)]), r.choice([1, 1, 5]))
              for e in range(1, 8)]
    participants = [(r.choice(contacts), r.randint(1, 9), r.choice([1, 2, 3])) for _ in range(25)]  # events 8, 9 missing
    option_group = [(1, "grant_type"), (2, "grant_status")]
    option_value = [(1, "1", "Beta"), (1, "2", "Alpha"), (1, "2", "Alpha"), (1, "3", "Gamma"), (1, "3.0", "Delta"),
                    (1, "x", "Junk"), (2, "1", "Open")]
    grant_rows = [(r.choice(contacts), r.choice([1, 2]), r.choice([1, 2, 3, 4]), r.choice([None, D(r.randint(1, 99))]))
                  for _ in range(25)]
    src = Sources.from_rows(spark, event=events, participant=participants, grant=grant_rows,
                            option_group=option_group, option_value=option_value)
    cfg = CFG
    ev = {e[0]: e for e in events}

    # E1: ORDER BY start_date ASC (NULL first) LIMIT 1 over matching rows
    want_e1 = {}
    for x in {p[0] for p in participants}:
        starts = [ev[p[1]][1] for p in participants
                  if p[0] == x and p[2] in cfg.participant_status_ids and p[1] in ev and ev[p[1]][2] in cfg.event_type_ids]
        want_e1[x] = None if not starts or any(s is None for s in starts) else min(starts)
    got_e1 = {row["entity_id"]: row["event_first_attended_date"] for row in attendance.build(src, cfg).collect()}
    assert got_e1 == want_e1

    # G1-G3: numeric comparison of option text with the type id; distinct labels, sorted
    def match(g):
        return g[1] in cfg.grant_status_ids and g[2] in cfg.grant_type_ids

    def labels(type_id):
        out = []
        for gid, value, label in option_value:
            try:
                num = float(value)
            except ValueError:
                continue
            if gid == 1 and num == type_id:
                out.append(label)
        return out

    got = {row["entity_id"]: row.asDict() for row in grants.build(src, cfg).collect()}
    for x in {g[0] for g in grant_rows}:
        mine = [g for g in grant_rows if g[0] == x and match(g)]
        assert got[x]["grant_count_received"] == len(mine)
        assert D(got[x]["grant_total_received"]) == sum((g[3] for g in mine if g[3] is not None), D(0))
        lab = sorted({lbl for g in mine for lbl in labels(g[2])})
        assert got[x]["grant_types_received"] == (", ".join(lab) if lab else None)
