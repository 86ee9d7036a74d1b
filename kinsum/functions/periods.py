"""Date windows -> half-open range predicates (FLT4-FLT7, SC1).

Every window is resolved on the driver into constant bounds from the explicit
``as_of`` date, so the predicate is a plain ``start <= d < end`` comparison that
Catalyst can push into the parquet scan.  ``YEAR(CAST(d AS DATE)) = y`` is
rewritten to ``d >= y-01-01 AND d < (y+1)-01-01``; ``CAST(d AS DATE) BETWEEN b
AND e`` to ``d >= b AND d < e + 1 day``.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinsum.config import RollupConfig


def minus_years(d: dt.date, n: int) -> dt.date:
    """``DATE_SUB(d, INTERVAL n YEAR)``: 29 Feb clamps to 28 Feb."""
    y = d.year - n
    try:
        return d.replace(year=y)
    except ValueError:
        return d.replace(year=y, day=28)


def fiscal_year_bounds(cfg: RollupConfig, years_back: int = 0) -> tuple[dt.date, dt.date]:
    """Inclusive (begin, end) of the fiscal year containing ``as_of``, shifted
    back ``years_back`` years with both bounds moved separately (FLT6)."""
    m, d = cfg.fiscal_year_start
    a = cfg.as_of
    year = a.year if (a.month, a.day) >= (m, d) else a.year - 1
    begin = dt.date(year, m, d)
    end = minus_years(begin, -1) - dt.timedelta(days=1)
    if years_back:
        begin, end = minus_years(begin, years_back), minus_years(end, years_back)
    return begin, end


@dataclass(frozen=True)
class Period:
    """Half-open [start, end) on a timestamp/date column; None = unbounded."""

    name: str
    start: dt.date | None = None
    end: dt.date | None = None

    def contains(self, c: Column | str) -> Column:
        c = F.col(c) if isinstance(c, str) else c
        cond = None
        if self.start is not None:
            cond = c >= _ts(self.start)
        if self.end is not None:
            hi = c < _ts(self.end)
            cond = hi if cond is None else cond & hi
        return F.lit(True) if cond is None else cond

    @property
    def unbounded(self) -> bool:
        return self.start is None and self.end is None


def _ts(d: dt.date) -> Column:
    return F.lit(dt.datetime(d.year, d.month, d.day)).cast("timestamp_ntz")


def calendar_year(cfg: RollupConfig, k: int) -> Period:
    y = cfg.as_of.year - k
    return Period(f"calendar_year_minus_{k}", dt.date(y, 1, 1), dt.date(y + 1, 1, 1))


def fiscal_year(cfg: RollupConfig, k: int) -> Period:
    b, e = fiscal_year_bounds(cfg, k)
    return Period(f"fiscal_year_minus_{k}", b, e + dt.timedelta(days=1))


def rolling_year(cfg: RollupConfig) -> Period:
    """``d >= DATE_SUB(as_of, INTERVAL 1 YEAR)``: lower bound only (FLT7)."""
    return Period("last_12_months", minus_years(cfg.as_of, 1), None)


def all_time() -> Period:
    return Period("all_time")


def named(cfg: RollupConfig, name: str) -> Period:
    """Window by the suffix used in metric keys."""
    table = {
        "this_calendar_year": lambda: calendar_year(cfg, 0),
        "last_calendar_year": lambda: calendar_year(cfg, 1),
        "year_before_last_calendar_year": lambda: calendar_year(cfg, 2),
        "this_fiscal_year": lambda: fiscal_year(cfg, 0),
        "last_fiscal_year": lambda: fiscal_year(cfg, 1),
        "alltime": all_time,
    }
    return table[name]()
