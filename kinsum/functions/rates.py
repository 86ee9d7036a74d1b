"""Exact mailing rate (SC4/AG9).

``ROUND(COALESCE(o / NULLIF(s - b, 0), 0) * 100, 2)`` on integer counts.  The
quotient is taken in decimal arithmetic (no binary rounding), ``round`` is
HALF_UP (away from zero for negatives, like MySQL), and a zero denominator gives
0.  ANSI mode raises on ``x / 0``, so ``nullif`` is required.  Output is double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(opened: Column, sent: Column, bounced: Column) -> Column:
    o = F.coalesce(opened, F.lit(0)).cast("decimal(20,0)")
    d = (F.coalesce(sent, F.lit(0)) - F.coalesce(bounced, F.lit(0))).cast("decimal(20,0)")
    q = F.coalesce(o / F.nullif(d, F.lit(0).cast("decimal(20,0)")), F.lit(0))
    return F.round(q * 100, 2).cast("double")
