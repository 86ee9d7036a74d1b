"""Aggregate building blocks with the reference's NULL-vs-0 rules.

* AG1 ``coalesce(sum(x), 0)`` -> :func:`sum_or_zero`
* AG2 ``coalesce(sum(x))`` (one argument) -> plain ``sum`` (NULL on no rows)
* AG3 ``coalesce(sum(x), 0)`` under GROUP BY in a scalar subquery -> NULL when
  the group is absent; callers left-join a plain ``sum`` onto the population.
* AG6 ordered distinct concat: see :mod:`kinsum.operators.grants`
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(20,2)"
HALF = 10**10


def sum_if(cond: Column, x: Column) -> Column:
    """Sum of ``x`` over rows where ``cond`` holds; NULL if none."""
    return F.sum(F.when(cond, x))


def sum_or_zero(cond: Column, x: Column) -> Column:
    return F.coalesce(sum_if(cond, x), F.lit(0).cast(MONEY))


def halves(x: Column) -> tuple[Column, Column]:
    """``x`` (a money amount or a sum of some) as two longs: the ten lower digits of its cents, and
    the digits above them.  A hash aggregate adds longs in place, while each wide decimal
    among its sums is read and written anew for every row, in the window or not."""
    cents = (x.cast("decimal(30,2)") * 100).cast("decimal(32,0)")
    return F.call_function("div", cents, F.lit(HALF).cast("decimal(11,0)")).cast("long"), (cents % F.lit(HALF).cast("decimal(11,0)")).cast("long")


def sum_halves_if(cond: Column, upper: Column, lower: Column) -> Column:
    """Exact :func:`sum_if` of an amount given as :func:`halves`."""
    up, low = (F.sum(F.when(cond, x)).cast("decimal(20,0)") for x in (upper, lower))
    return ((up * F.lit(HALF).cast("decimal(11,0)") + low) * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(30,2)")


def restrict(df, column: str, contacts):
    """Keep rows whose ``column`` is one of ``contacts.entity_id`` (key
    restriction of the incremental path); identity when ``contacts`` is None."""
    if contacts is None:
        return df
    k = contacts.select(F.col("entity_id").alias("_rk"))
    return df.join(k, df[column] == k["_rk"], "left_semi")
