"""Table contract checks (K1-K5): the declarations a schema library turns
into DDL, applied instead as checks on DataFrames.

* K1 :func:`conform` - cast every column to its declared SQL type with
  ``try_cast``; a non-NULL value that does not survive (bad text, decimal
  overflow, string longer than its declared length) is a failure.
* K2 :func:`apply_defaults` - NULLs take the declared default (booleans FALSE,
  ``CURRENT_TIMESTAMP`` = the configured "now").
* K3 :func:`not_null_violations` - required columns holding NULL.
* K4 :func:`unique_violations` - duplicate keys; a key with a NULL part never
  conflicts (MySQL unique-index rule).
* K5 :func:`fk_violations` - non-NULL child keys missing from the parent.

Counts come from one aggregation pass per table (``count_if`` per column),
unpivoted with ``stack`` into ``(column_name, violations)`` rows.

:func:`write_checked` applies all five in the pass that writes a table: every row is written
once, conformed and with defaults, the failing ones to a quarantine partition with
their original values, and the report's counts are observed on the written rows.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    sql_type: str
    required: bool = False
    default: object = None


@dataclass(frozen=True)
class TableContract:
    name: str
    columns: tuple[ColumnSpec, ...]
    primary_key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    foreign_keys: tuple[tuple[str, str, str], ...] = field(default_factory=tuple)  # (col, parent, parent_col)

    def column(self, name: str) -> ColumnSpec:
        return next(c for c in self.columns if c.name == name)


def spark_type(sql_type: str) -> tuple[str, int | None]:
    """SQL type -> (Spark type, max string length)."""
    t = sql_type.strip().lower()
    m = re.fullmatch(r"(?:var)?char\((\d+)\)", t)
    if m:
        return "string", int(m.group(1))
    m = re.fullmatch(r"decimal\((\d+),\s*(\d+)\)", t)
    if m:
        return f"decimal({m.group(1)},{m.group(2)})", None
    base = t.split()[0]
    table = {
        "int": "int", "integer": "int", "tinyint": "int", "smallint": "int", "bigint": "bigint",
        "boolean": "boolean", "bool": "boolean", "double": "double", "float": "double",
        "text": "string", "longtext": "string", "varchar": "string", "date": "date",
        "datetime": "timestamp_ntz", "timestamp": "timestamp_ntz", "decimal": "decimal(20,2)",
        "mediumtext": "string", "tinytext": "string", "time": "string", "blob": "binary", "longblob": "binary",
    }
    # an unsigned type needs the next wider signed one
    wider = {"int": "bigint", "integer": "bigint", "bigint": "decimal(20,0)"}
    if "unsigned" in t.split()[1:] and base in wider:
        return wider[base], None
    if base not in table:
        raise ValueError(f"unknown SQL type {sql_type!r}")
    return table[base], None


def _cast(c, sql_type: str):
    st, length = spark_type(sql_type)
    v = F.expr(f"try_cast(`{c}` AS {st})")
    if length is not None:
        v = F.when(F.length(v) <= length, v)
    return v


def conform(df: DataFrame, contract: TableContract) -> tuple[DataFrame, DataFrame]:
    """K1: (conformed frame, ``(column_name, failures)``)."""
    cols = [c for c in contract.columns if c.name in df.columns]
    conformed = df.select(*[_cast(c.name, c.sql_type).alias(c.name) for c in cols])
    fails = df.select(
        *[(F.col(c.name).isNotNull() & _cast(c.name, c.sql_type).isNull()).alias(c.name) for c in cols]
    )
    return conformed, _count_flags(fails, [c.name for c in cols])


def apply_defaults(df: DataFrame, contract: TableContract, now: dt.datetime | None = None) -> DataFrame:
    """K2: NULL -> declared default; booleans default to FALSE."""
    return df.select(_defaulted(df, contract, now))


def _defaulted(df: DataFrame, contract: TableContract, now: dt.datetime | None = None) -> list[Column]:
    out = []
    for f in df.columns:
        spec = next((c for c in contract.columns if c.name == f), None)
        if spec is None:
            out.append(F.col(f))
            continue
        d = spec.default
        if d is None and spark_type(spec.sql_type)[0] == "boolean":
            d = False
        if d is None:
            out.append(F.col(f))
        elif isinstance(d, str) and d.upper() == "CURRENT_TIMESTAMP":
            if now is None:
                raise ValueError("CURRENT_TIMESTAMP default needs an explicit 'now'")
            out.append(F.coalesce(F.col(f), F.lit(now).cast("timestamp_ntz")).alias(f))
        else:
            out.append(F.coalesce(F.col(f), F.lit(d).cast(df.schema[f].dataType)).alias(f))
    return out


def _count_flags(flags: DataFrame, names: list[str]) -> DataFrame:
    agg = flags.agg(*[F.count_if(F.col(n)).alias(n) for n in names])
    args = ", ".join(f"'{n}', `{n}`" for n in names)
    return agg.select(F.expr(f"stack({len(names)}, {args}) AS (column_name, violations)"))


def not_null_violations(df: DataFrame, contract: TableContract) -> DataFrame:
    """K3: ``(column_name, violations)`` for every required column."""
    req = [c.name for c in contract.columns if c.required and c.name in df.columns]
    return _count_flags(df.select(*[F.col(n).isNull().alias(n) for n in req]), req)


def unique_violations(df: DataFrame, keys) -> DataFrame:
    """K4: ``(keys..., n_rows)`` for each key value held by more than one row."""
    keys = list(keys)
    nn = None
    for k in keys:
        c = F.col(k).isNotNull()
        nn = c if nn is None else nn & c
    return df.where(nn).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def fk_violations(child: DataFrame, col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """K5: ``(col, n_rows)`` for non-NULL child keys absent from the parent."""
    # count per key first: the anti-join then sees one row per distinct key,
    # so a hot key cannot skew it
    counts = child.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n_rows"))
    p = parent.select(F.col(parent_col).alias("_pk"))
    return counts.join(p, F.col(col) == F.col("_pk"), "left_anti")


# ---------------------------------------------------------------- checks in the pass that writes


@dataclass
class WriteReport:
    rows: int
    quarantined: int
    violations: dict[str, int]  # check -> rows that fail it


def judged(df: DataFrame, contract: TableContract, parents: dict[str, DataFrame] | None = None, now: dt.datetime | None = None) -> tuple[DataFrame, list[str]]:
    """The rows conformed (K1) and with defaults (K2), ``_errors`` (names of the checks that
    the row fails, in order) and ``_row`` (the original values of a failing row as JSON);
    and the names of all checks: ``type:c``, ``null:c``, ``unique:c,d``, ``foreign:c``.

    Every row of a duplicated key fails; a parent that is not given is not checked.  Keys are
    counted and matched once each before they meet the rows, so a frequent one has one partner."""
    cols = [c for c in contract.columns if c.name in df.columns]
    names, flags = [], {}

    def check(name: str, failed: Column) -> None:
        names.append(name)
        flags[name] = F.coalesce(failed, F.lit(False))

    rows = df
    for i, keys in enumerate([k for k in (contract.primary_key, *contract.unique) if k]):
        twice = unique_violations(df, keys).select(*[F.col(k).alias(f"_u{i}_{k}") for k in keys], F.lit(True).alias(f"_u{i}"))
        on = None
        for k in keys:
            c = df[k] == twice[f"_u{i}_{k}"]
            on = c if on is None else on & c
        rows = rows.join(twice, on, "left")
    for i, (col, parent, parent_col) in enumerate(contract.foreign_keys):
        if parent in (parents or {}):
            lost = fk_violations(df, col, parents[parent], parent_col).select(F.col(col).alias(f"_f{i}_key"), F.lit(True).alias(f"_f{i}"))
            rows = rows.join(lost, df[col] == lost[f"_f{i}_key"], "left")
    for c in cols:
        check(f"type:{c.name}", df[c.name].isNotNull() & _cast(c.name, c.sql_type).isNull())
    value = {c: e for c, e in zip(df.columns, _defaulted(df, contract, now), strict=True)}
    for c in cols:
        if c.required:
            check(f"null:{c.name}", df[c.name].isNull() & value[c.name].isNull())
    for i, keys in enumerate([k for k in (contract.primary_key, *contract.unique) if k]):
        check(f"unique:{','.join(keys)}", F.col(f"_u{i}"))
    for i, (col, parent, _) in enumerate(contract.foreign_keys):
        if parent in (parents or {}):
            check(f"foreign:{col}", F.col(f"_f{i}"))
    errors = F.array_compact(F.array(*[F.when(flags[n], F.lit(n)) for n in names]))
    done = [(F.coalesce(_cast(c.name, c.sql_type), value[c.name].cast(spark_type(c.sql_type)[0]))).alias(c.name) for c in cols]
    # a value that does not conform is not replaced by a default
    done = [F.when(flags[f"type:{c.name}"], F.lit(None)).otherwise(d).alias(c.name) for c, d in zip(cols, done, strict=True)]
    raw = F.to_json(F.struct(*[df[c] for c in df.columns]))
    out = rows.select(*done, errors.alias("_errors"), F.when(F.size(errors) > 0, raw).alias("_row"))
    return out, names


def write_checked(df: DataFrame, contract: TableContract, path: str, parents: dict[str, DataFrame] | None = None, now: dt.datetime | None = None) -> WriteReport:
    """Write ``df`` under ``path``: sound rows to ``_quarantined=false``, others, with ``_errors``
    and ``_row``, to ``_quarantined=true``.  The counts come from the job that writes."""
    rows, names = judged(df, contract, parents, now)
    seen = Observation(f"contract-{contract.name}")
    bad = F.size("_errors") > 0
    counts = [F.count_if(F.array_contains("_errors", n)).alias(n) for n in names]
    rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("quarantined"), *counts)
    rows.withColumn("_quarantined", bad).write.mode("overwrite").partitionBy("_quarantined").parquet(path)
    got = seen.get
    return WriteReport(got["rows"], got["quarantined"], {n: got[n] for n in names})


def sound_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where("not cast(_quarantined as boolean)").drop("_errors", "_row", "_quarantined")


def quarantined_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where("cast(_quarantined as boolean)").drop("_quarantined")
