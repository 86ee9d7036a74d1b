"""The set of CRM-shaped input DataFrames (SRC1).

``Sources`` is a thin, lazy mapping ``name -> DataFrame`` with the declared
schemas of :mod:`kinsum.sources.schemas`.  Loading never triggers a job.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from kinsum.sources.schemas import OPTIONAL, SCHEMAS


class MissingTable(LookupError):
    """An input table that a metric needs is absent."""


class Sources(Mapping):
    """``absent``: tables that a loader looked for and did not find."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame], absent=()):
        self.spark = spark
        self._t = dict(tables)
        self.absent = frozenset(absent)

    # Mapping protocol -------------------------------------------------
    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._t:
            if name not in SCHEMAS:
                raise KeyError(name)
            if name in self.absent and name not in OPTIONAL:
                raise MissingTable(f"required table {name!r} is absent")
            self._t[name] = self.empty(name)
        return self._t[name]

    def __iter__(self):
        return iter(self._t)

    def __len__(self):
        return len(self._t)

    def has(self, name: str) -> bool:
        return name in self._t

    def empty(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], SCHEMAS[name])

    def replace(self, **tables: DataFrame) -> "Sources":
        t = dict(self._t)
        t.update(tables)
        return Sources(self.spark, t, self.absent - set(tables))

    def missing(self) -> list[str]:
        """Required tables that are absent."""
        return sorted(self.absent - OPTIONAL)

    # Loaders ----------------------------------------------------------
    @classmethod
    def from_parquet_dir(cls, spark: SparkSession, path: str) -> "Sources":
        """``<path>/<table>.parquet`` (file or directory, any Hadoop file
        system) for each known table.  A table that is not there is recorded in
        ``absent``: an optional one (a component that is not installed) reads as
        empty, a required one fails when it is used.  Columns are selected and cast
        to the declared schema so a wider physical file is pruned at the scan."""
        tables, absent = {}, []
        for name, schema in SCHEMAS.items():
            try:
                df = spark.read.parquet(f"{path.rstrip('/')}/{name}.parquet")
            except AnalysisException as e:
                if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
                    raise
                absent.append(name)
                continue
            tables[name] = df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
        return cls(spark, tables, absent)

    @classmethod
    def from_frames(cls, spark: SparkSession, **frames: DataFrame) -> "Sources":
        out = {}
        for name, df in frames.items():
            if name not in SCHEMAS:  # a user's own table
                out[name] = df
                continue
            schema = SCHEMAS[name]
            out[name] = df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
        return cls(spark, out)

    @classmethod
    def from_rows(cls, spark: SparkSession, **rows) -> "Sources":
        """Small in-memory tables (tests / golden fixtures)."""
        return cls(spark, {n: spark.createDataFrame(list(r), SCHEMAS[n]) for n, r in rows.items()})
