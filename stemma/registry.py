"""The registry of named queries, the driver's tables, and small literal tables that stand in both a query and its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_TYPES = {"long": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "array<int>": "INTEGER[]", "array<double>": "DOUBLE[]"}


@dataclass(frozen=True)
class Sample:
    """Rows that the driver's invented texts lack, so that a query and its SQL meet every case."""

    name: str
    columns: dict[str, str]
    rows: list[tuple]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, ", ".join(f"{c} {t}" for c, t in self.columns.items()))

    @property
    def sql(self) -> str:
        """The rows as a common table expression."""
        values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in self.rows)
        casts = ", ".join(f'"{c}"::{_TYPES[t]} AS "{c}"' for c, t in self.columns.items())
        names = ", ".join(f'"{c}"' for c in self.columns)
        return f"{self.name} AS (SELECT {casts} FROM (VALUES {values}) v({names}))"


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    if isinstance(x, list | tuple):
        return "[" + ", ".join(map(_literal, x)) + "]"
    return repr(x)
