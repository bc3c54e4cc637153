"""Declared streams, existing tables, event selections and literal tables as sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicework.functions._args import col
from sluicework.sources.schema import conform

TABLE_PREFIX = "Microsoft-Table-"


def declared_stream(df: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Rows pushed with a declared schema: (conforming, rejected)."""
    return conform(df, schema)


def table_stream(spark: SparkSession, name: str, streaming: bool = False) -> DataFrame:
    """An existing table as the source of a workspace transform."""
    if not name.startswith(TABLE_PREFIX):
        raise ValueError(f"{name!r} does not start with {TABLE_PREFIX!r}")
    table = name[len(TABLE_PREFIX):]
    return spark.readStream.table(table) if streaming else spark.table(table)


def select_levels(df: DataFrame, facilities: list[str], levels: list[str],
                  facility: str = "Facility", level: str = "SeverityLevel") -> DataFrame:
    """Events of the listed facilities and levels."""
    return df.filter(F.col(facility).isin(facilities) & F.col(level).isin(levels))


def print_(spark: SparkSession, **exprs) -> DataFrame:
    """One row of constants."""
    return spark.range(1).select(*[col(value).alias(name) for name, value in exprs.items()])


def datatable(spark: SparkSession, schema: T.StructType | str, rows: list[tuple]) -> DataFrame:
    """A literal table."""
    return spark.createDataFrame(rows, schema)
