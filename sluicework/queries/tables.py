"""Reading the supplied tables for the registered queries."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework.session import prepare


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table with its times as zoned timestamps."""
    df = prepare(spark).read.parquet(f"{folder}/{name}.parquet")
    times = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({name: F.col(name).cast("timestamp") for name in times}) if times else df


def plain(t: Column) -> Column:
    """A time as the supplied tables hold it."""
    return t.cast("timestamp_ntz")


def micros(span: Column) -> Column:
    """A time span as a number of microseconds."""
    return F.unix_micros(F.lit("1970-01-01").cast("timestamp") + span)
