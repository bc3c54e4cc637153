"""The streams that one rule document declares and reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicework import fixed_values as fv
from sluicework.functions import extract, todatetime
from sluicework.sources.logs import CORRUPT, json_log, text_log
from sluicework.sources.schema import conform, declared_schema


def declared_streams(rule: dict) -> dict[str, T.StructType]:
    """Schema of every stream that a rule (as a dict) declares."""
    declarations = rule["properties"].get("streamDeclarations", {})
    return {name: declared_schema(declared["columns"]) for name, declared in declarations.items()}


def _text_rows(spark: SparkSession, entry: dict, streaming: bool) -> DataFrame:
    settings = entry.get("settings", {}).get("text", {})
    name = settings.get("recordStartTimestampFormat", "ISO 8601")
    if name not in fv.RECORD_START_FORMATS:
        raise ValueError(f"unknown recordStartTimestampFormat {name!r}; known: {', '.join(fv.RECORD_START_FORMATS)}")
    start, pattern = fv.RECORD_START_FORMATS[name]
    time = extract(rf"\A({start})", 1, F.col("RawData"))
    time = todatetime(time) if pattern is None else F.try_to_timestamp(time, F.lit(pattern))
    return text_log(spark, entry["filePatterns"], start, streaming).withColumn("TimeGenerated", time)


def log_streams(spark: SparkSession, rule: dict, streaming: bool = False,
                computer: str | None = None) -> dict[str, tuple[DataFrame, DataFrame]]:
    """For every stream fed by log files: rows with the declared schema, and rejected rows.

    Text records give ``RawData``, ``FilePath`` and, as ``TimeGenerated``, the time
    they start with, in the entry's format; JSON lines give their fields and ``FilePath``.
    ``computer`` fills a declared ``Computer`` column.  Several entries of one stream
    are put together.  (Spark refuses to count rejected JSON lines straight from the files; write
    or collect them first.)
    """
    schemas, streams = declared_streams(rule), {}
    for entry in rule["properties"].get("dataSources", {}).get("logFiles", []):
        for name in entry["streams"]:
            if name not in schemas:
                raise ValueError(f"the rule reads logs to stream {name!r} but doesn't declare it")
            schema = schemas[name]
            if entry["format"] == "text":
                read = _text_rows(spark, entry, streaming)
                corrupt = None
            else:
                read = json_log(spark, entry["filePatterns"], schema, streaming)
                corrupt = read.filter(F.col(CORRUPT).isNotNull())
                read = read.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
            if computer is not None and "Computer" in schema.names:
                own = F.col("Computer") if "Computer" in read.columns else F.lit(None).cast("string")
                read = read.withColumn("Computer", F.coalesce(own, F.lit(computer)))
            good, bad = conform(read, schema)
            if corrupt is not None:
                bad = corrupt.unionByName(bad, allowMissingColumns=True)
            if name in streams:
                before = streams[name]
                good, bad = before[0].unionByName(good), before[1].unionByName(bad, allowMissingColumns=True)
            streams[name] = good, bad
    return streams
