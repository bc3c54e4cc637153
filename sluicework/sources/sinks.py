"""Destinations of data flows.

A destination writes to tables under one folder, one per output stream.  Every
write owns the partition folder of its rule, run, flow and stream and overwrites just
that: a write that is repeated after a failure leaves the rows once, and writers
of one table do not get in each other's way.  A table's columns are listed in its folder
``_schema``, a small file for each write that brought new ones, so that neither writers nor readers open
all data files to learn them.

With a ``Ledger`` the destinations of a run appear together: each attempt at a run writes under a name of its own, and
readers take the attempts that the ledger lists.  An attempt is listed after its last write, in
one file that is put in place by a rename.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS = ["_rule", "_run", "_flow", "_stream"]
NAME = r"[A-Za-z0-9._-]+"


def table_name(stream: str) -> str:
    """Table that an output stream names: ``Custom-X_CL`` -> ``X_CL``."""
    for prefix in ("Microsoft-Table-", "Custom-", "Microsoft-"):
        if stream.startswith(prefix):
            return stream[len(prefix):]
    return stream


def checked_name(kind: str, name: str) -> str:
    if not re.fullmatch(NAME, name):
        raise ValueError(f"a {kind} name is made of letters, digits, '.', '_' and '-', not {name!r}")
    return name


def _absent(error: AnalysisException) -> bool:
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def table_columns(spark: SparkSession, table: str, file_format: str) -> list[T.StructField]:
    """The columns that a table lists; for a table without a list, written by other means, those of its files."""
    try:
        listed = spark.read.text(f"{table}/_schema", wholetext=True).distinct().collect()
    except AnalysisException as error:
        if not _absent(error):
            raise
        try:
            return list(spark.read.format(file_format).option("mergeSchema", True).load(table).drop(*PARTS).schema)
        except AnalysisException as error:
            if _absent(error):
                return []  # nothing has been written yet
            raise
    known: dict[str, T.StructField] = {}
    for text, in sorted(listed):
        for field in T.StructType.fromJson(json.loads(text)):
            known.setdefault(field.name, field)
    return list(known.values())


def list_columns(df: DataFrame, table: str, file_format: str) -> None:
    """List the columns of rows that are to be written; one that the table has with another type is an error."""
    known = {f.name: f.dataType for f in table_columns(df.sparkSession, table, file_format)}
    differ = [f.name for f in df.schema if known.get(f.name, f.dataType) != f.dataType]
    if differ:
        raise ValueError(f"the table {table} has other types for: {', '.join(differ)}")
    if any(f.name not in known for f in df.schema):
        fields = [T.StructField(n, t) for n, t in known.items()] + [f for f in df.schema if f.name not in known]
        text = T.StructType(fields).json()
        df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("append").text(f"{table}/_schema")


@dataclass(frozen=True)
class Ledger:
    """The attempts at runs that are complete, one small file each."""

    folder: str

    def attempt(self, run: str) -> str:
        """A name for a new attempt at a run."""
        return f"{checked_name('run', run)}.{uuid.uuid4().hex}"

    def commit(self, spark: SparkSession, rule: str, run: str, attempt: str) -> None:
        """From now on this attempt stands for the run."""
        row = [(rule, run, attempt, time.time_ns())]
        spark.createDataFrame(row, "rule string, run string, attempt string, at bigint").coalesce(1).write.mode("append").json(self.folder)

    def committed(self, spark: SparkSession) -> DataFrame:
        """The attempt that stands for each run: rule, run, attempt."""
        schema = "rule string, run string, attempt string, at bigint"
        try:
            rows = spark.read.schema(schema).json(self.folder)
        except AnalysisException as error:
            if not _absent(error):
                raise
            rows = spark.createDataFrame([], schema)
        return rows.groupBy("rule", "run").agg(F.max_by("attempt", F.struct("at", "attempt")).alias("attempt"))


@dataclass(frozen=True)
class LogTables:
    """Tables of one workspace: Parquet (or another file format) under ``folder``."""

    folder: str
    source_format: str = "parquet"

    def path(self, stream: str) -> str:
        return f"{self.folder.rstrip('/')}/{table_name(stream)}"

    def part(self, output_stream: str, rule: str, run: str, flow: int, number: int) -> str:
        checked_name("rule", rule), checked_name("run", run)
        return f"{self.path(output_stream)}/_rule={rule}/_run={run}/_flow={flow}/_stream={number}"

    def write(self, df: DataFrame, part: str) -> None:
        """Replace a part; a column that the table has with another type is an error."""
        list_columns(df, part[:part.rindex("/_rule=")], self.source_format)
        df.write.format(self.source_format).mode("overwrite").save(part)

    def read_part(self, spark: SparkSession, part: str) -> DataFrame:
        return spark.read.format(self.source_format).load(part)

    def read(self, spark: SparkSession, output_stream: str, ledger: Ledger | None = None) -> DataFrame:
        """All rows of a table with the columns of all its parts; with a ledger, those of complete runs."""
        table = self.path(output_stream)
        fields = table_columns(spark, table, self.source_format)
        kinds = {n: T.StringType() if n in PARTS[:2] else T.IntegerType() for n in PARTS}
        schema = T.StructType([*fields, *[T.StructField(n, t) for n, t in kinds.items()]])
        rows = spark.read.format(self.source_format).schema(schema).load(table)
        if ledger is not None:
            done = ledger.committed(spark).select(F.col("rule").alias("_rule"), F.col("attempt").alias("_run"))
            rows = rows.join(done, ["_rule", "_run"])
        return rows.select(*[f.name for f in fields])


class MetricsTable(LogTables):
    """The metrics destination: all its streams go to one table of records."""

    def path(self, stream: str) -> str:
        return f"{self.folder.rstrip('/')}/metrics"


def log_table_sink(df: DataFrame, name: str, checkpoint: str | None = None, run: str | None = None):
    """Append to a catalog table; a stream gives the started query (``checkpoint`` needed).

    With ``run`` the rows are those of a run (partition column ``_run``), and running
    again replaces them; without it every call appends.
    """
    if df.isStreaming:
        return df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).toTable(name)
    if run is None:
        df.write.mode("append").saveAsTable(name)
        return None
    checked_name("run", run)
    spark = df.sparkSession
    if not spark.catalog.tableExists(name):
        df.withColumn("_run", F.lit(run)).write.partitionBy("_run").saveAsTable(name)
    else:
        columns = [F.col(c) for c in spark.table(name).columns if c != "_run"]
        spark.sql(f"INSERT OVERWRITE TABLE {name} PARTITION (_run = '{run}') SELECT * FROM {{rows}}", rows=df.select(columns))
    return None


def metrics_sink(df: DataFrame, name: str, checkpoint: str | None = None, run: str | None = None):
    """The same for a catalog table of metrics."""
    return log_table_sink(df, name, checkpoint, run)
