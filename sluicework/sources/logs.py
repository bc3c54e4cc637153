"""Log files as sources."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ISO_8601 = r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}"

CORRUPT = "_corrupt_record"

#: Lines before the first start in a split that are put together.
LINES = 1_024
SPLIT = ["path", "block"]


def _starts(line: Column, record_start: str) -> Column:
    """Whether a record starts at the line; anchors of the pattern mean the line's ends."""
    return F.rlike(line, F.lit(rf"\A(?:{record_start})"))


def _line(value: Column) -> Column:
    return F.regexp_replace(value, r"\r\z", "")


def _records(lines: DataFrame) -> DataFrame:
    """Records ``RawData, path`` of lines (path, block, id, value, start); ``id`` orders the lines of a split.

    The number of a record is a two-level running sum: of the starts in the splits of its file before,
    and of those in its own split.  The lines are shuffled once, by split, so that a task's share is bounded
    by the size of a split.  Records inside a split are put together there; only what is open at a split's ends
    meets in a second shuffle.
    """
    splits = lines.groupBy(*SPLIT).agg(F.sum(F.col("start").cast("bigint")).alias("n"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(*SPLIT, "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    inside = Window.partitionBy(*SPLIT).orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = lines.withColumn("at", F.sum(F.col("start").cast("bigint")).over(inside)).withColumn(
        "n", F.sum(F.col("start").cast("bigint")).over(Window.partitionBy(*SPLIT)))
    part = F.when(F.col("at") == 0, F.floor(F.col("id") / LINES))
    pieces = numbered.groupBy(*SPLIT, "at", "n", part.alias("part")).agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("id", "value")))["value"], "\n").alias("text"), F.min("id").alias("first"))

    closed = pieces.filter("at > 0 and at < n").select(F.col("text").alias("RawData"), "path")
    ends = pieces.filter("at = 0 or at = n").drop("n").join(splits.drop("n"), SPLIT).withColumn("record", F.col("before") + F.col("at"))
    whole = ends.filter("record > 0").groupBy("path", "record").agg(F.array_join(
        F.array_sort(F.collect_list(F.struct("block", "first", "text")))["text"], "\n").alias("RawData")).select("RawData", "path")
    # No record owns the lines before the first start of a file: each is its own.
    headless = ends.filter("record = 0").select(F.explode(F.split("text", "\n")).alias("RawData"), "path")
    return closed.unionByName(whole).unionByName(headless)


def _whole_files(files: DataFrame, record_start: str) -> DataFrame:
    """The same records from rows of whole files, inside the row."""
    lines = F.transform(F.split(F.regexp_replace("value", r"\n\z", ""), "\n"), _line)
    starts = F.filter(F.transform("lines", lambda x, i: F.when(_starts(x, record_start), i)), lambda i: i.isNotNull())
    head = F.slice(F.col("lines"), F.lit(1), F.coalesce(F.get("starts", F.lit(0)), F.size("lines")))
    rest = F.transform("starts", lambda s, i: F.array_join(F.slice(
        F.col("lines"), s + 1, F.coalesce(F.get(F.col("starts"), i + 1), F.size("lines")) - s), "\n"))
    return files.withColumn("lines", lines).withColumn("starts", starts).select(
        F.explode(F.concat(head, rest)).alias("RawData"), "path")


def text_log(spark: SparkSession, patterns: list[str] | str, record_start: str = ISO_8601,
             streaming: bool = False) -> DataFrame:
    """Records ``RawData, FilePath`` of text log files.

    A record starts at a line whose beginning matches ``record_start``; lines that don't
    start one belong to the record before them, and lines before the first start of a file are
    records of their own.  Line ends become ``\\n``.  A batch reads files of any size in
    splits; a stream gives the same records but reads every file whole: its files must be
    closed, rolled files of at most about 1 GB.
    """
    paths = [patterns] if isinstance(patterns, str) else list(patterns)
    path = F.col("_metadata.file_path").alias("path")
    if streaming:
        found = [_whole_files(spark.readStream.text(p, wholetext=True).select("value", path), record_start) for p in paths]
        records = functools.reduce(DataFrame.unionByName, found)
    else:
        lines = spark.read.text(paths, lineSep="\n").select(
            path, F.col("_metadata.file_block_start").cast("bigint").alias("block"),
            F.monotonically_increasing_id().alias("id"), _line(F.col("value")).alias("value"))
        records = _records(lines.withColumn("start", _starts(F.col("value"), record_start)))
    return records.select("RawData", F.col("path").alias("FilePath"))


def json_log(spark: SparkSession, patterns: list[str] | str, schema: T.StructType,
             streaming: bool = False) -> DataFrame:
    """One JSON record per line with the declared schema.

    A line that is not such a record keeps its text in ``_corrupt_record``.  A declared
    ``FilePath`` that a record doesn't have is the path of its file.
    """
    paths = [patterns] if isinstance(patterns, str) else list(patterns)
    with_corrupt = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])

    def read(source) -> DataFrame:
        reader = (spark.readStream if streaming else spark.read).schema(with_corrupt).option(
            "columnNameOfCorruptRecord", CORRUPT).option("mode", "PERMISSIVE")
        rows = reader.json(source)
        if "FilePath" in schema.names:
            rows = rows.withColumn("FilePath", F.coalesce("FilePath", "_metadata.file_path"))
        return rows

    return functools.reduce(DataFrame.unionByName, map(read, paths)) if streaming else read(paths)
