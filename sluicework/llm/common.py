"""What the operators share: tables, written intermediates, joins that survive hot keys."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework.session import fresh_path, remove, shared_folder

#: White space between words, inside a character class of a regular expression.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a supplied table."""
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def written(df: DataFrame) -> DataFrame:
    """The rows, evaluated once and kept in the shared checkpoint folder, so that a lost executor costs nothing.

    The files go with the garbage where the cluster sets spark.cleaner.referenceTracking.cleanCheckpoints.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Settings while a table is written: its shuffle files go when it is done, and batches for Python are small.
WHILE_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}


@contextmanager
def tables(spark):
    """Gives a function that writes rows to a table in the shared folder and reads them back.

    The shuffle files behind a table go when it is written, the tables at the end, or when the function's ``drop`` is
    called for what it gave.
    """
    paths, given = [], {}
    before = {k: spark.conf.get(k) for k in WHILE_WRITING}

    def write(df: DataFrame) -> DataFrame:
        paths.append(fresh_path(spark, "table"))
        for k, v in WHILE_WRITING.items():
            spark.conf.set(k, v)
        try:
            df.write.parquet(paths[-1])
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)
        back = spark.read.schema(df.schema).parquet(paths[-1])
        given[id(back)] = back, paths[-1]  # the frame is held, so that its id stays its own
        return back

    def drop(*frames: DataFrame) -> None:
        for df in frames:
            remove(spark, given.pop(id(df))[1])

    write.drop = drop
    try:
        yield write
    finally:
        for path in paths:
            remove(spark, path)


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def row_key(*columns: str) -> Column:
    """A number that names a row by its contents; never null."""
    return F.xxhash64(*[F.col(c) for c in columns])


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once per row, however often ``then`` uses it."""
    return F.transform(F.array(value), then)[0]


def with_group(rows: DataFrame, key: str, *totals: Column, least: int = 1, hot: float = 0.001) -> DataFrame:
    """The rows of keys that occur ``least`` times, with the totals of their key and its number of rows, ``_n``.

    Keys that hold at least the fraction ``hot`` of the rows are at most ``1 / hot``; they are
    broadcast, so that no task gets all rows of such a key.  The others are joined by shuffle.
    """
    often_from = hot * rows.count()
    found = written(rows.groupBy(key).agg(F.count("*").alias("_n"), *totals).where(F.col("_n") >= least))
    often, seldom = found.where(F.col("_n") >= often_from), found.where(F.col("_n") < often_from)
    others = rows.join(F.broadcast(often.select(key)), key, "left_anti")
    return rows.join(F.broadcast(often), key).unionByName(others.join(seldom, key))
