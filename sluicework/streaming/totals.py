"""Totals per code of documents that arrive again in newer versions.

A document's codes in its last version are kept as state.  When a newer version arrives, what the
earlier one counted is taken back and its own codes are added, so that the sums of all changes are
at any time the totals of the last versions.

Documents are dealt by hash to ``BUCKETS`` buckets, and the state is a row per bucket, since a call
of Python per document costs far more than the document.  Of a bucket's lists of codes, which are few, each is kept once.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sluicework.plans.findings import codes_of_marks

COUNTED = "array<struct<code:string,severity:string,n:bigint>>"
#: Buckets of documents.  State that a stream has kept under another number is of no use to it.
BUCKETS = 1 << 14
#: Of a bucket: its documents, their last versions and the places of these' lists of codes; the lists.
STATE = "keys array<string>, ats array<bigint>, places array<int>, lists array<string>"
CHANGE = "code string, severity string, findings bigint, documents bigint"


def _counted(marks: DataFrame) -> DataFrame:
    """(doc_id as (key, at), marks) -> key, at, and how often the version has each code."""
    rows = marks.select("doc_id.*", codes_of_marks(F.col("marks")).alias("codes"))
    one = F.transform(F.array_distinct("codes"), lambda c: F.struct(
        c["code"].alias("code"), c["severity"].alias("severity"),
        F.size(F.filter("codes", lambda other: other == c)).cast("bigint").alias("n")))
    return rows.select("key", "at", F.to_json(one).alias("codes"))


def _changes(bucket: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    keys, ats, places, lists = map(list, state.get) if state.exists else ([], [], [], [])
    known = {key: (at, lists[place]) for key, at, place in zip(keys, ats, places, strict=True)}
    before: dict[str | None, str] = {}  # of the documents that have changed
    for batch in batches:
        for key, at, codes in zip(batch["key"], batch["at"], batch["codes"], strict=True):
            last = known.get(key)
            if last is None or at > last[0] or at == last[0] and codes > last[1]:
                before.setdefault(key, "[]" if last is None else last[1])
                known[key] = int(at), codes
    if not before:
        return
    number: dict[str, int] = {}
    places = [number.setdefault(codes, len(number)) for _, codes in known.values()]
    state.update(([*known], [at for at, _ in known.values()], places, [*number]))
    signs: Counter[str] = Counter(known[key][1] for key in before)
    signs.subtract(before.values())
    sums: dict[tuple, list[int]] = {}
    for codes, sign in signs.items():
        for row in json.loads(codes) if sign else ():
            change = sums.setdefault((row["code"], row["severity"]), [0, 0])
            change[0] += sign * row["n"]
            change[1] += sign
    rows = [(*code, *change) for code, change in sums.items() if any(change)]
    if rows:
        yield pd.DataFrame(rows, columns=["code", "severity", "findings", "documents"])


def total_stream(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str,
                 trigger: dict | None = None) -> StreamingQuery:
    """Append the changes that arriving ``(doc_id, at, body)`` rows make to the totals to Parquet files.

    ``at``, a whole number, orders a document's versions; an older one that arrives late changes nothing, and of two
    with one number that counts whose list of codes sorts last.  State is ``at`` and the codes of each document.
    """
    judged = judge(docs.select(F.struct(F.col("doc_id").alias("key"), F.col("at").cast("bigint").alias("at")).alias("doc_id"), "body"))
    rows = _counted(judged).select(F.col("key").cast("string").alias("key"), "at", "codes")
    changes = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS))).groupBy("bucket").applyInPandasWithState(
        _changes, CHANGE, STATE, "append", GroupStateTimeout.NoTimeout)
    return (changes.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start(folder))


def totals(spark: SparkSession, folder: str) -> DataFrame:
    """The totals of the last versions: code, severity, findings, documents."""
    return spark.read.schema(CHANGE).parquet(folder).groupBy("code", "severity").agg(
        F.sum("findings").alias("findings"), F.sum("documents").alias("documents")).where("documents > 0")
