"""Audits of fleets in which bodies repeat: each different body is judged once.

Judging costs much more than hashing.  Bodies are reduced to one per digest, with partial results in
the tasks that read them, and judged; documents then take the marks of their body's digest.  A body that many
documents have is copied to several keys, and its documents are dealt to these.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicework.operators.tabular import materialize

#: A digest that holds this share of the documents is hot, so that there are at most a thousand of them.
HOT = 0.001
#: Documents of a hot digest that share a key.
SHARE = 100_000


def judge_distinct(docs: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``judge`` (``judge_queries`` or ``judge_rules``) gives for ``(doc_id, body)``: ``(doc_id, marks)``.

    A null body is a body of its own.  Documents with one and the same id are kept apart as rows.
    """
    digest = F.coalesce(F.sha2("body", 256), F.lit("")).alias("digest")
    bodies = docs.groupBy(digest).agg(F.first("body").alias("body"), F.count("*").alias("n"))
    judged = materialize(judge(bodies.select(F.struct("digest", "n").alias("doc_id"), "body")).select("doc_id.*", "marks"))
    total = judged.agg(F.sum("n")).first()[0] or 0
    hot = judged.where((F.col("n") >= HOT * total) & (F.col("n") > SHARE)).select("digest", F.ceil(F.col("n") / SHARE).cast("int").alias("copies"))
    copies = F.coalesce("copies", F.lit(1))
    marks = judged.join(F.broadcast(hot), "digest", "left").select(
        "digest", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"), "marks")
    keyed = docs.select("doc_id", digest).join(F.broadcast(hot), "digest", "left").select(
        "doc_id", "digest", F.pmod(F.xxhash64("doc_id"), copies).cast("int").alias("copy"))
    return keyed.join(marks, ["digest", "copy"]).select("doc_id", "marks")
