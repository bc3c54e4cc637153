"""Exact dedup with a heavy-hitter split (native).

Digests of equal texts are counted with a Misra-Gries sketch.  The digests it finds
are counted exactly; those that are indeed frequent are at most ``1 / support``, so their
winners can be broadcast and settle their rows without a shuffle.  All other digests,
none of which holds more than a fraction ``support`` of the rows, are grouped and joined
by an ordinary shuffle of narrow rows.

Null text counts as empty, and empty texts are equal to each other.  Of equal texts the
longest row stays, then the smallest ``doc_id``; a null ``doc_id`` comes last.  Of rows that
also agree in length and ``doc_id`` the first by place in the input stays, so that one row of each group is kept.
Texts of any length are read whole.  An empty table gives an empty result.  Further columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicework.llm.common import SPACE, written

#: Digests that hold at least this fraction of the rows are settled map-side.
SUPPORT = 0.001
#: Counters of the sketch; it finds every digest above 3.5 / COUNTERS of the rows.
COUNTERS = 8192
#: Sketches are merged in so many groups before the last merge.
MERGES = 256


def digests(docs: DataFrame) -> DataFrame:
    """Per document its digest without white space, its length in code points, and a number for the row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        F.sha2(F.regexp_replace(text, f"[{SPACE}]+", ""), 256).alias("digest"),
        F.length(text).cast("long").alias("n_chars"),
        F.monotonically_increasing_id().alias("row"),
    )


def frequent(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Candidates for digests with at least ``support`` of the rows: a bounded number, and none is missed.

    A count is wrong by at most 3.5 / COUNTERS of the rows, so no more digests than this can look frequent.
    """
    error = 3.5 / COUNTERS
    if not 2 * error <= support <= 1:
        raise ValueError(f"support must be between {2 * error:.5f} and 1")
    most = int(1 / (support - error))
    part = rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGES)).alias("part")).agg(
        F.expr(f"approx_top_k_accumulate(digest, {COUNTERS})").alias("sketch"))
    # Grouped, since the combining function fails on a task without rows.
    whole = part.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_combine(sketch, {COUNTERS})").alias("sketch"))
    return whole.select(
        F.explode(F.expr(f"approx_top_k_estimate(sketch, {most})")).alias("x")
    ).select(F.col("x.item").alias("digest"))


def winners(rows: DataFrame) -> DataFrame:
    """Per digest the row that stays and the number of rows."""
    first = F.min(F.struct((-F.col("n_chars")).alias("shorter"), F.col("doc_id").isNull().alias("unknown"), "doc_id", "row"))
    return rows.groupBy("digest").agg(first.alias("first"), F.count("*").alias("group_size")).select(
        "digest", "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"))


def exact_dedup(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = written(digests(docs))
    total = rows.count()
    candidates = frequent(rows, support) if total else rows.select("digest").limit(0)
    heavy = written(
        winners(rows.join(F.broadcast(candidates), "digest", "left_semi"))
        .where(F.col("group_size") >= max(2, support * total)))
    settled = rows.join(F.broadcast(heavy), "digest")
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    both = settled.unionByName(rest.join(winners(rest), "digest"))
    return both.select(
        "doc_id", "keep_id", "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.col("digest").alias("text_sha256"))
