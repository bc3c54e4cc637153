"""Rollups over findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicework.plans.findings import bind, codes_of_marks

COUNTS = {"errors": "error", "warnings": "warning", "infos": "info"}


def verdict(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """Per document: valid or not, and the number of errors, warnings and infos.

    For findings that are already a table.  Counts are combined before the
    shuffle by ``doc_id``; documents without findings are valid.
    """
    counts = findings.groupBy("doc_id").agg(
        *[F.count_if(F.col("severity") == severity).alias(name) for name, severity in COUNTS.items()])
    joined = docs.select("doc_id").join(counts, "doc_id", "left")
    return joined.select(
        "doc_id", (F.coalesce("errors", F.lit(0)) == 0).alias("valid"),
        *[F.coalesce(name, F.lit(0).cast("bigint")).alias(name) for name in COUNTS])


def verdict_of_marks(marks: DataFrame) -> DataFrame:
    """The same from ``judge_queries`` or ``judge_rules`` rows, counted inside the row: no shuffle."""
    def of(severity: str):
        return lambda m: m["head"]["severity"] == severity

    counted = marks.select("doc_id", *[
        F.size(F.filter("marks", of(severity))).cast("bigint").alias(name) for name, severity in COUNTS.items()])
    return counted.select("doc_id", (F.col("errors") == 0).alias("valid"), *COUNTS)


def findings_by_code(findings: DataFrame) -> DataFrame:
    """Fleet totals per code and severity: findings, and documents that have them.

    The first step counts per document and code, which spreads a code that a
    large part of the fleet has; the second adds up partial sums.
    """
    per_document = findings.groupBy("code", "severity", "doc_id").agg(F.count("*").alias("n"))
    return per_document.groupBy("code", "severity").agg(
        F.sum("n").alias("findings"), F.count("*").alias("documents"))


def totals_of_marks(marks: DataFrame) -> DataFrame:
    """The same totals from ``judge_queries`` or ``judge_rules`` rows.

    Codes are counted inside the row, so what a task shuffles is a row per code.
    """
    counted = bind(codes_of_marks(F.col("marks")), lambda all_: F.transform(
        F.array_distinct(all_), lambda one: F.struct(
            one["code"].alias("code"), one["severity"].alias("severity"),
            F.size(F.filter(all_, lambda other: other == one)).cast("bigint").alias("n"))))
    return marks.select(F.explode(counted).alias("c")).select("c.*").groupBy("code", "severity").agg(
        F.sum("n").alias("findings"), F.count("*").alias("documents"))
