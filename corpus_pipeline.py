"""A corpus pipeline in five stages; each stage's rows are written and read again by the next one.

Every stage but the last returns the columns of ``documents``:

1. ``quality_rules``: documents that fail the rules, or come from a rejected host, go.
2. ``toxicity``: documents that score as toxic go.
3. ``line_dedup``: repeated lines are cut from the texts; ``n_chars`` is counted anew.  A
   document that loses every line stays, with an empty text.
4. ``ngram_join``: of each class of near copies the document with the least doc_id stays.
5. ``packing``: the documents' places in sequences of 1024 ids.

SQL cannot express the toxicity model and the tokens, so there is no SQL for the whole; the tests
hold every stage against a plain version of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework.llm import line_dedup, ngram_join, packing, quality, toxicity
from sluicework.llm.common import table, written
from sluicework.llm.queries import vocabulary
from sluicework.session import fresh_path, remove


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the rules and whose host isn't rejected."""
    return quality.keep_good(docs)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that don't score as toxic."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the lines that occurred before."""
    left = line_dedup.dedup_lines(docs, "_removed").drop("_removed")
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else left


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return ngram_join.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of the documents' pieces in sequences."""
    return packing.best_fit_packing(docs, vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality_rules", quality_rules), ("toxicity", toxic_documents), ("line_dedup", repeated_lines),
    ("ngram_join", near_copies), ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)  # its rows have been read for the last time
        docs, before = spark.read.parquet(path), path
    result = written(STAGES[-1][1](spark, docs, sf_dir))
    remove(spark, before)
    return result


QUERIES = {"pipeline": run}
ORACLE = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
