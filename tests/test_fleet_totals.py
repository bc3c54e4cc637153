"""Repeated bodies, versions of documents, and totals of days."""

import importlib
import random

import pytest
from pyspark.sql import functions as F

from sluicework.plans import (
    audit_queries, audit_rules, codes_of_days, codes_of_range, distinct_bodies, findings_by_code, judge_distinct, judge_queries,
    judge_rules,
)
from sluicework.plans.findings import to_rows
from sluicework.streaming import total_stream, totals

# The package gives its function ``totals`` under the module's name.
stream_totals = importlib.import_module("sluicework.streaming.totals")

TEXTS = ["source", None, "", "T | sort by a", "source | extend x = my_fn(1) | sort by b", "source | where a == 'b'"]


@pytest.mark.parametrize("judge, audit", [(judge_queries, audit_queries), (judge_rules, audit_rules)])
def test_bodies_are_judged_once(spark, monkeypatch, judge, audit):
    """Also if a body is hot, and its documents are dealt to several keys."""
    monkeypatch.setattr(distinct_bodies, "SHARE", 7)
    draw = random.Random(1)
    fleet = spark.createDataFrame([(i, TEXTS[0] if i % 3 == 0 else draw.choice(TEXTS)) for i in range(300)] + [(5, "a"), (5, "a")], "doc_id long, body string")
    seen = []

    def counted(bodies):
        seen.append(bodies.count())
        return judge(bodies)

    assert sorted(to_rows(judge_distinct(fleet, counted)).collect()) == sorted(audit(fleet).collect())
    assert seen == [len(TEXTS) + 1 if judge else 0]
    none = fleet.limit(0)
    assert judge_distinct(none, judge).count() == 0


def test_totals_follow_the_last_versions(spark, tmp_path):
    """Versions in any order, over several runs of the stream, with late and repeated ones."""
    draw, last = random.Random(2), {}
    for batch in range(4):
        rows = [(draw.randrange(20), draw.randrange(8), draw.choice([t for t in TEXTS if t])) for _ in range(30)]
        rows = [r for k, r in enumerate(rows) if r[:2] not in {x[:2] for x in rows[:k]} and r[1] != last.get(r[0], (None,))[0]]
        for doc, at, text in rows:
            if doc not in last or at > last[doc][0]:
                last[doc] = (at, text)
        spark.createDataFrame(rows, "doc_id long, at int, body string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("doc_id long, at int, body string").parquet(str(tmp_path / "in"))
        total_stream(stream, judge_queries, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
        fleet = spark.createDataFrame([(d, t) for d, (_, t) in last.items()], "doc_id long, body string")
        assert sorted(totals(spark, str(tmp_path / "out")).collect()) == sorted(findings_by_code(audit_queries(fleet)).collect())


def test_codes_of_a_range_of_days(spark):
    """Findings are exact, documents within three standard errors, also if documents come back on other days."""
    found = spark.range(60_000).select(
        F.expr("date_add(date'2024-01-01', cast(id % 10 as int))").alias("day"), (F.col("id") % 17_000).alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("code"), F.lit("error").alias("severity"))
    days = codes_of_days(found)
    for first, last in (("2024-01-01", "2024-01-10"), ("2024-01-03", "2024-01-03"), ("2024-01-04", "2024-02-01")):
        part = found.where(F.col("day").between(first, last)).groupBy("code").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))
        want = {r.code: (r.n, r.docs) for r in part.collect()}
        rows = {r.code: (r.findings, r.documents) for r in codes_of_range(days, first, last).collect()}
        assert rows.keys() == want.keys() and all(
            rows[c][0] == n and abs(rows[c][1] - docs) <= 0.05 * docs for c, (n, docs) in want.items())
    assert codes_of_range(days, "2025-01-01", "2025-01-02").count() == 0


def test_state_is_kept_by_buckets(spark, tmp_path, monkeypatch):
    """A bucket's documents are one row of the state, whatever their ids are; totals follow each of them."""
    monkeypatch.setattr(stream_totals, "BUCKETS", 3)
    last = {}
    for batch in range(3):
        rows = [(None if k == 0 else f"d{k}", batch if k % 2 else -batch, TEXTS[3 + (k + batch) % 3]) for k in range(40)]
        rows += [(doc, at - 9, "T | sort by late") for doc, at, _ in rows[:10]]
        for doc, at, text in rows:
            if doc not in last or at > last[doc][0]:
                last[doc] = (at, text)
        spark.createDataFrame(rows, "doc_id string, at int, body string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("doc_id string, at int, body string").parquet(str(tmp_path / "in"))
        query = total_stream(stream, judge_queries, str(tmp_path / "out"), str(tmp_path / "ckpt"))
        query.awaitTermination()
        assert sum(op["numRowsTotal"] for op in query.lastProgress["stateOperators"]) <= 3
        fleet = spark.createDataFrame([(d or "", t) for d, (_, t) in last.items()], "doc_id string, body string")
        assert sorted(totals(spark, str(tmp_path / "out")).collect()) == sorted(findings_by_code(audit_queries(fleet)).collect())
