"""Flows of a fleet as data, and runs that are seen whole or not at all."""

import json

import pytest
from pyspark.sql import functions as F

from sluicework import operators as op
from sluicework import sources as so
from sluicework.plans import fleet_rows, flow_pairs, flow_table, run_fleet, run_flows
from sluicework.plans.routing import steps
from sluicework.streaming import stream_flows

RULE = {"properties": {"dataFlows": [{"streams": ["s"], "destinations": ["d", "e"]}]}}


def sinks(tmp_path):
    return {n: so.LogTables(str(tmp_path / n)) for n in "de"}


def ids(spark, to, ledger):
    return [sorted(r.id for r in to[n].read(spark, "s", ledger).collect()) if so.sinks.table_columns(spark, to[n].path("s"), "parquet") else []
            for n in "de"]


def test_a_run_that_stops_between_destinations(spark, tmp_path):
    """Readers see both destinations of the run before, until the new one is complete."""
    to, ledger = sinks(tmp_path), so.Ledger(str(tmp_path / "ledger"))
    run_flows(RULE, {"s": spark.range(2)}, {}, to, "run", "rule", ledger)
    assert ids(spark, to, ledger) == [[0, 1], [0, 1]]

    class Broken(so.LogTables):
        def write(self, df, part):
            raise OSError("full")

    with pytest.raises(OSError):
        run_flows(RULE, {"s": spark.range(5)}, {}, {"d": to["d"], "e": Broken(str(tmp_path / "e"))}, "run", "rule", ledger)
    assert ids(spark, to, ledger) == [[0, 1], [0, 1]]
    assert to["d"].read(spark, "s").count() == 7  # what has been written is there, but not listed
    run_flows(RULE, {"s": spark.range(3)}, {}, to, "run", "rule", ledger)
    run_flows(RULE, {"s": spark.range(10, 11)}, {}, to, "run", "other", ledger)
    assert ids(spark, to, ledger) == [[0, 1, 2, 10]] * 2


def test_nothing_committed(spark, tmp_path):
    to, ledger = sinks(tmp_path), so.Ledger(str(tmp_path / "ledger"))
    step = next(iter(steps(RULE, {}, to)))
    step.write(spark.range(2), "rule", ledger.attempt("run"))
    assert ids(spark, to, ledger) == [[], []] and ledger.committed(spark).count() == 0


def test_stream_batches_appear_whole(spark, tmp_path):
    to, ledger = sinks(tmp_path), so.Ledger(str(tmp_path / "ledger"))
    for low in (0, 5):
        spark.range(low, low + 5).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        for query in stream_flows(RULE, {"s": stream}, {}, to, str(tmp_path / "ckpt"), "rule", ledger=ledger):
            query.awaitTermination()
    assert ids(spark, to, ledger) == [list(range(10))] * 2
    assert ledger.committed(spark).count() == 2


def test_columns_are_listed(spark, tmp_path):
    """Footers are read only for tables without a list."""
    sink = so.LogTables(str(tmp_path))
    sink.write(spark.range(1), sink.part("t", "r", "a", 1, 1))
    sink.write(spark.range(1), sink.part("t", "r", "b", 1, 1))
    sink.write(spark.range(1).withColumn("x", F.lit("y")), sink.part("t", "r", "c", 1, 1))
    assert len(list((tmp_path / "t" / "_schema").glob("*.txt"))) == 2
    assert sink.read(spark, "t").columns == ["id", "x"] and sink.read(spark, "t").count() == 3
    other = so.LogTables(str(tmp_path / "old"))
    spark.range(2).write.parquet(other.part("t", "r", "a", 1, 1))
    assert other.read(spark, "t").columns == ["id"]
    with pytest.raises(ValueError, match="other types"):
        other.write(spark.range(1).selectExpr("string(id) as id"), other.part("t", "r", "b", 1, 1))


def fleet(spark, n):
    rules = [(i, json.dumps({"properties": {"dataFlows": [
        {"streams": [f"Custom-{i % 3}"], "destinations": ["near", "near"], "transformKql": " source "},
        {"streams": ["Custom-0", "Custom-1"], "destinations": ["far"], "transformKql": "half", "outputStream": "Custom-H_CL"}]}})) for i in range(n)]
    return spark.createDataFrame(rules, "doc_id long, body string")


def half(df):
    return op.project(df, "id", half=F.col("id") / 2)


def test_fleet(spark, tmp_path):
    """A thousand rules give the rows that a loop over rules, flows and destinations gives, in a bounded number of jobs."""
    records = spark.range(12).select("id", F.concat(F.lit("Custom-"), F.col("id") % 3).alias("stream")).unionByName(
        spark.createDataFrame([(99, None)], "id long, stream string"))
    ledger, n = so.Ledger(str(tmp_path / "ledger")), 1000
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("fleet", "fleet")
    run_fleet(records, flow_pairs(fleet(spark, n)), {"half": half}, str(tmp_path / "out"), ledger, "run")
    spark.sparkContext.setJobGroup("", "")
    assert len(tracker.getJobIdsForGroup("fleet")) <= 20
    rows = fleet_rows(spark, str(tmp_path / "out"), ledger)
    assert rows.columns == ["run", "destination", "table", "id", "rule", "flow", "stream", "half"]
    found = sorted((r.destination, r.table, r.rule, r.flow, r.stream, r.id, r.half) for r in rows.collect())
    want = []
    for i in range(n):
        want += [("near", str(i % 3), i, 1, f"Custom-{i % 3}", x, None) for x in range(12) if x % 3 == i % 3]
        want += [("far", "H_CL", i, 2, f"Custom-{x % 3}", x, x / 2) for x in range(12) if x % 3 < 2]
    assert found == sorted(want, key=lambda r: r[:6])
    run_fleet(records.limit(0), flow_pairs(fleet(spark, 3)), {"half": half}, str(tmp_path / "out"), ledger, "run")
    assert fleet_rows(spark, str(tmp_path / "out"), ledger).count() == 0


def test_shares_are_written_once(spark, tmp_path):
    """However many flows take the same records; each flow gets them, alone or as totals."""
    records = spark.createDataFrame([(1, "Custom-0"), (1, "Custom-0"), (None, "Custom-0"), (7, "Custom-1"), (9, None)], "id long, stream string")
    rules = fleet(spark, 300).unionByName(fleet(spark, 2))  # two rules are there twice
    ledger, out = so.Ledger(str(tmp_path / "ledger")), str(tmp_path / "out")
    for run, some in (("a", records), ("a", records), ("b", records.limit(0))):
        run_fleet(some, flow_pairs(rules), {"half": half}, out, ledger, run)
    assert spark.read.parquet(f"{out}/rows").where("_run like 'a%'").count() == 2 * (4 + 4)
    keys = ["run", "destination", "table", "rule", "flow", "stream"]
    totals = [F.count("*").alias("n"), F.sum("id").alias("ids"), F.max("half").alias("most")]
    whole = fleet_rows(spark, out, ledger)
    found = fleet_rows(spark, out, ledger, totals)
    assert found.columns == [*keys, "n", "ids", "most"]
    assert sorted(found.collect(), key=str) == sorted(whole.groupBy(*keys).agg(*totals).collect(), key=str)
    assert whole.groupBy("destination").count().orderBy("destination").collect() == [("far", 300 * 4), ("near", 100 * 4)]


def test_fleet_checks(spark, tmp_path):
    records, ledger = spark.createDataFrame([(1, "Custom-0")], "id long, stream string"), so.Ledger(str(tmp_path / "ledger"))
    pairs, out = flow_pairs(fleet(spark, 1)), str(tmp_path / "out")
    for transforms, problem in (({}, "no function"), ({"half": lambda df: df.select("id")}, "loses"),
                                ({"half": lambda df: df.withColumn("table", F.lit(1))}, "flows have"),
                                ({"half": lambda df: df.withColumn("id", F.lit("x"))}, "another one")):
        with pytest.raises(ValueError, match=problem):
            run_fleet(records, pairs, transforms, out, ledger, "run")
    assert flow_table(pairs).count() == 3 and ledger.committed(spark).count() == 0
