"""Log files, sinks and flows."""

import pathlib
import uuid

import pytest
import seeds
from pyspark.sql import functions as F

from sluicework import sources as so
from sluicework.plans import audit_queries, run_flows
from sluicework.streaming import audit_stream, stream_flows


def log_text(n):
    """Records of very different length, some longer than a split, with a header and Windows line ends."""
    lines = ["# header", "# more"]
    for i in range(n):
        lines.append(f"2024-01-01 00:00:{i % 60:02d} record {i}")
        lines += [f"  line {j} of {i}" for j in range([0, 1, 30, 2][i % 4])]
    return "\r\n".join(lines) + "\r\n"


def expected_records(text, start="2024"):
    """Records by a loop over lines; lines before the first start are their own."""
    records, begun = [], False
    for line in text.removesuffix("\r\n").split("\r\n"):
        begun = begun or line.startswith(start)
        if line.startswith(start) or not begun:
            records.append([])
        records[-1].append(line)
    return sorted("\n".join(r) for r in records)


@pytest.mark.parametrize("size", ["100", "700", "128m"])
@pytest.mark.parametrize("start", ["2024", "^2024-", "[0-9]{4}-|INFO"])
def test_text_log(spark, tmp_path, size, start):
    """The same records in splits of any size and on a stream, for anchors, alternatives, Windows line ends and no start."""
    logs = {"a": log_text(400), "b": log_text(3), "none": "no start\r\nat all"}
    (tmp_path / "in").mkdir()
    for name, text in logs.items():
        (tmp_path / "in" / f"{name}.log").write_bytes(text.encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = so.text_log(spark, [str(tmp_path / "in" / "*.log")], start).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    stream = so.text_log(spark, str(tmp_path / "in"), start, streaming=True)
    stream.writeStream.option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start(
        str(tmp_path / "out"), format="parquet").awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out")).collect()
    for name, text in logs.items():
        for found in (rows, streamed):
            assert sorted(r.RawData for r in found if r.FilePath.endswith(f"/{name}.log")) == expected_records(text)


def test_json_log(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1, "t": "2024-01-01T00:00:00Z"}\n{"a": "x"}\nnot json\n')
    schema = so.declared_schema([{"name": "a", "type": "int"}, {"name": "t", "type": "datetime"}])
    rows = so.json_log(spark, str(tmp_path), schema).collect()
    assert sorted((r.a or 0, r._corrupt_record is None) for r in rows) == [(0, False), (0, False), (1, True)]


def test_streams_of_a_rule(spark, tmp_path):
    (tmp_path / "a.txt").write_text("2024-01-01 10:00:00.5 one\n more\n2024-01-01T11:00:00Z two\n")
    (tmp_path / "a.json").write_text('{"Code": 1, "Module": "m"}\n{"Code": "x"}\n')
    text, lines = seeds.log_file("Custom-T", pattern=str(tmp_path / "*.txt")), seeds.log_file(
        "Custom-J", fmt="json", start=None, pattern=str(tmp_path / "*.json"))
    rule = seeds.rule(["Custom-T"], declared={"Custom-T": seeds.LOG, "Custom-J": seeds.JSON_LOG}, files=[text, lines])
    streams = so.log_streams(spark, rule)
    good, rejected = streams["Custom-T"]
    assert good.columns == ["TimeGenerated", "RawData", "FilePath", "Computer"] and rejected.count() == 0
    assert sorted((r.TimeGenerated.hour, r.RawData.count("\n")) for r in good.collect()) == [(10, 1), (11, 0)]
    good, rejected = streams["Custom-J"]
    assert [(r.Code, r.Module) for r in good.collect()] == [(1, "m")] and len(rejected.collect()) == 1
    assert declared_names(rule) == ["Custom-J", "Custom-T"]


def declared_names(rule):
    return sorted(so.declared_streams(rule))


def test_unknown_time_format_and_undeclared_stream(spark):
    entry = seeds.log_file("Custom-T", pattern="x")
    entry["settings"] = {"text": {"recordStartTimestampFormat": "never"}}
    rule = seeds.rule(["Custom-T"], declared={"Custom-T": seeds.LOG}, files=[entry])
    with pytest.raises(ValueError, match="recordStartTimestampFormat"):
        so.log_streams(spark, rule)
    with pytest.raises(ValueError, match="declare"):
        so.log_streams(spark, seeds.rule(["Custom-T"], declared={"Custom-U": seeds.LOG}, files=[entry]))


def test_types_of_a_table_agree(spark, tmp_path):
    sink, rule = so.LogTables(str(tmp_path)), {"properties": {"dataFlows": [{"streams": ["s"], "destinations": ["d"]}]}}
    run_flows(rule, {"s": spark.range(1)}, {}, {"d": sink}, "r", "one")
    with pytest.raises(ValueError, match="other types"):
        run_flows(rule, {"s": spark.range(1).selectExpr("string(id) as id")}, {}, {"d": sink}, "r", "two")


def test_log_table_sink_by_run(spark):
    name = f"sink_by_run_{uuid.uuid4().hex}"
    for n, run in ((3, "a"), (2, "b"), (4, "a")):
        so.log_table_sink(spark.range(n), name, run=run)
    assert sorted((r._run, r.id) for r in spark.table(name).collect()) == [("a", i) for i in range(4)] + [("b", i) for i in range(2)]
    spark.sql(f"DROP TABLE {name}")


def test_table_names():
    from sluicework.sources.sinks import table_name
    assert [table_name(n) for n in ("Custom-X_CL", "Microsoft-Syslog", "Microsoft-Table-Event", "Plain")] == [
        "X_CL", "Syslog", "Event", "Plain"]


def test_flow_checks(spark):
    flow = {"streams": ["s"], "destinations": ["d"], "transformKql": "source | where a"}
    rule = {"properties": {"dataFlows": [flow]}}
    with pytest.raises(ValueError, match="no function"):
        run_flows(rule, {"s": spark.range(1)}, {}, {"d": so.LogTables("x")}, "r", "rule")
    with pytest.raises(ValueError, match="no such destination"):
        run_flows(rule, {"s": spark.range(1)}, {1: lambda df: df}, {}, "r", "rule")


def test_stream_flows_restart_and_repeat(spark, tmp_path):
    """New files add rows once, a repeated batch replaces what it wrote before."""
    rule = {"properties": {"dataFlows": [{"streams": ["s"], "destinations": ["d", "e"]}]}}
    sinks = {"d": so.LogTables(str(tmp_path / "d")), "e": so.LogTables(str(tmp_path / "e"))}
    source = tmp_path / "in"

    def run():
        stream = spark.readStream.schema("id long").parquet(str(source))
        for query in stream_flows(rule, {"s": stream}, {}, sinks, str(tmp_path / "ckpt"), "rule"):
            query.awaitTermination()
        return [sorted(r.id for r in sinks[n].read(spark, "s").collect()) for n in ("d", "e")]

    spark.range(5).write.mode("append").parquet(str(source))
    assert run() == [list(range(5))] * 2
    spark.range(5, 8).write.mode("append").parquet(str(source))
    assert run() == [list(range(8))] * 2
    commits = sorted(pathlib.Path(tmp_path / "ckpt" / "s" / "commits").glob("[0-9]*"))
    commits[-1].unlink()  # as if the stream had stopped before the last commit
    for crc in pathlib.Path(tmp_path / "ckpt" / "s" / "commits").glob(f".{commits[-1].name}.crc"):
        crc.unlink()
    assert run() == [list(range(8))] * 2


def test_audit_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "source"), (2, "T | sort")], "doc_id long, body string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    audit_stream(stream, audit_queries, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(audit_queries(docs).collect())


def test_sink_on_stream(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    name = "sink_on_stream_test"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.createDataFrame([], "id long").write.option("path", str(tmp_path / "table")).saveAsTable(name)
    so.log_table_sink(stream, name, str(tmp_path / "ckpt")).awaitTermination()
    assert spark.table(name).count() == 3


