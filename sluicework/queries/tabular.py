"""Registered queries on table operators, sources, sinks and flows, with the same in SQL."""

import warnings

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import functions as F

import sluicework.functions as k
from sluicework import operators as op
from sluicework import sources as so
from sluicework.plans.fleet_flows import fleet_rows, run_fleet
from sluicework.plans.routing import flow_pairs, run_flows, steps
from sluicework.queries.tables import plain, table
from sluicework.session import fresh_path
from sluicework.streaming import stream_flows

c = F.col

EVENT_COLUMNS = [
    {"name": "TimeGenerated", "type": "datetime"}, {"name": "Kind", "type": "string"},
    {"name": "Value", "type": "real"}, {"name": "Number", "type": "int"},
]


def flagship(spark, d):
    """Errors with a number from their properties, as the records of a log table."""
    df = op.where(table(spark, d, "events"), c("event_type") == "error")
    df = op.extend(df, Properties=k.parse_json(c("props")), Number=k.toint(k.field(c("Properties"), "k")),
                   Level=k.case(c("Number") >= 75, "Critical", c("Number") >= 25, "Error", "Warning"))
    return op.project(df, "event_id", "Number", "Level", TimeGenerated=plain(c("ts")), Source=k.strcat("user-", c("user_id")))


def t_where(spark, d):
    return op.where(table(spark, d, "orders"), (c("o_totalprice") > 200000) & k.has(c("o_orderpriority"), "urgent")).select(
        "o_orderkey", "o_totalprice")


def t_extend(spark, d):
    return op.extend(table(spark, d, "part").select("p_partkey", "p_size"), p_size=c("p_size") + 1, twice=c("p_size") * 2,
                     note=k.strcat("size ", c("twice")))


def t_project(spark, d):
    return op.project(table(spark, d, "events"), "event_id", "user_id", kind=k.toupper(c("event_type")), half=c("value") / 2)


def t_project_away(spark, d):
    return op.project_away(table(spark, d, "events"), "ts", "props", "value")


def t_project_rename(spark, d):
    return op.project_rename(table(spark, d, "nation"), key="n_nationkey", region="n_regionkey")


def t_parse(spark, d):
    df = table(spark, d, "pages").select("page_id", "url")
    return op.parse(df, "url", op.ANY, "://", ("host", "string"), ".example.", ("zone", "string"), "/", ("lang", "string"),
                    "/", ("number", "int"))


def t_parse_regex(spark, d):
    df = table(spark, d, "pages").select("page_id", "url")
    return op.parse(df, "url", "https?://", ("host", "string"), r"\.example\.(?:com|org|net)/", ("rest", "string"), kind="regex")


def t_parse_regex_back(spark, d):
    df = table(spark, d, "pages").select("page_id", "url")
    return op.parse(df, "url", "[a-z]+", ("rest", "string"), "s?://", ("host", "string"), r"[a-z.]+", ("zone", "string"), "g/", ("path", "string"),
                    kind="regex")


def t_columnifexists(spark, d):
    df = table(spark, d, "events")
    return op.project(df, "event_id", kind=op.columnifexists(df, "event_type", "none"), level=op.columnifexists(df, "Level", "none"))


def t_let(spark, d):
    op.let("events_of_users", table(spark, d, "events").select("user_id", "value"))
    return spark.sql("SELECT user_id, count(*) AS n FROM events_of_users GROUP BY user_id")


def t_materialize(spark, d):
    bound = op.materialize(op.where(table(spark, d, "events"), c("value") > 50).select("event_id", "event_type", "value"))
    high, low = bound.filter("value >= 150"), bound.filter("value < 150")
    return high.withColumn("half", F.lit("high")).unionByName(low.withColumn("half", F.lit("low")))


def _timed(spark, d):
    df = table(spark, d, "events")
    return op.project(df, "event_id", TimeGenerated=k.todatetime(k.iff(c("value") > 20, k.tostring(c("ts")), c("props"))))


def t_time_column(spark, d):
    good, _ = op.time_column(_timed(spark, d))
    return good.select("event_id", plain(c("TimeGenerated")).alias("TimeGenerated"))


def t_time_column_rejected(spark, d):
    _, rejected = op.time_column(_timed(spark, d))
    return rejected.select("event_id")


def t_geo_location(spark, d):
    """Addresses (user numbers) in ranges made from the customers' keys and nations."""
    ranges = table(spark, d, "customer").filter("c_custkey % 3 <> 0").select(
        (c("c_custkey") * 2).alias("lo"), (c("c_custkey") * 2 + 1).alias("hi"), c("c_nationkey").alias("place"))
    far = spark.createDataFrame([(10**17, 10**18 + 12345, 99)], "lo bigint, hi bigint, place int")
    ranges = ranges.unionByName(far)
    events = table(spark, d, "events").select("event_id", c("user_id").alias("address"))
    return op.geo_location(events, "address", ranges).select("event_id", "address", "place")


def t_geo_location_nested(spark, d):
    """Ranges within ranges, of which the narrowest counts, one hot address and records without one."""
    customers = table(spark, d, "customer")
    ranges = customers.select((c("c_custkey") * 4).alias("lo"), (c("c_custkey") * 4 + 2).alias("hi"), c("c_custkey").alias("place")).unionByName(
        customers.select((c("c_custkey") * 40).alias("lo"), (c("c_custkey") * 40 + 39).alias("hi"), (-c("c_custkey")).alias("place")))
    address = F.when(c("event_id") % 3 == 0, 42).when(c("event_id") % 3 == 1, c("user_id"))
    return op.geo_location(table(spark, d, "events").select("event_id", address.alias("address")), "address", ranges).select(
        "event_id", "address", "place")


def t_ip_location(spark, d):
    """Text addresses of both versions in networks of several lengths."""
    key = c("c_custkey")
    customers = table(spark, d, "customer").filter(key % 3 == 0)
    networks = customers.select(F.concat_ws(".", F.lit("10"), (key % 200).cast("string"), F.floor(key / 200).cast("string"), F.lit("0/24")).alias("network"),
                                key.alias("place")).unionByName(
        table(spark, d, "supplier").filter("s_suppkey < 200").select(
            F.concat(F.lit("10."), c("s_suppkey").cast("string"), F.lit(".0.0/16")).alias("network"), (-c("s_suppkey")).alias("place"))).unionByName(
        customers.select(F.concat(F.lit("2001:DB8:"), F.hex(key), F.lit("::/48")).alias("network"), (key + 10**6).alias("place")))
    user = c("user_id")
    address = F.when(c("event_id") % 7 == 0, "10.1.2").when(c("event_id") % 5 == 0, F.concat(F.lit("2001:db8:"), F.hex(user), F.lit(":0::1"))).when(
        c("event_id") % 5 == 1, F.concat(F.lit("::ffff:10."), (user % 220).cast("string"), F.lit(".0.9"))).otherwise(
        F.concat_ws(".", F.lit("10"), (user % 220).cast("string"), (c("event_id") % 8).cast("string"), F.lit("7")))
    return op.ip_location(table(spark, d, "events").select("event_id", address.alias("address")), "address", networks).select("event_id", "place")


def t_let_function(spark, d):
    """A scalar and a table function that SQL text calls."""
    op.let("events_of_let", table(spark, d, "events").select("event_id", "event_type", "value"))
    op.let_function(spark, "level_of", {"x": "double", "most": "int"}, "string", "CASE WHEN x > most THEN 'high' WHEN x > most / 2 THEN 'middle' ELSE 'low' END")
    op.let_function(spark, "events_over", {"least": "double"}, {"id": "bigint", "kind": "string", "v": "double"},
                    "SELECT event_id, event_type, value FROM events_of_let WHERE value > least")
    return spark.sql("SELECT id, kind, level_of(v, 150) AS level FROM events_over(40.0D)")


def t_parse_limit(spark, d):
    """A pattern with more captures than the language allows works, and warns."""
    wanted = [x for i in range(11) for x in ((f"c{i}", "string"), " ")]
    df = table(spark, d, "events").select("event_id", F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: i + c("event_id"))).alias("line"))
    with warnings.catch_warnings(record=True) as found:
        warnings.simplefilter("always")
        out = op.parse(df, "line", *wanted, ("rest", "string"))
    return out.select("event_id", "c0", "c10", "rest", F.lit(len(found)).alias("warnings"))


# Sources and sinks -----------------------------------------------------------

def _pushed(spark, d):
    """Events as text columns, some of which do not hold what was declared."""
    return table(spark, d, "events").select(
        "event_id", c("ts").cast("string").alias("TimeGenerated"), c("event_type").alias("Kind"), c("value").alias("Value"),
        k.iff(c("user_id") % 10 == 3, "many", c("user_id").cast("string")).alias("Number"))


def r_declared_schema(spark, d):
    """Column names and types of a declaration, for every row that conforms."""
    good, _ = so.conform(_pushed(spark, d), so.declared_schema(EVENT_COLUMNS))
    types = F.array(*[F.struct(F.lit(n).alias("column"), F.lit(t).alias("type")) for n, t in good.dtypes])
    return good.groupBy("Kind").agg(F.count("*").alias("n")).select("Kind", "n", F.explode(types).alias("t")).select(
        "Kind", "n", "t.*")


def r_conform(spark, d):
    good, _ = so.conform(_pushed(spark, d), so.declared_schema(EVENT_COLUMNS))
    return good.withColumn("TimeGenerated", plain(c("TimeGenerated")))


def r_conform_rejected(spark, d):
    _, rejected = so.conform(_pushed(spark, d), so.declared_schema(EVENT_COLUMNS))
    return rejected.select("event_id", "Number")


def r_conform_once(spark, d):
    """Good rows and rejected ones with their causes, from one pass."""
    good, rejected = so.conform_once(_pushed(spark, d), so.declared_schema(EVENT_COLUMNS), fresh_path(spark, "conformed"))
    bad = rejected.select("event_id", F.explode("_causes").alias("e")).select("event_id", "e.*")
    return good.groupBy().agg(F.count("*").alias("event_id")).select(
        "event_id", *[F.lit(None).cast("string").alias(n) for n in ("column", "cause", "value")]).unionByName(bad)


def r_declared_stream(spark, d):
    schema = so.declared_schema([{"name": "o_orderkey", "type": "long"}, {"name": "o_orderdate", "type": "DateTime"},
                                 {"name": "o_totalprice", "type": "double"}, {"name": "Comment", "type": "dynamic"}])
    good, _ = so.declared_stream(table(spark, d, "orders"), schema)
    return good.select("o_orderkey", plain(c("o_orderdate")).alias("o_orderdate"), "o_totalprice",
                       c("Comment").isNull().alias("no_comment"))


def r_table_stream(spark, d):
    op.let("SupplierLog", table(spark, d, "supplier"))
    return so.table_stream(spark, "Microsoft-Table-SupplierLog").select("s_suppkey", "s_name")


def r_table_stream_stream(spark, d):
    """An existing table that grows between two triggers of the stream that reads it."""
    folder, name = _sink_name(spark, "SupplierLog")
    out, ckpt = fresh_path(spark, "suppliers"), fresh_path(spark, "ckpt")
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name")
    spark.createDataFrame([], rows.schema).write.format("parquet").option("path", folder).saveAsTable(name)
    for part in (rows.filter("s_suppkey % 2 = 0"), rows.filter("s_suppkey % 2 = 1")):
        part.write.mode("append").saveAsTable(name)
        _run(so.table_stream(spark, f"Microsoft-Table-{name}", streaming=True).writeStream.format("parquet").option("checkpointLocation", ckpt)
             .trigger(availableNow=True).start(out))
    return spark.read.parquet(out)


def r_select_levels(spark, d):
    df = op.project_rename(table(spark, d, "events"), Facility="event_type")
    df = op.extend(df, SeverityLevel=k.case(c("value") > 100, "Error", c("value") > 50, "Warning", "info"))
    return so.select_levels(df, ["error", "signup"], ["Error", "Warning"]).select("event_id", "Facility", "SeverityLevel")


def r_datatable(spark, d):
    names = so.datatable(spark, "event_type string, label string", [("error", "bad"), ("view", "fine"), ("click", "fine")])
    return table(spark, d, "events").join(F.broadcast(names), "event_type").select("event_id", "label")


def r_print(spark, d):
    wanted = so.print_(spark, event_type="error", least=100)
    return table(spark, d, "events").join(F.broadcast(wanted), "event_type").filter("value >= least").select("event_id", "least")


def _log_lines(spark, d):
    """Events as log records of one to three lines."""
    extra = F.when(c("event_id") % 3 == 0, F.concat(F.lit("\n  at "), c("props"), F.lit("\n  end"))).when(
        c("event_id") % 3 == 1, F.lit("\n")).otherwise("")
    return table(spark, d, "events").select(F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" id="), c("event_id").cast("string"), F.lit(" "),
        c("event_type"), extra).alias("value"))


def _written_log(spark, d):
    path = fresh_path(spark, "text-log")
    _log_lines(spark, d).write.text(path)
    return path


def _records(df):
    return df.select(k.tolong(k.extract(" id=([0-9]+)", 1, c("RawData"))).alias("event_id"), "RawData",
                     F.startswith(c("FilePath"), F.lit("file:")).alias("has_path"))


def r_text_log(spark, d):
    return _records(so.text_log(spark, _written_log(spark, d)))


def r_text_log_split(spark, d):
    """The same with records that a start pattern with alternatives and an anchor finds, over Windows line ends."""
    path = fresh_path(spark, "text-log")
    _log_lines(spark, d).select(F.regexp_replace("value", "\n", "\r\n").alias("value")).write.option("lineSep", "\r\n").text(path)
    return _records(so.text_log(spark, path, "^[0-9]{4}-|INFO"))


def r_text_log_no_start(spark, d):
    """A log in which no record starts is read line by line."""
    lines = so.text_log(spark, _written_log(spark, d), "START")
    return lines.groupBy("RawData").agg(F.count("*").alias("n"))


def _run(stream_query):
    stream_query.awaitTermination()


def r_text_log_stream(spark, d):
    records = so.text_log(spark, _written_log(spark, d), streaming=True)
    out = fresh_path(spark, "records")
    _run(_records(records).writeStream.format("parquet").option("checkpointLocation", fresh_path(spark, "ckpt"))
         .trigger(availableNow=True).start(out))
    return spark.read.parquet(out)


def _grown(lines, path, share):
    """Log files, a partition's lines in each, of which this share of the bytes has been written so far."""
    def write(rows):
        data = "".join(r.value + "\n" for r in rows).encode()
        system, place = fs.FileSystem.from_uri(path)
        system.create_dir(place)
        with system.open_output_stream(f"{place}/{TaskContext.get().partitionId()}.log") as file:
            file.write(data[:int(len(data) * share)])

    lines.foreachPartition(write)


def r_text_log_tail(spark, d):
    """Files that grow between the triggers of a stream, and are closed at last."""
    lines = _log_lines(spark, d).repartition(8, "value").sortWithinPartitions("value")
    path, out, ckpt = (fresh_path(spark, name) for name in ("growing", "records", "ckpt"))
    for share, idle in ((0.4, 3600), (1.0, 3600), (1.0, 0)):
        _grown(lines, path, share)
        _run(_records(so.text_log_tail(spark, path, idle_seconds=idle)).writeStream.format("parquet").option("checkpointLocation", ckpt)
             .trigger(availableNow=True).start(out))
    return spark.read.parquet(out)


JSON_COLUMNS = [{"name": "event_id", "type": "long"}, {"name": "TimeGenerated", "type": "datetime"},
                {"name": "event_type", "type": "string"}, {"name": "value", "type": "real"}]


def _written_json(spark, d):
    path = fresh_path(spark, "json-log")
    df = table(spark, d, "events").select("event_id", c("ts").alias("TimeGenerated"), "event_type", "value")
    line = F.when(c("event_id") % 50 == 7, F.lit("{broken")).otherwise(
        F.to_json(F.struct(*df.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"}))
    df.select(line.alias("value")).write.text(path)
    return path


def r_json_log(spark, d):
    df = so.json_log(spark, _written_json(spark, d), so.declared_schema(JSON_COLUMNS))
    return df.withColumn("TimeGenerated", plain(c("TimeGenerated")))


def r_json_log_stream(spark, d):
    df = so.json_log(spark, _written_json(spark, d), so.declared_schema(JSON_COLUMNS), streaming=True)
    out = fresh_path(spark, "json")
    _run(df.writeStream.format("parquet").option("checkpointLocation", fresh_path(spark, "ckpt"))
         .trigger(availableNow=True).start(out))
    return spark.read.parquet(out).withColumn("TimeGenerated", plain(c("TimeGenerated")))


def _sink_name(spark, name):
    folder = fresh_path(spark, name)
    table_name = f"{name}_{folder[-12:]}"
    return folder, table_name


def _appended(spark, sink, df, name):
    """Rows after two appends to a table of the session's catalog at a path of its own."""
    folder, table_name = _sink_name(spark, name)
    spark.createDataFrame([], df.schema).write.format("parquet").option("path", folder).saveAsTable(table_name)
    sink(df.filter("value < 100"), table_name)
    sink(df.filter("value >= 100"), table_name)
    return spark.table(table_name)


def r_log_table_sink(spark, d):
    return _appended(spark, so.log_table_sink, table(spark, d, "events").select("event_id", "event_type", "value"), "log_sink")


def r_metrics_sink(spark, d):
    return _appended(spark, so.metrics_sink, table(spark, d, "events").select("event_id", "value"), "metric_sink")


FLOW_RULE = {"properties": {"dataFlows": [
    {"streams": ["Custom-Errors"], "destinations": ["near", "far"], "outputStream": "Custom-Errors_CL",
     "transformKql": "source | where value > 100 | project TimeGenerated, event_id, value"},
    {"streams": ["Custom-Errors", "Custom-Views"], "destinations": ["near"], "outputStream": "Custom-All_CL",
     "transformKql": "source"},
    {"streams": ["Custom-Views"], "destinations": ["meter"], "transformKql": "source | project event_id, value"},
]}}
FLOW_TRANSFORMS = {
    1: lambda df: op.project(op.where(df, c("value") > 100), "TimeGenerated", "event_id", "value"),
    3: lambda df: op.project(df, "event_id", "value"),
}


def _flow_sinks(spark):
    return {"near": so.LogTables(fresh_path(spark, "near")), "far": so.LogTables(fresh_path(spark, "far")),
            "meter": so.MetricsTable(fresh_path(spark, "meter"))}


def _flow_results(spark, sinks, ledger=None):
    tables = {
        "near errors": sinks["near"].read(spark, "Custom-Errors_CL", ledger), "far errors": sinks["far"].read(spark, "Custom-Errors_CL", ledger),
        "near all": sinks["near"].read(spark, "Custom-All_CL", ledger), "metrics": sinks["meter"].read(spark, "Custom-Views", ledger),
    }
    out = None
    for name, df in tables.items():
        part = df.select(F.lit(name).alias("place"), "event_id", "value")
        out = part if out is None else out.unionByName(part)
    return out


def _input(events, kind):
    return events.filter(c("event_type") == kind).select("event_id", c("ts").alias("TimeGenerated"), "value")


def r_run_flows(spark, d):
    events, sinks = table(spark, d, "events"), _flow_sinks(spark)
    streams = {"Custom-Errors": _input(events, "error"), "Custom-Views": _input(events, "view")}
    for _ in range(2):  # a repeated run leaves the rows once
        run_flows(FLOW_RULE, streams, FLOW_TRANSFORMS, sinks, run="first", rule_id="rule")
    return _flow_results(spark, sinks)


def r_run_flows_stream(spark, d):
    sinks = _flow_sinks(spark)
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn(
        "ts", c("ts").cast("timestamp"))
    streams = {"Custom-Errors": _input(source, "error"), "Custom-Views": _input(source, "view")}
    for query in stream_flows(FLOW_RULE, streams, FLOW_TRANSFORMS, sinks, fresh_path(spark, "ckpt"), "rule"):
        _run(query)
    return _flow_results(spark, sinks)


def r_flows_committed(spark, d):
    """Runs of a ledger: one that is repeated, and one that stopped after its first destination."""
    events, sinks = table(spark, d, "events"), _flow_sinks(spark)
    ledger = so.Ledger(fresh_path(spark, "ledger"))
    views = {"Custom-Errors": _input(events, "error").limit(0), "Custom-Views": _input(events, "view")}
    streams = {**views, "Custom-Errors": _input(events, "error")}
    for streams_ in (views, streams):  # the second attempt replaces the first
        run_flows(FLOW_RULE, streams_, FLOW_TRANSFORMS, sinks, run="first", rule_id="rule", ledger=ledger)
    stopped = list(steps(FLOW_RULE, FLOW_TRANSFORMS, sinks))[0]
    stopped.write(streams[stopped.stream], "rule", ledger.attempt("second"))
    return _flow_results(spark, sinks, ledger)


FLEET_TEXT = "source | where value > 100 | project event_id, value"


def _fleet_of_rules(spark, d):
    """A rule per supplier that takes one kind of events, all of them to one place and the large ones to two."""
    kinds = F.array(*[F.lit(x) for x in ("error", "view", "click", "signup", "purchase")])
    stream = F.concat(F.lit("Custom-"), F.get(kinds, (c("s_suppkey") % 5).cast("int")))
    flow = lambda text, out, *to: F.struct(
        F.array(stream).alias("streams"), F.array(*map(F.lit, to)).alias("destinations"), F.lit(text).alias("transformKql"), F.lit(out).alias("outputStream"))
    flows = F.array(flow("source", "Custom-All_CL", "near"), flow(FLEET_TEXT, "Custom-Large_CL", "near", "far"))
    return table(spark, d, "supplier").select(
        c("s_suppkey").alias("doc_id"), F.to_json(F.struct(F.struct(flows.alias("dataFlows")).alias("properties"))).alias("body"))


def r_fleet_flows(spark, d):
    """What all rules of a fleet have written: one job for all rules, flows and destinations."""
    events = table(spark, d, "events").select("event_id", "value", F.concat(F.lit("Custom-"), c("event_type")).alias("stream"))
    folder, ledger = fresh_path(spark, "fleet"), so.Ledger(fresh_path(spark, "ledger"))
    large = {FLEET_TEXT: lambda df: op.project(op.where(df, c("value") > 100), "event_id", "value")}
    pairs = flow_pairs(_fleet_of_rules(spark, d))
    run_fleet(events.limit(0), pairs, large, folder, ledger, run="one")
    run_fleet(events, pairs, large, folder, ledger, run="one")
    totals = [F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.min("value").alias("least"), F.max("value").alias("most")]
    return fleet_rows(spark, folder, ledger, totals).groupBy("destination", "table", "rule", "flow").agg(
        F.sum("n").alias("n"), F.sum("ids").alias("ids"), F.min("least").alias("least"), F.max("most").alias("most"))


def _one_flow(*destinations, output="Custom-All_CL"):
    return {"properties": {"dataFlows": [
        {"streams": ["Custom-In"], "destinations": list(destinations), "outputStream": output, "transformKql": "source"}]}}


def r_flows_two_rules(spark, d):
    """Two rules that run under one name and write to one table."""
    events, sink = table(spark, d, "events"), so.LogTables(fresh_path(spark, "two"))
    for kind in ("error", "view"):
        run_flows(_one_flow("near"), {"Custom-In": _input(events, kind)}, {}, {"near": sink}, run="same", rule_id=kind)
    return sink.read(spark, "Custom-All_CL").select("event_id", "value")


def r_flows_same_destination_twice(spark, d):
    """A destination that a flow lists twice, and another one with the same folder."""
    events, folder = table(spark, d, "events"), fresh_path(spark, "twice")
    sinks = {"near": so.LogTables(folder), "again": so.LogTables(folder + "/")}
    run_flows(_one_flow("near", "near", "again"), {"Custom-In": _input(events, "error")}, {}, sinks, run="one", rule_id="rule")
    return sinks["near"].read(spark, "Custom-All_CL").select("event_id", "value")


def r_metrics_two_schemas(spark, d):
    """Two streams with other columns in the one table of a metrics destination."""
    events, sinks = table(spark, d, "events"), {"meter": so.MetricsTable(fresh_path(spark, "meter"))}
    orders = table(spark, d, "orders").select(c("o_orderkey").alias("order_id"), c("o_totalprice").alias("value"))
    for rule_id, df in (("events", events.select("event_id", "value")), ("orders", orders)):
        run_flows(_one_flow("meter"), {"Custom-In": df}, {}, sinks, run="one", rule_id=rule_id)
    return sinks["meter"].read(spark, "Custom-All_CL").select("event_id", "order_id", "value")


def _log_rule(entries, columns):
    return {"properties": {"streamDeclarations": {"Custom-L": {"columns": columns}}, "dataSources": {"logFiles": entries}}}


TEXT_COLUMNS = [{"name": "TimeGenerated", "type": "datetime"}, {"name": "RawData", "type": "string"},
                {"name": "FilePath", "type": "string"}, {"name": "Computer", "type": "string"}]


def _entry(fmt, *patterns, start=None):
    settings = {"settings": {"text": {"recordStartTimestampFormat": start}}} if start else {}
    return {"streams": ["Custom-L"], "filePatterns": list(patterns), "format": fmt, "name": "log", **settings}


def r_log_streams_text(spark, d):
    """Records that start with a time in another format than ISO 8601."""
    path = fresh_path(spark, "us-log")
    table(spark, d, "events").select(F.concat(
        F.date_format("ts", "M/d/yyyy h:mm:ss a"), F.lit(" id="), c("event_id").cast("string"), F.lit("\n  2020-01-01 00:00 no start")
    ).alias("value")).write.text(path)
    good, _ = so.log_streams(spark, _log_rule([_entry("text", path, start="M/D/YYYY HH:MM:SS AM/PM")], TEXT_COLUMNS),
                             computer="here")["Custom-L"]
    return good.select(plain(c("TimeGenerated")).alias("TimeGenerated"), "RawData", "Computer",
                       F.startswith(c("FilePath"), F.lit("file:")).alias("has_path"))


def r_log_streams_two_entries(spark, d):
    """Two log entries that feed one stream."""
    paths = [_written_log(spark, d), _written_log(spark, d)]
    good, _ = so.log_streams(spark, _log_rule([_entry("text", p, start="ISO 8601") for p in paths], TEXT_COLUMNS))["Custom-L"]
    return good.select("RawData", plain(c("TimeGenerated")).alias("TimeGenerated"))


def r_log_streams_json(spark, d):
    """JSON lines with a path, and a guid that has to be one."""
    path = fresh_path(spark, "json-log")
    guid = F.when(c("event_id") % 5 == 0, F.lit("none")).otherwise(
        F.concat(F.lit("ABCDEF00-0000-4000-8000-"), F.lpad(c("event_id").cast("string"), 12, "0")))
    table(spark, d, "events").select(F.to_json(F.struct("event_id", guid.alias("key"))).alias("value")).write.text(path)
    columns = [{"name": "event_id", "type": "long"}, {"name": "key", "type": "guid"}, {"name": "FilePath", "type": "string"}]
    good, _ = so.log_streams(spark, _log_rule([_entry("json", path)], columns))["Custom-L"]
    return good.select("event_id", "key", F.startswith(c("FilePath"), F.lit("file:")).alias("has_path"))


def t_parse_no_match(spark, d):
    """Long rows on which a pattern with many captures fails."""
    df = table(spark, d, "events").select("event_id", F.repeat(F.concat(c("event_type"), F.lit(" ")), 200).alias("line"))
    wanted = [x for i in range(8) for x in ((f"c{i}", "string"), " ")]
    return op.parse(df, "line", *wanted, "#end").select("event_id", "c0", "c7")


QUERIES = {
    f.__name__: f for f in (
        flagship, t_where, t_extend, t_project, t_project_away, t_project_rename, t_parse, t_parse_regex, t_parse_regex_back, t_columnifexists,
        t_let, t_materialize, t_time_column, t_time_column_rejected, t_geo_location, r_declared_schema, r_conform,
        r_conform_rejected, r_declared_stream, r_table_stream, r_select_levels, r_datatable, r_print, r_text_log,
        r_text_log_split, r_text_log_stream, r_json_log, r_json_log_stream, r_log_table_sink, r_metrics_sink,
        r_run_flows, r_run_flows_stream, r_flows_two_rules, r_flows_same_destination_twice, r_metrics_two_schemas,
        r_log_streams_text, r_log_streams_two_entries, r_log_streams_json, r_text_log_no_start, t_parse_no_match,
        r_text_log_tail, r_flows_committed, r_fleet_flows, t_geo_location_nested, t_ip_location, t_let_function, t_parse_limit,
        r_conform_once, r_table_stream_stream)
}

_RECORDS = """
    SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' id=' || event_id || ' ' || event_type ||
           CASE event_id % 3 WHEN 0 THEN chr(10) || '  at ' || props || chr(10) || '  end' WHEN 1 THEN chr(10) ELSE '' END AS "RawData",
           true AS has_path
    FROM events"""
_JSON = """
    SELECT CASE WHEN event_id % 50 <> 7 THEN event_id END AS event_id, CASE WHEN event_id % 50 <> 7 THEN ts END AS "TimeGenerated",
           CASE WHEN event_id % 50 <> 7 THEN event_type END AS event_type, CASE WHEN event_id % 50 <> 7 THEN value END AS value,
           CASE WHEN event_id % 50 = 7 THEN '{broken' END AS _corrupt_record
    FROM events"""
_FLOWS = """
    SELECT 'near errors' AS place, event_id, value FROM events WHERE event_type = 'error' AND value > 100
    UNION ALL SELECT 'far errors', event_id, value FROM events WHERE event_type = 'error' AND value > 100
    UNION ALL SELECT 'near all', event_id, value FROM events WHERE event_type IN ('error', 'view')
    UNION ALL SELECT 'metrics', event_id, value FROM events WHERE event_type = 'view'"""

ORACLE = {
    "flagship": """
        WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS n FROM events WHERE event_type = 'error')
        SELECT event_id, n AS "Number", CASE WHEN n >= 75 THEN 'Critical' WHEN n >= 25 THEN 'Error' ELSE 'Warning' END AS "Level",
               ts AS "TimeGenerated", 'user-' || user_id AS "Source" FROM e""",
    "t_where": """
        SELECT o_orderkey, o_totalprice FROM orders
        WHERE o_totalprice > 200000 AND regexp_matches(o_orderpriority, '(?i)(^|[^a-z0-9])urgent([^a-z0-9]|$)')""",
    "t_extend": """
        SELECT p_partkey, p_size + 1 AS p_size, (p_size + 1) * 2 AS twice, 'size ' || ((p_size + 1) * 2) AS note FROM part""",
    "t_project": "SELECT event_id, user_id, upper(event_type) AS kind, value / 2 AS half FROM events",
    "t_project_away": "SELECT event_id, user_id, event_type FROM events",
    "t_project_rename": "SELECT n_nationkey AS key, n_name, n_regionkey AS region FROM nation",
    "t_parse": r"""
        WITH p AS (SELECT page_id, url, regexp_extract(url, '\A.*?://(.*?)\.example\.(.*?)/(.*?)/(.*)\z',
                          ['host', 'zone', 'lang', 'number']) AS m,
                          regexp_matches(url, '\A.*?://.*?\.example\..*?/.*?/.*\z') AS hit FROM pages)
        SELECT page_id, url, CASE WHEN hit THEN m.host END AS host, CASE WHEN hit THEN m.zone END AS zone,
               CASE WHEN hit THEN m.lang END AS lang, CASE WHEN hit THEN try_cast(m.number AS INTEGER) END AS number FROM p""",
    "t_parse_regex": r"""
        WITH p AS (SELECT page_id, url, regexp_extract(url, '\Ahttps?://(.*?)\.example\.(?:com|org|net)/(.*)\z', ['host', 'rest']) AS m,
                          regexp_matches(url, '\Ahttps?://.*?\.example\.(?:com|org|net)/') AS hit FROM pages)
        SELECT page_id, url, CASE WHEN hit THEN m.host END AS host, CASE WHEN hit THEN m.rest END AS rest FROM p""",
    "t_parse_regex_back": r"""
        WITH p AS (SELECT page_id, url, regexp_extract(url, '\A[a-z]+(.*?)s?://(.*?)[a-z.]+(.*?)g/(.*)\z', ['rest', 'host', 'zone', 'path']) AS m,
                          regexp_matches(url, '\A[a-z]+.*?s?://.*?[a-z.]+.*?g/') AS hit FROM pages)
        SELECT page_id, url, CASE WHEN hit THEN m.rest END AS rest, CASE WHEN hit THEN m.host END AS host,
               CASE WHEN hit THEN m.zone END AS zone, CASE WHEN hit THEN m.path END AS path FROM p""",
    "t_columnifexists": "SELECT event_id, event_type AS kind, 'none' AS level FROM events",
    "t_let": "SELECT user_id, count(*) AS n FROM events GROUP BY user_id",
    "t_materialize": """
        SELECT event_id, event_type, value, CASE WHEN value >= 150 THEN 'high' ELSE 'low' END AS half FROM events WHERE value > 50""",
    "t_time_column": "SELECT event_id, ts AS \"TimeGenerated\" FROM events WHERE value > 20",
    "t_time_column_rejected": "SELECT event_id FROM events WHERE NOT value > 20",
    "t_geo_location": """
        SELECT event_id, user_id AS address, c_nationkey AS place FROM events
        LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON user_id BETWEEN c_custkey * 2 AND c_custkey * 2 + 1""",
    "t_geo_location_nested": """
        WITH e AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 42 WHEN 1 THEN user_id END AS address FROM events),
             r AS (SELECT c_custkey * 4 AS lo, c_custkey * 4 + 2 AS hi, c_custkey AS place FROM customer
                   UNION ALL SELECT c_custkey * 40, c_custkey * 40 + 39, -c_custkey FROM customer),
             a AS (SELECT DISTINCT address FROM e),
             f AS (SELECT address, arg_min(place, hi - lo) AS place FROM a JOIN r ON address BETWEEN lo AND hi GROUP BY address)
        SELECT event_id, address, place FROM e LEFT JOIN f USING (address)""",
    "t_ip_location": """
        WITH e AS (SELECT event_id, user_id, event_id % 7 AS bad, event_id % 5 AS kind, CASE event_id % 5 WHEN 1 THEN 0 ELSE event_id % 8 END AS third FROM events),
             n AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 = 0)
        SELECT event_id, CASE WHEN bad = 0 THEN NULL WHEN kind = 0 THEN six.k + 1000000 ELSE coalesce(four.k, -s_suppkey) END AS place FROM e
        LEFT JOIN n six ON kind = 0 AND six.k = user_id
        LEFT JOIN n four ON four.k % 200 = user_id % 220 AND four.k // 200 = third
        LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey < 200) ON s_suppkey = user_id % 220""",
    "t_let_function": """
        SELECT event_id AS id, event_type AS kind, CASE WHEN value > 150 THEN 'high' WHEN value > 75 THEN 'middle' ELSE 'low' END AS level
        FROM events WHERE value > 40""",
    "t_parse_limit": """
        SELECT event_id, event_id::VARCHAR AS c0, (event_id + 10)::VARCHAR AS c10, (event_id + 11)::VARCHAR AS rest, 1 AS warnings FROM events""",
    "r_conform_once": """
        SELECT count(*) AS event_id, NULL AS "column", NULL AS cause, NULL AS value FROM events WHERE user_id % 10 <> 3
        UNION ALL SELECT event_id, 'Number', 'not a int', 'many' FROM events WHERE user_id % 10 = 3""",
    "r_table_stream_stream": "SELECT s_suppkey, s_name FROM supplier",
    "r_declared_schema": """
        SELECT event_type AS "Kind", count(*) AS n, "column", "type" FROM events,
               (VALUES ('TimeGenerated', 'timestamp'), ('Kind', 'string'), ('Value', 'double'), ('Number', 'int')) v("column", "type")
        WHERE user_id % 10 <> 3 GROUP BY ALL""",
    "r_conform": """
        SELECT ts AS "TimeGenerated", event_type AS "Kind", value AS "Value", CAST(user_id AS INTEGER) AS "Number"
        FROM events WHERE user_id % 10 <> 3""",
    "r_conform_rejected": "SELECT event_id, 'many' AS \"Number\" FROM events WHERE user_id % 10 = 3",
    "r_declared_stream": "SELECT o_orderkey, o_orderdate, o_totalprice, true AS no_comment FROM orders",
    "r_table_stream": "SELECT s_suppkey, s_name FROM supplier",
    "r_select_levels": """
        SELECT event_id, event_type AS "Facility", CASE WHEN value > 100 THEN 'Error' ELSE 'Warning' END AS "SeverityLevel"
        FROM events WHERE event_type IN ('error', 'signup') AND value > 50""",
    "r_datatable": """
        SELECT event_id, CASE event_type WHEN 'error' THEN 'bad' ELSE 'fine' END AS label FROM events
        WHERE event_type IN ('error', 'view', 'click')""",
    "r_print": "SELECT event_id, 100 AS least FROM events WHERE event_type = 'error' AND value >= 100",
    "r_text_log": _RECORDS, "r_text_log_split": _RECORDS, "r_text_log_stream": _RECORDS, "r_text_log_tail": _RECORDS,
    "r_json_log": _JSON, "r_json_log_stream": _JSON,
    "r_log_table_sink": "SELECT event_id, event_type, value FROM events",
    "r_metrics_sink": "SELECT event_id, value FROM events",
    "r_run_flows": _FLOWS, "r_run_flows_stream": _FLOWS, "r_flows_committed": _FLOWS,
    "r_fleet_flows": """
        WITH f AS (
            SELECT s_suppkey AS rule, ['error', 'view', 'click', 'signup', 'purchase'][s_suppkey % 5 + 1] AS kind, f.* FROM supplier,
                (VALUES (1, 'near', 'All_CL', -1e300), (2, 'near', 'Large_CL', 100), (2, 'far', 'Large_CL', 100)) f(flow, destination, "table", least_value)
        )
        SELECT destination, "table", rule, flow, count(*) AS n, sum(event_id)::BIGINT AS ids, min(value) AS least, max(value) AS most
        FROM f JOIN events ON event_type = kind AND value > least_value GROUP BY ALL""",
    "r_flows_two_rules": "SELECT event_id, value FROM events WHERE event_type IN ('error', 'view')",
    "r_flows_same_destination_twice": "SELECT event_id, value FROM events WHERE event_type = 'error'",
    "r_metrics_two_schemas": """
        SELECT event_id, NULL::BIGINT AS order_id, value FROM events
        UNION ALL SELECT NULL, o_orderkey, o_totalprice FROM orders""",
    "r_log_streams_text": """
        SELECT date_trunc('second', ts) AS "TimeGenerated",
               strftime(ts, '%-m/%-d/%Y %-I:%M:%S %p') || ' id=' || event_id || chr(10) || '  2020-01-01 00:00 no start' AS "RawData",
               'here' AS "Computer", true AS has_path
        FROM events""",
    "r_log_streams_two_entries": f"""
        SELECT "RawData", date_trunc('second', ts) AS "TimeGenerated"
        FROM ({_RECORDS}) JOIN events USING (event_id), range(2)""",
    "r_log_streams_json": """
        SELECT event_id, 'abcdef00-0000-4000-8000-' || lpad(event_id::VARCHAR, 12, '0') AS key, true AS has_path
        FROM events WHERE event_id % 5 <> 0""",
    "r_text_log_no_start": f"""
        SELECT l AS "RawData", count(*) AS n FROM (SELECT unnest(string_split("RawData", chr(10))) AS l FROM ({_RECORDS})) GROUP BY l""",
    "t_parse_no_match": "SELECT event_id, NULL::VARCHAR AS c0, NULL::VARCHAR AS c7 FROM events",
}
