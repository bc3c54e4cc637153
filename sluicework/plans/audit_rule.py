"""Audit of a table of rule documents.

``audit_rules(docs)`` takes ``(doc_id, body)`` and returns one row per finding.
Everything a finding depends on lies in the document, so as in the audit of
texts the plan is scan -> project -> explode without a shuffle: cross-references
(streams against declarations, flows against destinations) are set differences
inside the row, which Spark does by hashing, and no name or document id can
become a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicework import fixed_values as fv
from sluicework.plans import rule_document as rd
from sluicework.plans.audit_query import bounded_text, embedded_steps, trimmed
from sluicework.plans.findings import (
    Steps, apply_steps, bind, each, has_error, is_among, mark, marks_where, none, once, to_rows,
)
from sluicework.session import prepare


def _if(condition: Column, code: str, *values: Column) -> Column:
    """The mark where the condition is true, else null (dropped at the end)."""
    return F.when(condition, mark(code, *values))


def _number(index: Column) -> Column:
    return (index + 1).cast("string")


def _prefixed(name: Column, prefix: str) -> Column:
    return F.startswith(name, F.lit(prefix))


def _top_level(doc: Column, properties: Column) -> Column:
    return F.array(
        _if(doc["location"].isNull(), "DCR010"),
        _if(doc["properties"].isNull(), "DCR011"),
        _if(doc["properties"].isNotNull() & properties.isNull(), "DCR012"),
    )


def _workspace_kind(p: Column, destinations: Column, flows: Column) -> Column:
    logs = rd.part(destinations["logAnalytics"], "array<variant>")
    sources = rd.part(p["dataSources"], "map<string,variant>")
    return F.concat(
        F.array(
            _if(F.size(sources) > 0, "DCR020"),
            _if(F.size(logs) != 1, "DCR021", F.size(logs).cast("string")),
            _if(destinations.isNotNull() & logs.isNull(), "DCR022"),
        ),
        each(flows, lambda f: marks_where(
            f["streams"], lambda s: ~_prefixed(s, "Microsoft-Table-"), lambda s: mark("DCR023", f["number"], s))),
    )


def _direct_kind(doc: Column, p: Column) -> Column:
    return F.array(_if(
        p["dataCollectionEndpointId"].isNull() & doc["dataCollectionEndpointId"].isNull(), "DCR024"))


def _destinations(p: Column, destinations: Column, logs: Column) -> Column:
    def entry(dest: Column, index: Column) -> Column:
        number, workspace = _number(index), dest["workspaceResourceId"]
        return F.when(dest.isNull(), F.array(mark("DCR032", number))).otherwise(F.array(
            _if(rd.text_of(dest["name"]).isNull(), "DCR033", number),
            _if(workspace.isNull(), "DCR034", number),
            _if(~F.contains(rd.text_of(workspace), F.lit("/providers/")), "DCR035", number),
        ))

    return F.concat(each(logs, entry), F.array(
        _if(p["destinations"].isNotNull() & destinations.isNull(), "DCR030"),
        _if(p["destinations"].isNull(), "DCR031"),
    ))


def _declarations(declared: Column) -> Column:
    def column(stream: Column):
        def judge(col: Column, index: Column) -> Column:
            number = _number(index)
            return bind(rd.text_of(col["type"]), lambda t: F.array(
                _if(col["name"].isNull(), "DCR051", number, stream),
                _if(~F.lower(t).isin(fv.COLUMN_TYPES), "DCR052", number, stream, t),
                _if(t.isNull(), "DCR053", number, stream),
            ))
        return lambda col, index: F.when(col.isNotNull(), judge(col, index)).otherwise(none())

    def stream(entry: Column) -> Column:
        name = entry["key"]
        return bind(rd.part(entry["value"], rd.COLUMNS, "$.columns"), lambda columns: F.concat(
            F.array(_if(~_prefixed(name, "Custom-") & ~_prefixed(name, "Microsoft-"), "DCR050", name)),
            each(columns, column(name)),
            F.array(_if(columns.isNull(), "DCR054", name)),
        ))

    return each(declared, stream)


def _log_files(p: Column, files: Column, undeclared: Column) -> Column:
    def judge(number: Column, lf: Column, streams: Column, patterns: Column, form: Column) -> Column:
        start = rd.part(lf["settings"], "variant", "$.text.recordStartTimestampFormat")
        return F.concat(
            F.array(_if(lf["name"].isNull(), "DCR101", number), _if(F.size(streams) == 0, "DCR102", number)),
            marks_where(rd.strings_of(streams), lambda s: is_among(undeclared, s),
                        lambda s: mark("DCR103", number, s)),
            F.array(
                _if(streams.isNull(), "DCR104", number),
                _if(F.size(patterns) == 0, "DCR105", number),
                _if(patterns.isNull(), "DCR106", number),
                _if(~form.isin(fv.LOG_FORMATS), "DCR107", number, form),
                _if((form == "text") & start.isNull(), "DCR108", number),
                _if(form.isNull(), "DCR109", number),
            ))

    def entry(lf: Column, index: Column) -> Column:
        parts = F.struct(rd.part(lf["streams"], "array<variant>").alias("streams"),
                         rd.part(lf["filePatterns"], "array<variant>").alias("patterns"),
                         rd.text_of(lf["format"]).alias("form"))
        return F.when(lf.isNull(), F.array(mark("DCR100", _number(index)))).otherwise(
            bind(parts, lambda x: judge(_number(index), lf, x["streams"], x["patterns"], x["form"])))

    return F.concat(
        each(files, entry),
        F.array(_if(files.isNotNull() & p["dataCollectionEndpointId"].isNull(), "DCR090")),
    )


def _transforms(flows: Column) -> Column:
    """Embedded transformation of each flow; null where there is nothing to check."""
    return F.transform(flows, lambda f: bind(
        trimmed(f["transform"]), lambda t: F.when((t != "") & (t != "source"), t)))


def _transform(number: Column, marks: Column) -> Column:
    """Errors, then warnings of an embedded transformation, under the flow's label."""
    def labelled(severity: str) -> Column:
        return F.transform(F.filter(marks, lambda m: m["head"]["severity"] == severity), lambda m: F.struct(
            F.struct(m["head"]["text"].alias("text"), m["head"]["severity"].alias("severity"),
                     number.cast("int").alias("flow")).alias("head"),
            m["args"].alias("args")))

    return F.coalesce(F.concat(labelled("error"), labelled("warning")), none())


def _flows(p: Column, flows: Column, transforms: Column, undeclared: Column, undefined: Column) -> Column:
    def stream(number: Column):
        return lambda s: F.when(
            _prefixed(s, "Custom-"), _if(is_among(undeclared, s), "DCR066", number, s),
        ).otherwise(_if(
            _prefixed(s, "Microsoft-") & ~_prefixed(s, "Microsoft-Table-") & ~s.isin(fv.KNOWN_STREAMS),
            "DCR067", number, s))

    def flow(f: Column) -> Column:
        number, out = f["number"], f["output_stream"]
        return F.when(f["bad"], F.array(mark("DCR060", number))).otherwise(F.concat(
            F.array(_if(f["n_streams"] == 0, "DCR061", number)),
            F.coalesce(F.transform(f["streams"], stream(number)), none()),
            F.array(_if(f["streams"].isNull(), "DCR062", number), _if(f["n_destinations"] == 0, "DCR063", number)),
            marks_where(f["destinations"], lambda d: is_among(undefined, d),
                        lambda d: mark("DCR064", number, d)),
            F.array(_if(f["destinations"].isNull(), "DCR065", number)),
            _transform(number, F.get(transforms, number.cast("int") - 1)),
            F.array(
                _if(_prefixed(out, "Custom-") & ~F.endswith(out, F.lit("_CL")), "DCR080", number, out),
                _if(~_prefixed(out, "Custom-") & ~_prefixed(out, "Microsoft-"), "DCR081", number, out),
            ),
        ))

    return F.concat(
        F.array(_if(F.size(flows) == 0, "DCR040")),
        each(flows, flow),
        F.array(
            _if(p["dataFlows"].isNotNull() & flows.isNull(), "DCR041"),
            _if(p["dataFlows"].isNull(), "DCR042"),
        ),
    )


def _by_key(entries: Column) -> Column:
    return F.array_sort(
        entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))


def _undeclared(declared: Column, flows: Column, files: Column) -> Column:
    """Custom streams that are referenced but not declared, sorted."""
    empty = F.array().cast("array<string>")
    used = F.concat(
        F.coalesce(F.flatten(F.transform(flows, lambda f: F.coalesce(f["streams"], empty))), empty),
        F.coalesce(F.flatten(F.transform(files, lambda lf: F.coalesce(
            rd.strings_of(rd.part(lf["streams"], "array<variant>")), empty))), empty))
    custom = F.filter(used, lambda s: F.startswith(s, F.lit("Custom-")))
    return F.sort_array(F.array_except(custom, F.coalesce(F.transform(declared, lambda e: e["key"]), empty)))


def _undefined(destinations: Column, logs: Column, flows: Column) -> Column:
    """Destinations that are referenced but not set up, sorted."""
    empty = F.array().cast("array<string>")
    metrics = rd.text_of(rd.part(destinations["azureMonitorMetrics"], "variant", "$.name"))
    defined = F.concat(F.coalesce(F.transform(logs, lambda d: rd.text_of(d["name"])), empty), F.array(metrics))
    used = F.flatten(F.transform(flows, lambda f: F.coalesce(f["destinations"], empty)))
    return F.sort_array(F.array_except(F.coalesce(used, empty), defined))


@once
def _parts() -> Steps:
    """Typed parts of a document; null where the document lacks them."""
    c = F.col
    return [
        ("text", bounded_text()),
        ("value", rd.strict_json(c("text"))),
        ("doc", rd.part(c("value"), rd.DOCUMENT)),
        ("p", rd.part(c("doc.properties"), rd.PROPERTIES)),
        ("flows", rd.flows_of(c("p"))),
        ("destinations", rd.part(c("p.destinations"), rd.DESTINATIONS)),
        ("logs", rd.part(c("p.destinations"), rd.LOG_DESTINATIONS, "$.logAnalytics")),
        ("declared", F.map_entries(rd.part(c("p.streamDeclarations"), "map<string,variant>"))),
        ("files", rd.part(c("p.dataSources"), rd.LOG_FILES, "$.logFiles")),
    ]


@once
def _judgement() -> Steps:
    c, p = F.col, F.col("p")
    by_kind = (
        F.when(c("kind") == "WorkspaceTransforms", _workspace_kind(p, c("destinations"), c("flows")))
        .when(c("kind") == "Direct", _direct_kind(c("doc"), p)).otherwise(none())
    )
    of_properties = F.concat(
        by_kind,
        _destinations(p, c("destinations"), c("logs")),
        _declarations(c("declared")),
        _log_files(p, c("files"), c("undeclared")),
        _flows(p, c("flows"), c("transforms"), c("undeclared"), c("undefined")),
    )
    found = F.concat(_top_level(c("doc"), p), F.when(p.isNull(), none()).otherwise(of_properties))
    return [
        ("declared", _by_key(c("declared"))),
        ("undeclared", _undeclared(c("declared"), c("flows"), c("files"))),
        ("undefined", _undefined(c("destinations"), c("logs"), c("flows"))),
        ("kind", rd.text_of(c("doc.kind"))),
        ("transforms", _transforms(c("flows"))),
        *embedded_steps("transforms"),
        ("found", F.array_compact(found)),
        ("marks", F.when(c("text").isNull(), F.array(mark("rule_too_big")))
         .when(c("text") == "", F.array(mark("DCR001")))
         .when(c("value").isNull(), F.array(mark("DCR002")))
         .when(c("doc").isNull(), F.array(mark("DCR003")))
         .when(has_error(c("found")), c("found"))
         .otherwise(F.concat("found", F.array(mark("DCR000"))))),
        ("long_names", rd.long_names(c("text"))),
        ("marks", F.when(c("long_names").isNull(), c("marks")).otherwise(F.transform("marks", lambda m: F.struct(
            m["head"].alias("head"), rd.with_long_names(m["args"], c("long_names")).alias("args"))))),
    ]


def parsed_rules(docs: DataFrame, bounded: bool = True) -> DataFrame:
    """Documents with their typed parts; ``bounded`` leaves out those over the audits' size limit."""
    prepare(docs.sparkSession)
    parts = _parts() if bounded else [("text", trimmed(F.col("body"))), *_parts()[1:]]
    return apply_steps(docs.select("doc_id", "body"), parts)


def judge_rules(docs: DataFrame) -> DataFrame:
    """``(doc_id, body)`` -> ``(doc_id, marks)``, one row per document."""
    return apply_steps(parsed_rules(docs), _judgement()).select("doc_id", "marks")


def audit_rules(docs: DataFrame) -> DataFrame:
    """``(doc_id, body)`` -> ``(doc_id, seq, code, severity, message, suggestion)``.

    ``seq`` numbers the findings of a document in check order.  Works on batch
    and streaming DataFrames.
    """
    return to_rows(judge_rules(docs))
