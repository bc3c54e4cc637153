"""Fleets of texts and documents made from the supplied tables.

Every event becomes one text or document: its number picks a template and its
values go into the ``{e}`` (event type), ``{u}`` (user) and ``{k}`` (number)
places, so the fleet grows with the table.
"""

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicework.queries.tables import table
from sluicework.session import spread

QUERY_TEMPLATES = [
    "source",
    "source | where severity == \"{e}\" | extend P = parse_json(props) | project TimeGenerated = todatetime(t), U = {u}",
    "  source\n| where Kind in ('{e}', 'x;y|z') // in (a list)\n| project-away Raw{u}",
    "source | summarize count() by {e}",
    "source | join kind=inner (T{u}) on Key | summarize dcount({e}) by u{u}",
    " \n\t ", "// only {e} ({u})",
    "{e}{u} | where severity == 'error'\n| extend a = 1h, b=12e3ms (x)",
    "source | extend a = Column_IfExists('{e}', ''), b = avg({u}) | extend c = my_fn(1), d = dynamic({k})",
    "let d=externaldata(c:string)[h'https://example.com/{e}.txt']\n| parse Raw with c:string;\nsource\n| where c has '{u}'",
    "let x = {k};\nSys{u}\n| where t == @'{e}\\' and u == @\"a\"\"b\"",
    "source | Order by {e} | sort by x | order\nby y | extend z = ORDER  BY",
    "source | parse m with * 'a' c1:string ' ' c2:int c3 c4 c5 c6 c7 c8 c9 c10 c11:long 'u{u}' | project TimeGenerated, {e}",
    "source | parse m \"{e}\" c1 'x' c2 'x' c3 'x' c4 'x' c5 'x' c6 'x' c7 'x' c8 'x' c9 'x' c10 'x' c{u} | parse-where q 'a' b",
    "source | where m has_any ('{e}') or n Has_All(\"u\") and toscalar(x) > toScalar {u}",
    "source | mv-expand {e} | make-series n=count() | top-nested 3 of u{u}",
    "| where {e} > {u} | extend x = strcat('it\\'s', \"q\\\"{e}\", tostring({k}))",
    "let lim = {u};", "print x = {k} | extend TimeGenerated = now() | project-rename y = {e}",
    "source\\n| where a == 1 \\n| project {e} // TimeGenerated",
    "source | where timegenerated > ago(1d) | project {e}, u{u} | getschema",
    "source | extend é{e} = 5ü{u}, b = not(isnull({e})), K = \u212Aount(x) | Lookup\u00a0T on k",
    "source | where s == 'open {e} ; | ) | unknownop {u} | foo-bar x | serialize | later",
    "datatable(a:string)['{e}'] | columnifexists('x{u}', '') | source | where 1a2(3) or _x{u}(4)",
    "SOURCE | WHERE x !~ '{e}' and y !contains \"{u}\" and z != 3.5e7 | PROJECT TimeGenerated",
    "{k}{e} (1) | fork | { find {u} } ; ; | | search x",
]


def _rule(properties, **top):
    return json.dumps({**top, "properties": properties}, separators=(", ", ": "))


_ID = "/subscriptions/s/providers/w{u}"
_TO = {"logAnalytics": [{"workspaceResourceId": _ID, "name": "{e}"}]}
_FLOW = {"streams": ["Microsoft-Syslog"], "destinations": ["{e}"], "transformKql": "source"}
_COLUMNS = {"columns": [{"name": "TimeGenerated", "type": "datetime"}, {"name": "u{u}", "type": "Guid"}]}
_LOG = {"name": "l{u}", "streams": ["Custom-{e}"], "filePatterns": ["C:\\logs\\*.txt"], "format": "text",
        "settings": {"text": {"recordStartTimestampFormat": "ISO 8601"}}}


def _flows(*flows, **more):
    return _rule({"destinations": _TO, "dataFlows": list(flows), **more}, location="eastus")


RULE_TEMPLATES = [
    _flows(_FLOW),
    "", "\u2003\n", "{\"{e}\": ", "[{k}]", "\"{e}\"", "null", "{k}",
    "{\"location\": null, \"properties\": {\"dataFlows\": []}} {\"{e}\": {u}}", "{\"a\": 1}]",
    "{\"kind\": \"Direct\"}", "{\"location\": \"{e}\", \"properties\": [{u}]}", "{\"location\": \"{e}\", \"properties\": null}",
    _rule({}, kind="{e}"), _rule({"destinations": [], "dataFlows": {}}, location=1),
    _rule({"destinations": None, "dataFlows": None, "streamDeclarations": [1], "dataSources": {"logFiles": {}}}, location="x"),
    _rule({"dataSources": {"syslog": []}, "destinations": {"logAnalytics": []},
           "dataFlows": [{"streams": ["Microsoft-Table-{e}", "Custom-{e}", 5, "Other"]}, {"streams": "x"}, 7]},
          kind="WorkspaceTransforms", location="x"),
    _rule({"dataSources": {}, "destinations": {"azureMonitorMetrics": {"name": "{e}"}}, "dataFlows": [_FLOW]},
          kind="WorkspaceTransforms", location="x"),
    _rule({"destinations": _TO, "dataFlows": [_FLOW]}, kind="Direct", location="x", dataCollectionEndpointId="d{u}"),
    _rule({"destinations": _TO, "dataFlows": [_FLOW]}, kind="Direct"),
    _rule({"destinations": _TO, "dataFlows": [_FLOW]}, kind=["Direct"], location="x"),
    _rule({"destinations": {"logAnalytics": [5, {}, {"name": 3, "workspaceResourceId": 4}, {"name": "{e}", "workspaceResourceId": "w{u}"}]},
           "dataFlows": [_FLOW, {"streams": [], "destinations": []}, {}, None]}, location="x"),
    _flows(_FLOW, streamDeclarations={"Custom-{e}": _COLUMNS, "Bad{u}": {"columns": [{}, 5, {"name": None, "type": "decimal"},
           {"type": 3}, {"name": "x", "type": "BOOLEAN"}]}, "Custom-a": {}, "Microsoft-b": 4, "Custom-c": {"columns": "x"}}),
    _flows({"streams": ["Custom-{e}", "Custom-gone{u}", "Custom-gone{u}", "Microsoft-{e}", "Microsoft-Perf", "Plain"],
            "destinations": ["{e}", "nowhere{u}", 3, "nowhere{u}"], "outputStream": "Custom-{e}"},
           {**_FLOW, "outputStream": "Custom-{e}_CL"}, {**_FLOW, "outputStream": "Table{u}"}, {**_FLOW, "outputStream": 7},
           streamDeclarations={"Custom-{e}": _COLUMNS}),
    _flows({**_FLOW, "transformKql": "  source | summarize count() by {e} "}, {**_FLOW, "transformKql": "\u2003source\n"},
           {**_FLOW, "transformKql": "source | where x in ('{e}') | project-away u{u} | order by y"},
           {**_FLOW, "transformKql": 5}, {**_FLOW, "transformKql": "T{u} | where a == \"{e}\""}, {**_FLOW, "transformKql": " "}),
    _flows({**_FLOW, "streams": ["Custom-{e}"]}, streamDeclarations={"Custom-{e}": _COLUMNS}, dataSources={"logFiles": [_LOG]},
           dataCollectionEndpointId=None),
    _flows(_FLOW, dataSources={"logFiles": [
        7, {}, {**_LOG, "format": "Text"}, {**_LOG, "format": "json", "streams": []}, {**_LOG, "settings": {"text": []}},
        {**_LOG, "settings": {"text": {"recordStartTimestampFormat": None}}, "filePatterns": []},
        {**_LOG, "streams": ["Custom-u{u}", 5, "Microsoft-Syslog"], "format": None}]}),
    _flows(_FLOW, dataSources={"logFiles": []}),
    _flows({**_FLOW, "destinations": ["metrics{u}", "{e}"]}).replace(
        "\"logAnalytics\"", "\"azureMonitorMetrics\": {\"name\": \"metrics{u}\"}, \"eventHubs\": [{\"name\": \"hub\"}], \"logAnalytics\""),
]


def _picked(templates: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in templates]), (number % len(templates)).cast("int") + 1)


def _filled(text: Column) -> Column:
    for place, value in (("{e}", "event_type"), ("{u}", "user_id"), ("{k}", "event_id")):
        text = F.replace(text, F.lit(place), F.col(value).cast("string"))
    return text


def _fleet(spark, folder: str, templates: list[str]) -> DataFrame:
    events = spread(table(spark, folder, "events").select("event_id", "event_type", "user_id"))
    return events.select(F.col("event_id").alias("doc_id"), _filled(_picked(templates, F.col("event_id"))).alias("body"))


def query_fleet(spark, folder: str) -> DataFrame:
    return _fleet(spark, folder, QUERY_TEMPLATES)


def rule_fleet(spark, folder: str) -> DataFrame:
    return _fleet(spark, folder, RULE_TEMPLATES)


def fleet_sql(templates: list[str]) -> str:
    """The same fleet in SQL."""
    rows = ", ".join("(" + str(i) + ", '" + t.replace("'", "''") + "')" for i, t in enumerate(templates))
    return f"""
        SELECT event_id AS doc_id,
               replace(replace(replace(template, '{{e}}', event_type), '{{u}}', user_id::VARCHAR), '{{k}}', event_id::VARCHAR) AS body
        FROM events JOIN (VALUES {rows}) t(number, template) ON event_id % {len(templates)} = number"""
