"""Seed texts with the codes expected of them (derived by hand from the rules).

The texts are fixed values: test inputs whose results are known."""

import json

WORKSPACE = "/subscriptions/s/resourceGroups/g/providers/Microsoft.OperationalInsights/workspaces/w"
ENDPOINT = "/subscriptions/s/resourceGroups/g/providers/Microsoft.Insights/dataCollectionEndpoints/e"

QUERIES = [
    ("source", "KQL009 KQL000"),
    ('source | where severity == "Critical"', "KQL009 KQL000"),
    ('source | where severity == "Critical" | extend Properties = parse_json(properties)'
     " | project TimeGenerated = todatetime(time), Category = category", "KQL000"),
    ("source | summarize count() by severity", "KQL003 KQL006 KQL009"),
    ("source | join other on key", "KQL003 KQL009"),
    ("", "KQL001"),
    ("Syslog | where severity == 'error'", "KQL002 KQL004 KQL009 KQL014"),
    ("source | extend x = column_ifexists('col', '')", "KQL005 KQL009"),
    ("let data=externaldata(col:string)[h'https://example.com/file.txt']\n| parse RawData with col:string;\n"
     "source\n| where col has 'test'", "KQL007 KQL009 KQL013"),
    ("CloudAppEvents\n| where TimeGenerated > ago(1h)", "KQL002 KQL004 KQL014"),
    ("let x = 1;\nSyslog\n| where severity == 'error'", "KQL004 KQL009 KQL014"),
    ('source\n| where severity == "Critical"\n| project TimeGenerated, Message, severity', "KQL000"),
    ("source\n| extend Properties = parse_json(properties)\n| extend Level = toint(Properties.Level)\n"
     "| extend DeviceId = tostring(Properties.DeviceID)\n| project TimeGenerated, Message, Level, DeviceId", "KQL000"),
    ("source\n| where EventLevelName in ('Error', 'Critical', 'Warning')\n| project-away ParameterXml",
     "KQL007 KQL008 KQL000"),
    ("source\n| summarize count() by severity\n| project TimeGenerated, severity, count_", "KQL003 KQL006"),
    ("source\n| join kind=inner (OtherTable) on CommonKey\n| project TimeGenerated, Message", "KQL003 KQL007"),
    ('Syslog\n| where SeverityLevel != "info"\n| project TimeGenerated, Message', "KQL002 KQL004 KQL014"),
    ("source\n| extend col = column_ifexists('MyCol', '')\n| project TimeGenerated, col", "KQL005"),
]


def rule(streams=("Microsoft-Syslog",), destinations=("ws",), transform="source", output=None,
         defined=("ws",), declared=None, files=None, endpoint=None, sources=None, kind=None):
    """A document with one flow, as most seeds have."""
    flow = {"streams": list(streams), "destinations": list(destinations), "transformKql": transform}
    if output:
        flow["outputStream"] = output
    properties = {"dataSources": sources if sources is not None else {}}
    if files is not None:
        properties["dataSources"]["logFiles"] = files
    if endpoint:
        properties["dataCollectionEndpointId"] = endpoint
    if declared is not None:
        properties["streamDeclarations"] = {
            name: {"columns": [{"name": c, "type": t} for c, t in columns.items()]} for name, columns in declared.items()}
    if defined is not None:
        properties["destinations"] = {
            "logAnalytics": [{"workspaceResourceId": WORKSPACE, "name": name} for name in defined]}
    properties["dataFlows"] = [flow]
    document = {"location": "eastus", "properties": properties}
    if kind:
        document["kind"] = kind
    return document


def log_file(stream, fmt="text", start="ISO 8601", pattern="C:\\logs\\*.txt"):
    entry = {"streams": [stream], "filePatterns": [pattern], "format": fmt, "name": "log"}
    if start:
        entry["settings"] = {"text": {"recordStartTimestampFormat": start}}
    return entry


RAW = {"TimeGenerated": "datetime", "RawData": "string"}
LOG = {**RAW, "FilePath": "string", "Computer": "string"}
JSON_LOG = {"TimeGenerated": "datetime", "FilePath": "string", "Code": "int", "Module": "string", "Message": "string"}

RULES = [
    ("", "DCR001"),
    ("{invalid}", "DCR002"),
    (rule(output="Microsoft-Syslog"), "DCR000"),
    (rule(["Custom-MyLogFile"], declared={"Custom-MyLogFile": LOG}, files=[log_file("Custom-MyLogFile")],
          endpoint=ENDPOINT, output="Custom-MyTable_CL"), "DCR000"),
    (rule(["Custom-MyLog"], declared={"Custom-MyLog": RAW}, files=[log_file("Custom-MyLog")],
          output="Custom-MyTable_CL"), "DCR090"),
    (rule(["Custom-UndeclaredStream"], output="Custom-MyTable_CL"), "DCR066"),
    (rule(["Custom-MyLog"], declared={"Custom-MyLog": RAW}, endpoint=ENDPOINT, output="Custom-MyTable_CL",
          files=[log_file("Custom-MyLog", fmt="csv", start=None)]), "DCR107"),
    (rule(["Microsoft-Table-LAQueryLogs"], kind="WorkspaceTransforms",
          transform="source | where QueryText !contains 'LAQueryLogs'"), "DCR000"),
    (rule(destinations=["missingDest"], defined=None), "DCR031 DCR064"),
    (rule(transform="source | summarize count() by severity"), "DCR070-KQL003 DCR070-KQL006"),
    (rule(sources={"syslog": [{"name": "base", "streams": ["Microsoft-Syslog"], "facilityNames": ["daemon"],
                               "logLevels": ["Warning"]}]},
          transform="source | where SeverityLevel != 'info'", output="Microsoft-Syslog"), "DCR000"),
    (rule(["Microsoft-Table-Event"], kind="WorkspaceTransforms",
          transform="source | where EventLevelName in ('Error', 'Critical', 'Warning') | project-away ParameterXml"),
     "DCR071-KQL007 DCR071-KQL008 DCR000"),
    (rule(["Custom-MyTable"], kind="Direct", output="Custom-MyTable_CL",
          declared={"Custom-MyTable": {"Time": "datetime", "Computer": "string", "AdditionalContext": "string"}},
          transform="source | extend jsonContext = parse_json(AdditionalContext) | project TimeGenerated = Time, "
                    "Computer, AdditionalContext = jsonContext, ExtendedColumn = tostring(jsonContext.CounterName)"),
     "DCR024 DCR000"),
    (rule(["Custom-Text"], declared={"Custom-Text": LOG}, files=[log_file("Custom-Text")], endpoint=ENDPOINT,
          transform='source | project d = split(RawData,",") | project TimeGenerated=todatetime(d[0]), '
                    "Code=toint(d[1]), Severity=tostring(d[2]), Module=tostring(d[3]), Message=tostring(d[4])",
          output="Custom-MyTable_CL"), "DCR000"),
    (rule(["Custom-Json-stream"], declared={"Custom-Json-stream": JSON_LOG}, endpoint=ENDPOINT,
          files=[log_file("Custom-Json-stream", fmt="json", start=None, pattern="C:\\logs\\*.json")],
          output="Custom-MyTable_CL"), "DCR000"),
    (rule(["Custom-MyLog"], declared={"Custom-MyLog": RAW}, files=[log_file("Custom-MyLog", start=None)],
          output="Custom-MyTable_CL"), "DCR108 DCR090"),
]
RULES = [(body if isinstance(body, str) else json.dumps(body, indent=2), codes) for body, codes in RULES]
