"""Audits on seed texts and on the edges of their rules."""

import json

import pytest
import seeds
from pyspark.sql import functions as F

from sluicework import fixed_values as fv
from sluicework.plans import audit_queries, audit_rules, findings_by_code, flow_pairs, judge_rules, verdict, verdict_of_marks


def docs(spark, bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "doc_id long, body string")


def codes(spark, audit, bodies):
    found = {i: [] for i in range(len(bodies))}
    for row in sorted(audit(docs(spark, bodies)).collect(), key=lambda r: (r.doc_id, r.seq)):
        found[row.doc_id].append(row.code)
    return [found[i] for i in range(len(bodies))]


def test_seed_queries(spark):
    found = codes(spark, audit_queries, [text for text, _ in seeds.QUERIES])
    assert [sorted(f) for f in found] == [sorted(expected.split()) for _, expected in seeds.QUERIES]


def test_seed_rules(spark):
    found = codes(spark, audit_rules, [text for text, _ in seeds.RULES])
    assert [sorted(f) for f in found] == [sorted(expected.split()) for _, expected in seeds.RULES]


QUERY_EDGES = {
    # A call is a word right before "("; a line end parts them, in both spellings.
    "source | extend TimeGenerated = foo\n(1)": "KQL000",
    "source | extend TimeGenerated = foo\\n(1)": "KQL000",
    "source | extend TimeGenerated = foo // c\n(1)": "KQL000",
    "source | extend TimeGenerated = foo {} (1)": "KQL007 KQL000",
    "source | where a in (1) and (b) or (TimeGenerated)": "KQL007 KQL007 KQL007 KQL000",
    # Compound names, and words that only look like them.
    "source | project-keep a, TimeGenerated": "KQL000",
    "source | project - away TimeGenerated": "KQL000",
    "source | top-nested 1 of TimeGenerated": "KQL003",
    "source | parse-where TimeGenerated": "KQL000",
    "source | mv-expand x": "KQL003 KQL009",
    "mv-expand x": "KQL002 KQL003 KQL009 KQL014",
    # Only the first refused operator counts, and unknown ones ahead of it.
    "source | odd | sort | odd2 | take": "KQL004 KQL003 KQL009",
    # "order by" is found a second time.
    "source | order by TimeGenerated": "KQL003 KQL003",
    # Functions behind the first wrong name are not looked at.
    "source | extend TimeGenerated = f(1), b = dynamic(2), c = g(3), d = dynamic(4)": "KQL007 KQL005",
    # TimeGenerated in a comment or string counts for one rule and not for the other.
    "source | project a // TimeGenerated": "KQL000",
    "source | where a == 'TimeGenerated'": "KQL009 KQL000",
    # No word first: no complaint about the start.
    "| where TimeGenerated > 1": "KQL000",
    "let x = 1;": "KQL009 KQL000",
    "// only a comment": "KQL001",
    "  ": "KQL001",
    # "|" and ";" part stages inside brackets too.
    "source | extend TimeGenerated = (a | b)": "KQL004 KQL000",
    "source | where TimeGenerated has_any (1)": "KQL007 KQL011 KQL000",
    "source | extend TimeGenerated = toscalar(toscalar)": "KQL007 KQL012 KQL012",
    # Names in strings do not count, however they are quoted.
    "source | where TimeGenerated == 'a\\'toscalar(' or x == @'b\\' or y == \"toscalar\"": "KQL000",
    "source | where TimeGenerated == 'open toscalar(": "KQL000",
    # A number takes the letters behind it.
    "source | where TimeGenerated > 12toscalar": "KQL000",
    "source | where TimeGenerated > 12_toscalar": "KQL000",
    "source | where TimeGenerated > étoscalar": "KQL012",
}


def test_query_edges(spark):
    found = codes(spark, audit_queries, list(QUERY_EDGES))
    for text, result in zip(QUERY_EDGES, found):
        assert sorted(result) == sorted(QUERY_EDGES[text].split()), text


def test_parse_column_limit(spark):
    ten, eleven = (" ".join(f"c{i}:int" for i in range(n)) for n in (10, 11))
    texts = [f"source | parse TimeGenerated with {ten}", f"source | parse TimeGenerated with {eleven}",
             f"source | parse TimeGenerated {ten.replace(':int', '')}"]
    assert codes(spark, audit_queries, texts) == [["KQL000"], ["KQL010", "KQL000"], ["KQL010", "KQL000"]]
    message = audit_queries(docs(spark, texts[1:2])).filter("code = 'KQL010'").first().message
    assert message == "Parse statement may have 11 columns (limit is 10 per statement)"


def test_long_strings_and_many_escapes(spark):
    long = "x" * 200_000
    texts = [f"source | where TimeGenerated == '{long}'", "source | where TimeGenerated == '" + "\\'" * 100_000 + "' | sort",
             "source | where TimeGenerated == 1 // " + long]
    assert codes(spark, audit_queries, texts) == [["KQL000"], ["KQL003"], ["KQL000"]]


def test_size_limit(spark):
    fits, over = (" " * (fv.MAX_BODY_BYTES - 6 + extra) + "source" for extra in (0, 1))
    assert codes(spark, audit_queries, [fits, over]) == [["KQL009", "KQL000"], ["KQL000"]]
    rows = audit_queries(docs(spark, [over])).collect()
    assert [(r.severity, r.message) for r in rows] == [("error", "Input exceeds maximum size (5MB)")]
    assert [(r.code, r.severity) for r in audit_rules(docs(spark, [over])).collect()] == [("DCR000", "error")]


JSON_EDGES = {
    # Taken: the last of repeated keys counts.
    '{"location": 1, "location": 2, "properties": 1, "properties": {"dataFlows": []}}': "DCR031 DCR040",
    '{"location": "\\ud83d\\ude00", "properties": 1}': "DCR012",
    '{"location": "\\\\ud83d", "properties": 1}': "DCR012",
    '{"location": 1e308, "properties": 1}': "DCR012",
    '{"location": 1e-999, "properties": 1}': "DCR012",
    '{"location": "1e999", "properties": 1}': "DCR012",
    '{"location": ' + "[" * 126 + "]" * 126 + ', "properties": 1}': "DCR012",
    '{"location": "' + "[" * 500 + '", "properties": 1}': "DCR012",
    " {} ": "DCR010 DCR011",
    # Not taken.
    '{"location": 1e999}': "DCR002", '{"location": -1' + "0" * 400 + "}": "DCR002",
    '{"location": "\\ud83d"}': "DCR002", '{"location": "\\ude00\\ud83d"}': "DCR002",
    '{"location": ' + "[" * 127 + "]" * 127 + "}": "DCR002",
    '{"a": 1} x': "DCR002", '{"a": 1}]': "DCR002", '{"a": 1}}': "DCR002", '{"a": 1},': "DCR002", '{"a": 1}, 2': "DCR002",
    '{"a": 1,}': "DCR002", "{'a': 1}": "DCR002", '{"a": 01}': "DCR002", '{"a": NaN}': "DCR002", '{"a": "\t"}': "DCR002",
    "﻿{}": "DCR002", "{} // c": "DCR002", '{"a": 1': "DCR002",
    "[]": "DCR003", "3": "DCR003", "null": "DCR003", '"{}"': "DCR003",
}


def test_json_edges(spark):
    found = codes(spark, audit_rules, list(JSON_EDGES))
    for text, result in zip(JSON_EDGES, found):
        assert sorted(result) == sorted(JSON_EDGES[text].split()), text[:80]


def test_embedded_transforms_have_no_size_limit(spark):
    document = seeds.rule(transform="source | sort by a //" + "x" * fv.MAX_BODY_BYTES)
    document["location"] = "x"
    body = json.dumps(document)
    assert len(body) > fv.MAX_BODY_BYTES  # the document's own limit comes first
    assert codes(spark, audit_rules, [body]) == [["DCR000"]]


@pytest.mark.parametrize("name", ["k" * 60_000, "é\\\"" * 30_000 + "'x", "\\\\" + "k, " * 20_000 + "\\u00e9\\\\"])
def test_names_longer_than_the_parser_takes(spark, name):
    """Documents with long names get the findings, in the same words, that they get with short ones."""
    spoken = json.loads(f'"{name}"')

    def texts(name):
        used = seeds.rule([f"Custom-{name}"], declared={f"Custom-{name}": seeds.LOG, f"Bad{name}": {"columns": [{"name": name, "type": name}]}},
                          output=f"Custom-{name}_CL")
        gone = seeds.rule([f"Custom-gone{name}"], [f"to{name}"], declared={f"Custom-{name}": seeds.LOG})
        plain = seeds.rule()
        plain[name] = {name: 1}
        return [json.dumps(d, ensure_ascii=False) for d in (used, gone, plain, {name: 1})] + ['{"' + "k" * 60_000 + '": }', '{"' + "k" * 60_000]

    def found(name):
        rows = audit_rules(docs(spark, texts(name))).collect()
        return sorted((r.doc_id, r.seq, r.code, r.message) for r in rows)

    want = [(i, k, c, m.replace("short", spoken)) for i, k, c, m in found("short")]
    assert found(spoken) == want and {c for i, _, c, _ in want if i == 2} == {"DCR000"} and want[-1][2] == want[-2][2] == "DCR002"


def test_many_unknown_names(spark):
    """A document near the size limit whose names are all unknown, some of them repeated."""
    streams, targets = [f"Custom-{i}" for i in range(150_000)], [f"d{i}" for i in range(200_000)]
    body = json.dumps(seeds.rule(streams + streams[:500], targets + ["ws"]))
    assert 4_500_000 < len(body) < fv.MAX_BODY_BYTES
    counts = dict(findings_by_code(audit_rules(docs(spark, [body]))).select("code", "findings").collect())
    assert counts == {"DCR066": 150_500, "DCR064": 200_000}


@pytest.mark.parametrize("known", [0, 5, 150, 199, 201, 1000])
def test_names_among_long_lists(spark, known):
    document = seeds.rule([f"Custom-{i}" for i in range(1000)], declared={f"Custom-{i * 7 % 1000}": {} for i in range(known)})
    missing = audit_rules(docs(spark, [json.dumps(document)])).filter("code = 'DCR066'").select("message").collect()
    found = {int(m.message.split("Custom-")[1].split("'")[0]) for m in missing}
    assert found == set(range(1000)) - {i * 7 % 1000 for i in range(known)}


def test_rollups_agree(spark):
    fleet = docs(spark, [text for text, _ in seeds.RULES])
    findings = audit_rules(fleet)
    joined, in_row = verdict(fleet, findings).collect(), verdict_of_marks(judge_rules(fleet)).collect()
    assert sorted(joined) == sorted(in_row)
    assert {r.doc_id for r in joined if r.valid} == {i for i, (_, c) in enumerate(seeds.RULES) if "DCR000" in c}
    without = verdict(fleet, findings.filter("false")).collect()
    assert all(r.valid and r.errors == 0 for r in without)


def test_flow_pairs(spark):
    document = seeds.rule(["a", "b"], ["x", "y"], output="o")
    document["properties"]["dataFlows"].append({"streams": ["c"], "destinations": ["x", 5]})
    pairs = flow_pairs(docs(spark, [json.dumps(document), "{", ""])).select("flow", "stream", "destination").collect()
    assert sorted(tuple(p) for p in pairs) == [(1, "a", "x"), (1, "a", "y"), (1, "b", "x"), (1, "b", "y"), (2, "c", "x")]


@pytest.mark.parametrize("audit", [audit_queries, audit_rules])
def test_audits_do_not_shuffle(spark, audit):
    plan = audit(docs(spark, ["source"]).filter(F.col("doc_id") >= 0))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert plan.count("parseJson") <= 1
