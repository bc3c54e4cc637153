"""Random texts and documents: the audits must agree with the SQL on tables of tokens and parts."""

import json
import random

import duckdb
import pandas as pd
import pytest

from oracle import compare
from sluicework import fixed_values as fv
from sluicework.plans import audit_queries, audit_rules
from sluicework.queries.audits import _FINDINGS, _RULE_FINDINGS, query_audit_sql, rule_audit_sql

PIECES = (
    ["source", "let", "print", "project", "parse", "parse", "with", "order", "by", "toscalar", "externaldata", "Has_Any",
     "has_all", "TimeGenerated", "Project", "_x", "a1", "string", "int", "dynamic", "column_ifexists", "avg", "COUNT", "T", "mv"]
    + ["|", "|", "|", ";", "(", "(", "(", ")", "-", "-", "=", "==", "=~", "!~", "<", ">=", ".", ",", "[", "]", "!", "/", "//", "*", "~", ":"]
    + ["\n", "\\n", "\\", " ", "  ", "\t", "\r", "{", "}", "é", " ", "K", "@", "'", '"', "'x'", '"y|z"', "@'q\\'", '@"r"', "'a\\'b'",
       "1h", "2e5", "3.", "4_b", "5é", "//c\n", "expand", "away", "rename", "series", "make", "sample", "distinct"]
    + fv.TABLE_OPERATORS + list(fv.REFUSED_OPERATORS)[::3] + fv.SCALAR_FUNCTIONS[::9]
)


def random_text(rng):
    glue = rng.choice([" ", "", " "])
    return glue.join(rng.choice(PIECES) for _ in range(rng.randint(0, 60)))


NAMES = ["Custom-a", "Custom-b", "Microsoft-Perf", "Microsoft-x", "Microsoft-Table-y", "z", "", "Custom-a_CL", "ws", "m"]


def random_value(rng, depth=0):
    kinds = [lambda: rng.choice(NAMES), lambda: None, lambda: rng.randint(0, 3), lambda: True, lambda: [], lambda: {}]
    if depth < 2:
        kinds += [lambda: [random_value(rng, depth + 1) for _ in range(rng.randint(0, 3))],
                  lambda: {rng.choice(["name", "streams", "type"]): random_value(rng, depth + 1)}]
    return rng.choice(kinds)()


def maybe(rng, value, chance=0.85):
    return value() if rng.random() < chance else random_value(rng)


def some(rng, **fields):
    return {k: maybe(rng, v) for k, v in fields.items() if rng.random() < 0.85}


def names(rng):
    return lambda: [maybe(rng, lambda: rng.choice(NAMES), 0.9) for _ in range(rng.randint(0, 3))]


def listed(rng, one):
    return lambda: [maybe(rng, one, 0.9) for _ in range(rng.randint(0, 3))]


def random_document(rng):
    def text():
        return random_text(rng) if rng.random() < 0.6 else rng.choice(["source", " source ", "", "source | where a"])

    def column():
        return some(rng, name=lambda: "c", type=lambda: rng.choice(["string", "Int", "decimal", "boolean"]))

    def flow():
        return some(rng, streams=names(rng), destinations=names(rng), transformKql=text, outputStream=lambda: rng.choice(NAMES))

    def log_file():
        return some(rng, name=lambda: "l", streams=names(rng), filePatterns=lambda: rng.choice([[], ["x"]]),
                    format=lambda: rng.choice(["text", "json", "csv"]),
                    settings=lambda: {"text": maybe(rng, lambda: {"recordStartTimestampFormat": rng.choice([None, "ISO 8601"])})})

    def destinations():
        return some(rng, logAnalytics=listed(rng, lambda: some(
            rng, name=lambda: rng.choice(NAMES), workspaceResourceId=lambda: rng.choice(["/providers/x", "y"]))),
            azureMonitorMetrics=lambda: some(rng, name=lambda: rng.choice(NAMES)))

    def declarations():
        return {n: maybe(rng, lambda: some(rng, columns=listed(rng, column))) for n in rng.sample(NAMES[:6] + NAMES[7:], rng.randint(0, 3))}

    def properties():
        return some(rng, destinations=destinations, streamDeclarations=declarations, dataFlows=listed(rng, flow),
                    dataSources=lambda: some(rng, logFiles=listed(rng, log_file)), dataCollectionEndpointId=lambda: "e")

    document = some(rng, location=lambda: "x", properties=properties,
                    kind=lambda: rng.choice(["WorkspaceTransforms", "Direct", "Other"]), dataCollectionEndpointId=lambda: "e")
    body = json.dumps(maybe(rng, lambda: document, 0.97), ensure_ascii=rng.random() < 0.5)
    if rng.random() < 0.05:
        body = body[:-1] + rng.choice(["", "]", "} x", "}}"])  # (DuckDB accepts a trailing comma)
    return rng.choice(["", " ", "\n "]) + body


@pytest.mark.parametrize("seed", [1, 2])
def test_texts(spark, seed):
    rng = random.Random(seed)
    fuzz = pd.DataFrame([(i, random_text(rng)) for i in range(1500)], columns=["doc_id", "body"])
    con = duckdb.connect()
    con.register("fuzz", fuzz)
    assert compare(audit_queries(spark.createDataFrame(fuzz)), con, query_audit_sql("SELECT * FROM fuzz", _FINDINGS)) is None


@pytest.mark.parametrize("seed", [1, 2])
def test_documents(spark, seed):
    rng = random.Random(seed)
    fuzz = pd.DataFrame([(i, random_document(rng)) for i in range(1500)], columns=["doc_id", "body"])
    con = duckdb.connect()
    con.register("fuzz", fuzz)
    assert compare(audit_rules(spark.createDataFrame(fuzz)), con, rule_audit_sql("SELECT * FROM fuzz", _RULE_FINDINGS)) is None
