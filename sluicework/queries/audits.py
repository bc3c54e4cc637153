"""Registered queries on the audits, with the same in SQL.

The SQL takes texts apart into a table of tokens and documents into tables of
their parts, and states every rule as a query on those tables.
"""

from pyspark.sql import functions as F

from sluicework import fixed_values as fv
from sluicework.plans import (
    audit_queries, audit_rules, codes_of_days, codes_of_range, flow_pairs, judge_distinct, judge_queries, judge_rules,
    totals_of_marks, verdict, verdict_of_marks,
)
from sluicework.plans.findings import to_rows
from sluicework.queries.fleet import QUERY_TEMPLATES, RULE_TEMPLATES, fleet_sql, query_fleet, rule_fleet
from sluicework.queries.tables import table
from sluicework.session import fresh_path, spread
from sluicework.streaming import audit_stream, total_stream, totals


def _texts(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", F.col("text").alias("body")))


def _chats(spark, d):
    chats = table(spark, d, "conversations")
    return spread(chats).select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.col("text").alias("body"))


def _props(spark, d):
    return spread(table(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.col("props").alias("body")))


def u_query_fleet(spark, d):
    return audit_queries(query_fleet(spark, d))


def u_query_documents(spark, d):
    return audit_queries(_texts(spark, d))


def u_query_chats(spark, d):
    return audit_queries(_chats(spark, d))


def u_query_verdict(spark, d):
    return verdict_of_marks(judge_queries(query_fleet(spark, d)))


def u_query_codes(spark, d):
    return totals_of_marks(judge_queries(query_fleet(spark, d)))


def u_rule_fleet(spark, d):
    return audit_rules(rule_fleet(spark, d))


def u_rule_props(spark, d):
    return audit_rules(_props(spark, d))


def u_rule_documents(spark, d):
    return audit_rules(_texts(spark, d))


def u_rule_verdict(spark, d):
    docs = rule_fleet(spark, d)
    return verdict(docs, audit_rules(docs))


def u_rule_verdict_in_row(spark, d):
    return verdict_of_marks(judge_rules(rule_fleet(spark, d)))


def u_rule_codes(spark, d):
    return totals_of_marks(judge_rules(rule_fleet(spark, d)))


def u_flow_pairs(spark, d):
    """The pairs of a fleet, one document in five thousand being padded to over 5 MB."""
    pad = F.when(F.col("doc_id") % 5000 == 0, F.repeat(F.lit(" "), fv.MAX_BODY_BYTES)).otherwise("")
    return flow_pairs(rule_fleet(spark, d).withColumn("body", F.concat("body", pad)))


BIG_EVERY = 2_000


def _some_too_big(fleet):
    """A fleet of which one document in two thousand is longer than allowed."""
    pad = F.when(F.col("doc_id") % BIG_EVERY == 0, F.repeat(F.lit("x"), fv.MAX_BODY_BYTES)).otherwise("")
    return fleet.withColumn("body", F.concat("body", pad))


def u_query_too_big(spark, d):
    return audit_queries(_some_too_big(query_fleet(spark, d)))


def u_rule_too_big(spark, d):
    return audit_rules(_some_too_big(rule_fleet(spark, d)))


REPEATED = "source | where Kind in ('a') | sort by t | extend x = my_fn(1)"


def u_query_repeated(spark, d):
    """A fleet of which a third has one and the same body, judged once per different body."""
    body = F.when(F.col("doc_id") % 3 == 0, REPEATED).otherwise(F.col("body"))
    return to_rows(judge_distinct(query_fleet(spark, d).withColumn("body", body), judge_queries))


def u_query_totals_stream(spark, d):
    """Totals of a fleet whose every second document arrives again, as the next one's text and newer, or older and too late."""
    arrived, folder, ckpt = (fresh_path(spark, name) for name in ("versions", "changes", "ckpt"))
    fleet = query_fleet(spark, d)
    later = fleet.select((F.col("doc_id") - 1).alias("doc_id"), "body").where("doc_id >= 0 and doc_id % 2 = 0")
    late = F.when(F.col("doc_id") % 4 == 0, 2).otherwise(0)
    for part in (fleet.withColumn("at", F.lit(1)), later.withColumn("at", late).select("doc_id", "body", "at")):
        part.write.mode("append").parquet(arrived)
        stream = spark.readStream.schema(part.schema).parquet(arrived)
        total_stream(stream, judge_queries, folder, ckpt).awaitTermination()
    return totals(spark, folder)


#: Relative error that an estimate of documents may have here: three standard errors.
ERROR = 0.05


def u_codes_of_days(spark, d):
    """Totals of a range of days from what was kept per day, and whether the documents are estimated well enough."""
    fleet = query_fleet(spark, d)
    days = table(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.to_date("ts").alias("day"))
    found = audit_queries(fleet).join(days, "doc_id").withColumn("doc_id", F.col("doc_id") % 5000)
    kept = fresh_path(spark, "days")
    codes_of_days(found).write.partitionBy("day").parquet(kept)
    first, last = "2024-01-03", "2024-01-20"
    exact = found.where(F.col("day").between(first, last)).groupBy("code", "severity").agg(F.count_distinct("doc_id").alias("exact"))
    return codes_of_range(spark.read.parquet(kept), first, last).join(exact, ["code", "severity"]).select(
        "code", "severity", "findings", (F.abs(F.col("documents") - F.col("exact")) <= ERROR * F.col("exact") + 1).alias("close"))


def _streamed(spark, docs, audit):
    """Findings of a fleet that arrives as files."""
    arrived, out = fresh_path(spark, "fleet"), fresh_path(spark, "findings")
    docs.write.parquet(arrived)
    stream = spark.readStream.schema(docs.schema).parquet(arrived)
    audit_stream(stream, audit, out, fresh_path(spark, "ckpt")).awaitTermination()
    return spark.read.parquet(out)


def u_query_stream(spark, d):
    return _streamed(spark, query_fleet(spark, d), audit_queries)


def u_rule_stream(spark, d):
    return _streamed(spark, rule_fleet(spark, d), audit_rules)


QUERIES = {
    f.__name__: f for f in (
        u_query_fleet, u_query_documents, u_query_chats, u_query_verdict, u_query_codes, u_query_stream,
        u_rule_fleet, u_rule_props, u_rule_documents, u_rule_verdict, u_rule_verdict_in_row, u_rule_codes,
        u_rule_stream, u_flow_pairs, u_query_too_big, u_rule_too_big, u_query_repeated, u_query_totals_stream,
        u_codes_of_days)
}


# SQL -------------------------------------------------------------------------

def _q(text):
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def _in(names):
    return "(" + ", ".join(_q(n) for n in names) + ")"


def _trim(expr):
    return f"trim({expr}, {' || '.join(f'chr({ord(ch)})' for ch in fv.UNICODE_SPACES)})"


TOKEN = (
    r"//[^\n]*|\n|\\n|'[^'\\]*(?:\\[\s\S][^'\\]*)*\\?'?|\"[^\"\\]*(?:\\[\s\S][^\"\\]*)*\\?\"?|@'[^']*'?|@\"[^\"]*\"?"
    r"|==|=~|!=|!~|<=|>=|[|()\[\],;.=<>+\-*/%!~]|[0-9][0-9.eE]*[A-Za-z]*|[A-Za-z_][A-Za-z0-9_]*"
).replace("\\\"", '"')


def _message(template, *values):
    parts = template.split("{}")
    out = [_q(parts[0])]
    for value, text in zip(values, parts[1:]):
        out += [f"({value})::VARCHAR", _q(text)]
    return " || ".join(out)


def _finding(source, step, place, key, *values, hint=None, where="true"):
    code, severity, message, suggestion = fv.QUERY_FINDINGS[key]
    return (f"SELECT key, {step} AS step, {place} AS place, '{code}' AS code, '{severity}' AS severity, "
            f"{_message(message, *values)} AS message, {hint or _q(suggestion)} AS suggestion FROM {source} WHERE {where}")


def _case(column, texts):
    return f"CASE {column} " + " ".join(f"WHEN {_q(n)} THEN {_q(t)}" for n, t in texts.items()) + " END"


def query_ctes(texts):
    """CTEs that end in ``q_findings(key, seq, code, severity, message, suggestion)``.

    ``texts`` is SQL that gives ``(key, text)``, trimmed."""
    known = list(fv.REFUSED_OPERATORS) + fv.TABLE_OPERATORS + ["source", "print", "let"]
    passed = [n for n in fv.TABLE_OPERATORS + list(fv.REFUSED_OPERATORS) if n != "print"] + ["let"]
    skipped = fv.TABLE_OPERATORS + ["source", "print"] + fv.SCALAR_FUNCTIONS
    wrong = list(fv.WRONG_FUNCTION_NAMES)
    per_key = "(PARTITION BY key ORDER BY pos)"
    found = [
        _finding("q_blank", 0, 0, "empty"),
        _finding("q_word", 1, "pos", "start", "token",
                 where="n = 1 AND is_name AND low NOT IN ('source', 'print', 'let')"),
        _finding("q_op", 2, "pos", "unknown_operator", "op",
                 where=f"(refused IS NULL OR pos < refused) AND op NOT IN {_in(known)}"),
        _finding("q_op", 2, "pos", "refused_operator", "op", hint=_case("op", fv.REFUSED_OPERATORS), where="pos = refused"),
        _finding("q_call", 3, "pos", "refused_function", "token", where=f"(wrong IS NULL OR pos < wrong) AND low IN {_in(fv.REFUSED_FUNCTIONS)} AND low NOT IN {_in(skipped)}"),
        _finding("q_call", 3, "pos", "unknown_function", "token", where=f"(wrong IS NULL OR pos < wrong) AND low NOT IN {_in(fv.REFUSED_FUNCTIONS)} AND low NOT IN {_in(skipped)}"),
        _finding("q_call", 3, "pos", "wrong_name", "token", hint=_case("low", fv.WRONG_FUNCTION_NAMES), where="pos = wrong"),
        _finding("q_about", 4, 0, "no_time_column", where="projects AND NOT contains(text, 'TimeGenerated')"),
        _finding("q_about", 4, 0, "time_column_tip", where="NOT projects AND NOT timed"),
        _finding("q_parse", 5, "pos", "parse_columns", "n", where=f"n > {fv.MAX_PARSE_COLUMNS}"),
        _finding("q_next", 6, "pos", "order_by", where="low = 'order' AND lower(next) = 'by'"),
        _finding("q_next", 7, "pos", "has_any", "token", where="low IN ('has_any', 'has_all') AND next = '('"),
        _finding("q_next", 8, "pos", "toscalar", where="low = 'toscalar'"),
        _finding("q_about", 9, 0, "externaldata", where="external"),
        _finding("q_other", 10, 0, "table_name", "token", where="low NOT IN ('source', 'print')"),
    ]
    code, severity, message, _ = fv.QUERY_FINDINGS["valid"]
    return f"""
    q_text AS ({texts}),
    q_raw AS (SELECT key, unnest(l) AS token, unnest(range(len(l))) AS pos
              FROM (SELECT key, regexp_extract_all(text, {_q(TOKEN)}) AS l FROM q_text)),
    q_next AS MATERIALIZED (SELECT key, pos, token, lower(token) AS low, regexp_full_match(token, '[A-Za-z_][A-Za-z0-9_]*') AS is_name,
                      lead(token) OVER {per_key} AS next
               FROM q_raw WHERE NOT starts_with(token, '//')),
    q_word AS MATERIALIZED (SELECT key, pos, token, low, is_name, row_number() OVER {per_key} AS n, lag(token) OVER {per_key} AS before,
                      lead(low) OVER {per_key} AS low1, lead(low, 2) OVER {per_key} AS low2
               FROM q_next WHERE token NOT IN (chr(10), '\\n')),
    q_staged AS MATERIALIZED (SELECT *, sum(CASE WHEN token IN ('|', ';') THEN 1 ELSE 0 END) OVER {per_key} AS stage FROM q_word),
    q_blank AS (SELECT key FROM q_text WHERE key NOT IN (SELECT key FROM q_word)),
    q_head AS MATERIALIZED (SELECT *, CASE WHEN low1 = '-' AND low || '-' || low2 IN {_in(fv.HYPHENATED_OPERATORS)}
                              THEN low || '-' || low2 ELSE low END AS op
               FROM q_staged WHERE is_name AND (before IS NULL OR before IN ('|', ';'))),
    q_op AS (SELECT *, min(pos) FILTER (WHERE op IN {_in(fv.REFUSED_OPERATORS)}) OVER (PARTITION BY key) AS refused FROM q_head),
    q_call AS (SELECT *, min(pos) FILTER (WHERE low IN {_in(wrong)}) OVER (PARTITION BY key) AS wrong
               FROM q_next WHERE is_name AND next = '('),
    q_names AS (SELECT key, bool_or(low = 'project') AS projects, bool_or(token = 'TimeGenerated') AS timed,
                       bool_or(low = 'externaldata') AS external FROM q_word GROUP BY key),
    q_about AS (SELECT * FROM q_names JOIN q_text USING (key)),
    q_with AS (SELECT h.key, h.pos, h.stage, min(w.pos) FILTER (WHERE w.low = 'with') AS at
               FROM q_head h LEFT JOIN q_staged w ON w.key = h.key AND w.stage = h.stage AND w.pos > h.pos
               WHERE h.op = 'parse' GROUP BY ALL),
    q_parse AS (SELECT p.key, p.pos, count(*) AS n
                FROM q_with p JOIN q_staged w ON w.key = p.key AND w.stage = p.stage AND w.pos > coalesce(p.at, p.pos) AND w.is_name
                     AND (p.at IS NULL OR w.low NOT IN {_in(fv.PARSE_TYPE_NAMES + ["with"])})
                GROUP BY ALL),
    q_other AS (SELECT key, arg_min(token, pos) AS token, arg_min(low, pos) AS low FROM q_head
                WHERE low NOT IN {_in(passed)} GROUP BY key),
    q_all AS MATERIALIZED ({' UNION ALL '.join(found)}),
    q_judged AS (SELECT * FROM q_all UNION ALL
                 SELECT key, 11, 0, '{code}', '{severity}', {_q(message)}, NULL FROM q_text
                 WHERE key NOT IN (SELECT key FROM q_all WHERE severity = 'error')),
    q_findings AS (SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY step, place) - 1 AS INTEGER) AS seq,
                          code, severity, message, suggestion FROM q_judged)"""


def query_audit_sql(docs, result):
    texts = f"SELECT doc_id AS key, {_trim('body')} AS text FROM docs"
    return f"WITH docs AS ({docs}), {query_ctes(texts)} {result}"


_FINDINGS = "SELECT key AS doc_id, seq, code, severity, message, suggestion FROM q_findings"
_VERDICT = """
    SELECT key AS doc_id, count_if(severity = 'error') = 0 AS valid, CAST(count_if(severity = 'error') AS BIGINT) AS errors,
           CAST(count_if(severity = 'warning') AS BIGINT) AS warnings, CAST(count_if(severity = 'info') AS BIGINT) AS infos
    FROM {} GROUP BY key"""
_CODES = """
    SELECT code, severity, count(*) AS findings, count(DISTINCT key) AS documents FROM {} GROUP BY code, severity"""
_TEXTS = "SELECT doc_id, text AS body FROM documents"
_CHATS = "SELECT conv_id * 1000 + turn AS doc_id, text AS body FROM conversations"



def _rule_finding(source, place, code, *values, where="true"):
    """``place`` orders a document's findings: section, entry, check, member, seq of an embedded finding."""
    severity, message, suggestion = fv.RULE_FINDINGS[code]
    return (f"SELECT doc_id, {place} AS place, '{code}' AS code, '{severity}' AS severity, "
            f"{_message(message, *values)} AS message, {_q(suggestion)} AS suggestion FROM {source} WHERE {where}")


def _place(section, entry="0", check=0, member="0", inner="0"):
    return f"[{section}, ({entry})::BIGINT, {check}, ({member})::BIGINT, ({inner})::BIGINT]"


def _members(source, column, keep):
    """Members of a JSON list column, numbered from 1, with their type."""
    return (f"SELECT *, coalesce(json_type(member), 'NULL') AS kind, member->>'$' AS word FROM (SELECT {keep}, unnest(from_json({column}, '[\"JSON\"]')) AS member, "
            f"unnest(range(CAST(json_array_length({column}) AS BIGINT))) + 1 AS idx FROM {source} WHERE json_type({column}) = 'ARRAY')")


def rule_audit_sql(docs, result):
    p = "props"
    is_list, no_list = "json_type({}) = 'ARRAY'", "coalesce(json_type({}), '') <> 'ARRAY'"
    string = "CASE WHEN json_type({0}) = 'VARCHAR' THEN {0}->>'$' END"
    workspace = "kind = 'WorkspaceTransforms'"
    file_ok, flow_ok = "type = 'OBJECT'", "type = 'OBJECT'"
    found = [
        _rule_finding("r_state", _place(0), "DCR001", where="state = 'blank'"),
        _rule_finding("r_state", _place(0), "DCR002", where="state = 'broken'"),
        _rule_finding("r_state", _place(0), "DCR003", where="state = 'other'"),
        _rule_finding("r_doc", _place(1), "DCR010", where="NOT has_location"),
        _rule_finding("r_doc", _place(2), "DCR011", where="NOT has_properties"),
        _rule_finding("r_doc", _place(2), "DCR012", where="has_properties AND json_type(props) <> 'OBJECT'"),
        _rule_finding("r_p", _place(3), "DCR020", where=f"{workspace} AND json_type(sources) = 'OBJECT' AND len(json_keys(sources)) > 0"),
        _rule_finding("r_p", _place(4), "DCR021", "json_array_length(logs)", where=f"{workspace} AND {is_list.format('logs')} AND json_array_length(logs) <> 1"),
        _rule_finding("r_p", _place(4), "DCR022", where=f"{workspace} AND json_type(dests) = 'OBJECT' AND {no_list.format('logs')}"),
        _rule_finding("r_flow_stream", _place(5, "flow", 0, "idx"), "DCR023", "flow", "word",
                      where=f"{workspace} AND kind_of = 'VARCHAR' AND NOT starts_with(word, 'Microsoft-Table-')"),
        _rule_finding("r_p", _place(6), "DCR024", where="kind = 'Direct' AND NOT has_endpoint AND NOT has_top_endpoint"),
        _rule_finding("r_dest", _place(7, "idx"), "DCR032", "idx", where="type <> 'OBJECT'"),
        _rule_finding("r_dest", _place(7, "idx", 1), "DCR033", "idx", where="type = 'OBJECT' AND coalesce(json_type(j, '$.name'), '') <> 'VARCHAR'"),
        _rule_finding("r_dest", _place(7, "idx", 2), "DCR034", "idx", where="type = 'OBJECT' AND json_type(j, '$.workspaceResourceId') IS NULL"),
        _rule_finding("r_dest", _place(7, "idx", 3), "DCR035", "idx", where="type = 'OBJECT' AND json_type(j, '$.workspaceResourceId') = 'VARCHAR' AND NOT contains(j->>'$.workspaceResourceId', '/providers/')"),
        _rule_finding("r_p", _place(8), "DCR030", where="json_type(dests) <> 'OBJECT'"),
        _rule_finding("r_p", _place(8), "DCR031", where="dests IS NULL"),
        _rule_finding("r_declared", _place(9, "nr", 0), "DCR050", "name", where="NOT starts_with(name, 'Custom-') AND NOT starts_with(name, 'Microsoft-')"),
        _rule_finding("r_column", _place(9, "nr", 1, "idx * 10 + 1"), "DCR051", "idx", "name", where="json_type(j, '$.name') IS NULL"),
        _rule_finding("r_column", _place(9, "nr", 1, "idx * 10 + 2"), "DCR052", "idx", "name", "j->>'$.type'",
                      where=f"json_type(j, '$.type') = 'VARCHAR' AND lower(j->>'$.type') NOT IN {_in(fv.COLUMN_TYPES)}"),
        _rule_finding("r_column", _place(9, "nr", 1, "idx * 10 + 3"), "DCR053", "idx", "name", where="coalesce(json_type(j, '$.type'), '') <> 'VARCHAR'"),
        _rule_finding("r_declared", _place(9, "nr", 2), "DCR054", "name", where=no_list.format("columns")),
        _rule_finding("r_file", _place(10, "idx"), "DCR100", "idx", where="type <> 'OBJECT'"),
        _rule_finding("r_file", _place(10, "idx", 1), "DCR101", "idx", where=f"{file_ok} AND json_type(j, '$.name') IS NULL"),
        _rule_finding("r_file", _place(10, "idx", 2), "DCR102", "idx", where=f"{file_ok} AND json_array_length(j->'$.streams') = 0 AND {is_list.format('j->$$$.streams$$')}"),
        _rule_finding("r_file_stream", _place(10, "file", 3, "idx"), "DCR103", "file", "word",
                      where="kind_of = 'VARCHAR' AND starts_with(word, 'Custom-') AND (doc_id, word) NOT IN (SELECT doc_id, name FROM r_declared)"),
        _rule_finding("r_file", _place(10, "idx", 4), "DCR104", "idx", where=f"{file_ok} AND {no_list.format('j->$$$.streams$$')}"),
        _rule_finding("r_file", _place(10, "idx", 5), "DCR105", "idx", where=f"{file_ok} AND json_array_length(j->'$.filePatterns') = 0 AND {is_list.format('j->$$$.filePatterns$$')}"),
        _rule_finding("r_file", _place(10, "idx", 6), "DCR106", "idx", where=f"{file_ok} AND {no_list.format('j->$$$.filePatterns$$')}"),
        _rule_finding("r_file", _place(10, "idx", 7), "DCR107", "idx", "j->>'$.format'",
                      where=f"{file_ok} AND json_type(j, '$.format') = 'VARCHAR' AND j->>'$.format' NOT IN {_in(fv.LOG_FORMATS)}"),
        _rule_finding("r_file", _place(10, "idx", 8), "DCR108", "idx",
                      where=f"{file_ok} AND json_type(j, '$.format') = 'VARCHAR' AND j->>'$.format' = 'text' AND json_type(j, '$.settings.text.recordStartTimestampFormat') IS NULL"),
        _rule_finding("r_file", _place(10, "idx", 9), "DCR109", "idx", where=f"{file_ok} AND coalesce(json_type(j, '$.format'), '') <> 'VARCHAR'"),
        _rule_finding("r_p", _place(11), "DCR090", where=f"{is_list.format('files')} AND NOT has_endpoint"),
        _rule_finding("r_p", _place(12), "DCR040", where=f"{is_list.format('flows')} AND json_array_length(flows) = 0"),
        _rule_finding("r_flow", _place(13, "idx"), "DCR060", "idx", where="type <> 'OBJECT'"),
        _rule_finding("r_flow", _place(13, "idx", 1), "DCR061", "idx", where=f"{flow_ok} AND {is_list.format('j->$$$.streams$$')} AND json_array_length(j->'$.streams') = 0"),
        _rule_finding("r_flow_stream", _place(13, "flow", 2, "idx"), "DCR066", "flow", "word",
                      where="kind_of = 'VARCHAR' AND starts_with(word, 'Custom-') AND (doc_id, word) NOT IN (SELECT doc_id, name FROM r_declared)"),
        _rule_finding("r_flow_stream", _place(13, "flow", 2, "idx"), "DCR067", "flow", "word",
                      where=f"kind_of = 'VARCHAR' AND starts_with(word, 'Microsoft-') AND NOT starts_with(word, 'Microsoft-Table-') AND word NOT IN {_in(fv.KNOWN_STREAMS)}"),
        _rule_finding("r_flow", _place(13, "idx", 3), "DCR062", "idx", where=f"{flow_ok} AND {no_list.format('j->$$$.streams$$')}"),
        _rule_finding("r_flow", _place(13, "idx", 4), "DCR063", "idx", where=f"{flow_ok} AND {is_list.format('j->$$$.destinations$$')} AND json_array_length(j->'$.destinations') = 0"),
        _rule_finding("r_flow_dest", _place(13, "flow", 5, "idx"), "DCR064", "flow", "word",
                      where="kind_of = 'VARCHAR' AND (doc_id, word) NOT IN (SELECT doc_id, name FROM r_defined)"),
        _rule_finding("r_flow", _place(13, "idx", 6), "DCR065", "idx", where=f"{flow_ok} AND {no_list.format('j->$$$.destinations$$')}"),
        *[f"SELECT key.doc_id, {_place(13, 'key.flow', check, '0', 'seq')} AS place, '{prefix}' || code AS code, severity, "
          f"{_message(fv.EMBEDDED_MESSAGE, 'key.flow', 'message')} AS message, suggestion FROM q_findings WHERE severity = '{severity}'"
          for check, severity, prefix in ((7, "error", fv.EMBEDDED_ERROR), (8, "warning", fv.EMBEDDED_WARNING))],
        _rule_finding("r_flow", _place(13, "idx", 9), "DCR080", "idx", "output", where="starts_with(output, 'Custom-') AND NOT ends_with(output, '_CL')"),
        _rule_finding("r_flow", _place(13, "idx", 9), "DCR081", "idx", "output", where="NOT starts_with(output, 'Custom-') AND NOT starts_with(output, 'Microsoft-')"),
        _rule_finding("r_p", _place(14), "DCR041", where=f"flows IS NOT NULL AND {no_list.format('flows')}"),
        _rule_finding("r_p", _place(14), "DCR042", where="flows IS NULL"),
    ]
    found = [f.replace("$$$.", "'$.").replace("$$", "'") for f in found]
    transforms = (f"SELECT {{'doc_id': doc_id, 'flow': idx}} AS key, text FROM (SELECT doc_id, idx, {_trim('kql')} AS text FROM r_flow WHERE kql IS NOT NULL) "
                  "WHERE text NOT IN ('', 'source')")
    severity, message, _ = fv.RULE_FINDINGS["DCR000"]
    return f"""WITH docs AS ({docs}),
    r_trim AS (SELECT doc_id, {_trim('body')} AS body FROM docs),
    r_state AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN NOT json_valid(body) THEN 'broken'
                               WHEN json_type(CASE WHEN json_valid(body) THEN body END) <> 'OBJECT' THEN 'other' ELSE 'object' END AS state FROM r_trim),
    r_doc AS (SELECT doc_id, body::JSON AS j, json_type(body, '$.location') IS NOT NULL AS has_location,
                     json_type(body, '$.properties') IS NOT NULL AS has_properties, json_extract(body, '$.properties') AS props,
                     {string.format("json_extract(body, '$.kind')")} AS kind,
                     json_type(body, '$.dataCollectionEndpointId') IS NOT NULL AS has_top_endpoint
              FROM r_state WHERE state = 'object'),
    r_p AS (SELECT doc_id, kind, has_top_endpoint, props, props->'$.destinations' AS dests, props->'$.dataSources' AS sources,
                   props->'$.destinations.logAnalytics' AS logs, props->'$.streamDeclarations' AS declarations,
                   props->'$.dataSources.logFiles' AS files, props->'$.dataFlows' AS flows,
                   json_type(props, '$.dataCollectionEndpointId') IS NOT NULL AS has_endpoint
            FROM r_doc WHERE json_type(props) = 'OBJECT'),
    r_dest AS (SELECT doc_id, member AS j, idx, kind AS type FROM ({_members('r_p', 'logs', 'doc_id')})),
    r_defined AS (SELECT doc_id, j->>'$.name' AS name FROM r_dest WHERE type = 'OBJECT' AND json_type(j, '$.name') = 'VARCHAR'
                  UNION SELECT doc_id, dests->>'$.azureMonitorMetrics.name' FROM r_p WHERE json_type(dests, '$.azureMonitorMetrics.name') = 'VARCHAR'),
    r_names AS (SELECT doc_id, declarations, unnest(json_keys(declarations)) AS name FROM r_p WHERE json_type(declarations) = 'OBJECT'),
    r_declared AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY name) AS nr,
                          json_extract(declarations, '$."' || name || '".columns') AS columns FROM r_names),
    r_column AS (SELECT doc_id, name, nr, idx, member AS j FROM ({_members('r_declared', 'columns', 'doc_id, name, nr')}) WHERE kind = 'OBJECT'),
    r_file AS (SELECT doc_id, idx, member AS j, kind AS type FROM ({_members('r_p', 'files', 'doc_id')})),
    r_file_list AS (SELECT doc_id, idx AS file, j->'$.streams' AS streams FROM r_file WHERE type = 'OBJECT'),
    r_file_stream AS (SELECT doc_id, file, idx, kind AS kind_of, word FROM ({_members('r_file_list', 'streams', 'doc_id, file')})),
    r_flow AS (SELECT doc_id, rule_kind, idx, member AS j, kind AS type,
                      CASE WHEN kind = 'OBJECT' THEN {string.format("(member->'$.transformKql')")} END AS kql,
                      CASE WHEN kind = 'OBJECT' THEN {string.format("(member->'$.outputStream')")} END AS output
               FROM ({_members('r_p', 'flows', 'doc_id, kind AS rule_kind')})),
    r_flow_list AS (SELECT doc_id, rule_kind, idx AS flow, j->'$.streams' AS streams, j->'$.destinations' AS dests FROM r_flow WHERE type = 'OBJECT'),
    r_flow_stream AS (SELECT doc_id, rule_kind AS kind, flow, idx, kind AS kind_of, word FROM ({_members('r_flow_list', 'streams', 'doc_id, rule_kind, flow')})),
    r_flow_dest AS (SELECT doc_id, flow, idx, kind AS kind_of, word FROM ({_members('r_flow_list', 'dests', 'doc_id, flow')})),
    {query_ctes(transforms)},
    r_all AS ({' UNION ALL '.join(found)}),
    r_judged AS (SELECT * FROM r_all UNION ALL
                 SELECT doc_id, {_place(15)}, 'DCR000', '{severity}', {_q(message)}, NULL FROM docs
                 WHERE doc_id NOT IN (SELECT doc_id FROM r_all WHERE severity = 'error')),
    r_findings AS (SELECT doc_id AS key, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS INTEGER) AS seq,
                          code, severity, message, suggestion FROM r_judged)
    {result}"""


_RULE_FINDINGS = _FINDINGS.replace("q_findings", "r_findings")
_PAIRS = """
    SELECT s.doc_id, CAST(s.flow AS INTEGER) AS flow, s.word AS stream, t.word AS destination, f.kql AS transform, f.output AS output_stream
    FROM r_flow_stream s JOIN r_flow_dest t ON s.doc_id = t.doc_id AND s.flow = t.flow
         JOIN r_flow f ON f.doc_id = s.doc_id AND f.idx = s.flow
    WHERE s.kind_of = 'VARCHAR' AND t.kind_of = 'VARCHAR'"""
_PROPS = "SELECT event_id AS doc_id, props AS body FROM events"

_SOME_TOO_BIG = """
    SELECT * FROM ({}) WHERE doc_id % {} <> 0
    UNION ALL SELECT event_id, 0, '{}', 'error', 'Input exceeds maximum size (5MB)', '{}' FROM events WHERE event_id % {} = 0"""


def _too_big_sql(audit, code, hint):
    return _SOME_TOO_BIG.format(audit, BIG_EVERY, code, hint, BIG_EVERY)


_REPEATED = f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {_q(REPEATED)} ELSE body END AS body FROM ({fleet_sql(QUERY_TEMPLATES)})"
_LAST = f"""
    SELECT a.doc_id, coalesce(b.body, a.body) AS body FROM ({fleet_sql(QUERY_TEMPLATES)}) a
    LEFT JOIN ({fleet_sql(QUERY_TEMPLATES)}) b ON b.doc_id = a.doc_id + 1 AND a.doc_id % 4 = 0"""
_DAYS = """
    SELECT code, severity, count(*) AS findings, true AS close FROM q_findings JOIN events ON event_id = key
    WHERE ts::DATE BETWEEN DATE '2024-01-03' AND DATE '2024-01-20' GROUP BY code, severity"""

ORACLE = {
    "u_query_fleet": query_audit_sql(fleet_sql(QUERY_TEMPLATES), _FINDINGS),
    "u_query_documents": query_audit_sql(_TEXTS, _FINDINGS),
    "u_query_chats": query_audit_sql(_CHATS, _FINDINGS),
    "u_query_verdict": query_audit_sql(fleet_sql(QUERY_TEMPLATES), _VERDICT.format("q_findings")),
    "u_query_codes": query_audit_sql(fleet_sql(QUERY_TEMPLATES), _CODES.format("q_findings")),
    "u_query_stream": query_audit_sql(fleet_sql(QUERY_TEMPLATES), _FINDINGS),
    "u_rule_fleet": rule_audit_sql(fleet_sql(RULE_TEMPLATES), _RULE_FINDINGS),
    "u_rule_props": rule_audit_sql(_PROPS, _RULE_FINDINGS),
    "u_rule_documents": rule_audit_sql(_TEXTS, _RULE_FINDINGS),
    "u_rule_verdict": rule_audit_sql(fleet_sql(RULE_TEMPLATES), _VERDICT.format("r_findings")),
    "u_rule_verdict_in_row": rule_audit_sql(fleet_sql(RULE_TEMPLATES), _VERDICT.format("r_findings")),
    "u_rule_codes": rule_audit_sql(fleet_sql(RULE_TEMPLATES), _CODES.format("r_findings")),
    "u_rule_stream": rule_audit_sql(fleet_sql(RULE_TEMPLATES), _RULE_FINDINGS),
    "u_query_too_big": _too_big_sql(query_audit_sql(fleet_sql(QUERY_TEMPLATES), _FINDINGS), "KQL000", "Reduce the query size"),
    "u_rule_too_big": _too_big_sql(rule_audit_sql(fleet_sql(RULE_TEMPLATES), _RULE_FINDINGS), "DCR000", "Reduce the JSON size"),
    "u_query_repeated": query_audit_sql(_REPEATED, _FINDINGS),
    "u_query_totals_stream": query_audit_sql(_LAST, _CODES.format("q_findings")),
    "u_codes_of_days": query_audit_sql(fleet_sql(QUERY_TEMPLATES), _DAYS),
    "u_flow_pairs": rule_audit_sql(fleet_sql(RULE_TEMPLATES), _PAIRS),
}
