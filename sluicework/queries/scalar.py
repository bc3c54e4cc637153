"""Registered queries on scalar functions, with the same in SQL."""

from datetime import timedelta

from pyspark.sql import functions as F

import sluicework.functions as k
from sluicework.queries.tables import micros, plain, table
from sluicework.session import spread

c = F.col
AS_OF = "2024-06-01 00:00:00"


def fn_bitwise(spark, d):
    return table(spark, d, "events").select(
        "event_id",
        k.binary_and(c("event_id"), c("user_id")).alias("b_and"),
        k.binary_or(c("event_id"), c("user_id")).alias("b_or"),
        k.binary_xor(c("event_id"), c("user_id")).alias("b_xor"),
        k.binary_not(c("event_id")).alias("b_not"),
        k.binary_shift_left(c("event_id"), 33).alias("b_left"),
        k.binary_shift_right(c("event_id"), 2).alias("b_right"),
    )


def fn_convert(spark, d):
    digits = k.extract("([0-9]+)", 1, c("props"))
    guid = F.concat(F.lpad(c("user_id").cast("string"), 8, "A"), F.lit("-BBBB-cccc-DDDD-0123456789AB"))
    span = F.concat((c("event_id") % 7).cast("string"), F.lit("."), F.lpad((c("user_id") % 24).cast("string"), 2, "0"),
                    F.lit(":05:06"))
    return table(spark, d, "events").select(
        "event_id",
        k.toint(digits).alias("as_int"), k.toint(c("props")).alias("bad_int"), k.toint(c("value")).alias("cut"),
        k.tolong(digits).alias("as_long"), k.todouble(digits).alias("as_double"), k.toreal(c("event_type")).alias("bad_real"),
        k.tobool(k.iff(c("value") > 100, "true", "no such")).alias("as_bool"),
        plain(k.todatetime(k.tostring(c("ts")))).alias("as_time"),
        plain(k.todatetime(c("event_type"))).alias("bad_time"),
        k.toguid(guid).alias("as_guid"), k.toguid(c("event_type")).alias("bad_guid"),
        k.tostring(c("user_id")).alias("as_text"),
        micros(k.totimespan(span)).alias("as_span"),
        micros(k.totimespan(k.substring(span, 2))).alias("short_span"),
    )


def fn_time_parts(spark, d):
    t = c("ts")
    return table(spark, d, "events").select(
        "event_id",
        k.dayofmonth(t).alias("day_of_month"), k.dayofyear(t).alias("day_of_year"),
        micros(k.dayofweek(t)).alias("day_of_week"), k.getmonth(t).alias("in_month"), k.getyear(t).alias("in_year"),
        k.hourofday(t).alias("in_hour"), k.weekofyear(t).alias("in_week"),
        k.datetime_part("minute", t).alias("in_minute"), k.datetime_part("second", t).alias("in_second"),
        k.datetime_part("millisecond", t).alias("in_milli"), k.datetime_part("quarter", t).alias("in_quarter"),
    )


def fn_time_bounds(spark, d):
    t = c("o_orderdate")
    bounds = {
        "day_start": k.startofday(t), "week_start": k.startofweek(t), "month_start": k.startofmonth(t),
        "year_start": k.startofyear(t), "day_end": k.endofday(t), "week_end": k.endofweek(t),
        "month_end": k.endofmonth(t), "year_end": k.endofyear(t),
    }
    return table(spark, d, "orders").select("o_orderkey", *[plain(v).alias(n) for n, v in bounds.items()])


def fn_time_arithmetic(spark, d):
    t, ref = c("ts"), F.lit(AS_OF).cast("timestamp")
    return table(spark, d, "events").select(
        "event_id",
        plain(k.now(ref)).alias("at"), plain(k.ago(k.timespan("36h"), ref)).alias("before"),
        plain(k.datetime_add("month", 1, t)).alias("plus_month"),
        plain(k.datetime_add("minute", c("user_id"), t)).alias("plus_minutes"),
        k.datetime_diff("hour", ref, t).alias("hours"), k.datetime_diff("day", ref, t).alias("days"),
        k.datetime_diff("week", ref, t).alias("weeks"), k.datetime_diff("month", ref, t).alias("months"),
        k.datetime_diff("year", ref, t).alias("years"), k.datetime_diff("second", ref, t).alias("seconds"),
        plain(k.make_datetime(2024, 2, c("user_id") % 31 + 1, 7)).alias("made"),
        micros(k.make_timespan(c("user_id") % 24, 5, 6)).alias("span"),
        plain(k.bin(t, timedelta(minutes=15))).alias("quarter_hour"),
    )


def fn_dynamic(spark, d):
    props = k.parse_json(c("props"))
    words = k.split(c("event_type"), "i")
    more = k.array_concat(words, k.pack_array(c("event_type"), c("props")))
    pairs = k.zip(words.alias("w"), k.pack_array(c("event_type")).alias("e"))
    packed = k.pack("id", c("event_id"), "kind", c("event_type"))
    return table(spark, d, "events").select(
        "event_id",
        k.toint(k.field(props, "k")).alias("num"), k.field(k.todynamic(c("event_type")), "k").alias("no_json"),
        k.array_length(more).alias("n_more"), F.concat_ws("|", more).alias("more"),
        k.item(words, 0).alias("first"), k.item(words, 9).alias("beyond"),
        k.array_length(k.pack_array(c("event_id"), c("event_type"), dynamic=True), dynamic=True).alias("n_mixed"),
        F.size(pairs).alias("n_zip"), F.concat_ws("|", F.transform(pairs, lambda p: F.coalesce(p["e"], F.lit("-")))).alias("zipped"),
        k.field(packed, "kind").alias("kind"), k.field(packed, "id", "bigint").alias("id"),
        k.gettype(packed, dynamic=True).alias("packed_type"),
    )


def fn_parse_xml(spark, d):
    text = F.concat(F.lit("<e><kind>"), c("event_type"), F.lit("</kind><user>"), c("user_id").cast("string"),
                    k.iff(c("value") > 100, "</user></e>", "</user>"))
    doc = k.parse_xml(text)
    return table(spark, d, "events").select(
        "event_id", k.field(doc, "kind").alias("kind"), k.field(doc, "user", "bigint").alias("user_no"))


def fn_math(spark, d):
    x, q = c("l_extendedprice"), c("l_quantity")
    return spread(table(spark, d, "lineitem")).select(
        "l_orderkey", "l_linenumber",
        k.abs(q - 25).alias("v_abs"), k.bin(x, 1000).alias("v_bin"), k.floor(x).alias("v_floor"),
        k.ceiling(x).alias("v_ceiling"), F.round(k.exp(c("l_discount")), 6).alias("v_exp"),
        F.round(k.exp2(c("l_tax")), 6).alias("v_exp2"), F.round(k.exp10(c("l_tax")), 6).alias("v_exp10"),
        F.round(k.log(x), 6).alias("v_log"), F.round(k.log10(x), 6).alias("v_log10"), F.round(k.log2(x), 6).alias("v_log2"),
        k.log(q - q).alias("log_zero"), k.pow(q, 2).alias("v_pow"), k.round(x / 7, 2).alias("v_round"), k.sign(q - 25).alias("v_sign"),
        k.isnan(x).alias("v_nan"), k.isinf(x).alias("v_inf"), k.isfinite(x).alias("v_finite"),
    )


def fn_conditional(spark, d):
    return table(spark, d, "part").select(
        "p_partkey",
        k.case(c("p_size") < 10, "small", c("p_size") < 30, "middle", "large").alias("size_class"),
        k.iif(c("p_retailprice") > 1500, c("p_brand"), c("p_type")).alias("either"),
        k.iff(c("p_size") == 1, 1, 0).alias("is_one"),
        k.max_of(c("p_size"), 25).alias("at_least"), k.min_of(c("p_size"), 25).alias("at_most"),
    )


def fn_text_search(spark, d):
    x = c("text")
    return spread(table(spark, d, "documents")).select(
        "doc_id",
        k.countof(x, "th").alias("n_th"), k.countof(x, "[0-9]+", kind="regex").alias("n_numbers"),
        k.extract("([A-Za-z]+) ([A-Za-z]+)", 2, x).alias("second"), k.array_length(k.extract_all("([A-Z])[a-z]+", x)).alias("n_capital"),
        k.indexof(x, "the").alias("at"), k.isempty(c("lang")).alias("empty"), k.isnotempty(c("lang")).alias("filled"),
        k.strlen(x).alias("chars"), k.array_length(k.split(x, "\n")).alias("n_lines"), k.split(x, ". ", 1).alias("sentence"),
    )


def fn_text_edit(spark, d):
    x = c("url")
    return table(spark, d, "pages").select(
        "page_id",
        k.replace_string(x, "http", "h").alias("short"), k.reverse(x).alias("back"), k.strcat(c("page_id"), "-", x).alias("glued"),
        k.strcat_delim("/", "a", c("page_id"), x).alias("joined"), k.substring(x, 4, 5).alias("piece"),
        k.tolower(x).alias("low"), k.toupper(x).alias("up"), k.trim("h|[0-9]+", x).alias("trimmed"),
        k.trim_start("https?://", x).alias("no_scheme"), k.trim_end("[^/]*", x).alias("no_tail"),
    )


def fn_text_encode(spark, d):
    x = c("text")
    coded = k.base64_encodestring(x)
    return table(spark, d, "conversations").select(
        "conv_id", "turn", coded.alias("coded"), k.base64_decodestring(coded).alias("decoded"),
        k.base64_decodestring(c("role")).isNull().alias("not_coded"), k.hash_sha256(x).alias("digest"))


def fn_types(spark, d):
    return table(spark, d, "events").select(
        "event_id",
        k.gettype(c("ts")).alias("t_ts"), k.gettype(c("value")).alias("t_value"), k.gettype(c("event_id")).alias("t_id"),
        k.gettype(k.parse_json(c("props")), dynamic=True).alias("t_props"),
        k.isnull(k.toint(c("event_type"))).alias("is_null"), k.isnotnull(c("event_type")).alias("is_not_null"),
    )


def fn_cef_dictionary(spark, d):
    text = F.concat(F.lit("act="), c("event_type"), F.lit(" msg=user "), c("user_id").cast("string"),
                    F.lit(" was here act="), c("user_id").cast("string"))
    found = k.parse_cef_dictionary(text)
    return table(spark, d, "events").select(
        "event_id", F.size(found).alias("n"), found["act"].alias("act"), found["msg"].alias("msg"))


def predicates(spark, d):
    x, u, v = c("text"), c("doc_id"), c("n_chars")
    return table(spark, d, "documents").select(
        "doc_id",
        (c("lang") == "en").alias("eq"), (c("lang") != "en").alias("ne"),
        k.eq_ignore_case(c("lang"), "EN").alias("eq_any_case"), k.ne_ignore_case(c("lang"), "EN").alias("ne_any_case"),
        k.in_(c("lang"), "en", "de").alias("in_list"), k.not_in(c("lang"), "en", "de").alias("not_in_list"),
        k.contains(x, "THE").alias("with_part"), k.not_contains(x, "THE").alias("without_part"), k.has(x, "and").alias("with_term"),
        k.add(u, v).alias("plus"), k.subtract(u, v).alias("minus"), k.multiply(u, v).alias("times"),
        k.divide(v, u).alias("ratio"), k.modulo(v, u).alias("rest"),
        ((u >= 10) & ~(v < 1000) | (u <= 3)).alias("logic"),
    )


QUERIES = {
    f.__name__: f for f in (
        fn_bitwise, fn_convert, fn_time_parts, fn_time_bounds, fn_time_arithmetic, fn_dynamic, fn_parse_xml, fn_math,
        fn_conditional, fn_text_search, fn_text_edit, fn_text_encode, fn_types, fn_cef_dictionary, predicates)
}

ORACLE = {
    "fn_bitwise": """
        SELECT event_id, event_id & user_id AS b_and, event_id | user_id AS b_or, xor(event_id, user_id) AS b_xor,
               ~event_id AS b_not, event_id << 33 AS b_left, event_id >> 2 AS b_right FROM events""",
    "fn_convert": """
        WITH e AS (SELECT *, regexp_extract(props, '[0-9]+') AS digits,
                          lpad((user_id % 24)::VARCHAR, 2, '0') || ':05:06' AS clock FROM events)
        SELECT event_id, try_cast(digits AS INTEGER) AS as_int, CAST(NULL AS INTEGER) AS bad_int,
               CAST(trunc(value) AS INTEGER) AS cut, try_cast(digits AS BIGINT) AS as_long,
               try_cast(digits AS DOUBLE) AS as_double, CAST(NULL AS DOUBLE) AS bad_real,
               CASE WHEN value > 100 THEN true END AS as_bool, ts AS as_time, CAST(NULL AS TIMESTAMP) AS bad_time,
               lower(lpad(user_id::VARCHAR, 8, 'A') || '-BBBB-cccc-DDDD-0123456789AB') AS as_guid,
               CAST(NULL AS VARCHAR) AS bad_guid, user_id::VARCHAR AS as_text,
               ((event_id % 7) * 86400 + (user_id % 24) * 3600 + 306) * 1000000 AS as_span,
               ((user_id % 24) * 3600 + 306) * 1000000 AS short_span
        FROM e""",
    "fn_time_parts": """
        SELECT event_id, CAST(day(ts) AS INTEGER) AS day_of_month, CAST(dayofyear(ts) AS INTEGER) AS day_of_year,
               dayofweek(ts) * 86400000000 AS day_of_week, CAST(month(ts) AS INTEGER) AS in_month,
               CAST(year(ts) AS INTEGER) AS in_year, CAST(hour(ts) AS INTEGER) AS in_hour, CAST(week(ts) AS INTEGER) AS in_week,
               minute(ts) AS in_minute, second(ts) AS in_second, millisecond(ts) % 1000 AS in_milli, quarter(ts) AS in_quarter
        FROM events""",
    "fn_time_bounds": """
        WITH o AS (SELECT o_orderkey, date_trunc('day', o_orderdate)::TIMESTAMP AS ds,
                          date_trunc('day', o_orderdate)::TIMESTAMP - to_days(CAST(dayofweek(o_orderdate) AS INTEGER)) AS ws,
                          date_trunc('month', o_orderdate)::TIMESTAMP AS ms, date_trunc('year', o_orderdate)::TIMESTAMP AS ys FROM orders)
        SELECT o_orderkey, ds AS day_start, ws AS week_start, ms AS month_start, ys AS year_start,
               ds + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS day_end, ws + INTERVAL 7 DAY - INTERVAL 1 MICROSECOND AS week_end,
               ms + INTERVAL 1 MONTH - INTERVAL 1 MICROSECOND AS month_end, ys + INTERVAL 1 YEAR - INTERVAL 1 MICROSECOND AS year_end
        FROM o""",
    "fn_time_arithmetic": f"""
        WITH e AS (SELECT *, TIMESTAMP '{AS_OF}' AS ref FROM events)
        SELECT event_id, ref AS "at", ref - INTERVAL 36 HOUR AS "before", ts + INTERVAL 1 MONTH AS plus_month,
               ts + to_minutes(user_id) AS plus_minutes, date_diff('hour', ts, ref) AS hours, date_diff('day', ts, ref) AS days,
               date_diff('week', ts + INTERVAL 1 DAY, ref + INTERVAL 1 DAY) AS weeks, date_diff('month', ts, ref) AS months,
               date_diff('year', ts, ref) AS years, date_diff('second', ts, ref) AS seconds,
               CASE WHEN user_id % 31 + 1 <= 29 THEN make_timestamp(2024, 2, user_id % 31 + 1, 7, 0, 0) END AS made,
               ((user_id % 24) * 3600 + 306) * 1000000 AS span,
               time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') AS quarter_hour
        FROM e""",
    "fn_dynamic": """
        WITH e AS (SELECT *, string_split(event_type, 'i') AS words FROM events)
        SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS num, CAST(NULL AS VARCHAR) AS no_json,
               CAST(len(words) + 2 AS INTEGER) AS n_more,
               array_to_string(words || [event_type, props], '|') AS more, words[1] AS "first", CAST(NULL AS VARCHAR) AS beyond,
               2 AS n_mixed, CAST(len(words) AS INTEGER) AS n_zip,
               event_type || repeat('|-', CAST(len(words) - 1 AS BIGINT)) AS zipped,
               event_type AS kind, event_id AS id, 'dictionary' AS packed_type
        FROM e""",
    "fn_parse_xml": """
        SELECT event_id, CASE WHEN value > 100 THEN event_type END AS kind, CASE WHEN value > 100 THEN user_id END AS user_no
        FROM events""",
    "fn_math": """
        SELECT l_orderkey, l_linenumber, abs(l_quantity - 25) AS v_abs, CAST(floor(l_extendedprice / 1000) AS BIGINT) * 1000 AS v_bin,
               CAST(floor(l_extendedprice) AS BIGINT) AS v_floor, CAST(ceil(l_extendedprice) AS BIGINT) AS v_ceiling,
               round(exp(l_discount), 6) AS v_exp, round(pow(2, l_tax), 6) AS v_exp2, round(pow(10, l_tax), 6) AS v_exp10,
               round(ln(l_extendedprice), 6) AS v_log, round(log10(l_extendedprice), 6) AS v_log10, round(log2(l_extendedprice), 6) AS v_log2,
               CAST(NULL AS DOUBLE) AS log_zero, pow(l_quantity, 2) AS v_pow, round(l_extendedprice / 7, 2) AS v_round,
               CAST(sign(l_quantity - 25) AS DOUBLE) AS v_sign, isnan(l_extendedprice) AS v_nan, isinf(l_extendedprice) AS v_inf,
               isfinite(l_extendedprice) AS v_finite
        FROM lineitem""",
    "fn_conditional": """
        SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS size_class,
               CASE WHEN p_retailprice > 1500 THEN p_brand ELSE p_type END AS "either", CASE WHEN p_size = 1 THEN 1 ELSE 0 END AS is_one,
               greatest(p_size, 25) AS at_least, least(p_size, 25) AS at_most
        FROM part""",
    "fn_text_search": r"""
        SELECT doc_id, CAST((length(text) - length(replace(text, 'th', ''))) / 2 AS INTEGER) AS n_th,
               CAST(len(regexp_extract_all(text, '[0-9]+')) AS INTEGER) AS n_numbers,
               CASE WHEN regexp_matches(text, '([A-Za-z]+) ([A-Za-z]+)') THEN regexp_extract(text, '([A-Za-z]+) ([A-Za-z]+)', 2) END AS "second",
               CAST(len(regexp_extract_all(text, '([A-Z])[a-z]+')) AS INTEGER) AS n_capital, CAST(instr(text, 'the') - 1 AS INTEGER) AS "at",
               coalesce(lang, '') = '' AS empty, coalesce(lang, '') <> '' AS filled, CAST(length(text) AS INTEGER) AS chars,
               CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_lines, string_split(text, '. ')[2] AS sentence
        FROM documents""",
    "fn_text_edit": r"""
        SELECT page_id, replace(url, 'http', 'h') AS short, reverse(url) AS back, page_id || '-' || url AS glued,
               'a/' || page_id || '/' || url AS joined, substring(url, 5, 5) AS piece, lower(url) AS low, upper(url) AS up,
               regexp_replace(regexp_replace(url, '\A(?:h|[0-9]+)', ''), '(?:h|[0-9]+)\z', '') AS trimmed,
               regexp_replace(url, '\Ahttps?://', '') AS no_scheme, regexp_replace(url, '[^/]*\z', '') AS no_tail
        FROM pages""",
    "fn_text_encode": """
        SELECT conv_id, turn, to_base64(encode(text)) AS coded, text AS decoded,
               true AS not_coded, sha256(text) AS digest FROM conversations""",
    "fn_types": """
        SELECT event_id, 'datetime' AS t_ts, 'real' AS t_value, 'long' AS t_id,
               CASE json_type(props) WHEN 'OBJECT' THEN 'dictionary' END AS t_props, true AS is_null, event_type IS NOT NULL AS is_not_null
        FROM events""",
    "fn_cef_dictionary": """
        SELECT event_id, 2 AS n, user_id::VARCHAR AS act, 'user ' || user_id || ' was here' AS msg FROM events""",
    "predicates": """
        SELECT doc_id, lang = 'en' AS eq, lang <> 'en' AS ne, lower(lang) = 'en' AS eq_any_case, lower(lang) <> 'en' AS ne_any_case,
               lang IN ('en', 'de') AS in_list, lang NOT IN ('en', 'de') AS not_in_list,
               contains(lower(text), 'the') AS with_part, NOT contains(lower(text), 'the') AS without_part,
               regexp_matches(text, '(?i)(^|[^A-Za-z0-9])and([^A-Za-z0-9]|$)') AS with_term, doc_id + n_chars AS plus,
               doc_id - n_chars AS minus, doc_id * n_chars AS times,
               CASE WHEN doc_id <> 0 THEN n_chars::DOUBLE / doc_id END AS ratio, CASE WHEN doc_id <> 0 THEN n_chars % doc_id END AS rest,
               (doc_id >= 10 AND NOT (n_chars < 1000)) OR doc_id <= 3 AS logic
        FROM documents""",
}
