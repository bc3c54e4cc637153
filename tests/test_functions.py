"""Scalar functions and table operators on values the supplied tables do not hold."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import sluicework.functions as k
from sluicework import fixed_values as fv
from sluicework import operators as op
from sluicework import sources as so

def cases():
    T0 = F.lit("2024-03-31 23:59:59.999999").cast("timestamp")

    return [
        (k.toint("12.7"), None), (k.toint(12.7), 12), (k.toint("99999999999"), None), (k.tobool("maybe"), None),
        (k.toguid("not one"), None), (k.totimespan("1.02:03:04"), dt.timedelta(days=1, hours=2, minutes=3, seconds=4)),
        (k.totimespan("-02:00:00"), -dt.timedelta(hours=2)), (k.totimespan("soon"), None),
        (k.binary_shift_left(1, 33), 2**33), (k.datetime_add("month", -1, T0), dt.datetime(2024, 2, 29, 23, 59, 59, 999999)),
        (k.datetime_diff("hour", F.lit("2024-01-01 01:01:00").cast("timestamp"), F.lit("2024-01-01 00:59:00").cast("timestamp")), 1),
        (k.datetime_diff("month", T0, F.lit("2023-12-31").cast("timestamp")), 3), (k.datetime_part("microsecond", T0), 999999),
        (k.dayofweek(T0), dt.timedelta(0)), (k.startofweek(T0), dt.datetime(2024, 3, 31)),
        (k.endofweek(T0), dt.datetime(2024, 4, 6, 23, 59, 59, 999999)), (k.endofmonth(T0), dt.datetime(2024, 3, 31, 23, 59, 59, 999999)),
        (k.make_datetime(2023, 2, 29), None), (k.make_timespan(1, 2), dt.timedelta(hours=1, minutes=2)),
        (k.make_timespan(1, 2, 3, 4), dt.timedelta(days=1, hours=2, minutes=3, seconds=4)),
        (k.bin(-3, 2), -4), (k.bin(T0, dt.timedelta(hours=1)), dt.datetime(2024, 3, 31, 23)), (k.round(2.5), 3.0), (k.round(-2.5), -3.0),
        (k.log(0.0), None), (k.log(-1.0), None), (k.isinf(float("-inf")), True), (k.isfinite(float("nan")), False),
        (k.max_of(1, F.lit(None).cast("int"), 3), 3), (k.case(F.lit(False), 1, F.lit(None).cast("boolean"), 2, 3), 3),
        (k.base64_decodestring("/////w=="), None), (k.base64_decodestring("!"), None), (k.countof("aaaa", "aa"), 2),
        (k.extract("(x)", 1, "abc"), None), (k.indexof("abc", "z"), -1), (k.indexof("abc", F.lit("c")), 2), (k.isempty(F.lit(None).cast("string")), True),
        (k.split("a.b.c", ".", 2), "c"), (k.split("a.b", ".", 5), None), (k.strcat("a", F.lit(None), 1), "a1"), (k.substring("hello", 1), "ello"),
        (k.trim("[ -]+", "- a-b -"), "a-b"), (k.has("user-name x", "name"), True), (k.has("username", "name"), False),
        (k.has("a.b+c", "b+c"), True), (k.divide(1, 0), None), (k.modulo(1, 0), None), (k.add(2**63 - 1, 1), None),
        (k.parse_cef_dictionary(F.lit("a=1 b=two words a=3")), {"a": "3", "b": "two words"}),
        (k.field(k.parse_xml(F.lit("<a><b>1</b></a>")), "b"), "1"), (k.parse_xml(F.lit("<a><b>")).isNull(), True),
        (k.parse_json("{").isNull(), True), (k.field(k.parse_json('{"a": {"b": 1}}'), "a.b", "int"), 1),
        (k.gettype(k.parse_json("[1]"), dynamic=True), "array"), (k.gettype(k.parse_json("null"), dynamic=True), "null"),
        (k.gettype(k.timespan("1h")), "timespan"), (k.timespan("90m"), dt.timedelta(minutes=90)),
    ]


def test_values(spark):
    found = cases()
    row = spark.range(1).select(*[value.alias(f"v{i}") for i, (value, _) in enumerate(found)]).first()
    for i, (_, expected) in enumerate(found):
        assert row[i] == expected, f"case {i}"


def test_every_listed_function_exists():
    for name in fv.SCALAR_FUNCTIONS:
        assert callable(getattr(k, name, None) or getattr(op, name)), name


def test_functions_stay_in_the_jvm(spark):
    df = spark.range(3).select(k.strcat("a", F.col("id")).alias("x"), k.toint("1").alias("y"), k.bin(F.col("id"), 2).alias("z"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_extend_sees_earlier_columns(spark):
    assert op.extend(spark.range(1), a=F.col("id") + 1, b=F.col("a") + 1).first().b == 2


def test_rename_needs_the_column(spark):
    with pytest.raises(ValueError):
        op.project_rename(spark.range(1), x="missing")


def test_parse(spark):
    df = spark.createDataFrame([("user=7 took 1.5s (ok)",), ("user=x took 2s (no)",), ("other",)], "m string")
    rows = op.parse(df, "m", "user=", ("user", "long"), " took ", ("secs", "double"), "s (", ("state", "string"), ")").collect()
    assert [tuple(r)[1:] for r in rows] == [(7, 1.5, "ok"), (None, 2.0, "no"), (None, None, None)]


@pytest.mark.parametrize(("text", "pattern", "kind", "expected"), [
    ("xyz:1", ("[a-z]+", ("id", "string"), "z:", ("v", "string")), "regex", ("", "1")),
    ("abc", ("a|ab", "c", ("v", "string")), "regex", ("",)),
    ("k=a=b;1", (("k", "string"), "=[a-z=]+", ("v", "string"), "b;", ("w", "long")), "regex", ("k", "", 1)),
    ("xaab1", ("x", op.ANY, "a", "b", ("v", "long")), "simple", (1,)),
    ("xaab", ("x", ("v", "string"), "a", "b"), "simple", ("a",)),
])
def test_parse_loses_no_match(spark, text, pattern, kind, expected):
    """Expressions that have to give back what they took, and texts without a gap between them."""
    assert op.parse(spark.createDataFrame([(text,)], "m string"), "m", *pattern, kind=kind).first()[1:] == expected


def test_parse_warns_over_ten_columns(spark):
    df = spark.createDataFrame([("x",)], "m string")
    pattern = [part for i in range(11) for part in ((f"c{i}", "string"), ",")]
    with pytest.warns(UserWarning, match="limit is 10"):
        op.parse(df, "m", *pattern)


def test_time_column_needs_a_time(spark):
    with pytest.raises(ValueError):
        op.time_column(spark.range(1).withColumnRenamed("id", "TimeGenerated"))


def test_declared_schema():
    schema = so.declared_schema([{"name": "a", "type": "DateTime"}, {"name": "b", "type": "boolean"}, {"name": "c", "type": "dynamic"}])
    assert [f.dataType for f in schema] == [T.TimestampType(), T.BooleanType(), T.VariantType()]
    with pytest.raises(ValueError, match="DCR051.*DCR052.*DCR053"):
        so.declared_schema([{"type": "int"}, {"name": "x", "type": "decimal"}, {"name": "y", "type": 5}])


def test_conform_keeps_every_row_once(spark):
    df = spark.createDataFrame([("1", "x", "{}"), ("a", "y", "[1]"), (None, None, None), ("2", "z", "{")], "n string, s string, d string")
    schema = so.declared_schema([{"name": "n", "type": "int"}, {"name": "d", "type": "dynamic"}, {"name": "new", "type": "guid"}])
    good, rejected = so.conform(df, schema)
    assert sorted(r.n or 0 for r in good.collect()) == [0, 1] and good.columns == ["n", "d", "new"]
    assert sorted(r.s for r in rejected.collect()) == ["y", "z"]


def test_geo_location(spark):
    """Against a search through all ranges; a third of the addresses are the same, one range is far off and wide."""
    ranges = [(i * 1000 + 5, i * 1000 + 5 + (i * 37) % 900, f"p{i}") for i in range(-50, 200)] + [(10**9, 2 * 10**9, "wide"), (2**62 + 5, 2**63 - 1, "last")]
    addresses = [(i * 977) % 260_000 - 55_000 for i in range(600)] + [42_010] * 300 + [10**9, 2 * 10**9, 2 * 10**9 + 1, None, 2**62 + 4, 2**62 + 5, 2**63 - 1, -(2**63)]
    found = op.geo_location(spark.createDataFrame([(i, a) for i, a in enumerate(addresses)], "id long, ip long"), "ip",
                            spark.createDataFrame(ranges, "lo long, hi long, place string")).select("id", "place").collect()
    expected = [(i, next((p for lo, hi, p in ranges if a is not None and lo <= a <= hi), None)) for i, a in enumerate(addresses)]
    assert sorted(tuple(r) for r in found) == expected


def test_bad_input_gives_null(spark):
    """One bad value per function leaves the job running."""
    least = F.lit(-(2**63)).cast("bigint")
    values = [
        k.binary_and("x", 1), k.binary_not("x"), k.binary_shift_left(1, "x"), k.binary_shift_right("x", 1),
        k.datetime_add("day", "x", F.lit("2024-01-01").cast("timestamp")),
        k.datetime_add("year", 10**9, F.lit("2024-01-01").cast("timestamp")),
        k.make_datetime("x", 1, 1), k.make_datetime(2024, 13, 1), k.make_timespan("x", 1),
        k.make_timespan(2**31 - 1, 0, 0, "x"), k.abs(least), k.countof("abc", ""), k.bin(5, 0), k.floor(least, 3),
    ]
    row = spark.range(1).select(*[v.alias(f"c{i}") for i, v in enumerate(values)]).collect()[0]
    assert [i for i, v in enumerate(row) if v is not None] == []


def test_large_numbers(spark):
    n = F.col("n")
    values = [2**53 + 1, -(2**53) - 1, 2**63 - 1, 60 * 10**9 * 30_000_000 - 1, 0, -7, None]
    df = spark.createDataFrame([(v,) for v in values], "n bigint")
    rows = df.select("n", k.floor(n).alias("f"), k.bin(n, 60 * 10**9).alias("b"), k.bin(n, 7).alias("s"), k.abs(n).alias("a"))
    for r in rows.collect():
        if r.n is None:
            assert r.f is None and r.b is None
        else:
            assert (r.f, r.b, r.s, r.a) == (r.n, r.n // (60 * 10**9) * (60 * 10**9), r.n // 7 * 7, abs(r.n))


def test_dynamic_arrays(spark):
    a, b = k.parse_json(F.lit("[1, \"x\"]")), k.parse_json(F.lit("[2]"))
    row = spark.range(1).select(
        F.to_json(k.array_concat(a, b, dynamic=True)).alias("both"), F.to_json(k.zip(a, b, dynamic=True)).alias("zip"),
        k.item(a, 1, dynamic=True).cast("string").alias("item"), k.item(a, 5, dynamic=True).alias("none"),
        k.array_length(a, dynamic=True).alias("n"), k.array_concat(k.parse_json(F.lit("1")), b, dynamic=True).alias("bad"),
        k.gettype(F.lit("2024-01-01").cast("timestamp").cast("variant"), dynamic=True).alias("type")).collect()[0]
    assert (row.both, row.zip, row.item, row.none, row.n, row.bad, row.type) == (
        '[1,"x",2]', '[[1,2],["x",null]]', "x", None, 2, None, "datetime")
    with pytest.raises(Exception, match="DATATYPE_MISMATCH"):
        spark.range(1).select(k.array_concat(a, b)).collect()


def test_timespan_literals(spark):
    row = spark.range(1).select(
        k.timespan("1.5h").alias("a"), k.timespan("20tick").alias("b"), k.timespan("3ms").alias("c")).collect()[0]
    assert tuple(row) == (dt.timedelta(hours=1.5), dt.timedelta(microseconds=2), dt.timedelta(milliseconds=3))


def test_parse_is_linear(spark):
    """Ten captures on a long row without a match, and a Java pattern with a group of its own."""
    df = spark.createDataFrame([("a " * 50_000,)], "s string")
    wanted = [x for i in range(10) for x in ((f"c{i}", "string"), " ")]
    start = time.perf_counter()
    assert op.parse(df, "s", *wanted, "#").select("c0", "c9").collect()[0][:] == (None, None)
    assert time.perf_counter() - start < 20
    df = spark.createDataFrame([("k1=v1; end",)], "s string")
    row = op.parse(df, "s", ("a", "string"), r"(\p{L}|[0-9])=", ("b", "string"), ";", ("c", "string"), kind="regex").collect()[0]
    assert (row.a, row.b, row.c) == ("k", "v1", " end")
