"""Findings of the audits: short marks inside a row, full texts once exploded.

While a document is judged, a finding is only a *mark*: a number of the fixed
texts, the severity, the flow it came from (embedded transformations) and the
values for its message.  The texts are put in after the explode, from one
constant array, so neither expression trees nor rows carry them around.
"""

from __future__ import annotations

import functools
import weakref
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicework import fixed_values as fv

MARKS = "array<struct<head:struct<text:int,severity:string,flow:int>,args:array<string>>>"

# Lists up to this length are looked through.
SHORT_LIST = 200


def _all_texts() -> dict[str, tuple[str, str, str, str | None]]:
    """key -> (severity, code, message, suggestion)."""
    texts = {}
    for key, (code, severity, message, hint) in fv.QUERY_FINDINGS.items():
        texts[key] = (severity, code, message, hint)
    for key, names in (("refused_operator", fv.REFUSED_OPERATORS), ("wrong_name", fv.WRONG_FUNCTION_NAMES)):
        severity, code, message, _ = texts.pop(key)
        for name, hint in names.items():
            texts[f"{key} {name}"] = (severity, code, message, hint)
    for code, (severity, message, hint) in fv.RULE_FINDINGS.items():
        texts[code] = (severity, code, message, hint)
    code, severity, message, hint = fv.RULE_TOO_BIG
    texts["rule_too_big"] = (severity, code, message, hint)
    return texts


TEXTS = _all_texts()
NUMBERS = {key: i for i, key in enumerate(TEXTS)}
NAMED = {"refused_operator": list(fv.REFUSED_OPERATORS), "wrong_name": list(fv.WRONG_FUNCTION_NAMES)}


Steps = list[tuple[str, Column]]


def once(build: Callable[[], Steps]) -> Callable[[], Steps]:
    """Build the columns of a plan once per Spark context.  They name columns and
    no table, and building some hundred of them from Python takes seconds."""
    built = weakref.WeakKeyDictionary()

    @functools.wraps(build)
    def cached() -> Steps:
        context = SparkContext.getOrCreate()
        if context not in built:
            built[context] = build()
        return built[context]

    return cached


def apply_steps(df: DataFrame, steps: Steps) -> DataFrame:
    """Add columns one after the other, each in a projection of its own, so that a
    column used by several later ones is computed once."""
    for name, value in steps:
        df = df.withColumn(name, value)
    return df


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it any number of times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mark(key: str, *values: Column, name: Column | None = None) -> Column:
    """A finding with its message values (strings); ``name`` selects among texts kept per name.

    Constant parts are written as SQL: one expression to parse instead of many
    small ones to build from Python.
    """
    if name is not None:
        names = NAMED[key]
        within = F.array_position(F.array(*[F.lit(n) for n in names]), name).cast("int") - 1
        head = F.struct((within + NUMBERS[f"{key} {names[0]}"]).alias("text"), F.lit("error").alias("severity"),
                        F.expr("cast(null as int) as flow")).alias("head")
    else:
        head = F.expr(
            f"named_struct('text', {NUMBERS[key]}, 'severity', '{TEXTS[key][0]}', 'flow', cast(null as int)) as head")
    args = F.array(*values) if values else F.expr("cast(array() as array<string>)")
    return F.struct(head, args.alias("args"))


def none() -> Column:
    return F.expr(f"cast(array() as {MARKS})")


def each(items: Column, body) -> Column:
    """Marks of every list member, in list order; none for a missing list."""
    return F.coalesce(F.flatten(F.transform(items, body)), none())


def marks_where(items: Column, condition, body) -> Column:
    """A mark for each list member that meets the condition; none for a missing list."""
    return F.coalesce(F.transform(F.filter(items, condition), body), none())


def is_among(names: Column, name: Column) -> Column:
    """Whether a name is in a sorted list: looked through if short, else halved step
    by step, so that a document full of unknown names does not cost their square."""
    def halve(bounds: Column, _: Column) -> Column:
        low, high = bounds["low"], bounds["high"]
        middle = F.shiftright(low + high, 1)
        after = (low < high) & (F.get(names, middle) < name)
        return F.struct(F.when(after, middle + 1).otherwise(low).alias("low"),
                        F.when(after | (low >= high), high).otherwise(middle).alias("high"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(names) + 1)).cast("int"))
    bounds = F.struct(F.lit(0).alias("low"), F.size(names).alias("high"))
    place = F.aggregate(steps, bounds, halve)["low"]
    return F.when(F.size(names) <= SHORT_LIST, F.array_contains(names, name)).otherwise(F.get(names, place) == name)


def has_error(marks: Column) -> Column:
    return F.exists(marks, lambda m: m["head"]["severity"] == "error")


def _sql(text: str | None) -> str:
    if text is None:
        return "cast(null as string)"
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _texts() -> Column:
    entries = (
        f"named_struct('code', {_sql(code)}, 'message', {_sql(message.replace('{}', '%s'))}, 'suggestion', {_sql(hint)})"
        for _, code, message, hint in TEXTS.values())
    return F.expr(f"array({', '.join(entries)})")


def codes_of_marks(marks: Column) -> Column:
    """Code and severity of each mark, in order."""
    def coded(m: Column) -> Column:
        flow, severity = m["head"]["flow"], m["head"]["severity"]
        prefix = F.when(flow.isNull(), "").when(severity == "error", fv.EMBEDDED_ERROR).otherwise(fv.EMBEDDED_WARNING)
        return F.struct(F.concat(prefix, F.get(_texts(), m["head"]["text"])["code"]).alias("code"), severity.alias("severity"))

    return F.transform(marks, coded)


def to_rows(docs: DataFrame) -> DataFrame:
    """``(doc_id, marks)`` -> one row per finding, with its texts.

    Every document has at least one finding, so the outer explode adds no rows;
    it keeps the optimizer from testing ``size(marks) > 0`` first, which would
    evaluate the list twice.
    """
    rows = docs.select("doc_id", F.posexplode_outer("marks").alias("seq", "m")).select(
        "doc_id", "seq", "m.head.*", "m.args", F.get(_texts(), F.col("m.head.text")).alias("t"))
    embedded = _sql(fv.EMBEDDED_MESSAGE.replace("{}", "%s"))
    return rows.selectExpr(
        "doc_id", "seq",
        f"concat(case when flow is null then '' when severity = 'error' then {_sql(fv.EMBEDDED_ERROR)} "
        f"else {_sql(fv.EMBEDDED_WARNING)} end, t.code) as code",
        "severity",
        f"concat(if(flow is null, '', format_string({embedded}, flow, '')), "
        "format_string(t.message, get(args, 0), get(args, 1), get(args, 2))) as message",
        "t.suggestion as suggestion",
    )
