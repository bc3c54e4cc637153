"""Audit of a table of transformation texts.

``audit_queries(docs)`` takes ``(doc_id, body)`` and returns one row per
finding.  A text is judged on its own, so the whole audit is one expression
over the row: the plan is scan -> project -> explode, without a shuffle, a
join or a broadcast, and a fleet with hot keys or many copies spreads like any
other.  A row is at most 5 MB (larger bodies get one finding and are not read
any further), which bounds what a task holds.

A text is first *cleaned*: string contents, comments, numbers and characters
outside the language are taken out in one pass that only stops at the few
characters which can start them.  All rules are then pattern counts or
extractions on the cleaned text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicework import fixed_values as fv
from sluicework.plans.findings import Steps, apply_steps, bind, has_error, mark, marks_where, none, once, to_rows
from sluicework.session import prepare

WORD = "[A-Za-z_][A-Za-z0-9_]*+"
AFTER = "(?<![A-Za-z0-9_])"
END = "(?![A-Za-z0-9_])"

# Anything between two neighbouring words or signs of a cleaned text.
GAP = r"""[^\n\\'"|()\[\],;.=<>+\-*/%!~A-Za-z0-9_]*+"""

# What cleaning takes out -> what it leaves: a string leaves its quote, a run of
# numbers its first digit, the two characters backslash-n a backslash (other
# backslashes go, so that it marks a line end only); comments leave nothing.
TAKEN_OUT = r"(?=[/\\'\"@0-9[^\x00-\x7F]])(?:" + "|".join([
    r"//[^\n]*+",
    r"(\\)n",
    r"\\",
    r"(')[^'\\]*+(?:\\[\s\S][^'\\]*+)*+\\?+'?+",
    r'(")[^"\\]*+(?:\\[\s\S][^"\\]*+)*+\\?+"?+',
    r"@(')[^']*+'?+",
    r'@(")[^"]*+"?+',
    AFTER + r"([0-9])[0-9.eE]*+[A-Za-z]*+(?:[0-9][0-9.eE]*+[A-Za-z]*+)*+",
    r"[^\x00-\x7F]++",
]) + ")"

STAGE_START = r"(?:\A|[|;])" + GAP
HYPHENATED = "|".join(n.replace("-", f"{GAP}-{GAP}") + END for n in fv.HYPHENATED_OPERATORS)
KNOWN_OPERATORS = fv.TABLE_OPERATORS + list(fv.REFUSED_OPERATORS) + ["source", "print", "let"]
SKIPPED_CALLS = fv.TABLE_OPERATORS + ["source", "print"]


def trimmed(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(fv.UNICODE_SPACES))


def cleaned(text: Column) -> Column:
    return F.regexp_replace(text, TAKEN_OUT, " $1$2$3$4$5$6 ")


def word(name: str) -> str:
    """Pattern of one whole word.  It starts with the literal, which lets the
    matcher skip through the text instead of testing every position."""
    return f"{name}(?<![A-Za-z0-9_]{name}){END}"


def _extract_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def _first(items: Column, names: list[str]) -> Column:
    """The first of ``items`` that is, in lower case, among ``names``, or null."""
    return F.get(F.filter(items, lambda n: F.lower(n).isin(names)), F.lit(0))


def _ahead(items: Column, stop: Column) -> Column:
    """Items ahead of the first ``stop``; all where it is null."""
    return F.when(stop.isNull(), items).otherwise(
        F.slice(items, F.lit(1), F.array_position(items, stop).cast("int") - 1))


def _start(words: Column) -> Column:
    first = F.regexp_extract(words, rf"\A{GAP}({WORD})", 1)
    return F.when((first != "") & ~F.lower(first).isin("source", "print", "let"), mark("start", first))


def _operators(heads: Column) -> Column:
    """First refused operator, and unknown ones ahead of it."""

    def judge(names: Column, refused: Column) -> Column:
        unknown = F.filter(_ahead(names, refused), lambda n: ~n.isin(KNOWN_OPERATORS))
        return F.concat(
            F.transform(unknown, lambda n: mark("unknown_operator", n)),
            F.array(F.when(refused.isNotNull(), mark("refused_operator", refused, name=refused))),
        )

    names = F.transform(heads, lambda n: F.lower(F.regexp_replace(n, "[^A-Za-z0-9_-]", "")))
    return bind(names, lambda ops: bind(
        _first(ops, list(fv.REFUSED_OPERATORS)), lambda refused: judge(ops, refused)))


def _calls(calls: Column) -> Column:
    """Unlisted functions ahead of the first wrong name, and that name."""

    def judge(wrong: Column) -> Column:
        unlisted = F.filter(
            _ahead(calls, wrong), lambda c: ~F.lower(c).isin(SKIPPED_CALLS + fv.SCALAR_FUNCTIONS))
        return F.concat(
            F.transform(unlisted, lambda c: F.when(
                F.lower(c).isin(fv.REFUSED_FUNCTIONS), mark("refused_function", c),
            ).otherwise(mark("unknown_function", c))),
            F.array(F.when(wrong.isNotNull(), mark("wrong_name", wrong, name=F.lower(wrong)))),
        )

    return bind(_first(calls, list(fv.WRONG_FUNCTION_NAMES)), judge)


def _time_column(text: Column, clean: Column, lowered: Column) -> Column:
    projects = F.rlike(lowered, F.lit(word("project")))
    return F.array(
        F.when(~F.contains(text, F.lit("TimeGenerated")) & projects, mark("no_time_column")),
        F.when(~projects & ~F.rlike(clean, F.lit(word("TimeGenerated"))), mark("time_column_tip")),
    )


def _parse_columns(words: Column, lowered: Column) -> Column:
    """Names captured by each parse stage; after ``with``, type names do not count."""
    stages = _extract_all(words, rf"{STAGE_START}(?i:parse){END}([^|;]*)")
    with_word = rf"(?i){AFTER}with{END}"
    typed_name = rf"(?i){AFTER}(?!(?:with|{'|'.join(fv.PARSE_TYPE_NAMES)}){END}){WORD}"

    def captured(stage: Column) -> Column:
        typed = F.regexp_extract(stage, rf"{with_word}([\s\S]*)", 1)
        return F.when(F.rlike(stage, F.lit(with_word)), F.regexp_count(typed, F.lit(typed_name))) \
            .otherwise(F.regexp_count(stage, F.lit(AFTER + WORD)))

    over = F.filter(F.transform(stages, captured), lambda n: n > fv.MAX_PARSE_COLUMNS)
    found = F.transform(over, lambda n: mark("parse_columns", n.cast("string")))
    return F.when(F.contains(lowered, F.lit("parse")), found).otherwise(none())


def _mistakes(calls: Column, lowered: Column) -> Column:
    def repeated(key: str, pattern: str) -> Column:
        return F.array_repeat(mark(key), F.regexp_count(lowered, F.lit(pattern)))

    return F.concat(
        repeated("order_by", rf"{word('order')}(?={GAP}by{END})"),
        marks_where(calls, lambda c: F.lower(c).isin("has_any", "has_all"), lambda c: mark("has_any", c)),
        repeated("toscalar", word("toscalar")),
        F.array(F.when(F.rlike(lowered, F.lit(word("externaldata"))), mark("externaldata"))),
    )


def _table_name(heads: Column) -> Column:
    """First stage that starts with neither an operator nor a source."""
    passed = [n for n in fv.TABLE_OPERATORS + list(fv.REFUSED_OPERATORS) if n != "print"] + ["let"]
    names = F.transform(heads, lambda n: F.regexp_extract(n, WORD, 0))
    name = F.get(F.filter(names, lambda n: ~F.lower(n).isin(passed)), F.lit(0))
    found = bind(name, lambda n: F.when(
        n.isNotNull() & ~F.lower(n).isin("source", "print"), mark("table_name", n)))
    return F.when(F.lower(F.get(heads, F.lit(0))) != "source", found)


def words_of(clean: Column) -> Column:
    """Line ends part two neighbours of a call, but not the words of a stage."""
    return F.replace(F.replace(clean, F.lit("\n"), F.lit(" ")), F.lit("\\"), F.lit(" "))


def calls_of(clean: Column) -> Column:
    return F.when(F.contains(clean, F.lit("(")), _extract_all(clean, rf"{AFTER}({WORD}){GAP}\(")).otherwise(
        F.array().cast("array<string>"))


def heads_of(words: Column) -> Column:
    """The operator words of each stage that starts with a word."""
    return _extract_all(words, rf"{STAGE_START}((?i:{HYPHENATED})|{WORD})")


def query_marks(q) -> Column:
    """Marks of one text in check order.  ``q`` gives the columns text, clean,
    words, lowered, calls and heads."""
    found = F.concat(
        F.array(_start(q["words"])), _operators(q["heads"]), _calls(q["calls"]),
        _time_column(q["text"], q["clean"], q["lowered"]),
        _parse_columns(q["words"], q["lowered"]), _mistakes(q["calls"], q["lowered"]), F.array(_table_name(q["heads"])),
    )
    any_word = F.rlike(q["words"], F.lit(r"[|()\[\],;.=<>+\-*/%!~A-Za-z0-9_'\"]"))
    return F.when(any_word, F.array_compact(found)).otherwise(F.array(mark("empty")))


def embedded_steps(column: str) -> Steps:
    """Steps that replace an array of texts (null where there is none) by their marks."""
    def step(*names: str, **more) -> tuple[str, Column]:
        return column, F.transform(column, lambda q: F.struct(
            *[q[n].alias(n) for n in names], *[f(q).alias(n) for n, f in more.items()]))

    return [
        (column, F.transform(column, lambda t: F.struct(t.alias("text"), cleaned(t).alias("clean")))),
        step("text", "clean", words=lambda q: words_of(q["clean"])),
        step("text", "clean", "words", lowered=lambda q: F.lower(q["clean"]),
             calls=lambda q: calls_of(q["clean"]), heads=lambda q: heads_of(q["words"])),
        (column, F.transform(column, lambda q: F.when(q["text"].isNotNull(), query_marks(q)))),
    ]


def bounded_text() -> Column:
    """The trimmed body; null where it is over the size limit."""
    return F.when(F.octet_length("body") > fv.MAX_BODY_BYTES, None).otherwise(trimmed(F.col("body")))


@once
def _steps() -> Steps:
    text, clean, words = F.col("text"), F.col("clean"), F.col("words")
    parts = ("text", "clean", "words", "lowered", "calls", "heads")
    return [
        ("text", bounded_text()),
        ("clean", cleaned(text)),
        ("words", words_of(clean)),
        ("lowered", F.lower("clean")),
        ("calls", calls_of(clean)),
        ("heads", heads_of(words)),
        ("found", query_marks({n: F.col(n) for n in parts})),
        ("marks", F.when(text.isNull(), F.array(mark("too_big")))
         .when(has_error(F.col("found")), F.col("found"))
         .otherwise(F.concat("found", F.array(mark("valid"))))),
    ]


def judge_queries(docs: DataFrame) -> DataFrame:
    """``(doc_id, body)`` -> ``(doc_id, marks)``, one row per text."""
    prepare(docs.sparkSession)
    return apply_steps(docs.select("doc_id", "body"), _steps()).select("doc_id", "marks")


def audit_queries(docs: DataFrame) -> DataFrame:
    """``(doc_id, body)`` -> ``(doc_id, seq, code, severity, message, suggestion)``.

    ``seq`` numbers the findings of a document in check order.  Works on batch
    and streaming DataFrames.
    """
    return to_rows(judge_queries(docs))
