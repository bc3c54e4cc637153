"""Record-local table operators: no shuffle, same on batch and streaming DataFrames."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework import fixed_values as fv
from sluicework.functions._args import col, quote
from sluicework.functions.convert import tobool, todatetime, todouble, toguid, toint, tolong, tostring, totimespan
from sluicework.functions.dynamic import parse_json
from sluicework.session import shared_folder

CONVERT = {
    "string": tostring, "int": toint, "long": tolong, "real": todouble, "double": todouble,
    "datetime": todatetime, "bool": tobool, "boolean": tobool, "dynamic": parse_json,
    "guid": toguid, "timespan": totimespan,
}

ANY = "*"

#: A column of this name goes with a record through ``project``, as what a fleet's flows tag records with.
TAG = "_tag"


def where(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(condition)


def extend(df: DataFrame, **exprs) -> DataFrame:
    """Add or replace columns from left to right; later ones see earlier ones."""
    for name, value in exprs.items():
        df = df.withColumn(name, col(value))
    return df


def project(df: DataFrame, *names: str, **exprs) -> DataFrame:
    """Exactly these columns: named ones as they are, then computed ones.  A record's tag stays with it."""
    return df.select(*[c for c in df.columns if c == TAG], *names, *[col(value).alias(name) for name, value in exprs.items()])


def project_away(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def project_rename(df: DataFrame, **new_to_old: str) -> DataFrame:
    missing = [old for old in new_to_old.values() if old not in df.columns]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}")
    return df.withColumnsRenamed({old: new for new, old in new_to_old.items()})


def columnifexists(df: DataFrame, name: str, default) -> Column:
    return F.col(name) if name in df.columns else col(default)


def parse(df: DataFrame, column: str, *pattern, kind: str = "simple") -> DataFrame:
    """New columns from a text column.

    ``pattern`` alternates literal texts, ``ANY`` and captures ``(name, type)``;
    the whole text has to match it.  ``kind='regex'`` takes the texts as Java regular
    expressions, and a row matches wherever the whole pattern does; how long a row without a
    match takes is up to the expressions.  A literal text counts where it is found first after the one before it,
    which loses no match and needs no going back, so that a row costs linear time; only the last text of a
    pattern that ends with one has to be at the end.  Without a match, and where a capture does not convert
    to its type, the new columns are null.
    """
    captures = [p for p in pattern if isinstance(p, tuple)]
    if len(captures) > fv.MAX_PARSE_COLUMNS:
        warnings.warn(f"parse with {len(captures)} columns (limit is {fv.MAX_PARSE_COLUMNS} per statement)", stacklevel=2)
    gap, text, pieces, group, groups = "", "", [], 0, {}
    for at, part in enumerate(pattern):
        if isinstance(part, tuple):
            group += 1
            groups[part[0]] = (group, part[1])
            gap += "(.*?)"
        elif part == ANY:
            gap += ".*?"
        else:
            if kind == "regex":
                group += _group_count(df, part)
                text = f"(?:{part})"
            else:
                text += quote(part)
                if any(isinstance(after, str) and after != ANY for after in pattern[at + 1:at + 2]):
                    continue  # texts without a gap between them are one
            if kind == "regex" or at == len(pattern) - 1:
                # a literal text has one match to the end, found by going through the ends of the gap once
                pieces.append(f"{gap}{text}")
            else:
                pieces.append(f"(?>{gap}{text})")
            gap = text = ""
    # Of several gaps in a row the last takes all.
    regex = rf"(?s)\A{''.join(pieces)}{gap}\z"
    hit = F.rlike(F.col(column), F.lit(regex))
    return df.withColumns({
        name: F.when(hit, CONVERT[as_type](F.regexp_extract(column, regex, number)))
        for name, (number, as_type) in groups.items()
    })


def _group_count(df: DataFrame, regex: str) -> int:
    """Groups of a Java regular expression."""
    return df.sparkSession._jvm.java.util.regex.Pattern.compile(regex).matcher("").groupCount()


def let(name: str, df: DataFrame) -> DataFrame:
    """Bind a table to a name, also for SQL in the same session."""
    df.createOrReplaceTempView(name)
    return df


def let_function(spark: SparkSession, name: str, parameters: dict[str, str], returns: str | dict[str, str], body: str) -> None:
    """Bind a function to a name, for SQL in the same session.

    ``parameters`` are names and types.  ``returns`` is a type, and ``body`` an SQL expression of the parameters, or
    ``returns`` are columns and their types, and ``body`` a query that gives them: a table function.  Spark puts the body into the
    plan of the query that calls it, so that no rows leave the JVM and filters reach the tables.
    """
    wrong = [n for n in (name, *parameters, *(returns if isinstance(returns, dict) else ())) if not re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", n)]
    if wrong:
        raise ValueError(f"no name for a function, parameter or column: {', '.join(map(repr, wrong))}")

    def listed(names: dict[str, str]) -> str:  # types are checked, so that they can't be anything else
        return ", ".join(f"`{n}` {spark.createDataFrame([], f'x {t}').schema['x'].dataType.simpleString()}" for n, t in names.items())

    kind = f"TABLE ({listed(returns)})" if isinstance(returns, dict) else listed({"x": returns}).removeprefix("`x` ")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({listed(parameters)}) RETURNS {kind} RETURN {body}")


def materialize(df: DataFrame) -> DataFrame:
    """Evaluate a bound table once.  The rows are written to the shared folder, so
    a lost executor does not evaluate it again; a stream is returned as it is."""
    if df.isStreaming:
        return df
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def time_column(df: DataFrame, name: str = "TimeGenerated") -> tuple[DataFrame, DataFrame]:
    """Split into rows with and rows without a time; the column must be a timestamp."""
    types = dict(df.dtypes)
    if types.get(name) not in ("timestamp", "timestamp_ntz"):
        raise ValueError(f"the output needs a timestamp column {name!r}, found {types.get(name)!r}")
    return df.filter(F.col(name).isNotNull()), df.filter(F.col(name).isNull())
