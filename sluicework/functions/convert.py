"""Conversions.  What cannot be converted gives null, never a failed job."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluicework.functions._args import col

GUID = r"(?i)\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"


def tobool(x) -> Column:
    return col(x).try_cast("boolean")


def toint(x) -> Column:
    return col(x).try_cast("int")


def tolong(x) -> Column:
    return col(x).try_cast("bigint")


def todouble(x) -> Column:
    return col(x).try_cast("double")


toreal = todouble


def todatetime(x) -> Column:
    return col(x).try_cast("timestamp")


def toguid(x) -> Column:
    """Lower-case text of a GUID, null for any other text."""
    return F.when(F.rlike(col(x), F.lit(GUID)), F.lower(col(x)))


def tostring(x) -> Column:
    return col(x).cast("string")


def totimespan(x) -> Column:
    """``d.hh:mm:ss`` or ``hh:mm:ss`` text to an interval."""
    text = F.regexp_replace(col(x).cast("string"), r"^(-?)([0-9]+)[.]([0-9]+:)", "$1$2 $3")
    full = F.when(F.contains(text, F.lit(" ")), text).otherwise(
        F.regexp_replace(text, r"^(?<sign>-?)([0-9]+:)", "${sign}0 $2"))
    return full.try_cast("interval day to second")
