"""Choices between values."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluicework.functions._args import col


def case(*args) -> Column:
    """``case(cond1, value1, cond2, value2, ..., default)``."""
    *pairs, default = args
    out = F.when(col(pairs[0]), col(pairs[1]))
    for condition, value in zip(pairs[2::2], pairs[3::2], strict=True):
        out = out.when(col(condition), col(value))
    return out.otherwise(col(default))


def iff(condition, then, otherwise) -> Column:
    return F.when(col(condition), col(then)).otherwise(col(otherwise))


iif = iff


def max_of(*values) -> Column:
    return F.greatest(*[col(v) for v in values])


def min_of(*values) -> Column:
    return F.least(*[col(v) for v in values])
