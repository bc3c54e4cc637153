"""Numbers.  Undefined results (log of zero, division by zero) are null."""

from datetime import timedelta as _timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluicework.functions._args import col


def abs(x) -> Column:
    """Null for the least whole number, which has no opposite."""
    x = col(x)
    return F.when(F.try_subtract(F.lit(0), x).isNotNull(), F.abs(x))


def bin(x, size) -> Column:
    """``x`` rounded down to a multiple of ``size``; a timedelta rounds a time.

    Null for size zero and where the result has no place in the type.
    """
    if isinstance(size, _timedelta):
        micros = size // _timedelta(microseconds=1)
        t = F.unix_micros(col(x).cast("timestamp"))
        return F.timestamp_micros(F.try_subtract(t, F.pmod(t, F.lit(micros))))
    x, size = col(x), col(size)
    rest = F.try_mod(x, size)  # exact for whole numbers; it has the sign of x
    rest = F.when((rest != 0) & ((rest < 0) != (size < 0)), rest + size).otherwise(rest)
    return F.try_subtract(x, rest)


def floor(x, size=1) -> Column:
    return bin(x, size)


def ceiling(x) -> Column:
    return F.ceil(col(x))


def exp(x) -> Column:
    return F.exp(col(x))


def exp2(x) -> Column:
    return F.pow(F.lit(2.0), col(x))


def exp10(x) -> Column:
    return F.pow(F.lit(10.0), col(x))


def log(x) -> Column:
    return F.ln(col(x))


def log2(x) -> Column:
    return F.log2(col(x))


def log10(x) -> Column:
    return F.log10(col(x))


def pow(x, y) -> Column:
    return F.pow(col(x), col(y))


def round(x, digits: int = 0) -> Column:
    """Half away from zero."""
    return F.round(col(x), digits)


def sign(x) -> Column:
    return F.sign(col(x))


def isnan(x) -> Column:
    return F.isnan(col(x))


def isinf(x) -> Column:
    return F.abs(col(x)) == float("inf")


def isfinite(x) -> Column:
    return ~F.isnan(col(x)) & (F.abs(col(x)) != float("inf"))
