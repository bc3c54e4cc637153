"""Comparisons and arithmetic of the language that need more than a Column operator."""

import re
from datetime import timedelta
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluicework.functions._args import col, quote


def eq_ignore_case(a, b) -> Column:
    """``a =~ b``"""
    return F.lower(col(a)) == F.lower(col(b))


def ne_ignore_case(a, b) -> Column:
    """``a !~ b``"""
    return ~eq_ignore_case(a, b)


def in_(x, *values) -> Column:
    return col(x).isin(*values)


def not_in(x, *values) -> Column:
    return ~in_(x, *values)


def contains(x, part) -> Column:
    """Substring, in any case."""
    return F.contains(F.lower(col(x)), F.lower(col(part)))


def not_contains(x, part) -> Column:
    return ~contains(x, part)


def has(x, term: str) -> Column:
    """Whole term in any case, bounded by anything but ASCII letters and digits."""
    return F.rlike(col(x), F.lit(rf"(?i)(?<![A-Za-z0-9]){quote(term)}(?![A-Za-z0-9])"))


def add(a, b) -> Column:
    return F.try_add(col(a), col(b))


def subtract(a, b) -> Column:
    return F.try_subtract(col(a), col(b))


def multiply(a, b) -> Column:
    return F.try_multiply(col(a), col(b))


def divide(a, b) -> Column:
    """Null when dividing by zero; two integers give a double."""
    return F.try_divide(col(a), col(b))


def modulo(a, b) -> Column:
    return F.try_mod(col(a), col(b))


def timespan(text: str) -> Column:
    """Literal such as ``1h``, ``1.5h``, ``30m``, ``2d``, ``10s``, ``5ms``, ``20us``, ``7tick`` (of 100 nanoseconds)."""
    number, unit = re.fullmatch(r"([0-9]+(?:\.[0-9]+)?)([a-z]+)", text.strip().lower()).groups()
    units = {"d": 864 * 10**8, "h": 36 * 10**8, "m": 6 * 10**7, "s": 10**6, "ms": 1000, "us": 1, "microsecond": 1,
             "tick": Decimal("0.1"), "ticks": Decimal("0.1")}
    if unit not in units:
        raise ValueError(f"unknown unit {unit!r} of a time span; known: {', '.join(units)}")
    micros = int(Decimal(number) * units[unit])
    return F.lit(timedelta(microseconds=micros))
