"""Bit functions on 64-bit integers.  What is no such number gives null."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluicework.functions._args import col


def _long(value) -> Column:
    return col(value).try_cast("bigint")


def binary_and(a, b) -> Column:
    return _long(a).bitwiseAND(_long(b))


def binary_or(a, b) -> Column:
    return _long(a).bitwiseOR(_long(b))


def binary_xor(a, b) -> Column:
    return _long(a).bitwiseXOR(_long(b))


def binary_not(a) -> Column:
    return F.bitwise_not(_long(a))


def binary_shift_left(a, n) -> Column:
    return F.call_function("shiftleft", _long(a), col(n).try_cast("int"))


def binary_shift_right(a, n) -> Column:
    return F.call_function("shiftright", _long(a), col(n).try_cast("int"))
