"""Time functions on timestamps (session zone UTC).  Weeks start on Sunday."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluicework.functions._args import col

MICROS = {"microsecond": 1, "millisecond": 1000, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6}

ADDED = {
    **{unit: ("micros", n) for unit, n in MICROS.items()}, "day": ("day", 1), "week": ("day", 7),
    "month": ("month", 1), "quarter": ("month", 3), "year": ("month", 12),
}


def _days(n: int) -> Column:
    return F.expr(f"interval {n} day")


def _trunc(unit: str, t) -> Column:
    return F.date_trunc(unit, col(t)).cast("timestamp")


def _last_micro(next_start: Column) -> Column:
    return next_start - F.expr("interval 1 microsecond")


def now(as_of=None) -> Column:
    """The current time, or ``as_of`` for repeatable results."""
    return F.current_timestamp() if as_of is None else col(as_of)


def ago(span, as_of=None) -> Column:
    return now(as_of) - col(span)


def datetime_add(unit: str, n, t) -> Column:
    """Null when ``n`` is no whole number or the result is out of range."""
    part, each = ADDED[unit.lower()]
    n = col(n).try_cast("bigint")
    if part == "micros":
        span = F.try_multiply(F.expr("interval '0 00:00:00.000001' day to second"), F.try_multiply(n, F.lit(each)))
    else:
        span = F.try_multiply(F.expr(f"interval '1' {part}"), F.try_multiply(n, F.lit(each)))
    return F.try_add(col(t), span)


def datetime_diff(unit: str, a, b) -> Column:
    """Number of unit boundaries from ``b`` to ``a``."""
    a, b = col(a), col(b)
    if unit in MICROS:
        def whole(t: Column) -> Column:
            return F.floor(F.unix_micros(t.cast("timestamp")) / F.lit(MICROS[unit]).cast("decimal(20,0)"))
        return (whole(a) - whole(b)).cast("bigint")
    if unit == "day":
        return F.date_diff(a, b).cast("bigint")
    if unit == "week":
        return (F.date_diff(startofweek(a), startofweek(b)) / 7).cast("bigint")
    months = (F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)
    if unit == "month":
        return months.cast("bigint")
    if unit == "quarter":
        return ((F.year(a) - F.year(b)) * 4 + F.quarter(a) - F.quarter(b)).cast("bigint")
    if unit == "year":
        return (F.year(a) - F.year(b)).cast("bigint")
    raise ValueError(f"unknown unit {unit!r}")


PARTS = {
    "year": "YEAR", "quarter": "QUARTER", "month": "MONTH", "week_of_year": "WEEK", "day": "DAY",
    "dayofyear": "DOY", "hour": "HOUR", "minute": "MINUTE",
}


def datetime_part(part: str, t) -> Column:
    if part in PARTS:
        return F.date_part(F.lit(PARTS[part]), col(t)).cast("bigint")
    if part in MICROS:
        within = F.pmod(F.unix_micros(col(t).cast("timestamp")), F.lit(MICROS["minute"] if part == "second" else MICROS["second"]))
        return F.floor(within / MICROS[part]).cast("bigint")
    raise ValueError(f"unknown part {part!r}")


def dayofmonth(t) -> Column:
    return F.dayofmonth(col(t))


def dayofyear(t) -> Column:
    return F.dayofyear(col(t))


def dayofweek(t) -> Column:
    """Time span since the last Sunday, in whole days."""
    return F.make_dt_interval(F.dayofweek(col(t)) - 1)


def getmonth(t) -> Column:
    return F.month(col(t))


def getyear(t) -> Column:
    return F.year(col(t))


def hourofday(t) -> Column:
    return F.hour(col(t))


def weekofyear(t) -> Column:
    return F.weekofyear(col(t))


def startofday(t) -> Column:
    return _trunc("DAY", t)


def startofweek(t) -> Column:
    return (F.date_trunc("WEEK", col(t) + _days(1)) - _days(1)).cast("timestamp")


def startofmonth(t) -> Column:
    return _trunc("MONTH", t)


def startofyear(t) -> Column:
    return _trunc("YEAR", t)


def endofday(t) -> Column:
    return _last_micro(startofday(t) + _days(1))


def endofweek(t) -> Column:
    return _last_micro(startofweek(t) + _days(7))


def endofmonth(t) -> Column:
    return _last_micro(F.timestamp_add("MONTH", F.lit(1), startofmonth(t)))


def endofyear(t) -> Column:
    return _last_micro(F.timestamp_add("YEAR", F.lit(1), startofyear(t)))


def make_datetime(year, month, day, hour=0, minute=0, second=0) -> Column:
    """Null when the parts are no date."""
    return F.try_make_timestamp(
        years=col(year).try_cast("int"), months=col(month).try_cast("int"), days=col(day).try_cast("int"),
        hours=col(hour).try_cast("int"), mins=col(minute).try_cast("int"), secs=col(second).try_cast("decimal(16,6)"))


def make_timespan(*parts) -> Column:
    """From hour, minute; hour, minute, second; or day, hour, minute, second. Null for other texts and out of range."""
    parts = (parts if len(parts) > 3 else (0, *parts)) + (() if len(parts) > 2 else (0,))
    days, hours, minutes, seconds = parts
    total = col(seconds).try_cast("decimal(18,6)")
    for value, each in ((days, 86_400), (hours, 3600), (minutes, 60)):
        total = total + (col(value).try_cast("int").cast("decimal(10,0)") * F.lit(each)).cast("decimal(18,6)")
    return F.try_multiply(F.expr("interval '0 00:00:01' day to second"), total)
