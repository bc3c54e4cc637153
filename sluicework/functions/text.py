"""Text functions.  Positions count from 0; patterns are Java regular expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluicework.functions._args import col, quote


def base64_encodestring(x) -> Column:
    """On one line: Spark breaks long base64 into lines, which the language does not."""
    return F.replace(F.base64(F.encode(col(x), "utf-8")), F.lit("\r\n"), F.lit(""))


def base64_decodestring(x) -> Column:
    """Null for text that is not base64 or does not hold UTF-8."""
    return F.try_validate_utf8(F.try_to_binary(col(x), F.lit("base64")).cast("string"))


def countof(x, search, kind: str = "normal") -> Column:
    """Occurrences that do not overlap; ``kind='regex'`` takes a pattern.  Null for an empty search text."""
    if kind == "regex":
        return F.regexp_count(col(x), col(search))
    gone = F.length(col(x)) - F.length(F.replace(col(x), col(search), F.lit("")))
    return F.try_divide(gone, F.length(col(search))).cast("int")


def extract(pattern: str, group: int, x) -> Column:
    """One group of the first match; null without a match."""
    return F.when(F.rlike(col(x), F.lit(pattern)), F.regexp_extract(col(x), pattern, group))


def extract_all(pattern: str, x, group: int = 1) -> Column:
    return F.regexp_extract_all(col(x), F.lit(pattern), F.lit(group))


def indexof(x, search) -> Column:
    return F.locate(search, col(x)) - 1 if isinstance(search, str) else F.call_function("instr", col(x), search) - 1


def isempty(x) -> Column:
    return F.coalesce(col(x), F.lit("")) == ""


def isnotempty(x) -> Column:
    return ~isempty(x)


def replace_string(x, search, replacement) -> Column:
    return F.replace(col(x), col(search), col(replacement))


def reverse(x) -> Column:
    return F.reverse(col(x))


def split(x, delimiter: str, index: int | None = None) -> Column:
    parts = F.split(col(x), quote(delimiter), -1)
    return parts if index is None else F.get(parts, F.lit(index))


def strcat(*values) -> Column:
    return F.concat(*[F.coalesce(col(v).cast("string"), F.lit("")) for v in values])


def strcat_delim(delimiter: str, *values) -> Column:
    return F.concat_ws(delimiter, *[col(v).cast("string") for v in values])


def strlen(x) -> Column:
    return F.length(col(x))


def substring(x, start, length=None) -> Column:
    start = col(start) + 1
    return F.substr(col(x), start) if length is None else F.substr(col(x), start, col(length))


def tolower(x) -> Column:
    return F.lower(col(x))


def toupper(x) -> Column:
    return F.upper(col(x))


def trim_start(pattern: str, x) -> Column:
    return F.regexp_replace(col(x), rf"\A(?:{pattern})", "")


def trim_end(pattern: str, x) -> Column:
    return F.regexp_replace(col(x), rf"(?:{pattern})\z", "")


def trim(pattern: str, x) -> Column:
    return trim_end(pattern, trim_start(pattern, x))


def hash_sha256(x) -> Column:
    return F.sha2(col(x).cast("string"), 256)
