"""Arguments of the scalar functions: a Column stays, any other value is a literal."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def quote(text: str) -> str:
    """Regular expression that matches a text literally."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)
