"""Functions made for log records."""

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from sluicework.functions._args import col
from sluicework.session import prepare

PAIR = r"(\w+)=(.*?)(?=\s+\w+=|$)"


def parse_cef_dictionary(x) -> Column:
    """``key=value key=value`` text to a map; of a repeated key the last value.

    Relies on the last-wins setting of ``prepare``; by default Spark fails a job
    that meets a repeated key.
    """
    def part(group: int) -> Column:
        return F.regexp_extract_all(col(x), F.lit(PAIR), F.lit(group))

    prepare(SparkSession.active())
    return F.map_from_arrays(part(1), part(2))
