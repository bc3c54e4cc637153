"""Questions about types and missing values."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluicework.functions._args import col

COLUMN_NAMES = {
    "string": "string", "int": "int", "bigint": "long", "double": "real", "boolean": "bool",
    "timestamp": "datetime", "timestamp_ntz": "datetime", "variant": "dynamic",
}
DYNAMIC_NAMES = {
    "STRING": "string", "BIGINT": "long", "DOUBLE": "real", "BOOLEAN": "bool", "VOID": "null",
    "TIMESTAMP": "datetime", "TIMESTAMP_NTZ": "datetime", "DATE": "datetime",
}


def gettype(x, dynamic: bool = False) -> Column:
    """Type name of a column, or with ``dynamic`` of the value in a variant."""
    if dynamic:
        found = F.schema_of_variant(col(x))
        out = F.when(F.startswith(found, F.lit("OBJECT<")), "dictionary")
        out = out.when(F.startswith(found, F.lit("ARRAY<")), "array").when(F.startswith(found, F.lit("DECIMAL")), "real")
        names = DYNAMIC_NAMES
    else:
        found = F.typeof(col(x))
        out = F.when(F.startswith(found, F.lit("array<")), "array").when(F.startswith(found, F.lit("interval ")), "timespan")
        names = COLUMN_NAMES
    for spark_name, name in names.items():
        out = out.when(found == spark_name, name)
    return out.otherwise(F.lower(found))


def isnull(x) -> Column:
    return F.isnull(col(x))


def isnotnull(x) -> Column:
    return F.isnotnull(col(x))
