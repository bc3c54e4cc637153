"""Declared stream schemas and rows that do or do not conform to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicework import fixed_values as fv
from sluicework.operators.tabular import CONVERT

SPARK_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(),
    "real": T.DoubleType(), "double": T.DoubleType(), "datetime": T.TimestampType(),
    "bool": T.BooleanType(), "boolean": T.BooleanType(), "dynamic": T.VariantType(),
    "guid": T.StringType(), "timespan": T.DayTimeIntervalType(0, 3),
}


def declared_schema(columns: list[dict]) -> T.StructType:
    """Schema of a declared column list ``[{"name": .., "type": ..}]``.

    Raises ``ValueError`` with the codes of all columns that are wrong.
    """
    problems, fields = [], []
    for number, column in enumerate(columns, 1):
        if "name" not in column:
            problems.append(f"DCR051 column {number} is missing 'name'")
        kind = column.get("type")
        if not isinstance(kind, str):
            problems.append(f"DCR053 column {number} is missing 'type'")
        elif kind.lower() not in fv.COLUMN_TYPES:
            problems.append(f"DCR052 column {number} has invalid type '{kind}'")
        elif "name" in column:
            fields.append(T.StructField(column["name"], SPARK_TYPES[kind.lower()], True, {"declared": kind.lower()}))
    if problems:
        raise ValueError("; ".join(problems))
    return T.StructType(fields)


def _converted(df: DataFrame, field: T.StructField):
    if field.name not in df.columns:
        return F.lit(None).cast(field.dataType)
    source = F.col(field.name)
    declared = field.metadata.get("declared")
    if df.schema[field.name].dataType == field.dataType and declared != "guid":
        return source
    if declared == "dynamic" and df.schema[field.name].dataType != T.StringType():
        nested = isinstance(df.schema[field.name].dataType, T.ArrayType | T.MapType | T.StructType)
        return F.to_variant_object(source) if nested else source.cast("variant")
    if declared in CONVERT:
        return CONVERT[declared](source)
    return source.try_cast(field.dataType)


def conform(df: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Rows cast to the declared types, and the rows that hold a value that will not cast.

    Missing columns are null, undeclared ones are left out of the good rows.
    Both results are lazy and narrow; rejected rows are as they came.
    """
    values = {f.name: _converted(df, f) for f in schema.fields}
    bad = F.lit(False)
    for name, value in values.items():
        if name in df.columns:
            bad = bad | (F.col(name).isNotNull() & value.isNull())
    good = df.filter(~bad).select(*[value.alias(name) for name, value in values.items()])
    return good, df.filter(bad)


def conform_tagged(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Every row once: the declared columns, ``_causes`` and ``_record``.

    ``_causes`` lists, as (column, cause, value), the values that will not cast; it is empty for rows that conform.
    ``_record`` is the row as it came, for rows that don't; their declared columns are null.
    """
    values = {f.name: (_converted(df, f), f.metadata.get("declared", f.dataType.simpleString())) for f in schema.fields}
    causes = F.array_compact(F.array(*[
        F.when(F.col(name).isNotNull() & value.isNull(), F.struct(
            F.lit(name).alias("column"), F.lit(f"not a {kind}").alias("cause"), F.col(name).cast("string").alias("value")))
        for name, (value, kind) in values.items() if name in df.columns] or [F.lit(None).cast("struct<column:string,cause:string,value:string>")]))
    good = F.size("_causes") == 0
    tagged = df.withColumn("_causes", causes).withColumn("_record", F.when(~good, F.struct(*[F.col(c) for c in df.columns])))
    return tagged.select(*[F.when(good, value).alias(name) for name, (value, _) in values.items()], "_causes", "_record")


def conform_once(df: DataFrame, schema: T.StructType, folder: str) -> tuple[DataFrame, DataFrame]:
    """What ``conform`` gives, with causes, from one pass over the source.

    Both kinds of rows are written by one job to ``folder``, by status, and read back: the good rows, and the
    rejected ones as they came with ``_causes``.
    """
    tagged = conform_tagged(df, schema)
    status = F.when(F.size("_causes") == 0, "good").otherwise("rejected")
    tagged.withColumn("_status", status).write.partitionBy("_status").mode("overwrite").parquet(folder)
    rows = df.sparkSession.read.schema(T.StructType([*tagged.schema.fields, T.StructField("_status", T.StringType())])).parquet(folder)
    good = rows.filter(F.col("_status") == "good").select(*schema.names)
    return good, rows.filter(F.col("_status") == "rejected").select("_record.*", "_causes")
