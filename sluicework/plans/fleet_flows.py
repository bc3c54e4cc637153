"""The flows of a whole fleet of rules, run as data.

The flow table that ``flow_pairs`` gives is joined to the records on the stream, and all destinations of all rules
are written by one job, however many rules there are.  The records are transformed once per different
transform, before the join, and then go to every flow that has it.

Flows that send one stream through one transform to one table of a destination give the same rows.  They are a share:
its rows are written once, beside a list of the flows that have it, and readers get them for each of these flows.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework.operators.tabular import TAG
from sluicework.plans.routing import Transform
from sluicework.sources.sinks import Ledger, list_columns, table_columns

KEYS = ["destination", "table"]
FLOW = ["rule", "flow", "stream"]
#: What the flows of a share have in common, and the column that holds it in the files.
SHARED, SHARE = [*KEYS, "stream", "transform"], "_share"
#: The rule under which the ledger lists what a fleet has written.
FLEET = "fleet"


def _table(stream: Column) -> Column:
    return F.regexp_replace(stream, r"\A(?:Microsoft-Table-|Custom-|Microsoft-)", "")


def flow_table(pairs: DataFrame) -> DataFrame:
    """Rows of ``flow_pairs`` as (destination, table, rule, flow, stream, transform); what a flow lists twice counts once."""
    plain = F.trim(F.coalesce("transform", F.lit("")))
    return pairs.select(
        "destination", _table(F.coalesce("output_stream", "stream")).alias("table"), F.col("doc_id").alias("rule"), "flow", "stream",
        F.when(plain == "", "source").otherwise(plain).alias("transform")).distinct()


def routed(records: DataFrame, flows: DataFrame, transforms: dict[str, Transform], stream: str = "stream") -> DataFrame:
    """Every record for every flow that takes it: KEYS, FLOW, and the columns that the transforms leave.

    ``records`` name their stream in the column ``stream``.  ``transforms`` has a function for each
    transform text but ``source``; columns that one leaves out are null.
    """
    return _routed(records, flows, transforms, stream, [*KEYS, *FLOW])


def _routed(records: DataFrame, flows: DataFrame, transforms: dict[str, Transform], stream: str, given: list[str]) -> DataFrame:
    """The same with the ``given`` columns of ``flows``."""
    parts, types = [], {}
    for text, transform in {"source": lambda df: df, **transforms}.items():
        out = transform(records.withColumn(TAG, F.col(stream)).drop(stream))
        if TAG not in out.columns:
            raise ValueError(f"the transform {text!r} loses the records' tags; use operators.project")
        taken = {*KEYS, *FLOW, SHARE}.intersection(out.columns)
        if taken:
            raise ValueError(f"the transform {text!r} gives columns that flows have: {', '.join(sorted(taken))}")
        for name, kind in out.dtypes:
            if types.setdefault(name, kind) != kind:
                raise ValueError(f"the transform {text!r} gives {name!r} as {kind}, another one as {types[name]}")
        own = flows.filter(F.col("transform") == text).select(*given, F.col("stream").alias(f"{TAG}_of"))
        parts.append(out.join(own, F.col(TAG) == F.col(f"{TAG}_of")).drop(TAG, f"{TAG}_of"))
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def run_fleet(records: DataFrame, pairs: DataFrame, transforms: dict[str, Transform], folder: str, ledger: Ledger, run: str,
              stream: str = "stream") -> None:
    """Write the records of all flows under ``folder``, by destination and table, in one job.

    Readers see all of a run or nothing.  Running again under the same name replaces what the
    earlier run wrote.  A hot stream or rule is spread over tasks as Spark rebalances the write.
    """
    spark = records.sparkSession
    attempt = ledger.attempt(run)
    share = F.struct(*SHARED).alias(SHARE)
    listed = flow_table(pairs).select(share, *FLOW)
    listed.write.mode("overwrite").parquet(f"{folder}/flows/_run={attempt}")
    flows = spark.read.schema(listed.schema).parquet(f"{folder}/flows/_run={attempt}").select(f"{SHARE}.*", "rule", "flow")
    unknown = flows.filter(~F.col("transform").isin("source", *transforms)).select("rule", "flow", "transform").limit(3).collect()
    if unknown:
        raise ValueError("no function for the transforms of " + "; ".join(f"rule {r.rule} flow {r.flow}: {r.transform!r}" for r in unknown))
    list_columns(routed(records, flows, transforms, stream).drop(*KEYS), f"{folder}/rows", "parquet")
    shares = flows.select(*SHARED).distinct().withColumn(SHARE, share)
    rows = _routed(records, shares, transforms, stream, [*KEYS, SHARE])
    rows.hint("rebalance", *KEYS).write.partitionBy(*KEYS).mode("overwrite").parquet(f"{folder}/rows/_run={attempt}")
    ledger.commit(spark, FLEET, run, attempt)


def fleet_rows(spark: SparkSession, folder: str, ledger: Ledger, totals: list[Column] | None = None) -> DataFrame:
    """The rows of all complete runs: run, KEYS, FLOW and the records' columns.

    With ``totals``, named aggregates of the records' columns, a row per run, KEYS and FLOW that has rows, with the
    totals in place of the records' columns.  They are worked out once per share, so that no row stands for a
    record of a flow.
    """
    fields = table_columns(spark, f"{folder}/rows", "parquet")
    kinds = {f.name: f.dataType.simpleString() for f in fields}
    share = f"`{SHARE}` struct<{', '.join(f'`{k}`: string' for k in SHARED)}>"
    own = [f for f in kinds if f not in FLOW]
    schema = ", ".join([*[f"`{f}` {kinds[f]}" for f in own], share, "_run string", *[f"`{k}` string" for k in KEYS]])
    done = ledger.committed(spark).filter(F.col("rule") == FLEET).select("run", F.col("attempt").alias("_run"))
    rows = spark.read.schema(schema).parquet(f"{folder}/rows").join(done, "_run")
    columns = [f.name for f in fields]
    if totals is not None:
        rows = rows.groupBy("run", "_run", *KEYS, SHARE).agg(*totals)
        columns = [*FLOW, *[c for c in rows.columns if c not in ("run", "_run", *KEYS, SHARE)]]
    schema = ", ".join([share, *[f"`{f}` {kinds[f]}" for f in FLOW if f in kinds], "_run string"])
    flows = spark.read.schema(schema).parquet(f"{folder}/flows")
    return rows.join(flows, ["_run", SHARE]).select("run", *KEYS, *columns)
