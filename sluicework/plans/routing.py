"""Data flows: every stream of a flow, transformed, to every destination of it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicework.plans.audit_rule import parsed_rules
from sluicework.sources.sinks import Ledger, LogTables

Transform = Callable[[DataFrame], DataFrame]


def flow_pairs(rules: DataFrame) -> DataFrame:
    """Plan rows of a fleet: ``(doc_id, flow, stream, destination, transform, output_stream)``.

    One row for each stream and destination that a flow pairs, as the documents
    list them; made inside the document's row, without a shuffle.  (The outer
    explode keeps the optimizer from testing ``size(flows) > 0`` beforehand, which
    would parse every document a second time.)
    """
    return (
        parsed_rules(rules, bounded=False).select("doc_id", F.explode_outer("flows").alias("f")).filter("not f.bad")
        .select("doc_id", F.col("f.number").cast("int").alias("flow"), F.explode("f.streams").alias("stream"), "f")
        .select("doc_id", "flow", "stream", F.explode("f.destinations").alias("destination"),
                F.col("f.transform").alias("transform"), F.col("f.output_stream").alias("output_stream"))
    )


@dataclass(frozen=True)
class Step:
    """One flow for one of its streams."""

    flow: int
    stream: str
    number: int
    output_stream: str
    transform: Transform
    sinks: tuple[LogTables, ...]

    def write(self, df: DataFrame, rule: str, run: str) -> None:
        """Write to the first destination; the others get a copy of what it now holds,
        so the transform runs once and all destinations hold the same rows.  A folder
        that several destinations name is written once."""
        places = {sink.part(self.output_stream, rule, run, self.flow, self.number): sink for sink in self.sinks}
        (source, first), *others = places.items()
        first.write(self.transform(df), source)
        for place, other in others:
            other.write(first.read_part(df.sparkSession, source), place)


def steps(rule: dict, transforms: dict[int, Transform], sinks: dict[str, LogTables]) -> Iterator[Step]:
    """Flows of one rule document (as a dict), numbered from 1.

    A flow whose ``transformKql`` is more than ``source`` needs a function in
    ``transforms``: texts are audited, not run.
    """
    for number, flow in enumerate(rule["properties"]["dataFlows"], 1):
        text = flow.get("transformKql", "").strip()
        if text not in ("", "source") and number not in transforms:
            raise ValueError(f"flow {number} has a transform, but no function is given for it")
        unknown = [d for d in flow["destinations"] if d not in sinks]
        if unknown or not flow["destinations"]:
            raise ValueError(f"flow {number}: no such destination: {', '.join(unknown) or 'none is listed'}")
        for at, stream in enumerate(flow["streams"], 1):
            yield Step(number, stream, at, flow.get("outputStream", stream), transforms.get(number, lambda df: df),
                       tuple(sinks[d] for d in flow["destinations"]))


def run_flows(rule: dict, streams: dict[str, DataFrame], transforms: dict[int, Transform],
              sinks: dict[str, LogTables], run: str, rule_id: str, ledger: Ledger | None = None) -> None:
    """Run all flows on batch DataFrames.  Running a rule again under the same ``run`` name
    replaces what its earlier run wrote; rules with other ids keep their rows.

    With a ledger, readers that name it see all destinations of the new run or those of the
    earlier one; a run that stops on the way is never seen.
    """
    name = run if ledger is None else ledger.attempt(run)
    for step in list(steps(rule, transforms, sinks)):
        step.write(streams[step.stream], rule_id, name)
    if ledger is not None:
        ledger.commit(next(iter(streams.values())).sparkSession, rule_id, run, name)
