"""Data flows on streams."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sluicework.plans.routing import Transform, steps
from sluicework.sources.sinks import Ledger, LogTables


def stream_flows(rule: dict, streams: dict[str, DataFrame], transforms: dict[int, Transform],
                 sinks: dict[str, LogTables], checkpoint: str, rule_id: str, trigger: dict | None = None,
                 ledger: Ledger | None = None) -> list[StreamingQuery]:
    """One query per input stream that serves all flows of it.

    A batch that several flows share is kept while they are written.  Each batch writes under a run
    name made of the checkpoint and the batch number, and replaces what an
    interrupted attempt at it has written.  With a ledger, readers see all destinations of a batch or none.
    """
    by_stream: dict[str, list] = {}
    for step in steps(rule, transforms, sinks):
        by_stream.setdefault(step.stream, []).append(step)

    def start(name: str, todo: list) -> StreamingQuery:
        folder = f"{checkpoint.rstrip('/')}/{name}"
        run = hashlib.sha256(folder.encode()).hexdigest()[:16]

        def write(batch: DataFrame, batch_id: int) -> None:
            if len(todo) > 1:
                batch.persist()
            name = f"{run}-{batch_id}"
            attempt = name if ledger is None else ledger.attempt(name)
            try:
                for step in todo:
                    step.write(batch, rule_id, attempt)
                if ledger is not None:
                    ledger.commit(batch.sparkSession, rule_id, name, attempt)
            finally:
                if len(todo) > 1:
                    batch.unpersist()

        return (streams[name].writeStream.foreachBatch(write).option("checkpointLocation", folder)
                .trigger(**(trigger or {"availableNow": True})).start())

    return [start(name, todo) for name, todo in by_stream.items()]
