"""Audits of documents as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def audit_stream(docs: DataFrame, audit: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str,
                 trigger: dict | None = None) -> StreamingQuery:
    """Append the findings of arriving ``(doc_id, body)`` rows to Parquet files.

    The audits look at one row at a time, so they run on the stream itself: no
    state, and the file sink writes each batch exactly once.
    """
    return (audit(docs).writeStream.format("parquet").option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start(folder))
