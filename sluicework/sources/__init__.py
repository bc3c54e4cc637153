"""Sources, schemas and sinks of collection rules."""

from sluicework.sources.logs import json_log, text_log  # noqa: F401
from sluicework.sources.rules import declared_streams, log_streams  # noqa: F401
from sluicework.sources.schema import conform, conform_once, conform_tagged, declared_schema  # noqa: F401
from sluicework.sources.sinks import Ledger, LogTables, MetricsTable, log_table_sink, metrics_sink  # noqa: F401
from sluicework.sources.streams import (  # noqa: F401
    datatable, declared_stream, print_, select_levels, table_stream,
)
from sluicework.sources.tail import TextLogTail, text_log_tail  # noqa: F401
