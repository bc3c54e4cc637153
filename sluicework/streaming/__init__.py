"""Structured Streaming forms of routing and audits."""

from sluicework.streaming.audits import audit_stream  # noqa: F401
from sluicework.streaming.flows import stream_flows  # noqa: F401
from sluicework.streaming.totals import total_stream, totals  # noqa: F401
