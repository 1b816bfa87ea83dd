"""Structured Streaming jobs (STR-1..5, RL-1, monitoring windows)."""

from ledgermesh.streaming.ingest import IngestTables, stream_ingest
from ledgermesh.streaming.jobs import EngineTables, incremental_match, trigger_options
from ledgermesh.streaming.ratelimit import rate_limit_stream
from ledgermesh.streaming.stateful import stream_match

__all__ = ["stream_ingest", "IngestTables", "incremental_match", "EngineTables", "trigger_options", "stream_match",
           "rate_limit_stream"]
