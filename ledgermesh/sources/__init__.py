"""Sources: map landed data of each adapter kind to envelope rows (T0).

Envelope columns: ``idempotency_key, transaction_ref, source_system,
adapter_type, payload_text, payload_schema, trace_id, tags`` (+ optional
``server_received_at``). Readers take paths; mappers take DataFrames so the
same mapping serves batch and ``readStream`` inputs.
"""

from ledgermesh.sources.files import csv_lines_to_envelopes, read_ndjson, read_csv, route_files, ndjson_lines_to_envelopes
from ledgermesh.sources.webhook import explode_bodies, rejected_bodies
from ledgermesh.sources.kafka import from_kafka
from ledgermesh.sources.database import read_incremental, pick_key

__all__ = ["read_ndjson", "read_csv", "route_files", "ndjson_lines_to_envelopes", "csv_lines_to_envelopes", "explode_bodies", "rejected_bodies",
           "from_kafka", "read_incremental", "pick_key"]
