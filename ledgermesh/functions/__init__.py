"""Column functions (pure ``Column -> Column`` expressions, no UDFs)."""

from ledgermesh.functions.amounts import (
    AMOUNT_TYPE, amount_text, parse_amount, amount_error, strict_decimal_text,
)
from ledgermesh.functions.tolerance import within, tolerance_of
from ledgermesh.functions.times import (
    as_ts, parse_event_time, age_seconds, unix_millis_ntz, backoff_seconds, add_seconds,
)

__all__ = [
    "AMOUNT_TYPE", "amount_text", "parse_amount", "amount_error", "strict_decimal_text",
    "within", "tolerance_of", "as_ts", "parse_event_time", "age_seconds",
    "unix_millis_ntz", "backoff_seconds", "add_seconds",
]
