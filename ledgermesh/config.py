"""Options of the operators (plain dataclasses, no loader).

Defaults follow the reference's shipped configuration.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

# Fixed values that must equal the reference's for the same results.
STRATEGIES = ("exact", "tolerance", "majority")
DEFAULT_STRATEGY = "tolerance"
DEFAULT_ABS_TOLERANCE = "0.00"
DEFAULT_PCT_TOLERANCE = 0.0
DEFAULT_MAX_RETRIES = 3
DEFAULT_PENDING_TIMEOUT_SECS = 300
DEFAULT_RETRY_BACKOFF_SECS = 30
DEFAULT_BATCH_SIZE = 100


def parse_strategy(name: str) -> str:
    """Strategy names are case-insensitive; unknown names are an error."""
    s = (name or "").lower()
    if s not in STRATEGIES:
        raise ValueError(f"invalid match strategy: {s}")
    return s


def format_f64(x: float) -> str:
    """Render a float the way the reference prints it (``1.0`` -> ``1``)."""
    r = repr(float(x))
    return r[:-2] if r.endswith(".0") else r


@dataclass(frozen=True)
class MatchRules:
    """Options of ``reconcile``.

    ``pct_tolerance`` is a percentage: ``1.0`` means 1 %. It is divided by 100
    and rounded to 10 decimal places before use.
    """

    strategy: str = DEFAULT_STRATEGY
    abs_tolerance: str = DEFAULT_ABS_TOLERANCE
    pct_tolerance: float = DEFAULT_PCT_TOLERANCE
    expected_sources: tuple[str, ...] = ()
    max_retries: int = DEFAULT_MAX_RETRIES
    pending_timeout_secs: int | None = DEFAULT_PENDING_TIMEOUT_SECS  # None: never escalate
    majority_ties: str = "all_win"  # or "none_win"

    def __post_init__(self):
        object.__setattr__(self, "strategy", parse_strategy(self.strategy))
        Decimal(self.abs_tolerance)  # raises on bad text
        if self.pct_tolerance < 0:
            raise ValueError("percentage tolerance must be non-negative")
        object.__setattr__(self, "expected_sources", tuple(self.expected_sources))
        if self.majority_ties not in ("all_win", "none_win"):
            raise ValueError("majority_ties must be 'all_win' or 'none_win'")

    @property
    def pct_factor(self) -> Decimal:
        return Decimal(f"{self.pct_tolerance / 100.0:.10f}")

    @property
    def abs_text(self) -> str:
        return str(Decimal(self.abs_tolerance))


@dataclass(frozen=True)
class RetryPolicy:
    """Retry queue options (resolution side)."""

    base_backoff_secs: int = 60
    max_backoff_secs: int = 3600
    batch_size: int = 50
    default_max_attempts: int = 5


@dataclass(frozen=True)
class AutoResolveConfig:
    default_strategy: str = "latest_record"
    source_priority: str = ""
    auto_apply_on_exhaustion: bool = False
    resolver_id: str = "system:api"


@dataclass(frozen=True)
class IngestConfig:
    """Ingest pipeline options."""

    max_payload_bytes: int = 32 * 1024 * 1024
    clock_skew_secs: int = 300
    idempotency_ttl_secs: int = 24 * 3600
    default_rps: float = 1000.0
    rps_overrides: dict = field(default_factory=dict)
    parity: bool = False
