"""Decimal amount handling.

Amounts are ``DECIMAL(22,6)``: ``DECIMAL(22,6) * DECIMAL(13,10)`` is an exact
``DECIMAL(36,16)``, so tolerance arithmetic never loses scale. Text that needs
more precision is rejected (``amount_precision``) instead of being rounded.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DecimalType

AMOUNT_TYPE = DecimalType(22, 6)
AMOUNT_SQL = "decimal(22,6)"
_WIDE_SQL = "decimal(38,12)"

# Plain decimal text: optional sign, digits with an optional fraction, optional
# exponent. No padding, no thousands separators, no comma decimals.
DECIMAL_PATTERN = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z"


def strict_decimal_text(text: Column) -> Column:
    return text.rlike(DECIMAL_PATTERN)


def parse_amount(text: Column) -> Column:
    """Text -> DECIMAL(22,6); NULL when the text is not a plain decimal or
    does not fit exactly."""
    narrow = text.try_cast(AMOUNT_SQL)
    wide = text.try_cast(_WIDE_SQL)
    ok = strict_decimal_text(text) & narrow.isNotNull() & (narrow.cast(_WIDE_SQL) == wide)
    return F.when(ok, narrow)


def amount_error(text: Column) -> Column:
    """Why ``text`` is not an acceptable amount: NULL, ``invalid_amount`` or
    ``amount_precision``."""
    wide = text.try_cast(_WIDE_SQL)
    narrow = text.try_cast(AMOUNT_SQL)
    return (
        F.when(text.isNull() | (text == ""), F.lit(None).cast("string"))
        .when(~strict_decimal_text(text), F.lit("invalid_amount"))
        .when(wide.isNull() | narrow.isNull() | (narrow.cast(_WIDE_SQL) != wide),
              F.lit("amount_precision"))
    )


def amount_text(amount: Column) -> Column:
    """Canonical text of a DECIMAL(22,6) amount (``10000.500000``)."""
    return amount.cast("string")
