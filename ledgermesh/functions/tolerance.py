"""Amount tolerance as a decimal Column expression (MT-7)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

from ledgermesh.config import MatchRules


def tolerance_of(a: Column, b: Column, abs_tol: str, pct_factor: Decimal) -> Column:
    """Effective tolerance ``max(abs, max(|a|,|b|) * pct/100)``."""
    abs_lit = F.lit(Decimal(abs_tol)).cast("decimal(22,6)")
    pct_lit = F.lit(pct_factor).cast("decimal(13,10)")
    return F.greatest(abs_lit, F.greatest(F.abs(a), F.abs(b)) * pct_lit)


def within(a: Column, b: Column, rules: MatchRules) -> Column:
    """``|a-b| <= max(abs, max(|a|,|b|) * pct/100)``; a zero reference makes
    the percentage part zero by itself. The two parts are compared one after the
    other: the product is made only where the absolute tolerance does not do."""
    abs_lit = F.lit(Decimal(rules.abs_tolerance)).cast("decimal(22,6)")
    pct_lit = F.lit(rules.pct_factor).cast("decimal(13,10)")
    diff = F.abs(a - b)
    return (diff <= abs_lit) | (diff <= F.greatest(F.abs(a), F.abs(b)) * pct_lit)
