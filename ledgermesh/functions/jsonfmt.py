"""Compact JSON text built from Columns, with a fixed key order.

Keys are written in the order given (callers pass them alphabetically, which
is how the reference serialises its detail objects). Values are JSON text
Columns; ``None`` becomes ``null``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def jstr(c: Column) -> Column:
    """A JSON string literal (escaped), or ``null``."""
    arr = F.to_json(F.array(c.cast("string")))
    return F.regexp_extract(arr, r"^\[(.*)\]$", 1)


def jdecimal(c: Column) -> Column:
    """``jstr`` of a decimal, whose text has nothing to escape."""
    return F.coalesce(F.concat(F.lit('"'), c.cast("string"), F.lit('"')), F.lit("null"))


def jnum(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def jbool(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("null")).when(c, F.lit("true")).otherwise(F.lit("false"))


def jraw(c: Column) -> Column:
    """Already-JSON text, ``null`` when NULL."""
    return F.coalesce(c, F.lit("null"))


def jobject(*pairs: tuple[str, Column]) -> Column:
    parts = []
    for i, (k, v) in enumerate(pairs):
        parts.append(F.lit(("{" if i == 0 else ",") + '"' + k + '":'))
        parts.append(v)
    parts.append(F.lit("}"))
    return F.concat(*parts)


def jarray(items: Column) -> Column:
    """``items`` is an array of JSON texts."""
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def rust_debug_list(arr: Column) -> Column:
    """``["a", "b"]`` — the Debug rendering of a list of strings."""
    return F.concat(F.lit("["),
                    F.array_join(F.transform(arr, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", "),
                    F.lit("]"))
