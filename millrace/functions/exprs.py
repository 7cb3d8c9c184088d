"""Column expressions of the null-safe dialect and normal forms of index keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def eq(a: Column, b: Column) -> Column:
    """Null-safe ``=``: NULL = NULL is true, NULL = x false."""
    return a.eqNullSafe(b)


def ne(a: Column, b: Column) -> Column:
    """Null-safe ``<>``."""
    return ~a.eqNullSafe(b)


def compare_mixed(a: Column, b: Column, op: str) -> Column:
    """Compare as strings, as the dialect does where either side is one."""
    a, b = a.cast("string"), b.cast("string")
    return {"=": eq(a, b), "<>": ne(a, b), "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def divide_integers(a: Column, b: Column) -> Column:
    """Truncating integer division; by zero is an error in ANSI mode."""
    return F.call_function("div", a, b)


def definite(predicate: Column) -> Column:
    """True where the predicate is true, else false."""
    return F.coalesce(predicate, F.lit(False))


def key_char(c: Column) -> Column:
    """CHAR keys compare without the blanks at their end."""
    return F.rtrim(c)


def key_uuid(c: Column) -> Column:
    """UUID keys compare without case and braces."""
    return F.lower(F.regexp_replace(c, "[{}]", ""))


def key_float_equal(a: Column, b: Column, within: float = 1e-10) -> Column:
    """Equality of floating keys: within ``within``; NaN equals NaN."""
    return (F.abs(a - b) < within) | (F.isnan(a) & F.isnan(b)) | (a == b)


def key_order(c: Column) -> Column:
    """Ascending key order: NULL lowest, NaN highest."""
    return c.asc_nulls_first()
