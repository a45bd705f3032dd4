"""Scalar rules for names, keys, paths and typed missingness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The spellings of a missing value.
MISSING = ("nan", "none", "null", "")


def normalise(value: Column) -> Column:
    """Trimmed; the spellings of a missing value become null."""
    text = F.trim(value.cast("string"))
    return F.when(~F.lower(text).isin(*MISSING), text)


def simplify(value: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(value.cast("string")), "[^a-z0-9]+", "")


def slug(value: Column, fallback: str) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit(fallback))


def as_bool(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("true", "1", "yes", "y"), F.lit(False))


def capped_ratio(value: Column, cap: float) -> Column:
    if cap <= 0:
        return F.lit(0.0)
    return F.greatest(F.lit(0.0), F.least(value / F.lit(float(cap)), F.lit(1.0)))


def first_rule(text: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """The name of the first pattern that the lower-cased text holds."""
    out = F.lit(other)
    for pattern, name in reversed(rules):
        out = F.when(F.lower(text).rlike(pattern), name).otherwise(out)
    return out


def right_closed_bin(value: Column, edges: list[float]) -> Column:
    """Number of the bin (a, b] of ascending edges, the lowest edge included; null outside."""
    place = F.lit(0)
    for edge in edges[1:-1]:
        place = place + F.when(value > edge, 1).otherwise(0)
    return F.when((value >= edges[0]) & (value <= edges[-1]), place + 1)


def support_band(count: Column, well: int = 20, marginal: int = 10) -> Column:
    return F.when(count >= well, "well").when(count >= marginal, "marginal").otherwise("low")
