"""Display formats of measures. Rounding is half up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = {"wan": 1e4, "yi": 1e8, "K": 1e3, "M": 1e6, "G": 1e9}


def formatted(c: Column, how: str) -> Column:
    """integer, decimalN, percentN (text with %), plain_percentN (number without), thousands, unit:K/M/G/wan/yi."""
    if how == "integer":
        return F.round(c, 0).cast("long")
    if how.startswith("decimal"):
        return F.round(c, int(how[7:] or 2))
    if how.startswith("percent"):
        n = int(how[7:] or 2)
        return F.concat(F.format_string(f"%.{n}f", F.round(c * 100, n)), F.lit("%"))
    if how.startswith("plain_percent"):
        return F.round(c * 100, int(how[13:] or 2))
    if how == "thousands":
        return F.format_number(c, 2)
    if how.startswith("unit:"):
        return F.round(c / UNITS[how[5:]], 2)
    raise ValueError(f"unknown format {how}")


def parsed_number(c: Column) -> Column:
    """Number of a displayed text: thousands separators go, a lone dash is null."""
    return F.when(F.trim(c) == "-", None).otherwise(F.regexp_replace(c, ",", "").try_cast("double"))
