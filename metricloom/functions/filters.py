"""Predicates by operator name. Values become literals, never SQL text."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _in(c: Column, *v: Any) -> Column:
    """An empty string among the values also means null."""
    found = c.isin(*v)
    return found | c.isNull() if "" in v else found


def _not_in(c: Column, *v: Any) -> Column:
    out = ~c.isin(*v)
    return out & c.isNotNull() if "" in v else out | c.isNull()


OPERATORS: dict[str, Callable[..., Column]] = {
    "in": _in, "notIn": _not_in,
    "equals": lambda c, *v: c == v[0] if len(v) == 1 else c.isin(*v),
    "notEquals": lambda c, *v: c != v[0] if len(v) == 1 else ~c.isin(*v),
    "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v,
    "between": lambda c, lo, hi: c.between(lo, hi),
    "notBetween": lambda c, lo, hi: (c <= lo) | (c >= hi),
    "outside": lambda c, lo, hi: (c < lo) | (c > hi),
    "contains": lambda c, v: c.cast("string").contains(v),
    "notContains": lambda c, v: ~c.cast("string").contains(v),
    "startsWith": lambda c, v: c.cast("string").startswith(v),
    "set": lambda c: c.isNotNull(), "notSet": lambda c: c.isNull(),
    "empty": lambda c: c == "", "notEmpty": lambda c: c != "",
    "zero": lambda c: c == 0, "always": lambda c: F.lit(True),
    "inDateRange": lambda c, lo, hi: (c >= F.to_date(F.lit(lo))) & (c < F.date_add(F.to_date(F.lit(hi)), 1)),
    "beforeDate": lambda c, v: c < F.to_date(F.lit(v)), "beforeOrOnDate": lambda c, v: c < F.date_add(F.to_date(F.lit(v)), 1),
    "afterDate": lambda c, v: c >= F.date_add(F.to_date(F.lit(v)), 1), "afterOrOnDate": lambda c, v: c >= F.to_date(F.lit(v)),
}


def predicate(column: Column, op: str, values: tuple[Any, ...] = (), inclusive: bool = False) -> Column:
    """``inclusive`` gives the compatibility reading in which > and < include their ends."""
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {op}")
    return OPERATORS[{"gt": "gte", "lt": "lte"}.get(op, op) if inclusive else op](column, *values)
