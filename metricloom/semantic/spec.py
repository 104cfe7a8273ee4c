"""Query specification: frozen and hashable, so it can key a result cache."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

MAX_ROWS = 10_000
DEFAULT_ROWS = 1_000


@dataclass(frozen=True)
class Filter:
    """``op`` as in :data:`metricloom.functions.filters.OPERATORS`; member is a dimension or a measure."""

    member: str
    op: str
    values: tuple[Any, ...] = ()


@dataclass(frozen=True)
class And:
    parts: tuple[Any, ...]


@dataclass(frozen=True)
class Or:
    parts: tuple[Any, ...]


@dataclass(frozen=True)
class Order:
    member: str
    descending: bool = False
    values: tuple[Any, ...] = ()
    numeric: bool = False


@dataclass(frozen=True)
class Period:
    """Comparison with another period of the date dimension: shift back ``n`` units, or a fixed key.

    result: rate (a-b)/b, difference a-b, ratio a/b.
    """

    dimension: str
    unit: str = "month"
    n: int = 1
    fixed: Any = None
    result: str = "rate"


@dataclass(frozen=True)
class QuerySpec:
    measures: tuple[str, ...] = ()
    dimensions: tuple[str, ...] = ()
    where: Any = None
    having: Any = None
    order: tuple[Order, ...] = ()
    limit: int | None = None
    offset: int = 0
    period: Period | None = None
    subtotals: str | tuple[tuple[str, ...], ...] | None = None
    labels: bool = False
    as_of: str | None = None

    def rows(self) -> int | None:
        return None if self.limit is None else max(1, min(self.limit, MAX_ROWS))
