"""Metric catalog, query specification and the compiler from one to the other's DataFrame."""

from .catalog import Catalog, Dimension, Join, Measure, Table
from .engine import Engine
from .spec import And, Filter, Or, Order, Period, QuerySpec

__all__ = ["And", "Catalog", "Dimension", "Engine", "Filter", "Join", "Measure", "Or", "Order", "Period", "QuerySpec", "Table"]
