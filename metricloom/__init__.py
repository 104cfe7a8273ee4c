"""Metric semantic layer and DataFrame operators on PySpark."""

__version__ = "0.1.0"
