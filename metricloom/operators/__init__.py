"""Analytic operators on DataFrames: attribution, alerts, statistics, series, goals, metadata and text."""
