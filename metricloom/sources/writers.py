"""Sinks: CSV, Parquet, append-only result tables, triples as text, and plans as text."""

from __future__ import annotations

from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_POOL = ThreadPoolExecutor(4)


def to_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header; ``single`` asks for one file and is for small results."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def to_csv_later(df: DataFrame, path: str) -> Future:
    """The same as a job of its own; the handle tells when it is done."""
    return _POOL.submit(to_csv, df, path)


def append(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def to_turtle(triples: DataFrame, path: str) -> None:
    """One statement a line, of (s, p, o)."""
    term = lambda c: F.concat(F.lit("<"), F.regexp_replace(c, "[<> \"]", "_"), F.lit(">"))
    triples.select(F.concat_ws(" ", term(F.col("s")), term(F.col("p")), term(F.col("o")), F.lit(".")).alias("value")).write.mode("overwrite").text(path)


def plan_text(df: DataFrame) -> str:
    return df._jdf.queryExecution().toString()
