"""Pivots, subtotals, matrices, top-k and funnels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matrix(df: DataFrame, rows: list[str], column: str, values: list, aggs: dict[str, Column]) -> DataFrame:
    """rows x values, a column ``<value>_<name>`` for each aggregate; the values are given, so no pass finds them."""
    out = df.groupBy(*rows).pivot(column, values).agg(*[c.alias(n) for n, c in aggs.items()])
    return out.select(*rows, *[F.col(f"`{v}{f'_{n}' if len(aggs) > 1 else ''}`").alias(f"{v}_{n}") for v in values for n in aggs])


def spread(df: DataFrame, rows: list[str], column: str, values: list, measures: list[str], on_rows: bool = False) -> DataFrame:
    """Aggregated rows (rows, column, measures) as a matrix: a column ``<value>_<measure>`` each, or with ``on_rows`` a row for each measure
    (named ``measure``) and a column for each value. Formula measures are spread as they were worked out, not added up again."""
    one = lambda m, v: F.max(F.when(F.col(column).eqNullSafe(F.lit(v)), F.struct(F.col(m))))[m]
    name = lambda v: "null" if v is None else str(v)
    if not on_rows:
        return df.groupBy(*rows).agg(*[one(m, v).alias(f"{name(v)}_{m}") for v in values for m in measures])
    lines = [F.struct(F.lit(m).alias("measure"), *[one(m, v).cast("double").alias(name(v)) for v in values]) for m in measures]
    return df.groupBy(*rows).agg(F.array(*lines).alias("__m")).select(*rows, F.explode("__m").alias("__m")).select(*rows, "__m.*")


def labelled(df: DataFrame, dims: list[str], labels: dict[str, str], level: str = "level") -> DataFrame:
    """Rows of :func:`subtotals` with the dimensions as text, subtotal rows named by the label of the axis they sum up (bits of ``level``)."""
    n = len(dims)
    summed = [F.col(level).bitwiseAND(F.lit(1 << (n - 1 - i))) != 0 for i in range(n)]
    out = df
    for c, total in zip(dims, summed, strict=True):
        out = out.withColumn(c, F.when(total, F.lit(labels.get(c, "total"))).otherwise(F.col(c).cast("string")))
    return out


def subtotals(df: DataFrame, dims: list[str], aggs: dict[str, Column], kind: str = "rollup") -> DataFrame:
    """Rollup or cube from the detail rows with ``level`` = grouping id; sums, averages and distinct counts are each right."""
    grouped = df.rollup(*dims) if kind == "rollup" else df.cube(*dims)
    return grouped.agg(F.grouping_id().cast("long").alias("level"), *[c.alias(n) for n, c in aggs.items()])


def summed_subtotals(df: DataFrame, dims: list[str], measures: list[str]) -> DataFrame:
    """Rollup that adds up already aggregated values (compatibility for measures that do not add up)."""
    return df.rollup(*dims).agg(F.grouping_id().cast("long").alias("level"), *[F.sum(m).alias(m) for m in measures])


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """Rows of a page (from 1) with their row number, headers kept."""
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    return rows.withColumn("row_number", F.row_number().over(Window.orderBy(*order)) + (number - 1) * size)  # of one page


def top_k(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """First k rows of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def distribution(df: DataFrame, member: str, value: Column, top: int = 5) -> DataFrame:
    """(member, total, share, rank) of the largest members; null, empty, ``-`` and ``null`` are one member ``missing``."""
    text = F.col(member).cast("string")
    name = F.when(text.isNull() | F.trim(text).isin("", "-", "null", "NULL"), "missing").otherwise(text)
    got = df.groupBy(name.alias(member)).agg(value.alias("total"))
    every = got.agg(F.sum("total").alias("__t"))
    first = got.orderBy(F.desc("total"), member).limit(top)  # each task keeps its first rows
    w = Window.orderBy(F.desc("total"), member)  # of these few
    return first.crossJoin(every).select(member, "total", F.try_divide("total", "__t").alias("share"), F.row_number().over(w).alias("rank"))


def representatives(df: DataFrame, by: list[str], value: str, key: str) -> DataFrame:
    """Rows of the largest, middle and smallest value of each group."""
    w = Window.partitionBy(*by)
    d = df.withColumn("__r", F.row_number().over(w.orderBy(F.desc(value), key))).withColumn("__n", F.count("*").over(w))
    kind = F.when(F.col("__r") == 1, "max").when(F.col("__r") == F.col("__n"), "min").when(F.col("__r") == F.floor((F.col("__n") + 1) / 2), "middle")
    return d.withColumn("kind", kind).filter("kind is not null").drop("__r", "__n")


def funnel(df: DataFrame, stage: str, stages: list[str], unit: str) -> DataFrame:
    """(stage, events, units, of_first): rows and distinct units of each stage, units as a share of the first stage's."""
    got = df.filter(F.col(stage).isin(*stages)).groupBy(F.col(stage).alias("stage")).agg(F.count("*").alias("events"), F.countDistinct(unit).alias("units"))
    first = got.filter(F.col("stage") == stages[0]).select(F.col("units").alias("__f"))
    return got.crossJoin(first).select("stage", "events", "units", F.try_divide(F.col("units"), F.col("__f")).alias("of_first"))


def transitions(df: DataFrame, by: list[str], order: list, stage: str) -> DataFrame:
    """(before, after, n): how often one stage follows another within a unit."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.select(F.col(stage).alias("before"), F.lead(stage).over(w).alias("after")).filter("after is not null").groupBy("before", "after").agg(F.count("*").alias("n"))


def latest(df: DataFrame, date: str) -> DataFrame:
    """Rows of the latest date."""
    return df.join(df.agg(F.max(date).alias("__last")), F.col(date) == F.col("__last"), "left_semi")
