"""Ranks and running totals over a whole table without one task that sorts it all.

Rows are put into bins by approximate quantiles of the ordering value; bins are disjoint ranges, so a running total within a bin
plus the totals of the bins before it is the running total of the table. Bin bounds are literals, hence the same in every attempt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 200


def binned(df: DataFrame, value: str, bins: int = BINS) -> DataFrame:
    """Adds ``__bin``: the number of bounds below the value. Null values have bin -1."""
    bounds = sorted(set(df.select(F.col(value).cast("double").alias("v")).approxQuantile("v", [i / bins for i in range(1, bins)], 0.5 / bins)))
    v = F.col(value).cast("double")
    below = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < v)) if bounds else F.lit(0)
    return df.withColumn("__bin", F.when(v.isNull(), -1).otherwise(below))


def running(df: DataFrame, value: str, sums: dict[str, Column], descending: bool = False, ties: tuple[str, ...] = (), bins: int = BINS) -> DataFrame:
    """Adds, for each name in ``sums``, the running total of its column in order of the value (then of ``ties``)."""
    d = binned(df, value, bins)
    for n, c in sums.items():
        d = d.withColumn(f"__{n}", c)
    totals = d.groupBy("__bin").agg(*[F.sum(f"__{n}").alias(f"__t_{n}") for n in sums])
    order = F.desc("__bin") if descending else F.asc("__bin")
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)  # as many rows as bins
    offsets = totals.select("__bin", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums])
    within = Window.partitionBy("__bin").orderBy(F.desc(value) if descending else F.asc(value), *ties).rowsBetween(Window.unboundedPreceding, 0)
    out = d.join(offsets, "__bin")
    for n in sums:
        out = out.withColumn(n, F.col(f"__o_{n}") + F.sum(f"__{n}").over(within))
    return out.drop("__bin", *[f"__{n}" for n in sums], *[f"__o_{n}" for n in sums])


def average_ranks(df: DataFrame, value: str, bins: int = BINS) -> DataFrame:
    """(value, c, upto, rank): of each distinct value its rows, the rows up to it, and the mean rank of its rows. Nulls have none."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"))
    out = running(counts, value, {"upto": F.col("c")}, bins=bins)
    return out.select(value, "c", "upto", (F.col("upto") - (F.col("c") - 1) / 2).alias("rank"))


def quantiles(df: DataFrame, value: str, at: list[float], bins: int = BINS) -> list[float | None]:
    """Exact quantiles of a column, linear between neighbours: the ranks of distinct values are worked out in bins, one row reaches the driver."""
    n = df.agg(F.count(value)).first()[0]
    if not n:
        return [None] * len(at)
    places = [q * (n - 1) for q in at]
    ranks = average_ranks(df, value, bins)
    v = F.col(value).cast("double")
    row = ranks.agg(*[F.min(F.when(F.col("upto") >= k, v)) for x in places for k in (int(x) + 1, min(int(x) + 2, n))]).first()
    return [float(row[2 * i] + (row[2 * i + 1] - row[2 * i]) * (x - int(x))) for i, x in enumerate(places)]


def grouped_percentiles(df: DataFrame, by: list[str], value: str, at: list[float], bins: int = BINS) -> DataFrame:
    """(by, q, value): of each group the smallest value with at least a share q of the group's values up to it.

    The counts of distinct values are summed up within a group and a bin of values, so a group of any size is dealt to many tasks.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    d = binned(counts, "__v", bins)
    totals = d.groupBy(*by, "__bin").agg(F.sum("__c").alias("__s"))
    before = Window.partitionBy(*by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)  # as many rows a group as bins
    offsets = totals.select(
        *[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col("__bin").alias("__at"), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__o"), F.sum("__s").over(Window.partitionBy(*by)).alias("__n")
    )
    same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(by)] + [F.col("__bin") == F.col("__at")]
    within = Window.partitionBy(*by, "__bin").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    upto = d.join(offsets, same).select(*by, "__bin", "__v", "__n", "__c", "__o")
    upto = upto.withColumn("__upto", F.col("__o") + F.sum("__c").over(within))
    found = upto.groupBy(*by).agg(F.array(*[F.struct(F.lit(float(q)).alias("q"), F.min(F.when(F.col("__upto") >= F.ceil(q * F.col("__n")), F.col("__v"))).alias("value")) for q in at]).alias("__q"))
    return found.select(*by, F.explode("__q").alias("__q")).select(*by, "__q.*")
