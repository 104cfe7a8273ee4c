"""Anomaly and threshold alerts. Thresholds are parameters; severities are 2 (notable) and 3 (serious)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import predicate
from .ranking import quantiles


def _spread(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Group statistics joined to the rows: count, median, quartiles, median absolute deviation, median of non-zero magnitudes."""
    q = df.groupBy(*by).agg(
        F.count(value).alias("__n"), F.percentile(value, F.lit(0.5)).alias("__med"), F.percentile(value, F.lit(0.25)).alias("__q1"), F.percentile(value, F.lit(0.75)).alias("__q3"),
        F.percentile(F.when(F.abs(value) > 1e-12, F.abs(value)), F.lit(0.5)).alias("__base"),
    )
    out = df.join(q, by, "left")
    mad = out.groupBy(*by).agg(F.percentile(F.abs(F.col(value) - F.col("__med")), F.lit(0.5)).alias("__mad"))
    return out.join(mad, by, "left").withColumn("__iqr", F.greatest(F.col("__q3") - F.col("__q1"), F.lit(0.0)))


def self_anomalies(df: DataFrame, by: list[str], order: str, value: str, near_zero: float = 0.01, z: tuple[float, float] = (3.5, 5.0), iqr: float = 3.0, drop: float = -0.9, rise: float = 3.0, swing: float = 1.5, least: int = 3) -> DataFrame:
    """(by, order, value, severity) of the rows of each series that stand out from it or from the value before.

    Near zero against a clear base: 3. Robust z above the limits: 2, 3. Otherwise beyond iqr quartile ranges: 2. Against the value
    before: at most ``drop`` or at least ``rise``: 3, at least ``swing`` either way: 2. The highest counts; series of fewer than
    ``least`` values have no alerts.
    """
    s = _spread(df.select(*by, order, value), by, value)
    v = F.col(value)
    robust = F.abs(F.try_divide(0.6745 * (v - F.col("__med")), F.col("__mad")))
    first = (
        F.when((F.col("__base") > 0) & (F.abs(v) <= F.greatest(F.col("__base") * near_zero, F.lit(1e-9))), 3)
        .when((F.col("__mad") > 0) & (robust >= z[1]), 3).when((F.col("__mad") > 0) & (robust >= z[0]), 2)
        .when((F.col("__iqr") > 0) & ((v < F.col("__q1") - iqr * F.col("__iqr")) | (v > F.col("__q3") + iqr * F.col("__iqr"))), 2).otherwise(0)
    )
    before = F.last(v, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("__prev", before)
    ratio = F.when(F.abs("__prev") > 1e-12, (v - F.col("__prev")) / F.abs("__prev"))
    second = F.when((ratio <= drop) | (ratio >= rise), 3).when(F.abs(ratio) >= swing, 2).otherwise(0)
    return s.filter((F.col("__n") >= least) & v.isNotNull()).withColumn("severity", F.greatest(first, second)).filter("severity > 0").select(*by, order, value, "severity")


def path_anomalies(df: DataFrame, by: list[str], member: str, value: str, iqr: float = 2.5, low: float = 0.02, high: float = 5.0, least: int = 4) -> DataFrame:
    """(by, member, value, direction, severity): members of a group far above or below the others; 3 where a group has both."""
    s = _spread(df.select(*by, member, value), by, value).filter((F.col("__n") >= least) & F.col(value).isNotNull() & ~((F.col("__iqr") <= 0) & (F.col("__med") == 0)))
    v = F.col(value)
    up = ((F.col("__iqr") > 0) & (v > F.col("__q3") + iqr * F.col("__iqr"))) | ((F.col("__med") > 0) & (v >= F.col("__med") * high))
    down = ((F.col("__iqr") > 0) & (v < F.col("__q1") - iqr * F.col("__iqr"))) | ((F.col("__med") > 0) & (v <= F.greatest(F.col("__med") * low, F.lit(1e-9))))
    s = s.withColumn("__up", up).withColumn("__down", down).filter("__up or __down")
    w = Window.partitionBy(*by)
    both = F.max("__up").over(w) & F.max("__down").over(w)
    return s.select(*by, member, value, F.when(F.col("__up"), "high").otherwise("low").alias("direction"), F.when(both, 3).otherwise(2).alias("severity"))


def expression_anomalies(parents: DataFrame, operands: DataFrame, keys: list[str]) -> DataFrame:
    """Operand alerts (keys, operand, severity) at rows where the parent measure has no alert itself."""
    return operands.join(parents.select(*keys).distinct(), keys, "left_anti")


def thresholds(df: DataFrame, rules: list[tuple[str, str, str, tuple, int]]) -> DataFrame:
    """Rows that meet rules (name, measure, operator, values, severity), once for each rule, with rule and severity: one pass for all rules."""
    kind = "array<struct<rule:string,severity:int>>"
    hits = [F.when(predicate(F.col(measure), op, values), F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"))) for name, measure, op, values, severity in rules]
    met = F.filter(F.array(*hits), lambda h: h.isNotNull()) if hits else F.array()
    return df.select("*", F.explode(met.cast(kind)).alias("__hit")).select(*df.columns, "__hit.rule", "__hit.severity")


def monitor(df: DataFrame, by: list[str], value: str, current: Column, base: Column | None, op: str, values: tuple) -> DataFrame:
    """(by, current[, base, change]) of the groups whose value, or change against the base period, meets the comparison."""
    aggs = [F.sum(F.when(current, F.col(value))).alias("current")]
    if base is None:
        return df.groupBy(*by).agg(*aggs).filter(predicate(F.col("current"), op, values))
    got = df.groupBy(*by).agg(*aggs, F.sum(F.when(base, F.col(value))).alias("base"))
    return got.withColumn("change", F.try_divide(F.col("current") - F.col("base"), F.col("base"))).filter(predicate(F.col("change"), op, values))


def sanity(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n, n_values, all_zero, mild, extreme): counts, and values beyond 1.5 and 3 quartile ranges (of four or more values).

    Quartiles come from ranks in bins, the counts of all columns from one aggregation into one row.
    """
    facts = []
    for c in columns:
        v = F.col(c).cast("double")
        q1, q3 = quantiles(df.select(v.alias("v")), "v", [0.25, 0.75])
        wide = max((q3 or 0.0) - (q1 or 0.0), 0.0)
        beyond = lambda k, v=v, q1=q1, q3=q3, wide=wide: F.sum(F.when((v < q1 - k * wide) | (v > q3 + k * wide), 1).otherwise(0)) if wide else F.lit(0)
        few = F.count(v) < 4
        facts.append(F.struct(
            F.lit(c).alias("column_name"), F.count("*").alias("n"), F.count(v).alias("n_values"), (F.coalesce(F.sum(F.when(v != 0, 1).otherwise(0)), F.lit(0)) == 0).alias("all_zero"),
            F.when(few, 0).otherwise(beyond(1.5)).cast("long").alias("mild"), F.when(few, 0).otherwise(beyond(3.0)).cast("long").alias("extreme"),
        ))
    return df.agg(F.array(*facts).alias("f")).select(F.explode("f").alias("f")).select("f.*")
