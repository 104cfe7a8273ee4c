"""Profiling, key and relation discovery, table classification. One aggregation a table wherever that is possible."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PATTERNS = {"email": r"^[^@\s]+@[^@\s]+\.[a-zA-Z]+$", "phone": r"^\+?[0-9][0-9 -]{6,14}$", "date": r"^\d{4}-\d{2}-\d{2}", "url": r"^https?://", "uuid": r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$", "integer": r"^-?\d+$"}


def _base(t: T.DataType) -> str:
    return "NUMERIC" if isinstance(t, T.NumericType) else "STRING" if isinstance(t, T.StringType) else "DATETIME" if isinstance(t, (T.DateType, T.TimestampType)) else "OTHER"


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, base_type, n, n_null, n_distinct, min_value, max_value, mean, min_length, max_length, pattern) in one pass.

    A pattern is named where at least 80 % of the values that are there match it.
    """
    columns = columns or [f.name for f in df.schema if _base(f.dataType) != "OTHER"]
    facts = []
    for c in columns:
        t, v = _base(df.schema[c].dataType), F.col(f"`{c}`")
        text = v.cast("string")
        found = F.lit(None).cast("string")
        if t == "STRING":
            for name, p in reversed(PATTERNS.items()):
                found = F.when(F.sum(F.when(text.rlike(p), 1).otherwise(0)) >= 0.8 * F.count(v), F.when(F.count(v) > 0, name)).otherwise(found)
        facts.append(F.struct(
            F.lit(c).alias("column_name"), F.lit(t).alias("base_type"), F.count("*").alias("n"), (F.count("*") - F.count(v)).alias("n_null"), F.countDistinct(v).alias("n_distinct"),
            F.min(v).cast("string").alias("min_value"), F.max(v).cast("string").alias("max_value"), (F.avg(v) if t == "NUMERIC" else F.lit(None).cast("double")).alias("mean"),
            F.min(F.length(text)).alias("min_length"), F.max(F.length(text)).alias("max_length"), found.alias("pattern"),
        ))
    return df.agg(F.array(*facts).alias("f")).select(F.explode("f").alias("f")).select("f.*")


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).count().withColumnRenamed("count", "n").orderBy(F.desc("n"), "value").limit(k)


def table_histogram(tables: dict[str, DataFrame], dims: dict[str, list[str]]) -> DataFrame:
    """(table_name, n, distinct counts by column as a map)."""
    out = None
    for name, df in tables.items():
        counts = F.create_map(*[x for c in dims.get(name, []) for x in (F.lit(c), F.countDistinct(c))]) if dims.get(name) else F.create_map().cast("map<string,bigint>")
        one = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n"), counts.alias("distinct_counts"))
        out = one if out is None else out.unionByName(one)
    return out


def inclusion(a: DataFrame, ca: str, b: DataFrame, cb: str) -> DataFrame:
    """One row: distinct values of a, how many of them b has, their share, and the verdict (full 0.95, partial 0.6, of 3 common at least)."""
    x, y = a.select(F.col(ca).alias("v")).filter("v is not null").distinct(), b.select(F.col(cb).alias("v")).filter("v is not null").distinct().withColumn("__y", F.lit(1))
    got = x.join(y, "v", "left").agg(F.count("*").alias("n_values"), F.count("__y").alias("n_common"))
    share = F.try_divide(F.col("n_common"), F.col("n_values"))
    return got.withColumn("share", share).withColumn("verdict", F.when((F.col("n_common") >= 3) & (share >= 0.95), "full").when((F.col("n_common") >= 3) & (share >= 0.6), "partial").otherwise("none"))


def foreign_keys(tables: dict[str, DataFrame], keys: dict[str, str]) -> DataFrame:
    """(table_name, column_name, to_table, to_column, share, confidence): columns named like another table's key whose values it holds.

    Names match if they end alike after the table's prefix; confidence 0.95, 0.85, 0.7 or 0.6 by the share of values found.
    """
    out = None
    stem = lambda c: re.sub(r"^[a-z]{1,3}_", "", c.lower())
    for name, df in tables.items():
        for c in df.columns:
            for to, key in keys.items():
                if to != name and stem(c) == stem(key):
                    one = inclusion(df, c, tables[to], key).select(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), F.lit(to).alias("to_table"), F.lit(key).alias("to_column"), "share")
                    out = one if out is None else out.unionByName(one)
    if out is None:
        return next(iter(tables.values())).sparkSession.createDataFrame([], "table_name string, column_name string, to_table string, to_column string, share double, confidence double")
    confidence = F.when(F.col("share") >= 0.99, 0.95).when(F.col("share") >= 0.9, 0.85).when(F.col("share") >= 0.7, 0.7).when(F.col("share") >= 0.5, 0.6)
    return out.withColumn("confidence", confidence).filter("confidence is not null")


def orphans(child: DataFrame, fk: str, parent: DataFrame, key: str) -> DataFrame:
    """(value, n): foreign key values the parent does not have, with their rows. Null keys are no orphans."""
    missing = child.filter(F.col(fk).isNotNull()).join(parent.select(F.col(key).alias("__k")), F.col(fk) == F.col("__k"), "left_anti")
    return missing.groupBy(F.col(fk).alias("value")).agg(F.count("*").alias("n"))


def shared_enum(a: DataFrame, ca: str, b: DataFrame, cb: str, most: int = 1000) -> DataFrame:
    """One row: sizes of two value sets, common values, and confidence: equal 0.9, subset 0.8, overlap of 0.7 or more 0.65 + 0.15 share; same names 0.05 more."""
    x, y = a.select(F.col(ca).cast("string").alias("v")).filter("v is not null").distinct(), b.select(F.col(cb).cast("string").alias("v")).filter("v is not null").distinct()
    both = x.withColumn("__x", F.lit(1)).join(y.withColumn("__y", F.lit(1)), "v", "full").agg(F.count("__x").alias("n_a"), F.count("__y").alias("n_b"), F.sum(F.when(F.col("__x").isNotNull() & F.col("__y").isNotNull(), 1).otherwise(0)).alias("n_common"))
    small = F.least("n_a", "n_b")
    share = F.try_divide(F.col("n_common"), small)
    base = F.when((F.col("n_common") == F.col("n_a")) & (F.col("n_a") == F.col("n_b")), 0.9).when(share >= 0.999999, 0.8).when(share >= 0.7, 0.65 + 0.15 * share)
    return both.withColumn("confidence", F.when(F.greatest("n_a", "n_b") <= most, F.least(F.lit(1.0), base + (0.05 if ca == cb else 0.0))))


def profile_similarity(a: DataFrame, b: DataFrame, least: float = 0.7) -> DataFrame:
    """Pairs of profiled columns of one base type with 0.6 cardinality ratio + 0.4 null-rate likeness of at least ``least``."""
    x = a.select(F.col("column_name").alias("a"), "base_type", F.col("n_distinct").alias("da"), (F.col("n_null") / F.col("n")).alias("na"))
    y = b.select(F.col("column_name").alias("b"), "base_type", F.col("n_distinct").alias("db"), (F.col("n_null") / F.col("n")).alias("nb"))
    score = 0.6 * F.try_divide(F.least("da", "db"), F.greatest("da", "db")) + 0.4 * (1 - F.abs(F.col("na") - F.col("nb")))
    return x.join(y, "base_type").withColumn("score", score).filter(F.col("score") >= least).select("a", "b", "base_type", "score")


def classify(tables: dict[str, DataFrame], links: list[tuple[str, str]], counts: dict[str, int]) -> dict[str, str]:
    """fact, dimension, bridge or lookup for each table, from its name, foreign keys out and in, share of numeric columns and rows."""
    out = {}
    for name, df in tables.items():
        away, home = sum(a == name for a, _ in links), sum(b == name for _, b in links)
        numeric = sum(_base(f.dataType) == "NUMERIC" for f in df.schema) / max(len(df.columns), 1)
        low = name.lower()
        score = {
            "fact": 3 * bool(re.search(r"fact|order|sale|event|log|item|trans", low)) + 2 * (away >= 2) + (numeric > 0.5) + (counts.get(name, 0) > 10_000),
            "dimension": 3 * bool(re.search(r"dim|customer|product|part|supplier|user|store", low)) + 2 * (home >= 1) + (away <= 1),
            "bridge": 3 * bool(re.search(r"bridge|map|rel|link", low)) + 3 * (away == 2 and len(df.columns) <= 4),
            "lookup": 3 * bool(re.search(r"lookup|code|type|region|nation|country|status", low)) + 2 * (counts.get(name, 0) <= 100) + (len(df.columns) <= 3),
        }
        out[name] = max(score, key=lambda k: score[k])
    return out


def schema_difference(declared: dict[str, str], df: DataFrame) -> list[tuple[str, str]]:
    """(column, missing | added | type) between a declared schema and what a table has."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    out = [(c, "missing") for c in declared if c not in have] + [(c, "added") for c in have if c not in declared]
    return sorted(out + [(c, "type") for c in declared if c in have and declared[c] != have[c]])


def triples(tables: dict[str, DataFrame], joins: list[tuple[str, str, str, str]]) -> DataFrame:
    """(s, p, o): tables, columns with types, and references, as a knowledge graph."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        rows.append((f"table:{name}", "a", "Table"))
        for f in df.schema:
            rows += [(f"table:{name}", "hasColumn", f"column:{name}.{f.name}"), (f"column:{name}.{f.name}", "type", f.dataType.simpleString())]
    rows += [(f"column:{a}.{c}", "references", f"column:{b}.{k}") for a, c, b, k in joins]
    return spark.createDataFrame(rows, "s string, p string, o string")
