"""Catalog of the test tables: two facts (lineitem, orders), snowflaked dimensions, and the measures the queries use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..semantic import Catalog, Dimension, Engine, Join, Measure, Table

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

CATALOG = Catalog(
    tables=(Table("lineitem"), Table("orders", ("o_orderkey",)), Table("customer", ("c_custkey",)), Table("nation", ("n_nationkey",)), Table("region", ("r_regionkey",)), Table("part", ("p_partkey",)), Table("supplier", ("s_suppkey",)), Table("events", ("event_id",))),
    joins=(
        Join("lineitem", "l_orderkey", "orders", "o_orderkey"), Join("lineitem", "l_partkey", "part", "p_partkey"), Join("lineitem", "l_suppkey", "supplier", "s_suppkey"),
        Join("orders", "o_custkey", "customer", "c_custkey"), Join("customer", "c_nationkey", "nation", "n_nationkey"), Join("nation", "n_regionkey", "region", "r_regionkey"),
    ),
    measures=(
        Measure("revenue", table="lineitem", expr="l_extendedprice * (1 - l_discount)"),
        Measure("gross", table="lineitem", expr="l_extendedprice"),
        Measure("quantity", table="lineitem", expr="l_quantity"),
        Measure("lines", table="lineitem", expr="l_orderkey", agg="count"),
        Measure("parts", table="lineitem", expr="l_partkey", agg="count_distinct"),
        Measure("avg_price", table="lineitem", expr="l_extendedprice", agg="avg"),
        Measure("max_price", table="lineitem", expr="l_extendedprice", agg="max"),
        Measure("min_price", table="lineitem", expr="l_extendedprice", agg="min"),
        Measure("std_price", table="lineitem", expr="l_extendedprice", agg="stddev"),
        Measure("p50_price", table="lineitem", expr="l_extendedprice", agg="p50"),
        Measure("p90_price", table="lineitem", expr="l_extendedprice", agg="p90"),
        Measure("p95_price", table="lineitem", expr="l_extendedprice", agg="p95"),
        Measure("p99_price", table="lineitem", expr="l_extendedprice", agg="p99"),
        Measure("returned_quantity", kind="extended", base="quantity", where="l_returnflag = 'R'"),
        Measure("returned_late", kind="extended", base="returned_quantity", where="l_linestatus = 'F'"),
        Measure("open_lines", kind="extended", base="lines", where="l_linestatus = 'O'"),
        Measure("average_line", kind="derived", expr="{revenue} / {lines}"),
        Measure("return_rate", kind="derived", expr="{returned_quantity} / {quantity}"),
        Measure("return_rate_late", kind="derived", expr="({returned_late} + {returned_quantity}) / {quantity}"),
        Measure("discount_share", kind="formula", expr="([gross] - [revenue]) / [gross]"),
        Measure("order_value", table="orders", expr="o_totalprice"),
        Measure("order_count", table="orders", expr="o_orderkey", agg="count"),
        Measure("value_per_revenue", kind="formula", expr="[order_value] / [revenue]"),
        Measure("return_percent", kind="derived", expr="{returned_quantity} / {quantity}", format="percent1"),
        Measure("event_value", table="events", expr="value"),
        Measure("event_count", table="events", expr="event_id", agg="count"),
    ),
    dimensions=(
        Dimension("returnflag", "lineitem", "l_returnflag"), Dimension("linestatus", "lineitem", "l_linestatus"),
        Dimension("priority", "orders", "o_orderpriority"), Dimension("orderstatus", "orders", "o_orderstatus"), Dimension("orderkey", "orders", "o_orderkey"),
        Dimension("segment", "customer", "c_mktsegment"), Dimension("nation", "nation", "n_nationkey", label="n_name", hierarchy="place", level=2), Dimension("nation_name", "nation", "n_name"),
        Dimension("region", "region", "r_name", hierarchy="place", level=1), Dimension("brand", "part", "p_brand"), Dimension("part_size", "part", "p_size"),
        Dimension("order_day", "orders", "o_orderdate", grain="day", hierarchy="time", level=5), Dimension("order_week", "orders", "o_orderdate", grain="week", hierarchy="time", level=4),
        Dimension("order_month", "orders", "o_orderdate", grain="month", hierarchy="time", level=3), Dimension("order_quarter", "orders", "o_orderdate", grain="quarter", hierarchy="time", level=2), Dimension("order_year", "orders", "o_orderdate", grain="year", hierarchy="time", level=1),
        Dimension("ship_month", "lineitem", "l_shipdate", grain="month"),
        Dimension("size_band", "part", "p_size", groups=(("small", "{d} < 10"), ("medium", "{d} < 30"))),
        Dimension("delivery_days", "lineitem", "l_shipdate", expr="cast(datediff({d}, o_orderdate) as string)"),
        Dimension("event_day", "events", "ts", grain="day"), Dimension("event_type", "events", "event_type"),
    ),
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def engine(spark: SparkSession, sf_dir: str, **more) -> Engine:
    return Engine(CATALOG, lambda name: read(spark, sf_dir, name), **more)
