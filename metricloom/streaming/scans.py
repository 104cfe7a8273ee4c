"""Alert scans over streams: each micro-batch is checked against rules, alerts of one key wait out a cooldown; windowed totals.

A batch writes its alerts and the cooldowns it leaves behind under its own number, and reads those of the batch before. A batch that is run
again after a failure replaces what it wrote, so no alert is told twice or lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.alerts import thresholds


def cooled(alerts: DataFrame, last: DataFrame | None, key: list[str], time: str, minutes: int = 15) -> DataFrame:
    """The alerts, all their columns, that do not fall within the cooldown of the one told before; ``last`` has the time each key's last was told."""
    rest = [c for c in alerts.columns if c not in key and c != time]
    kind = f"array<struct<{', '.join(f'`{c}`:{alerts.schema[c].dataType.simpleString()}' for c in (time, *rest))}>>"
    grouped = alerts.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(time, *rest))).alias("__found"))
    if last is None:
        grouped = grouped.withColumn("__last", F.lit(None).cast(alerts.schema[time].dataType))
    else:
        grouped = grouped.join(last.select(*key, F.col(time).alias("__last")), key, "left")
    wait = F.expr(f"interval {minutes} minutes")
    told = F.aggregate(
        "__found", F.struct(F.col("__last").alias("last"), F.array().cast(kind).alias("told")),
        lambda s, x: F.when(s["last"].isNull() | (x[time] >= s["last"] + wait), F.struct(x[time].alias("last"), F.concat(s["told"], F.array(x)).alias("told"))).otherwise(s),
    )
    return grouped.select(*key, F.explode(told["told"]).alias("__a")).select(*key, "__a.*").select(*alerts.columns)


def scan_stream(stream: DataFrame, rules: list[tuple[str, str, str, tuple, int]], key: list[str], time: str, sink: str, checkpoint: str, minutes: int = 15):
    """Starts the scan. Alerts that pass the cooldown are in the Parquet table ``sink`` with rule, severity, measure and value, by batch."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        found = thresholds(batch, rules)
        measure = value = F.lit(None)
        for name, column, *_ in rules:
            measure, value = F.when(F.col("rule") == name, column).otherwise(measure), F.when(F.col("rule") == name, F.col(column).cast("double")).otherwise(value)
        names = ["rule", *key]
        found = found.select(*names, time, "severity", measure.cast("string").alias("measure"), value.cast("double").alias("value"))
        state = f"{checkpoint}-cooldowns"
        last = spark.read.parquet(f"{state}/batch={number - 1}") if number else None
        folder = f"{sink}/batch={number}"
        cooled(found, last, names, time, minutes).write.mode("overwrite").parquet(folder)
        now = spark.read.schema(found.schema).parquet(folder).select(*names, time)
        now = now if last is None else now.unionByName(last)
        newest = now.groupBy(*names).agg(F.max(time).alias(time))
        # a cooldown that is over long ago need not be remembered
        recent = newest.crossJoin(newest.agg(F.max(time).alias("__newest"))).filter(F.col(time) >= F.col("__newest") - F.expr(f"interval {8 * minutes} minutes")).drop("__newest")
        recent.write.mode("overwrite").parquet(f"{state}/batch={number}")
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/batch={number - 2}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(stream: DataFrame, time: str, by: list[str], value: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Event-time totals with a watermark (an extension beyond scheduled scans)."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
