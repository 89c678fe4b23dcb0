"""A deterministic table of sales, for trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sales(spark: SparkSession, rows: int, *, seed: int = 42, customers: int = 1000, regions: int = 10, categories: int = 20, skew: float = 0.0, nulls: float = 0.05, files: int = 4) -> DataFrame:
    """Rows depend on seed and order_id only, so any number of files holds the same."""
    draw = lambda name: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(name)), F.lit(1 << 30)) / float(1 << 30))
    label = lambda name, n: F.concat(F.lit(f"{name}-"), F.floor(F.pow(draw(name), F.lit(1.0 + skew)) * n).cast("string"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.floor(draw("day") * 1096).cast("int"))
    second = F.floor(draw("time") * 86_400_000_000).cast("long")
    return spark.range(0, rows, 1, files).select(
        F.col("id").alias("order_id"),
        F.floor(draw("customer") * customers).cast("long").alias("customer_id"),
        label("region", regions).alias("region"),
        (F.lit(1.0) + draw("amount") * 999.0).alias("amount"),
        day.alias("event_date"),
        F.timestamp_micros(F.unix_micros(day.cast("timestamp")) + second).cast("timestamp_ntz").alias("event_time"),
        label("category", categories).alias("category"),
        F.when(draw("null") >= nulls, draw("discount") * 0.3).alias("discount"),
    )
