"""Scans over several paths, globs and Hive partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir
from ..sources import read_parquet
from . import Entry


def _scratch(spark: SparkSession) -> str:
    return scratch_dir(spark, "scan")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def multi_path_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _scratch(spark)
    orders = _orders(spark, sf_dir).select("o_orderkey", "o_totalprice")
    orders.where("o_orderkey % 2 = 0").write.parquet(f"{at}/even")
    orders.where("o_orderkey % 2 = 1").write.parquet(f"{at}/odd")
    return read_parquet(spark, f"{at}/even", f"{at}/odd")


def glob_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _scratch(spark)
    _orders(spark, sf_dir).select("o_orderkey", "o_orderstatus").repartition(3, "o_orderkey").write.parquet(at)
    return read_parquet(spark, f"{at}/part-*.parquet")


def recursive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _scratch(spark)
    orders = _orders(spark, sf_dir).select("o_orderkey", "o_custkey")
    orders.where("o_orderkey % 3 = 0").write.parquet(f"{at}/a")
    orders.where("o_orderkey % 3 <> 0").write.parquet(f"{at}/b/c")
    return read_parquet(spark, at)


def _partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _scratch(spark)
    table = _orders(spark, sf_dir).select("o_orderkey", "o_totalprice", "o_orderstatus", F.year("o_orderdate").alias("order_year"))
    table.repartition("order_year").write.partitionBy("order_year", "o_orderstatus").parquet(at)
    return read_parquet(spark, at)


def hive_partitioned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _partitioned(spark, sf_dir)


def hive_partition_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _partitioned(spark, sf_dir).where((F.col("order_year") == 1997) & (F.col("o_orderstatus") == "F")).select("o_orderkey", "order_year")


def _by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _scratch(spark)
    table = _orders(spark, sf_dir).select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    table.repartition("day").write.partitionBy("day").parquet(at)
    return read_parquet(spark, at)


def hive_date_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_day(spark, sf_dir)


ENTRIES = {
    "multi_path_scan": Entry(multi_path_scan, "SELECT o_orderkey, o_totalprice FROM orders"),
    "glob_scan": Entry(glob_scan, "SELECT o_orderkey, o_orderstatus FROM orders"),
    "recursive_scan": Entry(recursive_scan, "SELECT o_orderkey, o_custkey FROM orders"),
    "hive_partitioned_scan": Entry(hive_partitioned_scan, "SELECT o_orderkey, o_totalprice, CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS order_year, o_orderstatus FROM orders"),
    "hive_partition_pruning": Entry(hive_partition_pruning, "SELECT o_orderkey, CAST(1997 AS BIGINT) AS order_year FROM orders WHERE o_orderstatus = 'F' AND EXTRACT(YEAR FROM o_orderdate) = 1997"),
    "hive_date_partition": Entry(hive_date_partition, "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders"),
}
