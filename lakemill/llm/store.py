"""Intermediate tables in the folder that driver and executors share, and joins that hot keys don't slow."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot above this share of all rows, so there are at most its inverse.
HOT = 1000

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session. Only a local session (one machine) may go without: it gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="lakemill-"))
    return _own[0]


class Workspace:
    """Named Parquet tables of one operator run.

    A written table cuts lineage: a lost executor costs the tasks that read it,
    not the work before it. `drop` frees tables that no later plan reads; what
    is left, which the result may still read, goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:02d}_{name}"
        schema = df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._workspace_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table._workspace_path)
            path.getFileSystem(conf).delete(path, True)


def join_hot(rows: DataFrame, keyed: DataFrame, on: list[str], many: str) -> DataFrame:
    """Inner join of rows with a table that has one row a key and the number of rows of each key (column `many`).

    Keys of more than a thousandth of all rows are at most a thousand: they are
    broadcast, so that their rows stay where they are. The others are joined as
    Spark sees fit. A side without keys is left out of the plan, as every
    broadcast costs the driver memory. Both tables may be read twice and should
    be written ones.
    """
    total, least, most = keyed.agg(F.sum(many), F.min(many), F.max(many)).first()
    values = keyed.drop(many)
    if not total or most * HOT <= total:
        return rows.join(values, on)
    if least * HOT > total:
        return rows.join(F.broadcast(values), on)
    hot = F.col(many) * HOT > total
    known = F.broadcast(keyed.where(hot).drop(many))
    cold = rows.join(F.broadcast(keyed.where(hot).select(*on)), on, "left_anti").join(keyed.where(~hot).drop(many), on)
    return rows.join(known, on).unionByName(cold)


def power_of_two(n: float, least: int, most: int) -> int:
    """The smallest power of two that is at least n, within [least, most]."""
    p = least
    while p < n and p < most:
        p *= 2
    return p
