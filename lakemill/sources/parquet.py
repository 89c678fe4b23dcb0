"""Parquet files, directories and globs, with Hive partitions and schema checks."""

from __future__ import annotations

import datetime
import re
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import StorageError

SCHEMES = {"", "file", "s3", "s3a", "gs", "gcs", "abfs", "abfss", "az", "hdfs", "viewfs"}
_SEGMENT = re.compile(r"([A-Za-z_][A-Za-z0-9_]*)=(.*)")


def _check_root(path: str, root: str | None) -> None:
    if root is None or urlparse(path).scheme not in ("", "file"):
        return
    full = Path(urlparse(path).path if path.startswith("file:") else path).resolve()
    if not full.is_relative_to(Path(root).resolve()):
        raise StorageError(f"{path} is outside of {root}")


def resolve_files(spark: SparkSession, paths: list[str], root: str | None = None) -> list[str]:
    """Parquet files behind files, directories (recursive) and globs (last segment), sorted, without repeats."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found: set[str] = set()
    for spec in paths:
        scheme = urlparse(spec).scheme
        if scheme not in SCHEMES:
            raise StorageError(f"no store for scheme {scheme!r}: {spec}")
        _check_root(spec, root)
        head, _, last = spec.rstrip("/").rpartition("/")
        if re.search(r"[*?]", head):
            raise StorageError(f"a glob may stand in the last segment only: {spec}")
        at = jvm.org.apache.hadoop.fs.Path(spec)
        fs = at.getFileSystem(conf)
        glob = bool(re.search(r"[*?]", last))
        if glob and re.search(r"[\[\]{}\\]", last):
            raise StorageError(f"a glob knows * and ? only: {spec}")
        statuses = list(fs.globStatus(at) or []) if glob else [fs.getFileStatus(at)] if fs.exists(at) else []
        own: set[str] = set()
        for status in statuses:
            if status.isDirectory():
                if glob:
                    continue
                files = fs.listFiles(status.getPath(), True)
                while files.hasNext():
                    name = files.next().getPath().toString()
                    if name.endswith(".parquet"):
                        own.add(name)
            elif status.getPath().getName().endswith(".parquet"):
                own.add(status.getPath().toString())
            elif not glob:
                raise StorageError(f"not a .parquet file: {spec}")
        if not own:
            raise StorageError(f"no Parquet files match {spec}")
        found |= own
    return sorted(found)


def hive_values(file: str) -> list[tuple[str, str]]:
    """Trailing key=value directories of a file, outermost first."""
    out: list[tuple[str, str]] = []
    for part in reversed(urlparse(file).path.split("/")[:-1]):
        m = _SEGMENT.fullmatch(unquote(part))
        if not m:
            break
        out.append((m[1], m[2]))
    return out[::-1]


def _hive_type(values: list[str]) -> T.DataType:
    if all(re.fullmatch(r"-?\d{1,18}", v) for v in values):
        return T.LongType()
    try:
        for v in values:
            if datetime.date.fromisoformat(v).isoformat() != v:
                return T.StringType()
    except ValueError:
        return T.StringType()
    return T.DateType()


def check_schemas(spark: SparkSession, files: list[str]) -> None:
    """All files must have one schema: names, order and types. Footers are read by the executors, every file's."""
    if len(files) < 2:
        return

    def columns(file: str) -> list[tuple[str, T.DataType]]:
        return [(f.name, f.dataType) for f in spark.read.parquet(file).schema]

    first = columns(files[0])
    # a merged schema hides a file that lacks a column, so each file is asked; the jobs run beside each other
    with ThreadPoolExecutor(min(64, max(8, spark.sparkContext.defaultParallelism))) as pool:
        for file, own in zip(files[1:], pool.map(columns, files[1:]), strict=True):
            if own != first:
                pool.shutdown(wait=False, cancel_futures=True)
                raise StorageError(f"schema of {file} differs from {files[0]}: {T.StructType([T.StructField(*c) for c in first]).simpleString()}")


def read_parquet(spark: SparkSession, *paths: str, root: str | None = None, strict: bool = True) -> DataFrame:
    """One table over all files; Hive partition columns come last, as BIGINT, DATE or STRING."""
    files = resolve_files(spark, list(paths), root)
    layout = [hive_values(f) for f in files]
    keys = [k for k, _ in layout[0]]
    if any([k for k, _ in x] != keys for x in layout):
        raise StorageError("files disagree on their partition columns")
    if strict:
        check_schemas(spark, files)
    if not keys:
        return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(*(paths if all(not re.search(r"[*?]", p) for p in paths) else files))
    types = {k: _hive_type([x[i][1] for x in layout]) for i, k in enumerate(keys)}
    own = spark.read.option("recursiveFileLookup", "true").parquet(files[0]).schema
    clash = set(own.names) & set(keys)
    if clash:
        raise StorageError(f"partition column in the files too: {sorted(clash)}")
    schema = T.StructType([*own.fields, *(T.StructField(k, t) for k, t in types.items())])
    bases = {f.rsplit("/", len(keys) + 1)[0] for f in files}
    if len(bases) == 1:
        return spark.read.schema(schema).option("basePath", bases.pop()).parquet(*sorted({f.rsplit("/", 1)[0] for f in files}))
    parts = [spark.read.schema(schema).option("basePath", b).parquet(*sorted({f.rsplit("/", 1)[0] for f in files if f.startswith(b + "/")})) for b in sorted(bases)]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.select(*[F.col(c) for c in schema.names])


def inspect(path: str) -> dict:
    """Footer of one local file: schema, rows, and statistics of its row groups."""
    import pyarrow.parquet as pq

    meta = pq.read_metadata(path.removeprefix("file:"))
    groups = []
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        columns = []
        for c in range(group.num_columns):
            column = group.column(c)
            stats = column.statistics
            known = stats is not None and stats.has_min_max
            columns.append(
                {
                    "name": column.path_in_schema,
                    "type": column.physical_type,
                    "codec": column.compression,
                    "min": stats.min if known else None,
                    "max": stats.max if known else None,
                    "nulls": stats.null_count if stats is not None and stats.has_null_count else None,
                }
            )
        groups.append({"rows": group.num_rows, "bytes": group.total_byte_size, "columns": columns})
    schema = meta.schema.to_arrow_schema()
    return {"path": path, "rows": meta.num_rows, "schema": [{"name": f.name, "type": str(f.type), "nullable": f.nullable} for f in schema], "row_groups": groups}
