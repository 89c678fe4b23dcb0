"""Sources: table functions resolved to DataFrames."""

from .lakehouse import read_delta, read_iceberg, read_unity_catalog
from .parquet import inspect, read_parquet, resolve_files

READERS = {"read_parquet": read_parquet, "read_iceberg": read_iceberg, "read_delta": read_delta, "read_unity_catalog": read_unity_catalog}

__all__ = ["READERS", "inspect", "read_delta", "read_iceberg", "read_parquet", "read_unity_catalog", "resolve_files"]
