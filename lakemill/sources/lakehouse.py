"""Iceberg, Delta and Unity Catalog tables, through Spark's connectors where they are installed."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession

from ..errors import ConfigurationError, SqlError, StorageError
from .parquet import read_parquet

_ICEBERG = "org.apache.iceberg.spark.SparkCatalog"
_DELTA = "io.delta.sql.DeltaSparkSessionExtension"


def _installed(spark: SparkSession, name: str) -> bool:
    try:
        spark.sparkContext._jvm.java.lang.Class.forName(name, False, spark.sparkContext._jvm.Thread.currentThread().getContextClassLoader())
    except Exception:
        return False
    return True


def iceberg_settings(name: str, uri: str, token: str | None = None, credential: str | None = None) -> dict[str, str]:
    """Session settings of a REST catalogue, without login, with a bearer token, or with client credentials."""
    out = {f"spark.sql.catalog.{name}": _ICEBERG, f"spark.sql.catalog.{name}.type": "rest", f"spark.sql.catalog.{name}.uri": uri}
    if token:
        out[f"spark.sql.catalog.{name}.token"] = token
    if credential:
        out[f"spark.sql.catalog.{name}.credential"] = credential
    return out


def read_iceberg(spark: SparkSession, *names: str, **_: object) -> DataFrame:
    """read_iceberg('catalog.namespace[.…].table')."""
    if len(names) != 1:
        raise SqlError("read_iceberg takes one table name")
    parts = names[0].split(".")
    if len(parts) < 3 or not all(parts):
        raise SqlError(f"read_iceberg needs catalog.namespace.table: {names[0]!r}")
    if not _installed(spark, _ICEBERG):
        raise ConfigurationError("the Iceberg connector is not installed")
    if spark.conf.get(f"spark.sql.catalog.{parts[0]}", None) is None:
        raise ConfigurationError(f"no catalogue {parts[0]!r} is configured")
    return spark.table(".".join(f"`{p}`" for p in parts))


def read_delta(spark: SparkSession, *uris: str, **_: object) -> DataFrame:
    """read_delta('uri'); partition columns come last."""
    if len(uris) != 1:
        raise SqlError("read_delta takes one table URI")
    if not _installed(spark, _DELTA):
        raise ConfigurationError("the Delta connector is not installed")
    table = spark.read.format("delta").load(uris[0])
    keys = spark.sql(f"DESCRIBE DETAIL delta.`{uris[0]}`").first()["partitionColumns"]
    return table.select(*[c for c in table.columns if c not in keys], *keys)


def _fetch(url: str, token: str | None) -> dict:
    request = Request(url, headers={"Authorization": f"Bearer {token}"} if token else {})
    with urlopen(request, timeout=30) as answer:
        return json.load(answer)


def storage_settings(location: str, granted: dict) -> dict[str, str]:
    """Hadoop settings of vended credentials for a storage location."""
    bucket = re.match(r"\w+://(?:[^@/]+@)?([^/]+)", location)
    name = bucket[1] if bucket else ""
    if aws := granted.get("aws_temp_credentials"):
        base = f"fs.s3a.bucket.{name}"
        return {
            f"{base}.aws.credentials.provider": "org.apache.hadoop.fs.s3a.TemporaryAWSCredentialsProvider",
            f"{base}.access.key": aws["access_key_id"],
            f"{base}.secret.key": aws["secret_access_key"],
            f"{base}.session.token": aws["session_token"],
        }
    if azure := granted.get("azure_user_delegation_sas"):
        return {f"fs.azure.account.auth.type.{name}": "SAS", f"fs.azure.sas.fixed.token.{name}": azure["sas_token"]}
    if gcp := granted.get("gcp_oauth_token"):
        return {"fs.gs.auth.access.token": gcp["oauth_token"]}
    return {}


class UnityCatalog:
    """The REST interface of a Unity Catalog server."""

    def __init__(self, url: str, token: str | None = None, fetch: Callable[[str, str | None], dict] = _fetch):
        self._url, self._token, self._fetch = url.rstrip("/"), token, fetch

    def _get(self, path: str) -> dict:
        return self._fetch(f"{self._url}/api/2.1/unity-catalog/{path}", self._token)

    def _all(self, path: str, key: str) -> list[str]:
        out, page = [], ""
        while True:
            got = self._get(path + (("&" if "?" in path else "?") + f"page_token={page}" if page else ""))
            out += [x["name"] for x in got.get(key, [])]
            page = got.get("next_page_token") or ""
            if not page:
                return out

    def catalogs(self) -> list[str]:
        return self._all("catalogs", "catalogs")

    def schemas(self, catalog: str) -> list[str]:
        return self._all(f"schemas?catalog_name={catalog}", "schemas")

    def tables(self, catalog: str, schema: str) -> list[str]:
        return self._all(f"tables?catalog_name={catalog}&schema_name={schema}", "tables")

    def table(self, name: str) -> dict:
        return self._get(f"tables/{name}")

    def credentials(self, table_id: str) -> dict:
        return self._get(f"temporary-table-credentials?table_id={table_id}&operation=READ")


def read_unity_catalog(spark: SparkSession, *names: str, servers: dict[str, UnityCatalog] | None = None, root: str | None = None, **_: object) -> DataFrame:
    """read_unity_catalog('server.catalog.schema.table'): the table's format decides how it is read."""
    if len(names) != 1:
        raise SqlError("read_unity_catalog takes one table name")
    parts = names[0].split(".")
    if len(parts) != 4 or not all(parts):
        raise SqlError(f"read_unity_catalog needs server.catalog.schema.table: {names[0]!r}")
    if not servers or parts[0] not in servers:
        raise ConfigurationError(f"no Unity Catalog server {parts[0]!r} is configured")
    server = servers[parts[0]]
    table = server.table(".".join(parts[1:]))
    location, form = table.get("storage_location", ""), (table.get("data_source_format") or "PARQUET").upper()
    if re.match(r"(s3a?|gs|abfss?)://", location):
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for key, value in storage_settings(location, server.credentials(table["table_id"])).items():
            conf.set(key, value)
    if form == "PARQUET":
        return read_parquet(spark, location, root=root)
    if form == "DELTA":
        return read_delta(spark, location)
    if form == "ICEBERG":
        return read_iceberg(spark, ".".join(parts[1:]))
    raise StorageError(f"tables of format {form} are not supported")
