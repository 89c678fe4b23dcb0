import pytest

from lakemill.errors import StorageError
from lakemill.sources import inspect, read_parquet, read_unity_catalog, resolve_files
from lakemill.sources.lakehouse import UnityCatalog, storage_settings


def _write(spark, at, sql):
    spark.sql(sql).coalesce(1).write.parquet(str(at))


def test_paths(spark, tmp_path):
    _write(spark, tmp_path / "a", "SELECT 1L AS id")
    _write(spark, tmp_path / "b/c", "SELECT 2L AS id")
    assert len(resolve_files(spark, [str(tmp_path), str(tmp_path / "a")])) == 2
    assert sorted(r.id for r in read_parquet(spark, str(tmp_path)).collect()) == [1, 2]
    with pytest.raises(StorageError):
        resolve_files(spark, [str(tmp_path / "none")])
    with pytest.raises(StorageError):
        resolve_files(spark, [f"{tmp_path}/*/part.parquet"])
    with pytest.raises(StorageError):
        resolve_files(spark, ["ftp://x/y.parquet"])
    with pytest.raises(StorageError):
        resolve_files(spark, [str(tmp_path)], root=str(tmp_path / "a"))


def test_schemas_must_agree(spark, tmp_path):
    _write(spark, tmp_path / "a", "SELECT 1L AS id, 2L AS x")
    _write(spark, tmp_path / "b", "SELECT 1L AS id")
    with pytest.raises(StorageError):
        read_parquet(spark, str(tmp_path))
    _write(spark, tmp_path / "c", "SELECT 'x' AS id")
    with pytest.raises(StorageError):
        read_parquet(spark, str(tmp_path / "b"), str(tmp_path / "c"))


def test_one_file_of_many_lacks_a_column(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for k in range(70):
        pq.write_table(pa.table({"id": [k]} if k == 35 else {"id": [k], "x": [k]}), tmp_path / f"f{k:02d}.parquet")
    with pytest.raises(StorageError, match="f35"):
        read_parquet(spark, str(tmp_path))
    (tmp_path / "f35.parquet").unlink()
    assert read_parquet(spark, str(tmp_path)).count() == 69


def test_hive_types(spark, tmp_path):
    spark.sql("SELECT 1L AS id, '2024-01-02' AS day, 7 AS n, 'x' AS s").write.partitionBy("day", "n", "s").parquet(str(tmp_path / "t"))
    out = read_parquet(spark, str(tmp_path / "t"))
    assert [(f.name, f.dataType.simpleString()) for f in out.schema] == [("id", "bigint"), ("day", "date"), ("n", "bigint"), ("s", "string")]
    assert tuple(out.first())[2:] == (7, "x")


def test_inspect(data):
    found = inspect(f"{data}/nation.parquet")
    assert found["rows"] == 25 and found["row_groups"][0]["columns"][0]["max"] == 24


def test_unity_catalog(spark, tmp_path):
    _write(spark, tmp_path / "t", "SELECT 5L AS id")
    pages = {
        "tables/c.s.t": {"storage_location": str(tmp_path / "t"), "data_source_format": "PARQUET", "table_id": "1"},
        "tables/c.s.u": {"storage_location": "/x", "data_source_format": "ORC", "table_id": "2"},
        "catalogs": {"catalogs": [{"name": "c"}], "next_page_token": "p"},
        "catalogs?page_token=p": {"catalogs": [{"name": "d"}]},
    }
    server = UnityCatalog("http://x", fetch=lambda url, token: pages[url.split("unity-catalog/")[1]])
    assert read_unity_catalog(spark, "one.c.s.t", servers={"one": server}).first().id == 5
    assert server.catalogs() == ["c", "d"]
    with pytest.raises(StorageError):
        read_unity_catalog(spark, "one.c.s.u", servers={"one": server})
    got = storage_settings("s3://b/x", {"aws_temp_credentials": {"access_key_id": "a", "secret_access_key": "b", "session_token": "c"}})
    assert got["fs.s3a.bucket.b.session.token"] == "c"
