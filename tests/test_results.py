import json

import pyarrow as pa

from lakemill.cli import main
from lakemill.datagen import sales
from lakemill.results import as_arrow, as_csv, as_json_lines, as_table

T = pa.table({"a": [1, None], "b": ["x", "y,z"]})


def test_formats():
    assert as_table(T).splitlines()[2:] == ["1     x", "NULL  y,z"]
    assert as_csv(T) == 'a,b\n1,x\n,"y,z"\n'
    assert json.loads(as_json_lines(T).splitlines()[1]) == {"a": None, "b": "y,z"}
    assert pa.ipc.open_file(as_arrow(T)).read_all().equals(T)


def test_sales_depend_on_seed_only(spark):
    a, b = sales(spark, 50, files=1), sales(spark, 50, files=3)
    assert a.exceptAll(b).count() == 0 and sales(spark, 50, seed=1).exceptAll(a).count() > 0
    assert [f.dataType.simpleString() for f in a.schema] == ["bigint", "bigint", "string", "double", "date", "timestamp_ntz", "string", "double"]


def test_command_line(spark, data, tmp_path, capfd):
    assert main(["query", "--sql", f"SELECT r_name FROM read_parquet('{data}/region.parquet') ORDER BY r_name LIMIT 1", "--format", "csv", "--output", str(tmp_path / "o")]) == 0
    assert (tmp_path / "o").read_text() == "r_name\nAFRICA\n"
    assert main(["query", "--sql", "SELECT 1"]) == 1
    assert main(["inspect-parquet", f"{data}/region.parquet"]) == 0
