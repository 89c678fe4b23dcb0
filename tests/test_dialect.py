"""What the dialect takes and refuses."""

import re

import pytest

from lakemill.errors import BindingError, ConfigurationError, SqlError, StorageError
from lakemill.plans.dialect import check_tree, rewrite

P = "read_parquet('/x/a.parquet')"

REFUSED = {
    "distinct": f"SELECT DISTINCT a FROM {P}",
    "left join": f"SELECT l.a FROM {P} AS l LEFT JOIN {P} AS r ON l.k = r.k",
    "cross join": f"SELECT l.a FROM {P} AS l CROSS JOIN {P} AS r",
    "comma": f"SELECT l.a FROM {P} AS l, {P} AS r",
    "join without on": f"SELECT l.a FROM {P} AS l JOIN {P} AS r",
    "two equalities": f"SELECT l.a FROM {P} AS l JOIN {P} AS r ON l.k = r.k AND l.j = r.j",
    "inequality": f"SELECT l.a FROM {P} AS l JOIN {P} AS r ON l.k < r.k",
    "computed key": f"SELECT l.a FROM {P} AS l JOIN {P} AS r ON l.k + 1 = r.k",
    "function": f"SELECT upper(a) AS u FROM {P}",
    "bare table": "SELECT a FROM t",
    "union": f"SELECT a FROM {P} UNION SELECT a FROM {P}",
    "with": f"WITH t AS (SELECT a FROM {P}) SELECT a FROM t",
    "count distinct": f"SELECT COUNT(DISTINCT a) AS n FROM {P}",
    "derived table": f"SELECT a FROM (SELECT a FROM {P}) t",
    "offset": f"SELECT a FROM {P} LIMIT 5 OFFSET 2",
    "extract hour": f"SELECT EXTRACT(HOUR FROM d) AS h FROM {P}",
    "modulo": f"SELECT a % 2 AS m FROM {P}",
    "concat": f"SELECT a || b AS m FROM {P}",
    "scalar subquery in select": f"SELECT (SELECT MAX(a) FROM {P}) AS m FROM {P}",
    "scalar subquery in where": f"SELECT a FROM {P} WHERE a = (SELECT MAX(a) FROM {P})",
    "exists": f"SELECT a FROM {P} WHERE EXISTS (SELECT a FROM {P})",
    "insert": "INSERT INTO t VALUES (1)",
    "group by expression": f"SELECT COUNT(*) AS n FROM {P} GROUP BY a + 1",
    "window": f"SELECT SUM(a) OVER (PARTITION BY b) AS s FROM {P}",
    "ilike": f"SELECT a FROM {P} WHERE b ILIKE 'x'",
    "like column": f"SELECT a FROM {P} WHERE b LIKE c",
    "nulls first": f"SELECT a FROM {P} ORDER BY a NULLS FIRST",
    "two statements": f"SELECT a FROM {P}; SELECT a FROM {P}",
    "unbalanced": f"SELECT (a FROM {P}",
    "no argument": "SELECT a FROM read_parquet()",
    "depth": f"SELECT {'(' * 501}a{')' * 501} FROM {P}",
    "length": f"SELECT a FROM {P} WHERE b = '{'x' * (1 << 20)}'",
    "joins": f"SELECT a FROM {P} AS s " + f"JOIN {P} AS t ON s.k = t.k " * 65,
    "sources": f"SELECT a FROM {P} AS s " + f"JOIN {P} AS t ON s.k = t.k " * 12,
}


def _gate(spark, text):
    made = rewrite(text)
    check_tree(spark, re.sub(r"\{(source_\d+)\}", r"\1", made.sql))
    return made


@pytest.mark.parametrize("what", REFUSED)
def test_refuses(spark, what):
    with pytest.raises(SqlError):
        _gate(spark, REFUSED[what])


def test_takes_the_whole_dialect(spark):
    text = f"""SELECT l.a, SUM(l.b * (1 - l.c)) AS s, CASE l.a WHEN 1 THEN 'x' ELSE 'it''s' END AS t FROM {P} AS l JOIN {P} AS r ON l.k = r.k
        WHERE l.d BETWEEN DATE '1998-01-01' AND DATE '1998-02-01' AND l.e NOT IN (1, 2) AND l.f IN (SELECT g FROM {P}) AND NOT (l.h LIKE '%x_')
          AND l.i IS NOT NULL GROUP BY l.a, t HAVING SUM(l.b) > (SELECT AVG(b) FROM {P}) ORDER BY s DESC, a LIMIT 10"""
    made = _gate(spark, text)
    assert len(made.sources) == 4
    assert "s DESC NULLS FIRST" in made.sql and "a NULLS LAST LIMIT 10" in made.sql and "1L -" in made.sql


def test_table_functions_inside_strings_stay(spark):
    assert len(_gate(spark, f"SELECT 'read_parquet(''x'')' AS s FROM {P}").sources) == 1


def test_engine_semantics(spark, data, tmp_path):
    from lakemill.api import Engine

    keep = {k: spark.conf.get(k) for k in ("spark.sql.caseSensitive", "spark.sql.orderByOrdinal", "spark.sql.groupByOrdinal")}
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        engine = Engine(spark)
        part, orders = (f"read_parquet('{data}/{t}.parquet')" for t in ("part", "orders"))
        got = engine.sql(f"SELECT p_partkey, -p_size / 7 AS i, p_retailprice / 2 AS d FROM {part}").toArrow().to_pylist()
        assert all(isinstance(r["i"], int) and isinstance(r["d"], float) for r in got)
        years = engine.sql(f"SELECT EXTRACT(YEAR FROM o_orderdate) AS y, COUNT(*) AS n FROM {orders} GROUP BY y ORDER BY y LIMIT 2")
        assert [f.dataType.simpleString() for f in years.schema] == ["bigint", "bigint"]
        for text in (
            f"SELECT p_size FROM {part} WHERE p_name = 3",
            f"SELECT o_orderkey FROM {orders} WHERE o_orderdate > DATE '1998-01-01'",
            f"SELECT p.p_size FROM {part} AS p",
            f"SELECT p_size, p_size FROM {part}",
            f"SELECT P_SIZE FROM {part}",
            f"SELECT AVG(CAST(p_size AS DECIMAL(10,2))) AS a FROM {part}",
        ):
            with pytest.raises(BindingError):
                engine.sql(text)
        with pytest.raises(StorageError):
            Engine(spark, root=str(tmp_path)).sql(f"SELECT p_size FROM {part}")
        for text in ("SELECT a FROM read_iceberg('a.b.c')", "SELECT a FROM read_delta('/x')", "SELECT a FROM read_unity_catalog('a.b.c.d')"):
            with pytest.raises(ConfigurationError):
                engine.sql(text)
        with pytest.raises(SqlError):
            engine.sql("SELECT a FROM read_iceberg('a.b')")
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def _engine(spark):
    from lakemill.api import Engine

    return Engine(spark)


def test_the_given_session_keeps_its_settings(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.caseSensitive", "spark.sql.orderByOrdinal")}
    engine = _engine(spark)
    assert engine.spark.conf.get("spark.sql.caseSensitive") == "true"
    assert {k: spark.conf.get(k) for k in before} == before


def test_strings_as_written(spark, data):
    nation = f"read_parquet('{data}/nation.parquet')"
    row = _engine(spark).sql(rf"SELECT 'a / b' AS s, 'it''s' AS q, 'C:\new' AS p, 6 / 4 AS d FROM {nation} LIMIT 1").first()
    assert tuple(row) == ("a / b", "it's", "C:\\new", 1)


def test_decimal_sums_keep_their_type(spark, data):
    lineitem = f"read_parquet('{data}/lineitem.parquet')"
    text = f"""SELECT l_returnflag, SUM(CAST(l_quantity AS DECIMAL(12,2))) AS s, SUM(l_linenumber) AS n FROM {lineitem} GROUP BY l_returnflag
        HAVING SUM(CAST(l_tax AS DECIMAL(14,3))) > (SELECT MIN(CAST(l_tax AS DECIMAL(14,3))) FROM {lineitem})"""
    assert [f.dataType.simpleString() for f in _engine(spark).sql(text).schema] == ["string", "decimal(12,2)", "bigint"]


def test_a_scalar_subquery_gives_one_row(spark, data):
    part = f"read_parquet('{data}/part.parquet')"
    text = "SELECT p_brand, COUNT(*) AS n FROM {0} GROUP BY p_brand HAVING COUNT(*) > (SELECT p_size FROM {0} WHERE p_partkey {1})"
    assert _engine(spark).sql(text.format(part, "= 1")).count() >= 0
    for condition in ("< 0", "< 3"):
        with pytest.raises(Exception, match="scalar subquery"):
            _engine(spark).sql(text.format(part, condition)).collect()


def test_run_reports_what_was_read(spark, data):
    table, stats = _engine(spark).run(f"SELECT n_name FROM read_parquet('{data}/nation.parquet') WHERE n_nationkey < 5")
    assert table.num_rows == stats.rows == 5 and stats.files_read == 1 and stats.bytes_read > 0 and stats.rows_scanned == 25 and stats.seconds > 0
