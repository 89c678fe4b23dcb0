"""Scalar expressions."""

ENTRIES = {
    "arith_add": "SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS total FROM lineitem",
    "arith_sub": "SELECT l_orderkey, l_linenumber, l_extendedprice - l_quantity AS rest FROM lineitem",
    "arith_mul": "SELECT l_orderkey, l_linenumber, l_extendedprice * (1e0 - l_discount) AS net FROM lineitem",
    "arith_div": "SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS unit FROM lineitem",
    "int_div_trunc": "SELECT p_partkey, {p_size // 7} AS sevens, {(-p_size) // 7} AS negative_sevens FROM part",
    "int_arith_promotion": "SELECT p_partkey, CAST(p_size + p_partkey AS BIGINT) AS both, CAST(p_size * 2 AS BIGINT) AS twice FROM part",
    "mixed_arith_promotion": "SELECT p_partkey, p_size * p_retailprice AS weighted, p_partkey + 0.5e0 AS half FROM part",
    "unary_negate": "SELECT c_custkey, -c_acctbal AS owed, -c_nationkey AS minus_nation FROM customer",
    "case_searched": "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS class FROM part",
    "case_simple": "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END AS code FROM orders",
    "case_no_else": "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size END AS large_size FROM part",
    "case_mixed_numbers": "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_retailprice ELSE CAST(p_size AS DOUBLE) END AS value FROM part",
    "cast_bigint": "SELECT l_orderkey, l_linenumber, {trunc l_extendedprice} AS whole, {trunc -l_extendedprice} AS negative FROM lineitem",
    "cast_int": "SELECT p_partkey, CAST({trunc p_retailprice} AS INT) AS whole FROM part",
    "cast_double": "SELECT p_partkey, CAST(p_size AS DOUBLE) AS size_double FROM part",
    "cast_float": "SELECT p_partkey, CAST(CAST(p_size AS FLOAT) AS DOUBLE) AS size_float FROM part",
    "cast_boolean": "SELECT p_partkey, CAST(p_size - 1 AS BOOLEAN) AS larger FROM part",
    "cast_date": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders",
    "cast_timestamp": "SELECT o_orderkey, CAST(o_orderdate AS DATE) = CAST('1996-01-02' AS DATE) AS that_day FROM orders",
    "cast_decimal": "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DECIMAL(12,2)) AS quantity FROM lineitem",
    "cast_varchar": "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR(20)) AS key_text FROM orders",
    "extract_year": "SELECT o_orderkey, CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS y FROM orders",
    "extract_month": "SELECT o_orderkey, CAST(EXTRACT(MONTH FROM o_orderdate) AS BIGINT) AS m FROM orders",
    "extract_day": "SELECT o_orderkey, CAST(EXTRACT(DAY FROM o_orderdate) AS BIGINT) AS d FROM orders",
    "extract_from_date": "SELECT o_orderkey, CAST(EXTRACT(YEAR FROM CAST(o_orderdate AS DATE)) AS BIGINT) AS y FROM orders",
    "literal_kinds": "SELECT n_nationkey, CAST(42 AS BIGINT) AS i, 1.5e0 AS d, 'text' AS s, TRUE AS t, FALSE AS f, DATE '1998-12-01' AS day, CAST(NULL AS BIGINT) AS n FROM nation",
    "like_in_select": "SELECT p_partkey, p_name LIKE '%gadget%' AS is_gadget FROM part",
    "boolean_in_select": "SELECT p_partkey, p_size > 10 AND p_size < 20 AS middle, NOT (p_size = 1) AS more FROM part",
    "null_comparison": "SELECT p_partkey, (CASE WHEN p_size > 25 THEN p_size END) = 30 AS thirty FROM part",
    "literal_strings": r"SELECT n_nationkey, 'a / b' AS slash, 'it''s' AS quote, 'C:\new\\' AS backslash, 'read_parquet(''x'') -- no comment' AS call FROM nation",
    "filter_string_with_slash": "SELECT n_nationkey FROM nation WHERE n_name <> 'a / b' AND n_name <> 'a DIV b'",
    "like_backslash": r"SELECT n_nationkey, 'a\b_c' LIKE 'a\b%' AS plain, n_name LIKE '\%' AS none FROM nation",
    "like_null": "SELECT p_partkey, (CASE WHEN p_size > 25 THEN p_name END) LIKE '%widget%' AS is_widget FROM part",
    "int_div_of_literals": "SELECT n_nationkey, {7 // 2} AS three, {(0 - 7) // 2} AS minus_three, {n_nationkey // 2} AS half, n_nationkey / 2e0 AS real_half FROM nation",
    "int_div_in_aggregate": "SELECT p_brand, {SUM(p_size) // COUNT(*)} AS mean_size, ROUND(SUM(p_retailprice) / COUNT(*), 6) AS mean_price FROM part GROUP BY p_brand",
}
