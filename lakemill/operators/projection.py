"""Projection and filter."""

ENTRIES = {
    "scan_project": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem",
    "select_star_nation": "SELECT * FROM nation",
    "project_alias": "SELECT p_partkey AS part_id, p_size AS size_class, p_retailprice AS price FROM part",
    "filter_compare_eq": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'",
    "filter_compare_ne": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'",
    "filter_compare_lt": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity < 5e0",
    "filter_compare_le": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity <= 5e0",
    "filter_compare_gt": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45e0",
    "filter_compare_ge": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45e0",
    "filter_and_or_not": "SELECT p_partkey, p_size, p_brand FROM part WHERE (p_size < 10 OR p_size > 40) AND NOT (p_brand = 'Brand#1')",
    "filter_null_or_true": "SELECT p_partkey FROM part WHERE (CASE WHEN p_size > 25 THEN p_size END) > 30 OR p_brand = 'Brand#2'",
    "filter_between": "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount BETWEEN 0.03e0 AND 0.05e0",
    "filter_not_between": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity NOT BETWEEN 5e0 AND 45e0",
    "filter_in_list": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
    "filter_not_in_list": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')",
    "filter_in_expressions": "SELECT p_partkey, p_size FROM part WHERE p_size IN (1 + 1, 2 * 5, 49)",
    "filter_like": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%widget%'",
    "filter_like_underscore": "SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE 'Brand#1_'",
    "filter_not_like": "SELECT p_partkey, p_name FROM part WHERE p_name NOT LIKE 'red%'",
    "filter_is_null": "SELECT p_partkey FROM part WHERE (CASE WHEN p_size > 25 THEN p_size END) IS NULL",
    "filter_is_not_null": "SELECT p_partkey FROM part WHERE (CASE WHEN p_size > 25 THEN p_size END) IS NOT NULL",
    "filter_case_where": "SELECT o_orderkey FROM orders WHERE CASE WHEN o_orderstatus = 'O' THEN o_totalprice > 100000e0 ELSE o_totalprice < 50000e0 END",
    "filter_always_false": "SELECT o_orderkey, o_custkey FROM orders WHERE 1 = 0",
    "filter_always_true": "SELECT n_nationkey, n_name FROM nation WHERE 1 = 1",
    "filter_timestamp_range": "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= @ts'1996-01-01' AND o_orderdate < @ts'1996-04-01'",
    "filter_date_cast": "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1998-06-01'",
    "filter_literal_left": "SELECT n_nationkey FROM nation WHERE 10 < n_nationkey",
    "filter_column_to_column": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax > l_discount",
}
