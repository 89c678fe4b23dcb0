"""Sort, limit and top-k. Order shows through limits; ties end in a unique key."""

ENTRIES = {
    "order_by_asc": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal ASC NULLS LAST, c_custkey ASC NULLS LAST LIMIT 25",
    "order_by_desc": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS FIRST, c_custkey ASC NULLS LAST LIMIT 25",
    "order_by_multi": "SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_brand ASC NULLS LAST, p_size DESC NULLS FIRST, p_partkey ASC NULLS LAST LIMIT 40",
    "order_by_hidden_column": "SELECT p_partkey FROM part ORDER BY p_retailprice DESC NULLS FIRST, p_partkey ASC NULLS LAST LIMIT 15",
    "order_by_expression": "SELECT p_partkey, p_size FROM part ORDER BY p_size * p_retailprice DESC NULLS FIRST, p_partkey ASC NULLS LAST LIMIT 15",
    "order_by_aggregate_output": "SELECT p_brand, COUNT(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC NULLS FIRST, p_brand ASC NULLS LAST LIMIT 7",
    "order_nulls_asc": "SELECT p_partkey, CASE WHEN p_size = 50 THEN p_size END AS s FROM part ORDER BY CASE WHEN p_size = 50 THEN p_size END ASC NULLS LAST, p_partkey ASC NULLS LAST LIMIT 80",
    "order_nulls_desc": "SELECT p_partkey, CASE WHEN p_size > 1 THEN p_size END AS s FROM part ORDER BY CASE WHEN p_size > 1 THEN p_size END DESC NULLS FIRST, p_partkey ASC NULLS LAST LIMIT 80",
    "limit_n": "SELECT n_nationkey FROM nation ORDER BY n_nationkey ASC NULLS LAST LIMIT 10",
    "limit_zero": "SELECT o_orderkey, o_totalprice FROM orders LIMIT 0",
    "limit_beyond_rows": "SELECT r_regionkey, r_name FROM region LIMIT 100",
    "topk": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC NULLS FIRST, l_orderkey ASC NULLS LAST, l_linenumber ASC NULLS LAST LIMIT 100",
}
