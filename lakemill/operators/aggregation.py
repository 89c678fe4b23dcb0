"""Scalar and grouped aggregation."""

ENTRIES = {
    "agg_scalar_all": "SELECT CAST(SUM(p_size) AS BIGINT) AS sum_size, COUNT(p_size) AS n, COUNT(*) AS n_rows, MIN(p_name) AS first_name, MAX(p_retailprice) AS top_price, ROUND(AVG(p_retailprice), 6) AS mean_price FROM part",
    "agg_empty_input": "SELECT SUM(o_totalprice) AS total, COUNT(o_totalprice) AS n, COUNT(*) AS n_rows, MIN(o_orderkey) AS low, MAX(o_orderkey) AS high, AVG(o_totalprice) AS mean FROM orders WHERE 1 = 0",
    "agg_empty_groups": "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE 1 = 0 GROUP BY o_orderstatus",
    "agg_count_star_only": "SELECT COUNT(*) AS n FROM lineitem",
    "agg_grouped_sum": "SELECT l_returnflag, ROUND(SUM(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_returnflag",
    "agg_grouped_sum_int": "SELECT p_brand, CAST(SUM(p_size) AS BIGINT) AS total FROM part GROUP BY p_brand",
    "agg_grouped_count": "SELECT p_brand, COUNT(CASE WHEN p_size > 25 THEN p_size END) AS n FROM part GROUP BY p_brand",
    "agg_grouped_count_star": "SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment",
    "agg_grouped_min": "SELECT p_brand, MIN(p_name) AS low_name, MIN(p_retailprice) AS low_price FROM part GROUP BY p_brand",
    "agg_grouped_max": "SELECT o_orderstatus, MAX(o_orderdate) AS last_date, MAX(o_orderpriority) AS priority FROM orders GROUP BY o_orderstatus",
    "agg_grouped_avg": "SELECT c_mktsegment, ROUND(AVG(c_acctbal), 6) AS mean FROM customer GROUP BY c_mktsegment",
    "agg_avg_int": "SELECT p_brand, ROUND(AVG(p_size), 6) AS mean FROM part GROUP BY p_brand",
    "agg_expr_arg": "SELECT l_linestatus, ROUND(SUM(l_extendedprice * (1e0 - l_discount) * (1e0 + l_tax)), 2) AS charge FROM lineitem GROUP BY l_linestatus",
    "agg_arith_ratio": "SELECT l_returnflag, ROUND(100e0 * SUM(l_discount) / SUM(l_tax), 6) AS ratio FROM lineitem GROUP BY l_returnflag",
    "agg_case_arg": "SELECT l_returnflag, ROUND(SUM(CASE WHEN l_quantity > 25e0 THEN l_extendedprice ELSE 0e0 END), 2) AS bulk FROM lineitem GROUP BY l_returnflag",
    "agg_like_arg": "SELECT p_brand, CAST(SUM(CASE WHEN p_name LIKE '%widget%' THEN 1 ELSE 0 END) AS BIGINT) AS widgets FROM part GROUP BY p_brand",
    "agg_extract_arg": "SELECT o_orderstatus, CAST(MAX(EXTRACT(YEAR FROM o_orderdate)) AS BIGINT) AS last_year FROM orders GROUP BY o_orderstatus",
    "agg_same_twice": "SELECT p_brand, COUNT(*) AS n, COUNT(*) + 1 AS n_and_one, CAST(SUM(p_size) AS BIGINT) AS total, CAST(SUM(p_size) * 2 AS BIGINT) AS twice FROM part GROUP BY p_brand",
    "agg_multi_key": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_high_cardinality": "SELECT l_orderkey, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS quantity FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey",
    "agg_all_null": "SELECT p_brand, SUM(CASE WHEN p_size > 1000 THEN p_retailprice END) AS none, MIN(CASE WHEN p_size > 1000 THEN p_name END) AS no_name FROM part GROUP BY p_brand",
    "group_by_alias_case": "SELECT CASE WHEN p_size < 25 THEN 'small' ELSE 'large' END AS class, COUNT(*) AS n FROM part GROUP BY class",
    "group_by_alias_extract": "SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS y, COUNT(*) AS n FROM orders GROUP BY y",
    "group_by_alias_like": "SELECT p_name LIKE '%widget%' AS widget, COUNT(*) AS n FROM part GROUP BY widget",
    "group_by_base_column_wins": "SELECT MAX(p_size) AS p_size_max, p_brand FROM part GROUP BY p_brand",
    "having_literal": "SELECT p_brand, COUNT(*) AS n FROM part GROUP BY p_brand HAVING COUNT(*) > 80",
    "having_agg_not_selected": "SELECT p_brand FROM part GROUP BY p_brand HAVING MAX(p_retailprice) > 1900e0 AND MIN(p_size) = 1",
    "having_alias_and_key": "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus HAVING o_orderstatus <> 'P'",
    "agg_null_group_key": "SELECT CASE WHEN p_size > 25 THEN p_brand END AS brand, COUNT(*) AS n FROM part GROUP BY brand",
    "sum_decimal": "SELECT l_returnflag, CAST(SUM(CAST(l_quantity AS DECIMAL(12,2))) AS DECIMAL(12,2)) AS quantity FROM lineitem GROUP BY l_returnflag",
    "min_max_decimal": "SELECT l_linestatus, MIN(CAST(l_quantity AS DECIMAL(12,2))) AS low, MAX(CAST(l_quantity AS DECIMAL(12,2))) AS high FROM lineitem GROUP BY l_linestatus",
    "min_max_boolean": "SELECT p_brand, MIN(p_size > 25) AS all_large, MAX(p_size > 25) AS any_large FROM part GROUP BY p_brand",
    "sum_decimal_scalar": "SELECT CAST(SUM(CAST(l_tax AS DECIMAL(14,3))) AS DECIMAL(14,3)) AS tax, COUNT(*) AS n FROM lineitem",
    "sum_decimal_having": "SELECT l_returnflag, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag HAVING CAST(SUM(CAST(l_quantity AS DECIMAL(12,2))) AS DECIMAL(12,2)) > CAST(100 AS DECIMAL(12,2))",
}
