"""Non-correlated subqueries: scalar in HAVING, IN and NOT IN in WHERE."""

ENTRIES = {
    "having_scalar_subquery": "SELECT p_brand, ROUND(AVG(p_retailprice), 6) AS mean FROM part GROUP BY p_brand HAVING AVG(p_retailprice) > (SELECT AVG(p_retailprice) FROM part)",
    "having_subquery_between": "SELECT p_brand, COUNT(*) AS n FROM part GROUP BY p_brand HAVING COUNT(*) BETWEEN (SELECT COUNT(*) FROM region) AND (SELECT COUNT(*) FROM part WHERE p_size < 3)",
    "having_subquery_case": "SELECT p_brand, COUNT(*) AS n FROM part GROUP BY p_brand HAVING CASE WHEN p_brand = 'Brand#1' THEN COUNT(*) > (SELECT COUNT(*) FROM region) ELSE COUNT(*) > (SELECT COUNT(*) FROM nation) END",
    "having_subquery_null": "SELECT p_brand, COUNT(*) AS n FROM part GROUP BY p_brand HAVING MAX(p_retailprice) > (SELECT MAX(o_totalprice) FROM orders WHERE 1 = 0)",
    "in_subquery": "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')",
    "in_subquery_grouped": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING SUM(l_quantity) > 250e0)",
    "in_subquery_empty": "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE 1 = 0)",
    "not_in_subquery": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "not_in_subquery_empty": "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE 1 = 0)",
    "not_in_subquery_null": "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN p_size > 3 THEN p_size END FROM part)",
    "nested_subquery": "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2))",
    "nested_having_subquery": "SELECT p_brand, COUNT(*) AS n FROM part GROUP BY p_brand HAVING COUNT(*) > (SELECT COUNT(*) FROM nation WHERE n_nationkey IN (SELECT r_regionkey FROM region))",
}
