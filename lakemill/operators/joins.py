"""Inner equi-joins."""

_SIDES = "(SELECT CASE WHEN p_size > 25 THEN p_size END AS k, p_partkey FROM part)"

ENTRIES = {
    "join_inner_2": "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey",
    "join_3": "SELECT c.c_custkey, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey",
    "join_6": "SELECT n.n_name, COUNT(*) AS n, ROUND(SUM(l.l_extendedprice), 2) AS total FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'ASIA' GROUP BY n.n_name",
    "join_self": "SELECT a.n_nationkey AS left_key, b.n_nationkey AS right_key FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey",
    "join_composite_where": "SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_linenumber = b.l_linenumber AND a.l_quantity > 40e0",
    "join_filter_pushdown": "SELECT o.o_orderkey, c.c_custkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderdate >= @ts'1997-01-01' AND o.o_orderdate < @ts'1997-02-01' AND c.c_mktsegment = 'BUILDING'",
    "join_post_filter": "SELECT s.s_suppkey, c.c_custkey FROM supplier s JOIN customer c ON s.s_nationkey = c.c_nationkey WHERE s.s_acctbal > c.c_acctbal + 9000e0",
    "join_same_named_columns": "SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON a.n_nationkey = b.n_regionkey",
    "join_unqualified_unique": "SELECT o_orderkey, c_mktsegment FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o_totalprice > 200000e0",
    "join_null_keys": f"SELECT a.p_partkey AS a_key, b.p_partkey AS b_key FROM {_SIDES} a JOIN {_SIDES} b ON a.k = b.k",
    "join_null_keys_unique_side": "SELECT p.p_partkey, n.n_name FROM (SELECT CASE WHEN p_size <= 24 THEN p_size END AS k, p_partkey FROM part) p JOIN (SELECT CASE WHEN n_nationkey > 3 THEN n_nationkey END AS k, n_name FROM nation) n ON p.k = n.k",
    "join_empty_side": "SELECT o.o_orderkey, c.c_name FROM orders o JOIN (SELECT * FROM customer WHERE 1 = 0) c ON o.o_custkey = c.c_custkey",
    "join_duplicate_keys": "SELECT COUNT(*) AS pairs FROM part a JOIN part b ON a.p_size = b.p_size",
    "join_group_order_limit": "SELECT c.c_mktsegment, COUNT(*) AS n, ROUND(SUM(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment ORDER BY n DESC NULLS FIRST, c_mktsegment ASC NULLS LAST LIMIT 3",
}

#: Joins of tables that grow whose keys repeat on both sides.
REPEATED_KEYS = {"join_duplicate_keys", "join_null_keys", "join_post_filter"}
