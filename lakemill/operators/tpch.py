"""Decision-support queries over the local tables: shapes of the classic set, with windows that these tables fill."""

ENTRIES = {
    "tpch_q01": """
        SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS sum_base_price,
               ROUND(SUM(l_extendedprice * (1e0 - l_discount)), 4) AS sum_disc_price,
               ROUND(SUM(l_extendedprice * (1e0 - l_discount) * (1e0 + l_tax)), 2) AS sum_charge,
               ROUND(AVG(l_quantity), 6) AS avg_qty, ROUND(AVG(l_extendedprice), 6) AS avg_price, ROUND(AVG(l_discount), 6) AS avg_disc, COUNT(*) AS count_order
        FROM lineitem WHERE l_shipdate <= @ts'1998-09-02' GROUP BY l_returnflag, l_linestatus
        ORDER BY l_returnflag ASC NULLS LAST, l_linestatus ASC NULLS LAST""",
    "tpch_q03": """
        SELECT l.l_orderkey, ROUND(SUM(l.l_extendedprice * (1e0 - l.l_discount)), 4) AS revenue, o.o_orderdate
        FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON o.o_orderkey = l.l_orderkey
        WHERE c.c_mktsegment = 'BUILDING' AND o.o_orderdate < @ts'1998-03-15' AND l.l_shipdate > @ts'1998-03-15'
        GROUP BY l.l_orderkey, o.o_orderdate ORDER BY revenue DESC NULLS FIRST, o_orderdate ASC NULLS LAST, l_orderkey ASC NULLS LAST LIMIT 10""",
    "tpch_q05": """
        SELECT n.n_name, ROUND(SUM(l.l_extendedprice * (1e0 - l.l_discount)), 4) AS revenue
        FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON o.o_orderkey = l.l_orderkey
        JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
        WHERE r.r_name = 'ASIA' AND c.c_nationkey = s.s_nationkey AND o.o_orderdate >= @ts'1996-01-01' AND o.o_orderdate < @ts'1999-01-01'
        GROUP BY n.n_name ORDER BY revenue DESC NULLS FIRST""",
    "tpch_q06": """
        SELECT ROUND(SUM(l_extendedprice * l_discount), 4) AS revenue FROM lineitem
        WHERE l_shipdate >= @ts'1996-01-01' AND l_shipdate < @ts'1997-01-01' AND l_discount BETWEEN 0.05e0 AND 0.07e0 AND l_quantity < 24e0""",
    "tpch_q07": """
        SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(EXTRACT(YEAR FROM l.l_shipdate) AS BIGINT) AS l_year,
               ROUND(SUM(l.l_extendedprice * (1e0 - l.l_discount)), 4) AS revenue
        FROM supplier s JOIN lineitem l ON s.s_suppkey = l.l_suppkey JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
        JOIN nation n1 ON s.s_nationkey = n1.n_nationkey JOIN nation n2 ON c.c_nationkey = n2.n_nationkey
        WHERE ((n1.n_regionkey = 1 AND n2.n_regionkey = 2) OR (n1.n_regionkey = 2 AND n2.n_regionkey = 1))
          AND l.l_shipdate BETWEEN @ts'1996-01-01' AND @ts'1998-12-31'
        GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation ASC NULLS LAST, cust_nation ASC NULLS LAST, l_year ASC NULLS LAST""",
    "tpch_q09": """
        SELECT n.n_name AS nation_name, CAST(EXTRACT(YEAR FROM o.o_orderdate) AS BIGINT) AS o_year,
               ROUND(SUM(l.l_extendedprice * (1e0 - l.l_discount) - 0.1e0 * q.p_retailprice * l.l_quantity), 4) AS sum_profit
        FROM part p JOIN lineitem l ON p.p_partkey = l.l_partkey JOIN supplier s ON s.s_suppkey = l.l_suppkey
        JOIN part q ON q.p_partkey = l.l_partkey JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN nation n ON s.s_nationkey = n.n_nationkey
        WHERE p.p_name LIKE '%widget%' AND q.p_size = p.p_size
        GROUP BY nation_name, o_year ORDER BY nation_name ASC NULLS LAST, o_year DESC NULLS FIRST""",
    "tpch_q10": """
        SELECT c.c_custkey, c.c_name, ROUND(SUM(l.l_extendedprice * (1e0 - l.l_discount)), 4) AS revenue, c.c_acctbal, n.n_name
        FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN nation n ON c.c_nationkey = n.n_nationkey
        WHERE o.o_orderdate >= @ts'1996-10-01' AND o.o_orderdate < @ts'1997-01-01' AND l.l_returnflag = 'R'
        GROUP BY c.c_custkey, c.c_name, c.c_acctbal, n.n_name ORDER BY revenue DESC NULLS FIRST, c_custkey ASC NULLS LAST LIMIT 20""",
    "tpch_q11": """
        SELECT l.l_partkey, ROUND(SUM(l.l_extendedprice * l.l_quantity), 2) AS part_value
        FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
        WHERE n.n_regionkey = 3 GROUP BY l.l_partkey
        HAVING SUM(l.l_extendedprice * l.l_quantity) > (
          SELECT SUM(l.l_extendedprice * l.l_quantity) * 0.001e0 FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
          JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE n.n_regionkey = 3)
        ORDER BY part_value DESC NULLS FIRST, l_partkey ASC NULLS LAST""",
    "tpch_q12": """
        SELECT l.l_returnflag, CAST(SUM(CASE WHEN o.o_orderpriority = '1-URGENT' OR o.o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
               CAST(SUM(CASE WHEN o.o_orderpriority <> '1-URGENT' AND o.o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
        FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey
        WHERE l.l_returnflag IN ('A', 'R') AND l.l_shipdate >= @ts'1997-01-01' AND l.l_shipdate < @ts'1998-01-01'
        GROUP BY l.l_returnflag ORDER BY l_returnflag ASC NULLS LAST""",
    "tpch_q14": """
        SELECT ROUND(100e0 * SUM(CASE WHEN p.p_type LIKE 'PROMO%' THEN l.l_extendedprice * (1e0 - l.l_discount) ELSE 0e0 END)
               / SUM(l.l_extendedprice * (1e0 - l.l_discount)), 6) AS promo_revenue
        FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE l.l_shipdate >= @ts'1996-09-01' AND l.l_shipdate < @ts'1996-10-01'""",
    "tpch_q18": """
        SELECT c.c_name, c.c_custkey, o.o_orderkey, o.o_orderdate, o.o_totalprice, ROUND(SUM(l.l_quantity), 2) AS quantity
        FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON o.o_orderkey = l.l_orderkey
        WHERE o.o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING SUM(l_quantity) > 300e0)
        GROUP BY c.c_name, c.c_custkey, o.o_orderkey, o.o_orderdate, o.o_totalprice
        ORDER BY o_totalprice DESC NULLS FIRST, o_orderdate ASC NULLS LAST, o_orderkey ASC NULLS LAST LIMIT 100""",
    "tpch_q19": """
        SELECT ROUND(SUM(l.l_extendedprice * (1e0 - l.l_discount)), 4) AS revenue FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey
        WHERE (p.p_brand = 'Brand#12' AND l.l_quantity BETWEEN 1e0 AND 11e0 AND p.p_size BETWEEN 1 AND 15)
           OR (p.p_brand = 'Brand#23' AND l.l_quantity BETWEEN 10e0 AND 20e0 AND p.p_size BETWEEN 1 AND 25)
           OR (p.p_brand = 'Brand#3' AND l.l_quantity BETWEEN 20e0 AND 30e0 AND p.p_size BETWEEN 1 AND 35)""",
}
