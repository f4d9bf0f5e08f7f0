"""The SELECT language that the governed gate admits: one query for each family."""

from __future__ import annotations

from ..registry import sql_query

sql_query(
    "sql_inner_join",
    "SELECT n.n_name AS nation, CAST(count(*) AS BIGINT) AS n_orders, round(sum(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name",
)
sql_query(
    "sql_left_join",
    "SELECT c.c_custkey AS custkey, count(o.o_orderkey) AS n_orders, coalesce(round(sum(o.o_totalprice), 2), 0.0) AS spent FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey",
)
sql_query(
    "sql_right_join",
    "SELECT n.n_nationkey AS nationkey, count(s.s_suppkey) AS n_suppliers FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY n.n_nationkey",
)
sql_query(
    "sql_full_join",
    """SELECT coalesce(a.custkey, b.custkey) AS custkey, a.n_open, b.n_done
FROM (SELECT o_custkey AS custkey, count(*) AS n_open FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey) a
FULL OUTER JOIN (SELECT o_custkey AS custkey, count(*) AS n_done FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) b ON a.custkey = b.custkey""",
)
sql_query(
    "sql_cross_join",
    "SELECT r.r_name AS region, n.n_name AS nation, CAST(n.n_regionkey = r.r_regionkey AS INTEGER) AS own FROM region r CROSS JOIN nation n",
)
sql_query(
    "sql_semi_join",
    "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)",
)
sql_query(
    "sql_anti_join",
    "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)",
)
sql_query(
    "sql_in_subquery",
    "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount >= 0.09 AND l_quantity > 45)",
)
sql_query(
    "sql_not_in_subquery",
    "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 50)",
)
sql_query(
    "sql_theta_join",
    "SELECT a.n_nationkey AS a_key, b.n_nationkey AS b_key FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
)
sql_query(
    "sql_self_join",
    "SELECT a.l_orderkey AS orderkey, a.l_linenumber AS line_a, b.l_linenumber AS line_b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey AND a.l_linenumber < b.l_linenumber",
)
sql_query(
    "sql_natural_join",
    """SELECT region_name, nation_name FROM (SELECT r_regionkey AS regionkey, r_name AS region_name FROM region) a
NATURAL JOIN (SELECT n_regionkey AS regionkey, n_name AS nation_name FROM nation) b""",
)
sql_query(
    "sql_having",
    "SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) / count(*) AS mean_price FROM orders GROUP BY o_custkey HAVING count(*) >= 12 AND avg(o_totalprice) > 100000",
)
sql_query(
    "sql_distinct",
    "SELECT DISTINCT l_returnflag, l_linestatus, CAST(l_quantity > 25 AS INTEGER) AS large FROM lineitem",
)
sql_query(
    "sql_filtered_aggregate",
    """SELECT o_orderpriority AS priority, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderstatus <> 'F') AS rest,
    count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderpriority""",
)
sql_query(
    "sql_pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc,
    round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
)
sql_query(
    "sql_grouping_sets",
    """SELECT o_orderstatus AS status, o_orderpriority AS priority, CAST(grouping(o_orderstatus) AS INTEGER) AS g_status, CAST(grouping(o_orderpriority) AS INTEGER) AS g_priority, count(*) AS n
FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())""",
)
sql_query("sql_cube", "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
sql_query(
    "sql_rollup",
    "SELECT r_name AS region, n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
)
sql_query(
    "sql_row_number",
    "SELECT custkey, orderkey, price FROM (SELECT o_custkey AS custkey, o_orderkey AS orderkey, o_totalprice AS price, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) t WHERE r <= 3",
)
sql_query(
    "sql_ranks",
    """SELECT p_partkey, CAST(rank() OVER w AS BIGINT) AS rank_, CAST(dense_rank() OVER w AS BIGINT) AS dense, round(percent_rank() OVER w, 6) AS pct, round(cume_dist() OVER w, 6) AS cume,
    CAST(ntile(4) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS BIGINT) AS quarter FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)""",
)
sql_query(
    "sql_lag_lead",
    """SELECT event_id, lag(value) OVER w AS before, lead(value) OVER w AS after, first_value(event_type) OVER w AS first_type,
    last_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_type,
    nth_value(event_type, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second_type
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
sql_query(
    "sql_frames",
    """SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS last4,
    count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW) AS last_hour FROM events""",
)
sql_query("sql_union_distinct", "SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
sql_query("sql_union_all", "SELECT 'customer' AS kind, c_nationkey AS nationkey, count(*) AS n FROM customer GROUP BY c_nationkey UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY s_nationkey")
sql_query("sql_intersect", "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 40 INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity < 5")
sql_query("sql_except", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25")
sql_query("sql_intersect_all", "SELECT user_id FROM events WHERE event_type = 'view' INTERSECT ALL SELECT user_id FROM events WHERE event_type = 'click'")
sql_query("sql_except_all", "SELECT user_id FROM events WHERE event_type = 'click' EXCEPT ALL SELECT user_id FROM events WHERE event_type = 'purchase'")
sql_query("sql_scalar_subquery", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1.9 * (SELECT avg(o_totalprice) FROM orders)")
sql_query(
    "sql_correlated_subquery",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem l WHERE l_quantity < 0.2 * (SELECT avg(l_quantity) FROM lineitem i WHERE i.l_partkey = l.l_partkey)",
)
sql_query(
    "sql_cte",
    """WITH spent AS (SELECT o_custkey AS k, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), ranked AS (SELECT c_mktsegment AS segment, k, total, row_number() OVER (PARTITION BY c_mktsegment ORDER BY total DESC, k) AS r FROM spent JOIN customer ON c_custkey = k)
SELECT segment, k AS custkey, round(total, 2) AS total, CAST(r AS BIGINT) AS place FROM ranked WHERE r <= 5""",
)
sql_query(
    "sql_recursive_cte",
    """WITH RECURSIVE up(nationkey, node, depth) AS (SELECT n_nationkey, n_nationkey, 0 FROM nation UNION ALL SELECT nationkey, CAST(floor((node - 1) / 2.0) AS INTEGER), depth + 1 FROM up WHERE node > 0)
SELECT nationkey, CAST(max(depth) AS BIGINT) AS depth, count(*) AS steps FROM up GROUP BY nationkey""",
)
sql_query(
    "sql_case_coalesce",
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment, round(abs(c_acctbal), 2) AS size,
    greatest(c_custkey, 10) AS at_least, least(c_custkey, 10) AS at_most FROM customer""",
)
sql_query(
    "sql_like",
    "SELECT p_partkey, upper(substr(p_name, 1, 5)) AS head, length(p_name) AS size, replace(p_type, ' ', '_') AS kind, trim(p_brand) AS brand FROM part WHERE p_type ILIKE '%eco%' OR p_name LIKE 's%'",
)
sql_query(
    "sql_dates",
    """SELECT CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(quarter(o_orderdate) AS BIGINT) AS q, count(*) AS n, CAST(min(date_trunc('month', o_orderdate)) AS DATE) AS start_of
FROM orders GROUP BY year(o_orderdate), month(o_orderdate), quarter(o_orderdate)""",
)
sql_query(
    "sql_json",
    "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, get_json_object(props, '$.none') AS none FROM events",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS none FROM events",
)
sql_query(
    "sql_listagg",
    "SELECT n_regionkey AS regionkey, listagg(n_name, ', ') WITHIN GROUP (ORDER BY n_name) AS names, coalesce(sum(CAST(n_nationkey AS DOUBLE)), 0.0) AS total FROM nation GROUP BY n_regionkey",
    "SELECT n_regionkey AS regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names, coalesce(sum(CAST(n_nationkey AS DOUBLE)), 0.0) AS total FROM nation GROUP BY n_regionkey",
)
sql_query("sql_order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 5")
sql_query(
    "sql_lateral",
    "SELECT c.c_custkey AS custkey, t.top_price FROM customer c, LATERAL (SELECT max(o.o_totalprice) AS top_price FROM orders o WHERE o.o_custkey = c.c_custkey) t WHERE t.top_price IS NOT NULL",
)
sql_query(
    "sql_nulls_order",
    """SELECT custkey, top, CAST(row_number() OVER (ORDER BY top ASC NULLS FIRST, custkey) AS BIGINT) AS place
FROM (SELECT c_custkey AS custkey, max(o_totalprice) AS top FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey) t""",
)
sql_query(
    "sql_integer_division",
    "SELECT l_linenumber AS n, CAST(l_linenumber DIV 2 AS BIGINT) AS half, l_linenumber % 2 AS odd, try_divide(count(*), l_linenumber - 1) AS ratio FROM lineitem GROUP BY l_linenumber",
    "SELECT l_linenumber AS n, CAST(l_linenumber // 2 AS BIGINT) AS half, l_linenumber % 2 AS odd, CASE WHEN l_linenumber = 1 THEN NULL ELSE count(*) / (l_linenumber - 1) END AS ratio FROM lineitem GROUP BY l_linenumber",
)
