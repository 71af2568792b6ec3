"""Queries of the query language, the aggregates and the window functions, in the dialect over the test tables."""

from __future__ import annotations

from tessera.plans.dialect import query

# name: (dialect, SQL for comparison); where both read alike the second is None
QUERY = {
    "select": ("SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders", "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders"),
    "select_except": ("SELECT * EXCEPT (r_name) FROM region", "SELECT * EXCLUDE (r_name) FROM region"),
    "select_replace": ("SELECT * REPLACE (UPPER(r_name) AS r_name) FROM region", "SELECT * REPLACE (upper(r_name) AS r_name) FROM region"),
    "where": ("SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND NOT o_orderstatus = 'F'", "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND NOT o_orderstatus = 'F'"),
    "group_by": ("SELECT o_orderstatus, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS s FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY 1"),
    "having": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1 HAVING COUNT(*) > 12", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12"),
    "qualify": (
        "SELECT o_orderkey, o_custkey FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1",
        "SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1",
    ),
    "order_by_limit_offset": ("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5"),
    "order_by_nulls": ("SELECT NULLIF(n_regionkey, 0) AS k, n_name FROM nation ORDER BY k, n_name LIMIT 5", "SELECT nullif(n_regionkey, 0) AS k, n_name FROM nation ORDER BY k NULLS FIRST, n_name LIMIT 5"),
    "distinct": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders"),
    "union_all": ("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier"),
    "union_distinct": ("SELECT c_nationkey AS k FROM customer UNION DISTINCT SELECT s_nationkey FROM supplier", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "intersect": ("SELECT c_nationkey AS k FROM customer INTERSECT DISTINCT SELECT s_nationkey FROM supplier", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier"),
    "except": ("SELECT c_custkey AS k FROM customer EXCEPT DISTINCT SELECT o_custkey FROM orders WHERE o_totalprice > 200000", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000"),
    "inner_join": ("SELECT o_orderkey, c_name FROM orders INNER JOIN customer ON o_custkey = c_custkey", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"),
    "join_using": ("SELECT * FROM (SELECT n_regionkey AS k, n_name FROM nation) JOIN (SELECT r_regionkey AS k, r_name FROM region) USING (k)", "SELECT * FROM (SELECT n_regionkey AS k, n_name FROM nation) JOIN (SELECT r_regionkey AS k, r_name FROM region) USING (k)"),
    "left_join": ("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000"),
    "right_join": ("SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey", "SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey"),
    "full_join": ("SELECT s_suppkey, c_custkey FROM supplier FULL OUTER JOIN customer ON s_suppkey = c_custkey", "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey"),
    "cross_join": ("SELECT r_name, n_name FROM region CROSS JOIN nation", "SELECT r_name, n_name FROM region CROSS JOIN nation"),
    "comma_join": ("SELECT r_name, n_name FROM region, nation WHERE r_regionkey = n_regionkey", "SELECT r_name, n_name FROM region, nation WHERE r_regionkey = n_regionkey"),
    "semi_join": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"),
    "anti_join": ("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)"),
    "unnest": ("SELECT p_partkey, w, pos FROM part, UNNEST(SPLIT(p_name, ' ')) AS w WITH OFFSET AS pos", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, (generate_subscripts(string_split(p_name, ' '), 1) - 1)::BIGINT AS pos FROM part"),
    "unnest_structs": ("SELECT a, b FROM UNNEST([STRUCT(1 AS a, 'x' AS b), (2, 'y')])", "SELECT * FROM (VALUES (1::BIGINT, 'x'), (2, 'y')) AS t(a, b)"),
    "cte": ("WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000), n AS (SELECT COUNT(*) AS n FROM big) SELECT n FROM n", "SELECT count(*) AS n FROM orders WHERE o_totalprice > 200000"),
    "recursive_cte": ("WITH RECURSIVE t AS (SELECT 1 AS n, 1 AS f UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 10) SELECT n, f FROM t", "WITH RECURSIVE t AS (SELECT 1::BIGINT AS n, 1::BIGINT AS f UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 10) SELECT n, f FROM t"),
    "window": ("SELECT o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s FROM orders", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s FROM orders"),
    "named_window": ("SELECT o_orderkey, RANK() OVER w AS r FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice)", "SELECT o_orderkey, rank() OVER w AS r FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice)"),
    "window_range": ("SELECT p_partkey, COUNT(*) OVER (ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n FROM part", "SELECT p_partkey, count(*) OVER (ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n FROM part"),
    "case": ("SELECT p_partkey, CASE WHEN p_size < 10 THEN 's' WHEN p_size < 30 THEN 'm' ELSE 'l' END AS c, CASE p_size WHEN 1 THEN 'one' END AS d FROM part", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 's' WHEN p_size < 30 THEN 'm' ELSE 'l' END AS c, CASE p_size WHEN 1 THEN 'one' END AS d FROM part"),
    "exists": ("SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000)", "SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000)"),
    "in_subquery": ("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)"),
    "scalar_subquery": ("SELECT o_orderkey FROM orders AS o WHERE o_totalprice = (SELECT MAX(i.o_totalprice) FROM orders AS i WHERE i.o_custkey = o.o_custkey)", "SELECT o_orderkey FROM orders AS o WHERE o_totalprice = (SELECT max(i.o_totalprice) FROM orders AS i WHERE i.o_custkey = o.o_custkey)"),
    "rollup": ("SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, GROUPING(o_orderpriority) AS g FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderpriority)::BIGINT AS g FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"),
    "cube": ("SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"),
    "grouping_sets": ("SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"),
    "tablesample": ("SELECT COUNT(*) AS n FROM orders TABLESAMPLE SYSTEM (100 PERCENT)", "SELECT count(*) AS n FROM orders"),
    "pivot": ("SELECT * FROM (SELECT o_orderpriority, o_orderstatus FROM orders) PIVOT (COUNT(*) FOR o_orderstatus IN ('F', 'O', 'P'))", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1"),
    "unpivot": ("SELECT p_partkey, what, v FROM (SELECT p_partkey, p_name, p_brand FROM part) UNPIVOT (v FOR what IN (p_name, p_brand))", "SELECT p_partkey, 'p_name' AS what, p_name AS v FROM part UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM part"),
    "select_as_struct": ("SELECT s.a, s.b FROM (SELECT STRUCT(n_nationkey AS a, n_name AS b) AS s FROM nation)", "SELECT n_nationkey AS a, n_name AS b FROM nation"),
    "anonymous_columns": ("SELECT 1 + 1, 'x'", "SELECT 2::BIGINT AS f0_, 'x' AS f1_"),
    "sessionize": (
        "SELECT user_id, RANGE_START(session_range) AS s, RANGE_END(session_range) AS e FROM RANGE_SESSIONIZE((SELECT user_id, RANGE(DATE(ts), DATE_ADD(DATE(ts), INTERVAL 1 DAY)) AS r FROM events), 'r', ['user_id'])",
        """WITH e AS (SELECT user_id, ts::DATE AS a, ts::DATE + 1 AS b FROM events),
        m AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM e),
        g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM m)
        SELECT user_id, min(a) OVER (PARTITION BY user_id, k) AS s, max(b) OVER (PARTITION BY user_id, k) AS e FROM g""",
    ),
}

G = "FROM orders GROUP BY o_orderstatus"
AGGREGATES = {
    "any_value": (f"SELECT o_orderstatus, ANY_VALUE(o_orderstatus) AS r {G}", f"SELECT o_orderstatus, any_value(o_orderstatus) AS r {G}"),
    "array_agg": (f"SELECT o_custkey, ARRAY_AGG(o_orderkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 3) AS r FROM orders GROUP BY 1", "SELECT o_custkey, array_agg(o_orderkey ORDER BY o_totalprice DESC, o_orderkey)[1:3] AS r FROM orders GROUP BY 1"),
    "array_concat_agg": ("SELECT n_regionkey, ARRAY_CONCAT_AGG([n_nationkey, 1] ORDER BY n_nationkey) AS r FROM nation GROUP BY 1", "SELECT n_regionkey, flatten(array_agg([n_nationkey, 1]::BIGINT[] ORDER BY n_nationkey)) AS r FROM nation GROUP BY 1"),
    "avg": (f"SELECT o_orderstatus, ROUND(AVG(o_totalprice), 4) AS r {G}", f"SELECT o_orderstatus, round(avg(o_totalprice), 4) AS r {G}"),
    "bit_and": (f"SELECT o_orderstatus, BIT_AND(o_orderkey) AS r {G}", f"SELECT o_orderstatus, bit_and(o_orderkey) AS r {G}"),
    "bit_or": (f"SELECT o_orderstatus, BIT_OR(o_orderkey) AS r {G}", f"SELECT o_orderstatus, bit_or(o_orderkey) AS r {G}"),
    "bit_xor": (f"SELECT o_orderstatus, BIT_XOR(o_orderkey) AS r {G}", f"SELECT o_orderstatus, bit_xor(o_orderkey) AS r {G}"),
    "count": (f"SELECT o_orderstatus, COUNT(*) AS r, COUNT(DISTINCT o_custkey) AS d {G}", f"SELECT o_orderstatus, count(*) AS r, count(DISTINCT o_custkey) AS d {G}"),
    "countif": (f"SELECT o_orderstatus, COUNTIF(o_totalprice > 100000) AS r {G}", f"SELECT o_orderstatus, count(*) FILTER (o_totalprice > 100000) AS r {G}"),
    "grouping": ("SELECT o_orderstatus, GROUPING(o_orderstatus) AS r, COUNT(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus)", "SELECT o_orderstatus, grouping(o_orderstatus)::BIGINT AS r, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus)"),
    "logical_and": (f"SELECT o_orderstatus, LOGICAL_AND(o_totalprice > 0) AS r {G}", f"SELECT o_orderstatus, bool_and(o_totalprice > 0) AS r {G}"),
    "logical_or": (f"SELECT o_orderstatus, LOGICAL_OR(o_totalprice > 300000) AS r {G}", f"SELECT o_orderstatus, bool_or(o_totalprice > 300000) AS r {G}"),
    "max": (f"SELECT o_orderstatus, MAX(o_totalprice) AS r {G}", f"SELECT o_orderstatus, max(o_totalprice) AS r {G}"),
    "min": (f"SELECT o_orderstatus, MIN(o_totalprice) AS r {G}", f"SELECT o_orderstatus, min(o_totalprice) AS r {G}"),
    "max_by": (f"SELECT o_orderstatus, MAX_BY(o_orderkey, o_totalprice) AS r {G}", f"SELECT o_orderstatus, arg_max(o_orderkey, o_totalprice) AS r {G}"),
    "min_by": (f"SELECT o_orderstatus, MIN_BY(o_orderkey, o_totalprice) AS r {G}", f"SELECT o_orderstatus, arg_min(o_orderkey, o_totalprice) AS r {G}"),
    "string_agg": ("SELECT n_regionkey, STRING_AGG(n_name, '|' ORDER BY n_name DESC LIMIT 3) AS r FROM nation GROUP BY 1", "SELECT n_regionkey, array_to_string(array_agg(n_name ORDER BY n_name DESC)[1:3], '|') AS r FROM nation GROUP BY 1"),
    "sum": (f"SELECT o_orderstatus, SUM(o_custkey) AS r {G}", f"SELECT o_orderstatus, sum(o_custkey)::BIGINT AS r {G}"),
    **{
        n: (f"SELECT l_returnflag, ROUND({n.upper()}({a}), 6) AS r FROM lineitem GROUP BY 1", f"SELECT l_returnflag, round({o}({a}), 6) AS r FROM lineitem GROUP BY 1")
        for n, o, a in (
            ("corr", "corr", "l_quantity, l_extendedprice"), ("covar_pop", "covar_pop", "l_quantity, l_discount"), ("covar_samp", "covar_samp", "l_quantity, l_discount"), ("stddev", "stddev_samp", "l_quantity"),
            ("stddev_pop", "stddev_pop", "l_quantity"), ("stddev_samp", "stddev_samp", "l_quantity"), ("var_pop", "var_pop", "l_quantity"), ("var_samp", "var_samp", "l_quantity"), ("variance", "var_samp", "l_quantity"),
        )
    },
    "approx_count_distinct": (f"SELECT o_orderstatus, APPROX_COUNT_DISTINCT(o_custkey) AS r {G}", f"SELECT o_orderstatus, count(DISTINCT o_custkey) AS r {G}"),
    "approx_quantiles": ("SELECT APPROX_QUANTILES(p_partkey, 2)[OFFSET(1)] AS r FROM part", "SELECT quantile_disc(p_partkey, 0.5) AS r FROM part"),
    "approx_top_count": ("SELECT t.value, t.count AS n FROM UNNEST((SELECT APPROX_TOP_COUNT(event_type, 3) FROM events)) AS t", "SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3"),
    "approx_top_count_typed": ("SELECT o_orderstatus, t.value, t.count AS n FROM (SELECT o_orderstatus, APPROX_TOP_COUNT(o_custkey, 2) AS top FROM orders GROUP BY 1), UNNEST(top) AS t", "SELECT o_orderstatus, o_custkey AS value, count(*) AS n FROM orders GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC, o_custkey) <= 2"),
    "approx_top_sum": ("SELECT t.value, t.sum AS s FROM UNNEST((SELECT APPROX_TOP_SUM(event_type, user_id, 2) FROM events)) AS t", "SELECT event_type AS value, sum(user_id)::DOUBLE AS s FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2"),
    # sketches of many values stay within five in a hundred of the exact count, about three standard errors
    "hll_count_init": (
        "SELECT l_returnflag, ABS(HLL_COUNT.EXTRACT(HLL_COUNT.INIT(l_orderkey)) - COUNT(DISTINCT l_orderkey)) <= 0.05 * COUNT(DISTINCT l_orderkey) AS near, COUNT(DISTINCT l_orderkey) AS exact FROM lineitem GROUP BY 1",
        "SELECT l_returnflag, true AS near, count(DISTINCT l_orderkey) AS exact FROM lineitem GROUP BY 1",
    ),
    "hll_count_merge": (
        "SELECT ABS(m.r - e.r) <= 0.05 * e.r AS near, e.r AS exact FROM (SELECT HLL_COUNT.MERGE(s) AS r FROM (SELECT l_suppkey, HLL_COUNT.INIT(l_orderkey) AS s FROM lineitem GROUP BY 1)) AS m CROSS JOIN (SELECT COUNT(DISTINCT l_orderkey) AS r FROM lineitem) AS e",
        "SELECT true AS near, count(DISTINCT l_orderkey) AS exact FROM lineitem",
    ),
    "hll_count_merge_partial": (
        "SELECT m.f, ABS(m.r - e.r) <= 0.05 * e.r AS near, e.r AS exact FROM (SELECT f, HLL_COUNT.EXTRACT(HLL_COUNT.MERGE_PARTIAL(s)) AS r FROM (SELECT l_linestatus AS f, l_suppkey, HLL_COUNT.INIT(l_orderkey) AS s FROM lineitem GROUP BY 1, 2) GROUP BY 1) AS m JOIN (SELECT l_linestatus AS f, COUNT(DISTINCT l_orderkey) AS r FROM lineitem GROUP BY 1) AS e ON m.f = e.f",
        "SELECT l_linestatus AS f, true AS near, count(DISTINCT l_orderkey) AS exact FROM lineitem GROUP BY 1",
    ),
    "hll_count_extract": ("SELECT o_orderstatus, HLL_COUNT.EXTRACT(HLL_COUNT.INIT(o_orderpriority)) AS r FROM orders GROUP BY 1", "SELECT o_orderstatus, count(DISTINCT o_orderpriority) AS r FROM orders GROUP BY 1"),
    "having_max": (f"SELECT o_orderstatus, ANY_VALUE(o_orderkey HAVING MAX o_totalprice) AS r {G}", f"SELECT o_orderstatus, arg_max(o_orderkey, o_totalprice) AS r {G}"),
    "st_union_agg": ("SELECT ST_NPOINTS(ST_UNION_AGG(ST_GEOGPOINT(n_nationkey, 1))) AS r FROM nation", "SELECT count(DISTINCT n_nationkey) AS r FROM nation"),
}

W = "OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)"
FULL = "OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
WINDOWS = {
    **{n: (f"SELECT o_orderkey, {n.upper()}() {W} AS r FROM orders", f"SELECT o_orderkey, {n}() {W} AS r FROM orders") for n in ("row_number", "rank", "dense_rank")},
    **{n: (f"SELECT o_orderkey, ROUND({n.upper()}() {W}, 9) AS r FROM orders", f"SELECT o_orderkey, round({n}() {W}, 9) AS r FROM orders") for n in ("percent_rank", "cume_dist")},
    "ntile": (f"SELECT o_orderkey, NTILE(3) {W} AS r FROM orders", f"SELECT o_orderkey, ntile(3) {W} AS r FROM orders"),
    "lag": (f"SELECT o_orderkey, LAG(o_orderkey, 2, -1) {W} AS r FROM orders", f"SELECT o_orderkey, lag(o_orderkey, 2, -1) {W} AS r FROM orders"),
    "lead": (f"SELECT o_orderkey, LEAD(o_orderkey) {W} AS r FROM orders", f"SELECT o_orderkey, lead(o_orderkey) {W} AS r FROM orders"),
    "first_value": (f"SELECT o_orderkey, FIRST_VALUE(o_orderkey) {W} AS r FROM orders", f"SELECT o_orderkey, first_value(o_orderkey) {W} AS r FROM orders"),
    "last_value": (f"SELECT o_orderkey, LAST_VALUE(NULLIF(o_orderkey, 7) IGNORE NULLS) {FULL} AS r FROM orders", f"SELECT o_orderkey, last_value(nullif(o_orderkey, 7) IGNORE NULLS) {FULL} AS r FROM orders"),
    "nth_value": (f"SELECT o_orderkey, NTH_VALUE(o_orderkey, 2) {FULL} AS r FROM orders", f"SELECT o_orderkey, nth_value(o_orderkey, 2) {FULL} AS r FROM orders"),
    "percentile_cont": ("SELECT o_orderkey, ROUND(PERCENTILE_CONT(o_totalprice, 0.25) OVER (PARTITION BY o_orderstatus), 4) AS r FROM orders", "SELECT o_orderkey, round(quantile_cont(o_totalprice, 0.25) OVER (PARTITION BY o_orderstatus), 4) AS r FROM orders"),
    "percentile_disc": ("SELECT o_orderkey, PERCENTILE_DISC(o_totalprice, 0.5) OVER (PARTITION BY o_orderstatus) AS r FROM orders", "SELECT o_orderkey, quantile_disc(o_totalprice, 0.5) OVER (PARTITION BY o_orderstatus) AS r FROM orders"),
}

for _group, _items in (("query", QUERY), ("agg", AGGREGATES), ("window", WINDOWS)):
    for _name, (_dialect, _oracle) in _items.items():
        query(f"{_group}_{_name}", _dialect, _oracle)
