"""Queries that Spark SQL runs as they are: projections, predicates, joins, groups, windows, sets, common table expressions."""

from __future__ import annotations

from plumbline.queries._registry import sql

# projection and predicates
sql("scan_project_filter", "SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net FROM {lineitem} WHERE l_quantity > 45 AND l_returnflag = 'R'")
sql("bool_logic", "SELECT c_custkey, (c_acctbal > 0) AND NOT (c_mktsegment = 'BUILDING') AS both_hold, (c_acctbal > 0) OR (c_nationkey < 5) AS one_holds, (c_acctbal > 0) <> (c_nationkey < 5) AS just_one FROM {customer}")
sql("null_safe_eq", "SELECT c_custkey, nullif(c_nationkey, 3) IS NOT DISTINCT FROM nullif(c_nationkey, 3) AS same, nullif(c_nationkey, 3) IS DISTINCT FROM 4 AS differ FROM {customer}")
sql("is_truth", "SELECT c_custkey, (nullif(c_nationkey, 3) > 5) IS TRUE AS t, (nullif(c_nationkey, 3) > 5) IS NOT FALSE AS nf, (nullif(c_nationkey, 3) > 5) IS NULL AS u FROM {customer}")
sql("in_list", "SELECT o_orderkey, o_orderpriority FROM {orders} WHERE o_orderstatus IN ('F', 'P') AND o_custkey NOT IN (1, 2, 3)")
sql("like_ilike", "SELECT p_partkey, p_name FROM {part} WHERE p_name LIKE '%1%' OR p_type ILIKE '%brass%'")
sql("like_escape", "SELECT count(*) AS n FROM {part} WHERE p_name || '_x' LIKE '%!_x' ESCAPE '!'")
sql("case_when", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 END AS code FROM {orders}")
sql("coalesce_nullif_greatest", "SELECT c_custkey, coalesce(nullif(c_nationkey, 3), -1) AS filled, greatest(c_nationkey, 10) AS most, least(c_acctbal, 0.0) AS least_bal FROM {customer}")
sql("cast_types", "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12,2)) AS price, CAST(CAST(o_orderdate AS DATE) AS STRING) AS day, CAST(o_custkey AS STRING) AS cust, CAST('7' AS INT) AS seven FROM {orders}")
sql("values_rows", "SELECT v.k, v.name FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS v(k, name)")
sql("mysql_bits", "SELECT p_partkey, p_size & 6 AS band, p_size | 1 AS bor, p_size ^ 5 AS bxor FROM {part}", "SELECT p_partkey, p_size & 6 AS band, p_size | 1 AS bor, xor(p_size, 5) AS bxor FROM part")

# joins
sql("join_inner", "SELECT o.o_orderkey, c.c_name, n.n_name FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey WHERE o.o_totalprice > 150000")
sql("join_left", "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM {customer} c LEFT JOIN {orders} o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P' GROUP BY c.c_custkey")
sql("join_right", "SELECT c.c_custkey, o.o_orderkey FROM (SELECT * FROM {orders} WHERE o_orderstatus = 'P') o RIGHT JOIN {customer} c ON o.o_custkey = c.c_custkey")
sql("join_full_using", "SELECT k, a, b FROM (SELECT c_custkey + CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 1000000000 END AS k, c_name AS a FROM {customer}) x FULL JOIN (SELECT o_custkey AS k, count(*) AS b FROM {orders} GROUP BY o_custkey) y USING (k)")
sql("join_natural", "SELECT n_name, r_name FROM (SELECT n_name, n_regionkey AS rk FROM {nation}) NATURAL JOIN (SELECT r_name, r_regionkey AS rk FROM {region})", "SELECT n_name, r_name FROM (SELECT n_name, n_regionkey AS rk FROM nation) a NATURAL JOIN (SELECT r_name, r_regionkey AS rk FROM region) b")
sql("join_cross", "SELECT r.r_name, n.n_name FROM {region} r CROSS JOIN {nation} n")
sql("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM {nation} a JOIN {nation} b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
sql("join_semi", "SELECT c_custkey, c_name FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)")
sql("join_anti_not_exists", "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey)")
sql("not_in_null_aware", "SELECT s_suppkey FROM {supplier} WHERE s_nationkey NOT IN (SELECT nullif(n_nationkey, 99) FROM {nation} WHERE n_regionkey = 1)")
sql("exists_in_or", "SELECT c_custkey FROM {customer} c WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
sql("row_in_subquery", "SELECT l_orderkey, l_linenumber, l_partkey FROM {lineitem} WHERE (l_partkey, l_suppkey) IN (SELECT p_partkey, p_partkey % 10 + 1 FROM {part})")
sql("self_join", "SELECT a.s_suppkey AS s1, b.s_suppkey AS s2 FROM {supplier} a JOIN {supplier} b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
sql("lateral_topk", "SELECT c.c_custkey, o.o_orderkey, o.o_totalprice FROM {customer} c, LATERAL (SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) o")
sql("scalar_subquery", "SELECT o_orderkey, o_totalprice FROM {orders} o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)")

# groups
sql("group_by", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus")
sql("group_by_alias", "SELECT substring(o_orderpriority, 1, 1) AS p, count(*) AS n FROM {orders} GROUP BY p")
sql("having", "SELECT o_custkey, count(*) AS n, round(max(o_totalprice), 2) AS top FROM {orders} GROUP BY o_custkey HAVING count(*) > 12")
sql("grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
sql("rollup", "SELECT n_regionkey, n_name, count(*) AS n FROM {nation} GROUP BY ROLLUP (n_regionkey, n_name)")
sql("cube", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)")
sql("grouping_fn", "SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS BIGINT) AS g1, CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS g, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)")
sql("count_distinct_multi", "SELECT c_mktsegment, count(DISTINCT c_nationkey) AS nations FROM {customer} GROUP BY c_mktsegment")
sql("agg_filter", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 150000) AS high, round(sum(o_totalprice) FILTER (WHERE o_orderpriority LIKE '1%'), 2) AS urgent FROM {orders} GROUP BY o_orderstatus")
sql("string_agg_ordered", "SELECT n_regionkey, string_agg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
sql("percentile_cont_disc", "SELECT c_mktsegment, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY c_acctbal), 4) AS med, round(percentile_disc(0.25) WITHIN GROUP (ORDER BY c_acctbal), 4) AS q1 FROM {customer} GROUP BY c_mktsegment")
sql("mode_agg", "SELECT max(top) AS n FROM (SELECT l_linenumber, count(*) AS top FROM {lineitem} GROUP BY l_linenumber) WHERE l_linenumber = (SELECT mode() WITHIN GROUP (ORDER BY l_linenumber) FROM {lineitem})", "SELECT max(top) AS n FROM (SELECT l_linenumber, count(*) AS top FROM lineitem GROUP BY l_linenumber)")
sql("stats_aggs", "SELECT c_mktsegment, round(stddev_pop(c_acctbal), 4) AS sp, round(stddev_samp(c_acctbal), 4) AS ss, round(var_pop(c_acctbal), 2) AS vp, round(var_samp(c_acctbal), 2) AS vs, round(corr(c_acctbal, c_nationkey), 6) AS r, round(covar_pop(c_acctbal, c_nationkey), 4) AS cv, round(regr_slope(c_acctbal, c_nationkey), 6) AS slope FROM {customer} GROUP BY c_mktsegment")
sql("bit_aggs", "SELECT p_brand, bit_and(p_size) AS a, bit_or(p_size) AS o, bit_xor(p_size) AS x FROM {part} GROUP BY p_brand")
sql("bool_aggs", "SELECT c_mktsegment, bool_and(c_acctbal > -999) AS every_ok, bool_or(c_acctbal > 9900) AS any_rich FROM {customer} GROUP BY c_mktsegment")
sql("agg_no_group", "SELECT count(*) AS n, round(min(o_totalprice), 2) AS lo, round(max(o_totalprice), 2) AS hi FROM {orders} HAVING count(*) > 0")

# windows
sql("win_rank_family", "SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER w AS BIGINT) AS rk, CAST(dense_rank() OVER w AS BIGINT) AS dr, round(percent_rank() OVER w, 8) AS pr, round(cume_dist() OVER w, 8) AS cd, CAST(ntile(4) OVER w AS BIGINT) AS nt FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)")
sql("win_lag_lead", "SELECT event_id, lag(value, 1, 0.0) OVER w AS prev, lead(event_id, 2) OVER w AS after FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
sql("win_first_last_nth", "SELECT event_id, first_value(event_id) OVER w AS f, last_value(event_id) OVER w AS l, nth_value(event_id, 2) OVER w AS n2 FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
sql("win_ignore_nulls", "SELECT event_id, last_value(nullif(event_type, 'view')) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_action FROM {events}", "SELECT event_id, last_value(nullif(event_type, 'view') IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_action FROM events")
sql("win_rows_frame", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS s FROM {events}")
sql("win_range_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM {part}")
sql("win_range_interval", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS day_n FROM {events}")
sql("win_named", "SELECT c_custkey, round(sum(c_acctbal) OVER seg, 2) AS seg_total, CAST(rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC) AS BIGINT) AS rk FROM {customer} WINDOW seg AS (PARTITION BY c_mktsegment)")

# order, limit, distinct, sets
sql("order_nulls", "SELECT k, CAST(row_number() OVER (ORDER BY k ASC NULLS LAST, c_custkey) AS BIGINT) AS rn FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM {customer})")
sql("limit_offset", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
sql("topk", "SELECT l_orderkey, l_extendedprice FROM {lineitem} ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20")
sql("distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM {lineitem}")
sql("union_all", "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}")
sql("union", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}")
sql("intersect", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}")
sql("intersect_all", "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}")
sql("except", "SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT s_nationkey FROM {supplier}")
sql("except_all", "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}")

# common table expressions
sql("cte_chain", "WITH big AS (SELECT * FROM {orders} WHERE o_totalprice > 100000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT c.c_mktsegment, sum(p.n) AS n FROM per p JOIN {customer} c ON c.c_custkey = p.o_custkey GROUP BY c.c_mktsegment", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 100000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT c.c_mktsegment, cast(sum(p.n) AS BIGINT) AS n FROM per p JOIN customer c ON c.c_custkey = p.o_custkey GROUP BY c.c_mktsegment")
sql("cte_recursive", "WITH RECURSIVE r(n, total) AS (SELECT 1, 1 UNION ALL SELECT n + 1, total + n + 1 FROM r WHERE n < 30) SELECT n, total FROM r")
sql("cte_materialized_twice", "WITH t AS (SELECT o_custkey, sum(o_totalprice) AS s FROM {orders} GROUP BY o_custkey) SELECT count(*) AS n FROM t a JOIN t b ON a.s > b.s AND a.o_custkey = b.o_custkey + 1")

# scalar functions
sql("string_fns", "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, CAST(length(c_name) AS BIGINT) AS n, concat_ws('-', c_name, c_mktsegment) AS j, substring(c_name, 1, 4) AS s, replace(c_name, '#', '/') AS r, lpad(CAST(c_custkey AS STRING), 8, '0') AS p, trim('  x ') AS t, CAST(position('e' IN lower(c_name)) AS BIGINT) AS at, split_part(c_name, '#', 2) AS part2, reverse(c_mktsegment) AS rev FROM {customer}", "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, CAST(length(c_name) AS BIGINT) AS n, concat_ws('-', c_name, c_mktsegment) AS j, substring(c_name, 1, 4) AS s, replace(c_name, '#', '/') AS r, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS p, trim('  x ') AS t, CAST(position('e' IN lower(c_name)) AS BIGINT) AS at, split_part(c_name, '#', 2) AS part2, reverse(c_mktsegment) AS rev FROM customer")
sql("date_fns", "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d, CAST(CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS STRING) AS mon, CAST(datediff(DATE '1999-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS gap, CAST(quarter(o_orderdate) AS BIGINT) AS q, CAST(add_months(CAST(o_orderdate AS DATE), 1) AS STRING) AS nxt, CAST(dayofyear(o_orderdate) AS BIGINT) AS doy FROM {orders}", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS mon, datediff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') AS gap, quarter(o_orderdate) AS q, CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS nxt, dayofyear(o_orderdate) AS doy FROM orders")
sql("math_fns", "SELECT c_custkey, round(abs(c_acctbal), 2) AS a, CAST(floor(c_acctbal) AS BIGINT) AS f, CAST(ceil(c_acctbal) AS BIGINT) AS c, round(sqrt(abs(c_acctbal)), 6) AS s, round(power(c_nationkey, 2), 2) AS p, c_custkey % 7 AS m, CAST(sign(c_acctbal) AS INT) AS sg, round(ln(abs(c_acctbal) + 1), 6) AS l, round(exp(c_nationkey / 10.0), 6) AS e, round(degrees(radians(c_nationkey)), 6) AS dg FROM {customer}")
sql("hash_fns", "SELECT c_custkey, md5(c_name) AS m, sha2(c_name, 256) AS s, sha1(c_name) AS s1 FROM {customer}", "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s, sha1(c_name) AS s1 FROM customer")
sql("interval_arith", "SELECT o_orderkey, o_orderdate + INTERVAL '3' DAY AS later, o_orderdate - INTERVAL '2' MONTH AS earlier FROM {orders}")
sql("integer_division", "SELECT o_orderkey, o_orderkey DIV 7 AS q, o_orderkey % 7 AS r FROM {orders}", "SELECT o_orderkey, o_orderkey // 7 AS q, o_orderkey % 7 AS r FROM orders")
sql("divide_by_zero_null", "SELECT p_partkey, try_divide(p_size, p_size % 5) AS q FROM {part}", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size / (p_size % 5) END AS q FROM part")
sql("levenshtein", "SELECT a.n_name AS a, b.n_name AS b, CAST(levenshtein(a.n_name, b.n_name) AS BIGINT) AS d FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql("json_extract", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM {events}", "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events")
sql("collate_ci", "SELECT c_mktsegment, count(*) AS n FROM {customer} WHERE c_mktsegment COLLATE UTF8_LCASE = 'building' GROUP BY c_mktsegment", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE lower(c_mktsegment) = 'building' GROUP BY c_mktsegment")
sql("struct_row", "SELECT o_orderkey, r.f1 AS a, r.f2 AS b FROM (SELECT o_orderkey, named_struct('f1', o_custkey, 'f2', o_orderstatus) AS r FROM {orders})", "SELECT o_orderkey, o_custkey AS a, o_orderstatus AS b FROM orders")
sql("array_subscript", "SELECT n_nationkey, try_element_at(split(n_name, 'A'), 2) AS second, CAST(cardinality(split(n_name, 'A')) AS BIGINT) AS n, array_join(transform(slice(sequence(1, 5), 2, 3), x -> CAST(x AS STRING)), ',') AS mid FROM {nation}", "SELECT n_nationkey, string_split(n_name, 'A')[2] AS second, len(string_split(n_name, 'A')) AS n, '2,3,4' AS mid FROM nation")
sql("tumbling_window", "SELECT window.start AS w, event_type, count(*) AS n FROM {events} GROUP BY window(ts, '1 day'), event_type", "SELECT date_trunc('day', ts) AS w, event_type, count(*) AS n FROM events GROUP BY ALL")
sql("tpch_q1", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, count(*) AS n FROM {lineitem} GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus")
sql("tpch_q3", "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10")
sql("tpch_q5", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {supplier} ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY n_name")
sql("tpch_q6", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM {lineitem} WHERE l_discount BETWEEN 0.02 AND 0.08 AND l_quantity < 24")
