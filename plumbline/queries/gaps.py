"""Queries that go through our own operators, since Spark SQL lacks the syntax."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from plumbline.functions import registry as fn
from plumbline.operators import aggregates, json, predicates, ranges, recursive, rows, scans, windows
from plumbline.queries._registry import query
from plumbline.session import table


def _told(array: Column) -> Column:
    """An array as text, nulls too."""
    return F.array_join(F.transform(array, lambda x: F.coalesce(x.cast("string"), F.lit("NULL"))), ",")


@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN least(20, 10) AND greatest(20, 10)")
def between_symmetric(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter(predicates.between_symmetric(F.col("p_size"), F.lit(20), F.lit(10))).select("p_partkey", "p_size")


@query("SELECT p_partkey FROM part WHERE p_name SIMILAR TO '.*(1|3).*[0-4]'")
def similar_to(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter(predicates.similar_to(F.col("p_name"), "%(1|3)%[0-4]")).select("p_partkey")


@query("SELECT c_custkey, regexp_matches(c_name, '[0-9]+[13579]$') AS odd, regexp_replace(c_name, '[0-9]', 'n', 'g') AS masked FROM customer")
def regex(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.col("c_name").rlike("[0-9]+[13579]$").alias("odd"), F.regexp_replace("c_name", "[0-9]", "n").alias("masked"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey, l_linenumber) < (500, 3)")
def row_compare(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    return t.filter(predicates.row_compare([F.col("l_orderkey"), F.col("l_linenumber")], "<", [F.lit(500), F.lit(3)])).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT n_nationkey, n_nationkey = ANY([1, 5, 7]) AS one, n_nationkey > ALL([1, 5, 7]) AS every_one FROM nation")
def array_any_all(spark: SparkSession, d: str) -> DataFrame:
    array = F.array(*map(F.lit, (1, 5, 7)))
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select("n_nationkey", predicates.any_of(k, "=", array).alias("one"), predicates.all_of(k, ">", array).alias("every_one"))


@query(
    "SELECT s_suppkey, s_acctbal > ALL(SELECT c_acctbal FROM customer WHERE c_nationkey = 3) AS above, "
    "s_nationkey = ANY(SELECT nullif(n_nationkey, 4) FROM nation WHERE n_regionkey = 1) AS in_region FROM supplier"
)
def any_all_subquery(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "supplier")
    balances = table(spark, d, "customer").filter("c_nationkey = 3").select("c_acctbal")
    keys = table(spark, d, "nation").filter("n_regionkey = 1").select(F.expr("nullif(n_nationkey, 4)").alias("k"))
    out = predicates.compare_subquery(t, F.col("s_acctbal"), ">", "ALL", balances, "above")
    return predicates.compare_subquery(out, F.col("s_nationkey"), "=", "ANY", keys, "in_region").select("s_suppkey", "above", "in_region")


@query("SELECT c_custkey, coalesce((SELECT string_agg(cast(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) FROM orders WHERE o_custkey = c_custkey), '') AS keys FROM customer")
def array_subquery(spark: SparkSession, d: str) -> DataFrame:
    """ARRAY(SELECT ...): grouped once and joined, not run for each row."""
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    joined = table(spark, d, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", _told(F.coalesce("keys", F.array().cast("array<bigint>"))).alias("keys"))


@query("SELECT c_custkey, c_name, c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey, c_name, c_mktsegment")
def group_by_fd(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.group_by_dependent(joined, ["c_custkey"], ["c_name", "c_mktsegment"], F.count(F.lit(1)).alias("n"))


@query(
    "SELECT c_mktsegment, 1 + count(*) FILTER (WHERE c_acctbal < 5000) AS rk, 1 + count(DISTINCT c_nationkey) FILTER (WHERE c_nationkey < 10) AS dr, "
    "round(count(*) FILTER (WHERE c_acctbal < 5000) / count(*), 8) AS pr, round((count(*) FILTER (WHERE c_acctbal <= 5000) + 1) / (count(*) + 1), 8) AS cd FROM customer GROUP BY c_mktsegment"
)
def hypothetical_rank(spark: SparkSession, d: str) -> DataFrame:
    v, x = F.col("c_acctbal"), F.lit(5000.0)
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(
        aggregates.hypothetical_rank(x, v).alias("rk"), aggregates.hypothetical_dense_rank(F.lit(10), F.col("c_nationkey")).alias("dr"),
        F.round(aggregates.hypothetical_percent_rank(x, v), 8).alias("pr"), F.round(aggregates.hypothetical_cume_dist(x, v), 8).alias("cd"),
    )


@query("SELECT n_regionkey, string_agg(coalesce(cast(nullif(n_nationkey, 3) AS VARCHAR), 'NULL'), ',' ORDER BY n_name) AS keys FROM nation GROUP BY n_regionkey")
def array_agg_nulls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").groupBy("n_regionkey").agg(_told(aggregates.array_agg(F.expr("nullif(n_nationkey, 3)"), F.col("n_name"))).alias("keys"))


@query("SELECT n_regionkey, '[' || string_agg('\"' || n_name || '\"', ',' ORDER BY n_name) || ']' AS names, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS keys FROM nation GROUP BY n_regionkey")
def json_agg(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").groupBy("n_regionkey").agg(aggregates.json_agg(F.col("n_name")).alias("names"), aggregates.json_object_agg(F.col("n_name"), F.col("n_nationkey")).alias("keys"))


@query("SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.25), 4) AS q1, round(quantile_cont(c_acctbal, 0.75), 4) AS q3 FROM customer GROUP BY c_mktsegment")
def percentile_array(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(aggregates.percentiles(F.col("c_acctbal"), [0.25, 0.75]).alias("q")).select("c_mktsegment", F.round(F.col("q")[0], 4).alias("q1"), F.round(F.col("q")[1], 4).alias("q3"))


@query("SELECT bit_and(p_size) FILTER (WHERE false) IS NULL AS none, cast(-1 AS BIGINT) AS a, cast(0 AS BIGINT) AS o FROM part")
def mysql_bit_defaults(spark: SparkSession, d: str) -> DataFrame:
    empty = table(spark, d, "part").filter("p_size < 0")
    return empty.agg(F.bit_and("p_size").isNull().alias("none"), aggregates.bit_and(F.col("p_size").cast("long")).alias("a"), aggregates.bit_or(F.col("p_size").cast("long")).alias("o"))


@query("SELECT p_partkey, count(*) OVER w AS n, cast(sum(p_size) OVER w AS BIGINT) AS s FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING)")
def win_groups_frame(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part")
    return windows.groups_frame(t, ["p_brand"], [F.col("p_size")], 1, 1, {"v": F.col("p_size")}, {"n": "count(1)", "s": "sum(v)"}).select("p_partkey", "n", "s")


@query(
    "SELECT p_partkey, cast(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS BIGINT) AS others, "
    "cast(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE GROUP) AS BIGINT) AS far, "
    "cast(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE TIES) AS BIGINT) AS lone "
    "FROM part"
)
def win_exclude(spark: SparkSession, d: str) -> DataFrame:
    frame = Window.partitionBy("p_brand").orderBy("p_size").rangeBetween(-2, 2)
    out = lambda how: windows.sum_excluding(F.col("p_size"), frame, ["p_brand"], [F.col("p_size")], how)
    return table(spark, d, "part").select("p_partkey", out("CURRENT ROW").alias("others"), out("GROUP").alias("far"), out("TIES").alias("lone"))


@query("SELECT o_orderkey, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2) AS done FROM orders")
def win_filter(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.round(windows.filtered(F.sum, F.col("o_orderstatus") == "F", F.col("o_totalprice"), w), 2).alias("done"))


@query("SELECT o_orderkey, count(DISTINCT o_orderpriority) OVER (PARTITION BY o_custkey) AS n FROM orders")
def win_distinct(spark: SparkSession, d: str) -> DataFrame:
    return windows.count_distinct_whole(table(spark, d, "orders"), ["o_custkey"], F.col("o_orderpriority"), "n").select("o_orderkey", "n")


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS total, CAST(rank() OVER (ORDER BY sum(o_totalprice) DESC) AS BIGINT) AS rk FROM orders GROUP BY o_custkey")
def win_over_agg(spark: SparkSession, d: str) -> DataFrame:
    """Sums in the order of the stored rows, as the SQL adds on one thread: a rank tells sums apart by their last bit."""
    t = table(spark, d, "orders")
    stored = [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    totals = aggregates.sum_in_order(t, ["o_custkey"], stored, F.col("o_totalprice"), "s")
    return totals.select("o_custkey", F.round("s", 2).alias("total"), F.rank().over(Window.orderBy(F.desc("s"))).cast("long").alias("rk"))


@query("SELECT p_partkey, p_size FROM (SELECT *, rank() OVER (ORDER BY p_size DESC) AS rk FROM part) WHERE rk <= 10")
def limit_with_ties(spark: SparkSession, d: str) -> DataFrame:
    return rows.limit_with_ties(table(spark, d, "part"), 10, [rows.desc("p_size")]).select("p_partkey", "p_size")


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return rows.distinct_on(t, ["o_custkey"], [(-F.col("o_totalprice")).alias("a"), F.col("o_orderkey").alias("b")])


@query("WITH RECURSIVE r AS (SELECT s_suppkey AS k FROM supplier UNION SELECT (k * 3 + 1) % 97 FROM r) SELECT k FROM r")
def cte_recursive_distinct(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    return recursive.recursive_union(base, lambda r: r.select(((F.col("k") * 3 + 1) % 97).alias("k")))


@query(
    "WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 2 + 1) % 25 AS b FROM nation), "
    "r AS (SELECT 0 AS node, [0] AS path, 0 AS depth, false AS is_cycle UNION ALL SELECT e.b, list_append(path, e.b), depth + 1, list_contains(path, e.b) FROM r JOIN e ON r.node = e.a WHERE NOT is_cycle) "
    "SELECT node, array_to_string(path, ',') AS path, depth, is_cycle FROM r"
)
def cte_search_cycle(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    edges = table(spark, d, "nation").select(n.alias("a"), ((n * 2 + 1) % 25).alias("b"))
    start = spark.createDataFrame([(0,)], "k int")
    return recursive.connect_by(edges, "a", "b", start).select("node", _told(F.col("path")).alias("path"), "depth", "is_cycle")


@query("SELECT n_nationkey, cast(unnest(generate_series(1, n_regionkey)) AS INTEGER) AS i FROM nation WHERE n_regionkey > 0")
def generate_series(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", F.explode(rows.generate_series(F.lit(1), F.col("n_regionkey"))).alias("i"))


@query("SELECT n_nationkey, unnest([1, 2, 3]) AS a, unnest(['x', 'y']) AS b FROM nation")
def unnest_lockstep(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "nation").select("n_nationkey")
    return rows.unnest(t, {"a": F.array(*map(F.lit, (1, 2, 3))), "b": F.array(F.lit("x"), F.lit("y"))})


@query("SELECT n_nationkey, unnest(string_split(n_name, 'A')) AS piece, unnest(range(1, len(string_split(n_name, 'A')) + 1)) AS ord FROM nation")
def with_ordinality(spark: SparkSession, d: str) -> DataFrame:
    return rows.unnest(table(spark, d, "nation").select("n_nationkey", "n_name"), {"piece": F.split("n_name", "A")}, "ord").drop("n_name")


@query(
    "SELECT event_id, ord, a, has_b, n, x FROM (SELECT event_id, cast(props ->> '$.k' AS INT) AS k FROM events) e, "
    "(VALUES (1, 10, true, 1, 5), (1, 10, true, 2, 6), (2, NULL, false, NULL, NULL)) AS v(ord, a, has_b, n, x) WHERE k > 90"
)
def json_table(spark: SparkSession, d: str) -> DataFrame:
    doc = F.lit('{"items": [{"a": 10, "b": [{"x": 5}, {"x": 6}]}, {"c": 1}]}')
    t = table(spark, d, "events").filter(json.json_value(F.col("props"), "$.k", "int") > 90).select("event_id")
    nested = json.Nested("$.b", [json.Path("x", "int", "$.x")], "n")
    out = json.json_table(t, doc, "$.items", [json.Path("a", "int", "$.a"), json.Path("has_b", "boolean", "$.b", exists=True)], "ord", nested)
    return out.select("event_id", F.col("ord").cast("int").alias("ord"), "a", "has_b", F.col("n").cast("int").alias("n"), "x")


@query("SELECT event_id, cast(props ->> '$.k' AS INT) AS k, cast(-1 AS INT) AS missing, json_exists(props, '$.k') AS has FROM events")
def json_value_exists(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("props")
    return table(spark, d, "events").select("event_id", json.json_value(p, "$.k", "int").alias("k"), json.json_value(p, "$.zz", "int", on_empty=-1).alias("missing"), json.json_exists(p, "$.k").alias("has"))


@query("SELECT n_nationkey, '{\"key\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}' AS doc, '[' || n_nationkey || ',' || n_regionkey || ']' AS arr FROM nation")
def json_constructors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", json.json_object({"key": F.col("n_nationkey"), "name": F.col("n_name")}).alias("doc"), json.json_array([F.col("n_nationkey"), F.col("n_regionkey")]).alias("arr"))


@query("SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey AND a.p_size < b.p_size + 5 AND b.p_size < a.p_size + 5")
def range_overlap(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part")
    side = lambda x: t.select(F.col("p_partkey").alias(x), "p_brand", F.col("p_size").alias(f"{x}_low"), (F.col("p_size") + 5).alias(f"{x}_high"))
    return ranges.overlap_join(side("a"), side("b"), "a_low", "a_high", "b_low", "b_high", 5, ["p_brand"]).filter("a < b").select("a", "b")


@query("SELECT l_orderkey, l_linenumber, l_quantity, cast(lo AS DOUBLE) AS lo FROM lineitem JOIN (VALUES (0.0, 10.0), (10.0, 25.5), (40.0, 45.0)) AS b(lo, hi) ON l_quantity >= lo AND l_quantity < hi WHERE l_returnflag = 'R'")
def join_range(spark: SparkSession, d: str) -> DataFrame:
    bands = spark.createDataFrame([(0.0, 10.0), (10.0, 25.5), (40.0, 45.0)], "lo double, hi double")
    t = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_quantity")
    return ranges.point_join(t, bands, "l_quantity", "lo", "hi", 10.0).select("l_orderkey", "l_linenumber", "l_quantity", "lo")


@query("SELECT p_partkey, p_size >= 10 AND p_size < 20 AS held, p_size < 15 AND p_size + 3 > 10 AS touches FROM part")
def range_ops(spark: SparkSession, d: str) -> DataFrame:
    r = ranges.make(F.lit(10), F.lit(20))
    own = ranges.make(F.col("p_size"), F.col("p_size") + 3)
    return table(spark, d, "part").select("p_partkey", ranges.contains(r, F.col("p_size")).alias("held"), ranges.overlaps(ranges.make(F.lit(10), F.lit(15)), own).alias("touches"))


@query(
    "WITH s AS (SELECT DISTINCT p_brand, p_size AS low, p_size + 2 AS high FROM part), m AS (SELECT *, CASE WHEN low > max(high) OVER w THEN 1 WHEN max(high) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM s WINDOW w AS (PARTITION BY p_brand ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), "
    "i AS (SELECT *, sum(fresh) OVER (PARTITION BY p_brand ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT p_brand, min(low) AS low, max(high) AS high FROM i GROUP BY p_brand, g"
)
def range_agg(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").select("p_brand", F.col("p_size").alias("low"), (F.col("p_size") + 2).alias("high"))
    return aggregates.range_union(t, ["p_brand"], "low", "high")


@query("SELECT c_nationkey, round(sum(c_acctbal) FILTER (WHERE c_mktsegment = 'BUILDING'), 2) AS building, round(sum(c_acctbal) FILTER (WHERE c_mktsegment = 'MACHINERY'), 2) AS machinery FROM customer GROUP BY c_nationkey")
def pivot_crosstab(spark: SparkSession, d: str) -> DataFrame:
    out = rows.crosstab(table(spark, d, "customer"), "c_nationkey", "c_mktsegment", F.col("c_acctbal"), ["BUILDING", "MACHINERY"])
    return out.select("c_nationkey", F.round("BUILDING", 2).alias("building"), F.round("MACHINERY", 2).alias("machinery"))


@query(
    "WITH t AS (SELECT n_nationkey, n_name, list_distinct(list_transform(range(1, length(n_name) + 2), lambda i: ('  ' || lower(n_name) || ' ')[i:i + 2])) AS g FROM nation) "
    "SELECT a.n_name AS a, b.n_name AS b, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 6) AS sim FROM t a JOIN t b ON a.n_nationkey < b.n_nationkey"
)
def trigram_similarity(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "nation")
    a, b = (t.select(F.col("n_nationkey").alias(f"{x}k"), F.col("n_name").alias(x)) for x in "ab")
    return a.join(b, F.col("ak") < F.col("bk")).select("a", "b", F.round(fn.similarity(F.col("a"), F.col("b")), 6).alias("sim"))


@query("SELECT n_nationkey, array_to_string(map_keys(m), ',') AS ks, array_to_string(map_values(m), ',') AS vs, m['name'] AS name FROM (SELECT n_nationkey, MAP {'name': n_name, 'key': cast(n_nationkey AS VARCHAR)} AS m FROM nation)")
def ext_hstore_map(spark: SparkSession, d: str) -> DataFrame:
    m = F.create_map(F.lit("name"), F.col("n_name"), F.lit("key"), F.col("n_nationkey").cast("string"))
    return table(spark, d, "nation").select("n_nationkey", _told(F.map_keys(m)).alias("ks"), _told(F.map_values(m)).alias("vs"), m["name"].alias("name"))


@query("SELECT n_nationkey, len(a) AS icount, cast(list_position(a, 3) AS BIGINT) AS idx, array_to_string(list_reverse_sort(list_distinct(a)), ',') AS d FROM (SELECT n_nationkey, [3, n_regionkey, 1, 3] AS a FROM nation)")
def ext_intarray(spark: SparkSession, d: str) -> DataFrame:
    a = F.array(F.lit(3), F.col("n_regionkey"), F.lit(1), F.lit(3))
    return table(spark, d, "nation").select("n_nationkey", F.size(a).cast("long").alias("icount"), F.array_position(a, 3).alias("idx"), _told(F.sort_array(F.array_distinct(a), False)).alias("d"))


@query("SELECT o_orderkey, epoch(o_orderdate) AS secs, cast(date_part('month', age(TIMESTAMP '1999-01-01', o_orderdate)) + 12 * date_part('year', age(TIMESTAMP '1999-01-01', o_orderdate)) AS BIGINT) AS months FROM orders")
def extract_epoch_age(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("o_orderdate").cast("timestamp")
    return table(spark, d, "orders").select("o_orderkey", fn.epoch(at).alias("secs"), fn.whole_months(F.lit("1999-01-01").cast("timestamp"), at).alias("months"))


@query("SELECT c_custkey, (c_name IS NULL)::INT + (nullif(c_nationkey, 3) IS NULL)::INT AS nulls FROM customer")
def null_helpers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", fn.num_nulls(F.col("c_name"), F.expr("nullif(c_nationkey, 3)")).alias("nulls"))


@query("SELECT c_custkey, CASE WHEN nullif(c_nationkey, 3) IS NULL THEN NULL ELSE greatest(c_nationkey, 10) END AS most FROM customer")
def mysql_greatest_null(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", fn.mysql_greatest(F.expr("nullif(c_nationkey, 3)"), F.lit(10)).alias("most"))


@query(
    "SELECT e.event_id, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = e.user_id AND o_orderdate = (SELECT max(o_orderdate) FROM orders WHERE o_custkey = e.user_id AND o_orderdate <= e.ts)) AS last_order FROM events e"
)
def join_as_of(spark: SparkSession, d: str) -> DataFrame:
    """The last order at or before each event."""
    events, orders = table(spark, d, "events").select("event_id", "user_id", "ts"), table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return scans.as_of(events, orders, {"user_id": "o_custkey"}, ("ts", "o_orderdate"), "o_orderkey", "last_order").select("event_id", "last_order")


@query("SELECT DISTINCT user_id, cast(n AS BIGINT) AS n FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 DAY OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY user_id, s)")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    from plumbline.streaming import windows as streams

    return streams.sessions(table(spark, d, "events"), "2 days").select("user_id", "n").distinct()
