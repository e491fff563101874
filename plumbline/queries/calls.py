"""Functions, calls and sources as queries: time arithmetic, array bounds, ranges, JSON by type, operators, connectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from plumbline.functions import geometry, udf
from plumbline.functions import registry as fn
from plumbline.operators import json, ranges, windows
from plumbline.queries._registry import query, scratch, sql
from plumbline.session import table
from plumbline.sources import tables as sources

sql("function_style_cast", "SELECT o_orderkey, int(o_custkey) AS i, string(o_custkey) AS s, date(o_orderdate) AS d, double(o_custkey) AS f FROM {orders}", "SELECT o_orderkey, o_custkey::INT AS i, o_custkey::VARCHAR AS s, o_orderdate::DATE AS d, o_custkey::DOUBLE AS f FROM orders")
sql("approximate_aggregates", "SELECT abs(approx_count_distinct(l_orderkey) - count(DISTINCT l_orderkey)) <= 0.15 * count(DISTINCT l_orderkey) AS distinct_near, abs(percentile_approx(l_quantity, 0.5, 1000) - percentile(l_quantity, 0.5)) <= 1 AS median_near FROM {lineitem}", "SELECT true AS distinct_near, true AS median_near")
sql("xor_logic", "SELECT c_custkey, (c_acctbal > 0) <> (c_nationkey < 5) AS one_of_them, NOT ((c_acctbal > 0) <> (c_nationkey < 5)) AS both_or_none FROM {customer}")
sql("group_concat_distinct", "SELECT p_brand, array_join(array_sort(transform(collect_set(p_size), x -> string(x))), '|') AS sizes FROM {part} GROUP BY p_brand", "SELECT p_brand, string_agg(DISTINCT cast(p_size AS VARCHAR), '|' ORDER BY cast(p_size AS VARCHAR)) AS sizes FROM (SELECT p_brand, p_size FROM part) GROUP BY p_brand")
sql("regr_family", "SELECT c_mktsegment, round(regr_intercept(c_acctbal, c_nationkey), 4) AS i, round(regr_r2(c_acctbal, c_nationkey), 6) AS r2, CAST(regr_count(c_acctbal, c_nationkey) AS BIGINT) AS n, round(regr_avgx(c_acctbal, c_nationkey), 6) AS ax, round(regr_avgy(c_acctbal, c_nationkey), 4) AS ay, round(covar_samp(c_acctbal, c_nationkey), 4) AS cs FROM {customer} GROUP BY c_mktsegment")
sql("current_values", "SELECT current_date() <= date_add(current_date(), 1) AS today, current_timestamp() <= now() AS now_once, length(current_user()) > 0 AS someone", "SELECT true AS today, true AS now_once, true AS someone")
sql("like_matches", "SELECT c_custkey FROM {customer} WHERE c_mktsegment LIKE '%U%' AND c_mktsegment ILIKE '%uild%'")
sql("anti_with_rows", "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
sql("except_with_rows", "SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT n_nationkey FROM {nation} WHERE n_regionkey = 1")
sql("nested_arrays", "SELECT n_nationkey, array(array(1, n_regionkey), array(3, 4))[0][1] AS x, CAST(size(flatten(array(array(1, n_regionkey), array(3, 4)))) AS BIGINT) AS n FROM {nation}", "SELECT n_nationkey, [[1, n_regionkey], [3, 4]][1][2] AS x, 4::BIGINT AS n FROM nation")
sql("composite_star", "SELECT o_orderkey, r.* FROM (SELECT o_orderkey, named_struct('cust', o_custkey, 'status', o_orderstatus) AS r FROM {orders})", "SELECT o_orderkey, o_custkey AS cust, o_orderstatus AS status FROM orders")


@query(
    "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 5400 SECOND, '%Y-%m-%d %H:%M:%S') AS later, strftime(o_orderdate - INTERVAL 61 SECOND, '%Y-%m-%d %H:%M:%S') AS earlier, "
    "printf('%02d:%02d:%02d', k // 3600 + 1, k // 60 % 60, k % 60) AS sum_time, CASE WHEN k < 3600 THEN '-' ELSE '' END || printf('%02d:%02d:%02d', abs(k - 3600) // 3600, abs(k - 3600) // 60 % 60, abs(k - 3600) % 60) AS difference, "
    "CASE WHEN k % 70 < 60 THEN printf('%02d:%02d:%02d', k % 30, k % 70, 7) END AS made, printf('%02dh %02dm', k // 3600, k // 60 % 60) AS shown FROM (SELECT o_orderkey, o_orderdate, (o_orderkey * 37 % 90000)::INT AS k FROM orders)"
)
def mysql_time_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders").select("o_orderkey", "o_orderdate", (F.col("o_orderkey") * 37 % 90000).cast("int").alias("k"))
    k, at = F.col("k"), F.col("o_orderdate").cast("string")
    time = fn.sec_to_time(k)
    return t.select(
        "o_orderkey", fn.addtime(at, F.lit("01:30:00")).alias("later"), fn.subtime(at, F.lit("00:01:01")).alias("earlier"), fn.addtime(time, F.lit("01:00:00")).alias("sum_time"),
        fn.timediff(time, F.lit("01:00:00")).alias("difference"), fn.maketime(k % 30, k % 70, F.lit(7)).alias("made"), fn.time_format(time, "%Hh %im").alias("shown"),
    )


@query("SELECT n_nationkey, CASE WHEN n_regionkey > 0 THEN 1 END AS nd, CASE WHEN n_regionkey > 0 THEN 1 END AS lo, CASE WHEN n_regionkey > 0 THEN n_regionkey END AS up, CASE WHEN n_regionkey > 0 THEN '[1:' || n_regionkey || ']' END AS dims, '[1:2][1:3]' AS dims2 FROM nation")
def array_metadata(spark: SparkSession, d: str) -> DataFrame:
    a = F.slice(F.array(*map(F.lit, range(9))), F.lit(1), F.col("n_regionkey"))
    square = F.array(F.array(*map(F.lit, (1, 2, 3))), F.array(*map(F.lit, (4, 5, 6))))
    return table(spark, d, "nation").select("n_nationkey", fn.array_ndims(a).alias("nd"), fn.array_lower(a).alias("lo"), fn.array_upper(a).alias("up"), fn.array_dims(a).alias("dims"), fn.array_dims(square, 2).alias("dims2"))


@query("SELECT n_nationkey, list_sort(list_distinct([3, n_regionkey, 9]))::VARCHAR AS u, CASE WHEN n_regionkey IN (1, 3) THEN '[' || n_regionkey || ']' ELSE '[]' END AS i, CASE WHEN n_regionkey IN (1, 3) THEN '[9]' WHEN n_regionkey < 9 THEN '[' || n_regionkey || ', 9]' END AS m FROM nation")
def intarray_sets(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_regionkey")
    shown = lambda a: F.concat(F.lit("["), F.array_join(a, ", "), F.lit("]"))
    u = fn.intarray_union(F.array(F.lit(3), F.lit(9)), fn.intset(k))
    return table(spark, d, "nation").select("n_nationkey", shown(u).alias("u"), shown(fn.intarray_intersect(F.array(F.lit(1), F.lit(3)), fn.intset(k))).alias("i"), shown(fn.intarray_minus(F.array(k, F.lit(9)), F.array(F.lit(1), F.lit(3)))).alias("m"))


@query(
    "SELECT p_partkey, '[' || least(p_size, 20) || ',' || greatest(p_size + 5, 30) || ')' AS merged, CASE WHEN p_size >= 20 AND p_size + 5 <= 30 THEN 'empty' WHEN p_size >= 30 OR p_size + 5 <= 20 THEN '[' || p_size || ',' || p_size + 5 || ')' WHEN p_size < 20 THEN '[' || p_size || ',20)' ELSE '[30,' || p_size + 5 || ')' END AS less, "
    "p_size + 5 <= 30 AS ends_by, p_size >= 20 AS begins_from, '[' || p_size || ',' || p_size + 6 || ')' AS whole FROM part"
)
def range_functions(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    r, own = ranges.make(F.lit(20), F.lit(30)), ranges.make(size, size + 5)
    return table(spark, d, "part").select(
        "p_partkey", ranges.as_text(ranges.merge(own, r)).alias("merged"), ranges.as_text(ranges.minus(own, r)).alias("less"), ranges.right_bounded(own, r).alias("ends_by"), ranges.left_bounded(own, r).alias("begins_from"),
        ranges.as_text(ranges.canonical(ranges.make(size - 1, size + 5, "(]"))).alias("whole"),
    )


@query(
    "WITH s AS (SELECT DISTINCT p_brand, p_size AS low, p_size + 2 AS high FROM part), m AS (SELECT *, CASE WHEN low > max(high) OVER w THEN 1 WHEN max(high) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM s WINDOW w AS (PARTITION BY p_brand ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), "
    "i AS (SELECT *, sum(fresh) OVER (PARTITION BY p_brand ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS g FROM m), u AS (SELECT p_brand, min(low) AS low, max(high) AS high FROM i GROUP BY p_brand, g) "
    "SELECT p_brand, '{' || string_agg('[' || low || ',' || high || ')', ',' ORDER BY low) || '}' AS held FROM u GROUP BY p_brand"
)
def multirange_agg(spark: SparkSession, d: str) -> DataFrame:
    """range_agg as a multirange; a brand's ranges are told apart first, so that a group holds as many as there are different ones."""
    different = table(spark, d, "part").select("p_brand", ranges.make(F.col("p_size"), F.col("p_size") + 2).alias("r")).distinct()
    whole = different.groupBy("p_brand").agg(ranges.multirange(F.collect_list("r")).alias("m"))
    return whole.select("p_brand", F.concat(F.lit("{"), F.array_join(F.transform("m", ranges.as_text), ","), F.lit("}")).alias("held"))


_DOCS = [(1, '{"a": "[note]", "b": [1, 2], "n": null, "d": {"x": {"y": 1, "z": 2}}}'), (2, '{"a": "{x", "b": {"c": [3]}, "n": 7, "d": {"x": {"y": 1}}}'), (3, "nonsense"), (4, '["p", {"a": "q"}]')]


def _docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_DOCS, "id int, doc string")


@query("SELECT * FROM (VALUES (1, '[note]', 'bad', CAST(NULL AS VARCHAR), '[1,2]', '[\"[note]\"]'), (2, '{x', 'bad', '7', '{\"c\":[3]}', '[\"{x\"]'), (3, 'bad', 'bad', 'bad', NULL, NULL), (4, 'none', 'none', 'none', NULL, NULL)) AS t(id, a, b, n, q, w)")
def json_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Strings that look like arrays or objects, JSON's null, composites where scalars are asked for, text that isn't JSON."""
    doc = F.col("doc")
    told = lambda p: json.json_value(doc, p, on_empty="none", on_error="bad")
    return _docs(spark).select("id", told("$.a").alias("a"), told("$.b").alias("b"), told("$.n").alias("n"), json.json_query(doc, "$.b").alias("q"), json.json_query(doc, "$.a", wrapper=True).alias("w"))


@query("SELECT * FROM (VALUES (1, true, true, true, true, false, '{\"y\":1,\"z\":2}', '[note]'), (2, true, false, true, true, false, '{\"y\":1}', '{x'), (3, CAST(NULL AS BOOLEAN), NULL, NULL, NULL, NULL, NULL, NULL), (4, false, false, false, true, false, NULL, NULL)) AS t(id, nested, two, has_a, has_one, has_all, below, plain)")
def json_containment(spark: SparkSession, d: str) -> DataFrame:
    """@> at depth, ?, ?|, ?&, #> and #>>."""
    doc = F.col("doc")
    return _docs(spark).select(
        "id", json.contains(doc, F.lit('{"d": {"x": {"y": 1}}}')).alias("nested"), json.contains(doc, F.lit('{"d": {"x": {"z": 2}}, "b": [2]}')).alias("two"), json.has_key(doc, "a").alias("has_a"),
        json.has_any_key(doc, ["p", "b"]).alias("has_one"), json.has_all_keys(doc, ["a", "zz"]).alias("has_all"), json.extract_path(doc, "d", "x").alias("below"), json.extract_path_text(doc, "a").alias("plain"),
    )


@query("SELECT event_id, cast(props ->> '$.k' AS INT) AS k, cast(NULL AS VARCHAR) AS other FROM events")
def json_to_record(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", json.to_record(F.col("props"), {"k": "int", "other": "string"}).alias("r")).select("event_id", "r.*")


@query("SELECT * FROM (VALUES (1, 10, 1, 5, NULL, CAST(NULL AS INTEGER), NULL), (1, 10, 2, 6, NULL, NULL, 'u'), (1, 10, NULL, NULL, 'm', NULL, NULL), (2, -2, NULL, NULL, NULL, NULL, NULL)) AS t(ord, a, n, x, tag, nothing, deep)")
def json_table_nested(spark: SparkSession, d: str) -> DataFrame:
    """Sibling and deeper NESTED PATHs, ON ERROR for a column."""
    doc = F.lit('{"items": [{"a": 10, "b": [{"x": 5}, {"x": 6, "c": ["u"]}], "t": ["m"]}, {"a": "ten"}]}')
    deeper = json.Nested("$.c", [json.Path("deep", "string", "$")])
    nested = [json.Nested("$.b", [json.Path("x", "int", "$.x")], "n", [deeper]), json.Nested("$.t", [json.Path("tag", "string", "$"), json.Path("nothing", "int", "$.zz")])]
    out = json.json_table(spark.range(1).select(), doc, "$.items", [json.Path("a", "int", "$.a", on_error=-2)], "ord", nested)
    return out.select(F.col("ord").cast("int").alias("ord"), "a", F.col("n").cast("int").alias("n"), "x", "tag", "nothing", "deep")


@query("SELECT n_nationkey, n_regionkey * 10 + 5 AS with_default, n_regionkey * 10 + 1 AS by_name FROM nation")
def named_default_args(spark: SparkSession, d: str) -> DataFrame:
    udf.create_function(spark, "plumbline_scaled", "x INT, plus INT DEFAULT 5", "INT", "x * 10 + plus")
    table(spark, d, "nation").createOrReplaceTempView("plumbline_nation")
    return spark.sql("SELECT n_nationkey, plumbline_scaled(n_regionkey) AS with_default, plumbline_scaled(plus => 1, x => n_regionkey) AS by_name FROM plumbline_nation")


@query("SELECT n_nationkey, n_regionkey + 3 AS total, n_name AS field, cast(n_regionkey AS VARCHAR) AS text FROM nation")
def variadic_and_field_calls(spark: SparkSession, d: str) -> DataFrame:
    """A VARIADIC call, and name(x) as a field of a row and as a cast."""
    total = udf.variadic(lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x))
    row = F.struct("n_name", "n_regionkey")
    return table(spark, d, "nation").select("n_nationkey", total(F.col("n_regionkey"), F.lit(1), F.lit(2)).alias("total"), udf.call("n_name", row, {}, ("n_name",)).alias("field"), udf.call("string", F.col("n_regionkey"), {}).alias("text"))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, abs(a.n_nationkey - b.n_nationkey) > 2 AS far, a.n_nationkey || ' of ' || a.n_regionkey AS text FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey")
def created_operators_and_casts(spark: SparkSession, d: str) -> DataFrame:
    """CREATE OPERATOR ~= with its negator, and a cast of a row type to text."""
    own = udf.Operators()
    own.create_operator("~=", lambda a, b: F.abs(a - b) <= 2, negator="!~=")
    own.create_cast("place", "string", lambda p: F.concat(p["n_nationkey"].cast("string"), F.lit(" of "), p["n_regionkey"].cast("string")))
    t = table(spark, d, "nation")
    a, b = t.alias("a"), t.alias("b")
    place = own.cast(F.struct("a.n_nationkey", "a.n_regionkey"), "place", "string")
    pairs = a.join(b, F.col("a.n_regionkey") == F.col("b.n_regionkey")).filter("a.n_nationkey < b.n_nationkey")
    return pairs.select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"), own.apply("!~=", F.col("a.n_nationkey"), F.col("b.n_nationkey")).alias("far"), place.alias("text"))


@query("SELECT n_regionkey, 'MULTIPOINT(' || string_agg(n_nationkey || ' ' || n_regionkey, ',' ORDER BY n_nationkey) || ')' AS held FROM nation GROUP BY n_regionkey")
def st_collect(spark: SparkSession, d: str) -> DataFrame:
    points = geometry.collect(geometry.point(F.col("n_nationkey"), F.col("n_regionkey")))
    return table(spark, d, "nation").groupBy("n_regionkey").agg(geometry.as_text(points, "MULTIPOINT").alias("held"))


@query("SELECT p_partkey, (p_type ILIKE '%brass%')::INT + (p_type ILIKE '%small%')::INT AS score FROM part")
def match_against(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", fn.match_against(F.col("p_type"), ["BRASS", "small"]).alias("score"))


@query("SELECT p_partkey, max(p_size) OVER (PARTITION BY p_brand)::BIGINT AS top, sum(DISTINCT p_size) OVER (PARTITION BY p_brand)::BIGINT AS total FROM part")
def window_widened_max(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("p_brand")
    return table(spark, d, "part").select("p_partkey", windows.widened_over(F.max("p_size").over(w), "int").alias("top"), windows.sum_distinct_over(F.col("p_size"), w, "bigint").alias("total"))


@query("SELECT form, n_nationkey, n_name FROM nation, (VALUES ('json'), ('orc'), ('csv')) AS t(form)")
def connectors(spark: SparkSession, d: str) -> DataFrame:
    """nation written and read back in three formats."""
    t, out = table(spark, d, "nation").select("n_nationkey", "n_name"), None
    for form in ("json", "orc", "csv"):
        t.write.format(form).save(where := scratch(spark, form))
        back = sources.connect(spark, form, where, "n_nationkey int, n_name string").select(F.lit(form).alias("form"), "n_nationkey", "n_name")
        out = back if out is None else out.unionByName(back)
    return out


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN NULL ELSE n_name END AS n_name FROM nation")
def outfile(spark: SparkSession, d: str) -> DataFrame:
    """SELECT ... INTO OUTFILE and LOAD DATA, nulls and all."""
    sources.outfile(table(spark, d, "nation").selectExpr("n_nationkey", "if(n_regionkey = 1, null, n_name) AS n_name"), where := scratch(spark, "outfile"))
    return sources.load_data(spark, where, "n_nationkey int, n_name string")


@query("SELECT n_nationkey, 'key,name' AS ks, n_regionkey > 1 AS held, CASE WHEN n_regionkey > 1 THEN 'name' ELSE 'key,name' END AS minus, n_regionkey = 1 AS twin, 'key,' || n_nationkey || ',name,' || n_name AS flat, n_nationkey + 1 AS key_up FROM nation")
def ext_hstore(spark: SparkSession, d: str) -> DataFrame:
    m = F.create_map(F.lit("key"), F.col("n_nationkey").cast("string"), F.lit("name"), F.col("n_name"))
    other = F.create_map(F.lit("key"), F.when(F.col("n_regionkey") > 1, F.col("n_nationkey")).otherwise(-1).cast("string"))
    keys = lambda x: F.array_join(F.array_sort(F.map_keys(x)), ",")
    record = fn.populate_record(F.struct("n_nationkey", "n_name"), F.create_map(F.lit("n_nationkey"), (F.col("n_nationkey") + 1).cast("string")), {"n_nationkey": "int", "n_name": "string"})
    return table(spark, d, "nation").select(
        "n_nationkey", keys(m).alias("ks"), fn.hstore_contains(m, other).alias("held"), keys(fn.hstore_delete_pairs(m, other)).alias("minus"), fn.hstore_contains(F.create_map(F.lit("k"), F.col("n_regionkey")), F.create_map(F.lit("k"), F.lit(1))).alias("twin"),
        F.array_join(fn.hstore_to_array(m), ",").alias("flat"), record["n_nationkey"].alias("key_up"),
    )


@query("SELECT n_nationkey, 3 AS levels, 'r' || n_regionkey || '.n' AS part, 1 AS at, n_regionkey = 2 AS below, n_regionkey IN (1, 2) AS matched, 'top' AS common FROM nation")
def ext_ltree(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("top.r"), F.col("n_regionkey").cast("string"), F.lit(".n"))
    return table(spark, d, "nation").select(
        "n_nationkey", fn.nlevel(path).alias("levels"), fn.subltree(path, 1, 3).alias("part"), F.when(fn.ltree_index(path, "zz") == -1, 1).alias("at"), fn.is_ancestor(F.lit("top.r2"), path).alias("below"),
        fn.ltree_matches(path, "*.R1@|r2.*{1,}").alias("matched"), fn.lca(path, F.lit("top.x.y")).alias("common"),
    )


@query("SELECT n_nationkey, strip_accents('Crème ' || n_name || ' Århus') AS plain FROM nation")
def ext_unaccent(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", fn.unaccent(F.concat(F.lit("Crème "), "n_name", F.lit(" Århus"))).alias("plain"))


@query("SELECT n_nationkey, round(sqrt(power(n_nationkey - 3.0, 2) + power(n_regionkey - 4.0, 2)), 6) AS euclid, (abs(n_nationkey - 3.0) + abs(n_regionkey - 4.0))::DOUBLE AS taxi, greatest(abs(n_nationkey - 3.0), abs(n_regionkey - 4.0))::DOUBLE AS most, n_nationkey <= 5 AS meets, n_nationkey BETWEEN 0 AND 4 AS holds FROM nation")
def ext_cube(spark: SparkSession, d: str) -> DataFrame:
    point = F.array(F.col("n_nationkey").cast("double"), F.col("n_regionkey").cast("double"))
    centre = F.array(F.lit(3.0), F.lit(4.0))
    box = F.struct(F.array(F.lit(0.0), F.lit(0.0)).alias("lower"), F.array(F.lit(5.0), F.lit(9.0)).alias("upper"))
    own = F.struct(point.alias("lower"), F.transform(point, lambda x: x + 1).alias("upper"))
    return table(spark, d, "nation").select(
        "n_nationkey", F.round(fn.cube_distance(point, centre), 6).alias("euclid"), fn.taxicab_distance(point, centre).alias("taxi"), fn.chebyshev_distance(point, centre).alias("most"), fn.cube_overlaps(box, own).alias("meets"), fn.cube_contains(box, own).alias("holds"),
    )


@query("SELECT n_nationkey, round(2 * 6378168.0 * asin(least(1.0, sqrt(power(sin(radians(n_regionkey) / 2), 2) + cos(0.0) * cos(radians(n_regionkey)) * power(sin(radians(n_nationkey) / 2), 2)))), 3) AS metres FROM nation")
def ext_earthdistance(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "nation")
    return t.select("n_nationkey", F.round(fn.earth_distance(F.lit(0.0), F.lit(0.0), F.col("n_regionkey").cast("double"), F.col("n_nationkey").cast("double")), 3).alias("metres"))


@query("SELECT * FROM (VALUES ('0-306-40615-2', '9780306406157', true, true, false)) AS t(given, longer, valid, journal, other)")
def ext_isn(spark: SparkSession, d: str) -> DataFrame:
    given = spark.createDataFrame([("0-306-40615-2",)], "given string")
    longer = fn.isbn10_to_13(F.col("given"))
    return given.select("given", longer.alias("longer"), fn.isbn13_ok(longer).alias("valid"), fn.issn_ok(F.lit("0378-5955")).alias("journal"), fn.issn_ok(F.lit("0378-5954")).alias("other"))


@query("SELECT '2ed6657d-e927-568b-95e1-2665a8aea6a2' AS v5, true AS v4")
def ext_uuid(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1).select(fn.uuid_v5(fn.UUID_DNS, F.lit("www.example.com")).alias("v5"), F.uuid().rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$").alias("v4"))


@query("SELECT p_partkey, max(p_retailprice) OVER w AS most, round(avg(p_size) OVER t, 6) AS mean, count(p_size) OVER g AS n FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW), t AS (PARTITION BY p_brand ORDER BY p_size ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE TIES), g AS (PARTITION BY p_brand ORDER BY p_size ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE GROUP)")
def win_exclude_aggregates(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    out = windows.aggregate_excluding(table(spark, d, "part"), ["p_brand"], [size, F.col("p_partkey")], F.col("p_retailprice"), "most", "CURRENT ROW")
    out = windows.aggregate_excluding(out, ["p_brand"], [size], size, "mean", "TIES", "avg")
    return windows.aggregate_excluding(out, ["p_brand"], [size], size, "n", "GROUP", "count").select("p_partkey", "most", F.round("mean", 6).alias("mean"), "n")


@query("SELECT p_partkey, nth_value(p_partkey, 2) OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second_last FROM part")
def win_from_last(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", windows.nth_from_last(F.col("p_partkey"), 2, ["p_brand"], [F.desc("p_size"), F.desc("p_partkey")]).alias("second_last"))


@query("SELECT '[\"ALGERIA\",\"ETHIOPIA\"]' AS names, '{\"a\":[1,2]}' AS text, '7' AS number, '\"x\"' AS word, true AS refused WHERE (SELECT count(*) FROM nation) > 0")
def json_more_constructors(spark: SparkSession, d: str) -> DataFrame:
    """JSON_ARRAY of a subquery, JSON_SERIALIZE, JSON_SCALAR, WITH UNIQUE KEYS."""
    names = json.json_array_subquery(spark.createDataFrame([("ETHIOPIA",), (None,), ("ALGERIA",)], "n string"), F.col("n"))
    try:
        json.json_object_unique([("a", F.lit(1)), ("a", F.lit(2))])
        refused = False
    except json.DuplicateKey:
        refused = True
    return names.select(F.col("value").alias("names"), json.json_serialize(F.lit('{"a": [1,  2]}')).alias("text"), json.json_scalar(F.lit(7)).alias("number"), json.json_scalar(F.lit("x")).alias("word"), F.lit(refused).alias("refused"))


@query(
    "SELECT n_nationkey, k <= 4 AS meets, k > 4 AS apart, k = 1 AS inside, round(greatest(0.0, abs(k - 2) - 2)::DOUBLE, 6) AS gap, (k / 2.0)::DOUBLE AS halfway, 'POLYGON' AS kind, 2 AS dims, true AS valid, "
    "'{\"type\": \"Point\", \"coordinates\": [' || k || '.0, 1.5]}' AS geojson, k::DOUBLE AS back, true AS same, true AS crossed FROM (SELECT n_nationkey, n_nationkey % 8 AS k FROM nation)"
)
def geometry_relations(spark: SparkSession, d: str) -> DataFrame:
    k = (F.col("n_nationkey") % 8).cast("double")
    p = lambda x, y: geometry.point(F.lit(x), F.lit(y))
    big = geometry.make_envelope(p(0, 0), p(4, 4))
    small = geometry.make_envelope(geometry.point(k, F.lit(1)), geometry.point(k + 1, F.lit(2)))
    path, at = geometry.line(p(0, 0), geometry.point(k, F.lit(0))), geometry.point(k, F.lit(1.5))
    told = geometry.as_geojson(at, "POINT")
    bow = geometry.line(p(0, 0), p(2, 2), p(2, 0), p(0, 2), p(0, 0))
    return table(spark, d, "nation").select(
        "n_nationkey", geometry.polygons_meet(big, small).alias("meets"), geometry.polygons_disjoint(big, small).alias("apart"), (geometry.polygon_within(small, big) & (k == 1)).alias("inside"),
        F.round(geometry.point_line_distance(geometry.point(k, F.lit(2)), geometry.line(p(0, 2), p(4, 2))), 6).alias("gap"), F.when(k > 0, geometry.interpolate(path, F.lit(0.5))["x"]).otherwise(0.0).alias("halfway"),
        geometry.geometry_type(geometry.as_text(big, "POLYGON")).alias("kind"), geometry.dimension(geometry.as_text(big, "POLYGON")).alias("dims"), geometry.is_valid(small).alias("valid"),
        told.alias("geojson"), geometry.from_geojson(told)[0]["x"].alias("back"), geometry.same_points(big, F.reverse(big)).alias("same"), (~geometry.is_simple(bow) & ~geometry.is_valid(bow)).alias("crossed"),
    )


@query("SELECT n_nationkey, true AS near, 5.0::DOUBLE AS apart, true AS round_shape FROM nation")
def geometry_measures(spark: SparkSession, d: str) -> DataFrame:
    """A geohash and back, the greatest of the least distances, a circle's polygon."""
    p = geometry.point(F.col("n_nationkey") * 3 - 40, F.col("n_regionkey") * 10 - 20)
    back = geometry.point_from_geohash(geometry.geohash(p, 9))
    one, other = geometry.line(geometry.point(F.lit(0), F.lit(0)), geometry.point(F.lit(1), F.lit(0))), geometry.line(geometry.point(F.lit(0), F.lit(5)), geometry.point(F.lit(1), F.lit(5)))
    circle = geometry.buffer_point(p, F.lit(2.0))
    return table(spark, d, "nation").select("n_nationkey", (geometry.distance(p, back) < 0.0001).alias("near"), geometry.hausdorff_distance(one, other).alias("apart"), geometry.area(circle).between(12.4, 12.6).alias("round_shape"))


@query("SELECT 11 AS total, 'ab' AS label")
def procedure_inout(spark: SparkSession, d: str) -> DataFrame:
    """CALL with INOUT arguments: a script sets them."""
    body = "WHILE total < 10 DO SET total = total + 3; END WHILE; SET label = concat(label, 'b');"
    got = udf.call_procedure(spark, body, {"total": ("INT", 2), "label": ("STRING", "a")})
    return spark.createDataFrame([(got["total"], got["label"])], "total int, label string")


@query("SELECT n_nationkey, a, b FROM nation, (VALUES (1, 'x'), (2, NULL)) AS t(a, b)")
def json_to_recordset(spark: SparkSession, d: str) -> DataFrame:
    return json.to_recordset(table(spark, d, "nation").select("n_nationkey"), F.lit('[{"a": 1, "b": "x"}, {"a": "2"}]'), {"a": "int", "b": "string"})


@query("SELECT o_orderkey, year(o_orderdate) AS y FROM orders WHERE o_orderdate >= TIMESTAMP '1994-06-01 00:00:00' AND o_orderdate < TIMESTAMP '1996-01-01 00:00:00'")
def partitioned_parent(spark: SparkSession, d: str) -> DataFrame:
    """A parent of one partition a year: those outside the asked range aren't in the plan."""
    import datetime

    t = table(spark, d, "orders")
    year = lambda y: datetime.datetime(y, 1, 1)
    parts = [(year(y), year(y + 1), t.filter((F.col("o_orderdate") >= F.lit(year(y)).cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit(year(y + 1)).cast("timestamp_ntz")))) for y in range(1990, 2000)]
    out = sources.partitioned_scan(parts, "o_orderdate", datetime.datetime(1994, 6, 1), year(1996))
    return out.select("o_orderkey", F.year("o_orderdate").cast("bigint").alias("y"))


@query("SELECT * FROM (VALUES (1, true, false), (2, false, true), (3, CAST(NULL AS BOOLEAN), NULL), (4, false, false)) AS t(id, lists, nested)")
def json_schema_valid(spark: SparkSession, d: str) -> DataFrame:
    lists = '{"type": "object", "required": ["a", "b"], "properties": {"a": {"type": "string", "pattern": "^.n"}, "b": {"type": "array", "items": {"type": "integer", "minimum": 1}, "maxItems": 2}}}'
    nested = '{"type": "object", "properties": {"b": {"type": "object", "additionalProperties": {"type": "array"}}, "n": {"enum": [7, 8]}}, "not": {"required": ["zz"]}}'
    doc = F.col("doc")
    return _docs(spark).select("id", fn.lookup("JSON_SCHEMA_VALID")(lists, doc).alias("lists"), fn.lookup("JSON_SCHEMA_VALID")(nested, doc).alias("nested"))
