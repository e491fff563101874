"""XML, geometry, user-defined functions, views, sampling, scripting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import datetimes, json_udf, udf
from plumbline.functions import geometry as geo
from plumbline.operators import views, xml
from plumbline.queries._registry import query
from plumbline.session import table
from plumbline.sources import tables as sources


@query("SELECT n_nationkey, '<nation key=\"' || n_nationkey || '\"><name>' || n_name || '</name></nation>' AS doc FROM nation")
def xml_exprs(spark: SparkSession, d: str) -> DataFrame:
    doc = xml.element("nation", xml.forest({"name": F.col("n_name")}), attributes={"key": F.col("n_nationkey")})
    return table(spark, d, "nation").select("n_nationkey", doc.alias("doc"))


@query("SELECT n_regionkey, string_agg('<n>' || n_name || '</n>', '' ORDER BY n_name) AS doc FROM nation GROUP BY n_regionkey")
def xml_agg(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").groupBy("n_regionkey").agg(xml.xml_agg(xml.forest({"n": F.col("n_name")}), F.col("n_name")).alias("doc"))


@query("SELECT r_regionkey, ord, k, v FROM region, (VALUES (1, 'a', 'x'), (2, 'b', NULL), (3, NULL, 'y')) AS t(ord, k, v)")
def xml_table(spark: SparkSession, d: str) -> DataFrame:
    doc = F.lit('<r><rows><row k="a"><v>x</v></row><row k="b"/><row><v>y</v></row></rows></r>')
    out = xml.xml_table(table(spark, d, "region").select("r_regionkey"), doc, "/r/rows/row", {"k": "@k", "v": "v"}, "ord")
    return out.select("r_regionkey", F.col("ord").cast("int").alias("ord"), "k", "v")


@query(
    "SELECT n_nationkey, cast(n_nationkey + 1 AS DOUBLE) * 2 AS area, round(sqrt(pow(n_nationkey - 3, 2) + pow(n_regionkey - 4, 2)), 6) AS dist, 0 < 1 AND 1 < n_nationkey + 1 AS inside, "
    "'POINT(' || n_nationkey || ' ' || n_regionkey || ')' AS wkt FROM nation"
)
def geometry(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    ring = geo.line(*[geo.point(x, F.lit(y)) for x, y in ((F.lit(0), 0), (k + 1, 0), (k + 1, 2), (F.lit(0), 2), (F.lit(0), 0))])
    here = geo.point(k, F.col("n_regionkey"))
    return table(spark, d, "nation").select(
        "n_nationkey", geo.area(ring).alias("area"), F.round(geo.distance(here, geo.point(F.lit(3), F.lit(4))), 6).alias("dist"),
        geo.contains(ring, geo.point(F.lit(1), F.lit(1))).alias("inside"), geo.as_text(here, "POINT").alias("wkt"),
    )


@query("SELECT n_nationkey, n_nationkey * 2 + 1 AS twice FROM nation")
def sql_function(spark: SparkSession, d: str) -> DataFrame:
    udf.create_function(spark, "plumbline_twice", "x INT", "INT", "x * 2 + 1")
    return table(spark, d, "nation").select("n_nationkey", F.expr("plumbline_twice(n_nationkey)").alias("twice"))


@query("SELECT r_regionkey, i FROM region, LATERAL (SELECT unnest(range(1, r_regionkey + 1)) AS i)")
def table_function(spark: SparkSession, d: str) -> DataFrame:
    udf.create_function(spark, "plumbline_upto", "n INT", "i BIGINT", "SELECT explode(slice(sequence(0L, cast(n AS BIGINT)), 2, n)) AS i", table=True)
    return spark.sql("SELECT r_regionkey, t.i FROM {region} r, LATERAL plumbline_upto(r.r_regionkey) t", region=table(spark, d, "region"))


@query("SELECT n_regionkey, cast(product(n_nationkey + 1) AS BIGINT) AS p FROM nation GROUP BY n_regionkey")
def user_aggregate(spark: SparkSession, d: str) -> DataFrame:
    values = F.collect_list((F.col("n_nationkey") + 1).cast("long"))
    return table(spark, d, "nation").groupBy("n_regionkey").agg(udf.fold(values, F.lit(1).cast("long"), lambda a, x: a * x).alias("p"))


@query("SELECT c_mktsegment, round(max(c_acctbal) - min(c_acctbal), 2) AS spread FROM customer GROUP BY c_mktsegment")
def pandas_aggregate(spark: SparkSession, d: str) -> DataFrame:
    spread = udf.pandas_aggregate(lambda v: float(v.max() - v.min()))
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.round(spread(F.col("c_acctbal")), 2).alias("spread"))


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 AND n_nationkey > 2 THEN 'v' ELSE n_name END AS n_name FROM nation")
def view_update(spark: SparkSession, d: str) -> DataFrame:
    view = views.View({"id": "n_nationkey", "label": "n_name", "region": "n_regionkey"}, "n_regionkey = 1", check=True)
    return view.update(table(spark, d, "nation"), {"label": F.lit("v")}, F.col("n_nationkey") > 2).table.select("n_nationkey", "n_name")


@query("SELECT n_nationkey, n_nationkey IN (1, 5, 7) AS held FROM nation")
def member_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", F.array_contains(F.from_json(F.lit("[1, 5, 7]"), "array<int>"), F.col("n_nationkey")).alias("held"))


@query("SELECT 55 AS total")
def scripting(spark: SparkSession, d: str) -> DataFrame:
    """A procedural body in SQL."""
    return spark.sql("BEGIN DECLARE i INT = 0; DECLARE total INT = 0; WHILE i < 10 DO SET i = i + 1; SET total = total + i; END WHILE; SELECT total; END")


@query("SELECT 'rows' AS what, true AS near")
def tablesample(spark: SparkSession, d: str) -> DataFrame:
    """10 percent of lineitem within a fifth of the expected number, and the same rows each time."""
    t = table(spark, d, "lineitem")
    one, other = sources.sample(t, 10, 7), sources.sample(t.repartition(3), 10, 7)
    counts = one.agg(F.count(F.lit(1)).alias("a")).crossJoin(other.agg(F.count(F.lit(1)).alias("b"))).crossJoin(t.agg(F.count(F.lit(1)).alias("n")))
    return counts.select(F.lit("rows").alias("what"), ((F.abs(F.col("a") - F.col("n") / 10) <= F.col("n") / 50) & (F.col("a") == F.col("b"))).alias("near"))


@query("SELECT event_id, CASE WHEN cast(props ->> '$.k' AS INT) > 50 THEN '[' || (props ->> '$.k') || ']' ELSE '[]' END AS found, '{\"k\": ' || (props ->> '$.k') || ', \"z\": 1}' AS doc FROM events")
def jsonpath_and_json_set(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("props")
    return table(spark, d, "events").select("event_id", json_udf.path_query_array(p, "$.k ? (@ > 50)").alias("found"), json_udf.json_set(p, "$.z", 1).alias("doc"))


@query("SELECT o_orderkey, cast(o_orderdate + INTERVAL 14 MONTH + INTERVAL 3 DAY + INTERVAL 4 HOUR AS TIMESTAMP) AS due FROM orders")
def interval_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", datetimes.add_interval(F.col("o_orderdate"), datetimes.parse_interval(F.lit("1 year 2 mons 3 days 04:00:00"))).alias("due"))
