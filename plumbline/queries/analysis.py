"""Audits, differences and statements as queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import audit, migrate
from plumbline.catalog import TPCH, Catalog, parse
from plumbline.plans import facts, failures
from plumbline.queries._registry import query, scratch
from plumbline.session import table
from plumbline.sources import tables as sources
from plumbline.statement import Session, one
from plumbline.statement import query as statement


@dataclass
class Revenue:
    nation: str
    revenue: float


#: The flagship statement: one branch, two bound values.
REVENUE = statement(
    Revenue,
    """
    SELECT n_name AS nation, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
    WHERE l_shipdate >= CAST({{.since}} AS TIMESTAMP_NTZ) {{if .segment}}AND c_mktsegment = {{.segment}}{{end}}
    GROUP BY n_name ORDER BY revenue DESC, nation
    """,
)


@query("SELECT n_name AS nation, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_shipdate >= TIMESTAMP '1995-01-01 00:00:00' AND c_mktsegment = 'BUILDING' GROUP BY n_name")
def tmpl_branches(spark: SparkSession, d: str) -> DataFrame:
    frames = {t: table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation")}
    return REVENUE.frame(spark, frames, {"since": "1995-01-01", "segment": "BUILDING"})


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O' OR o_orderstatus = 'P'")
def tmpl_range(spark: SparkSession, d: str) -> DataFrame:
    q = statement(object, "SELECT o_orderkey, o_orderstatus FROM {orders} WHERE false{{range .states}} OR o_orderstatus = {{.}}{{end}}")
    return q.frame(spark, {"orders": table(spark, d, "orders")}, {"states": ["O", "P"]})


@query("SELECT 'by key' AS statement, true AS single UNION ALL SELECT 'by status', false UNION ALL SELECT 'aggregate', true UNION ALL SELECT 'through join', true UNION ALL SELECT 'lineitem', false")
def single_row_proof(spark: SparkSession, d: str) -> DataFrame:
    t = {n: table(spark, d, n) for n in ("orders", "customer", "lineitem")}
    for n, df in t.items():
        df.createOrReplaceTempView(f"proof_{n}")
    names = {f"proof_{n}": n for n in t}
    texts = {
        "by key": "SELECT * FROM proof_orders WHERE o_orderkey = 7",
        "by status": "SELECT * FROM proof_orders WHERE o_orderstatus = 'O'",
        "aggregate": "SELECT count(*) AS n FROM proof_orders",
        "through join": "SELECT * FROM proof_orders JOIN proof_customer ON o_custkey = c_custkey WHERE o_orderkey = 7",
        "lineitem": "SELECT * FROM proof_lineitem WHERE l_orderkey = 7 AND l_linenumber = 1",
    }
    return spark.createDataFrame([(k, facts.at_most_one(spark.sql(q), TPCH, names)) for k, q in texts.items()], "statement string, single boolean")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def audit_unique(spark: SparkSession, d: str) -> DataFrame:
    return audit.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3)")
def audit_fk(spark: SparkSession, d: str) -> DataFrame:
    parents = table(spark, d, "customer").filter("c_nationkey <> 3")
    return audit.orphans(table(spark, d, "orders"), ["o_custkey"], parents, ["c_custkey"]).select("o_orderkey", "o_custkey")


@query("SELECT p_partkey, p_size FROM part WHERE NOT (p_size BETWEEN 5 AND 45)")
def audit_check(spark: SparkSession, d: str) -> DataFrame:
    return audit.broken(table(spark, d, "part"), "p_size BETWEEN 5 AND 45").select("p_partkey", "p_size")


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 3")
def audit_not_null(spark: SparkSession, d: str) -> DataFrame:
    return audit.nulls(table(spark, d, "customer").select("c_custkey", F.expr("nullif(c_nationkey, 3)").alias("k")), "k").select("c_custkey")


@query("SELECT event_id, old, event_type AS new FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events) WHERE old <> event_type AND NOT ((old = 'view' AND event_type = 'click') OR (old = 'click' AND event_type = 'purchase'))")
def audit_transitions(spark: SparkSession, d: str) -> DataFrame:
    out = audit.history_transitions(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", [("view", "click"), ("click", "purchase")])
    return out.select("event_id", "old", "new")


@query("SELECT p_partkey FROM (SELECT p_partkey, p_size, max(p_size + 3) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM part) WHERE reach > p_size")
def audit_overlap(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", (F.col("p_size") + 3).alias("high"))
    return audit.overlaps(t, ["p_brand"], "p_size", "high", ["p_partkey"]).select("p_partkey")


@query(
    "SELECT 'orders_o_orderkey_not_null' AS constraint_name, 'not null' AS kind, 0::BIGINT AS violations UNION ALL SELECT 'orders_o_custkey_not_null', 'not null', 0 UNION ALL SELECT 'orders_o_orderstatus_check', 'check', (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F', 'P')) "
    "UNION ALL SELECT 'orders_pkey', 'unique', (SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)) UNION ALL SELECT 'orders_o_custkey_fkey', 'foreign key', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))"
)
def audit_report(spark: SparkSession, d: str) -> DataFrame:
    return audit.report(TPCH["orders"], table(spark, d, "orders"), {"customer": table(spark, d, "customer")})


@query("SELECT 'orders_pkey' AS failure UNION ALL SELECT 'orders_o_custkey_fkey' UNION ALL SELECT 'orders_o_orderkey_not_null' UNION ALL SELECT 'orders_o_custkey_not_null'")
def failure_modes(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(f,) for f in sorted(failures.insert_failures(TPCH, "orders", ["o_orderkey", "o_custkey"]))], "failure string")


@query("SELECT CASE WHEN n.n_nationkey IS NULL THEN 'add' WHEN n.n_nationkey % 5 = 0 THEN 'drop' ELSE 'change' END AS op, coalesce(n.n_nationkey, a.k) AS n_nationkey FROM nation n FULL JOIN (SELECT unnest([100, 101]) AS k) a ON a.k = n.n_nationkey WHERE n.n_nationkey IS NULL OR n.n_nationkey % 5 = 0 OR n.n_nationkey = 7")
def seed_diff(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "nation")
    new = old.filter("n_nationkey % 5 <> 0").withColumn("n_name", F.when(F.col("n_nationkey") == 7, "X").otherwise(F.col("n_name")))
    new = new.unionByName(spark.createDataFrame([(100, "A", 1), (101, "B", 2)], "n_nationkey int, n_name string, n_regionkey int"))
    return migrate.row_changes(old, new, ["n_nationkey"]).select("op", "n_nationkey")


@query("SELECT n_nationkey, CASE WHEN n_nationkey = 7 THEN 'SEVEN' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_nationkey IN (3, 7)")
def seed_merge(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "nation")
    rows = t.filter("n_nationkey IN (3, 7)").withColumn("n_name", F.when(F.col("n_nationkey") == 7, "SEVEN").otherwise(F.col("n_name")))
    return migrate.seed(t, rows, ["n_nationkey"], prune=True).table


_NEW = parse("CREATE TABLE region (r_regionkey int PRIMARY KEY, r_label text NOT NULL, r_rank int DEFAULT 1); CREATE TABLE zone (z int PRIMARY KEY)")
_OLD = Catalog({"region": TPCH["region"]})


@query("SELECT op, kind, name, cast(field AS VARCHAR) AS field, before, after FROM (VALUES ('rename', 'column', 'region.r_name', NULL, 'r_name', 'r_label'), ('add', 'column', 'region.r_rank', NULL, NULL, NULL), ('add', 'table', 'zone', NULL, NULL, NULL)) AS t(op, kind, name, field, before, after)")
def schema_diff(spark: SparkSession, d: str) -> DataFrame:
    return migrate.changes_frame(spark, migrate.compare(_OLD, _NEW, migrate.Intents({"region.r_name": "r_label"})))


@query("SELECT r_regionkey, r_name AS r_label, cast(1 AS INT) AS r_rank FROM region")
def schema_rewrite(spark: SparkSession, d: str) -> DataFrame:
    return migrate.rewrite(table(spark, d, "region"), TPCH["region"], _NEW["region"], migrate.Intents({"region.r_name": "r_label"}))


@query("SELECT n_nationkey FROM nation WHERE n_nationkey >= 10")
def audit_narrowing(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") * 13).alias("v"))
    return audit.narrowing(wide, "v", "tinyint").select("n_nationkey")


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 90, 'NEW' UNION ALL SELECT 91, NULL")
def copy_append(spark: SparkSession, d: str) -> DataFrame:
    @dataclass
    class Region:
        r_regionkey: int
        r_name: str | None

    rows = sources.rows_frame(spark, [Region(90, "NEW"), Region(91, None)], "r_regionkey int, r_name string")
    return table(spark, d, "region").unionByName(rows)


@query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey")
def matview_refresh(spark: SparkSession, d: str) -> DataFrame:
    body = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return sources.refresh(spark, body, scratch(spark, "matview"), 1)


@query("SELECT 'c_custkey' AS name, 'bigint' AS type, false AS nullable, 'customer.c_custkey' AS source UNION ALL SELECT 'seg', 'string', true, 'customer.c_mktsegment' UNION ALL SELECT 'o_totalprice', 'double', true, 'orders.o_totalprice'")
def describe_shape(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer").alias("customer"), table(spark, d, "orders").alias("orders")
    out = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("c_mktsegment").alias("seg"), "o_totalprice")
    return spark.createDataFrame(facts.shape(out, TPCH), "name string, type string, nullable boolean, source string")


@query("SELECT table_name, column_name, data_type FROM (VALUES ('region', 'r_regionkey', 'int'), ('region', 'r_name', 'string')) AS t(table_name, column_name, data_type)")
def information_schema(spark: SparkSession, d: str) -> DataFrame:
    return sources.columns_table(spark, TPCH).filter("table_name = 'region'").select("table_name", "column_name", "data_type")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 5")
def get_one(spark: SparkSession, d: str) -> DataFrame:
    @dataclass
    class Customer:
        c_custkey: int
        c_name: str

    q = one(Customer, "SELECT c_custkey, c_name FROM {customer} WHERE c_custkey = {{.id}}")
    found = Session(spark, {"customer": table(spark, d, "customer")}).get(q, {"id": 5})
    return spark.createDataFrame([(found.c_custkey, found.c_name)], "c_custkey bigint, c_name string")


@query("SELECT c_custkey FROM customer WHERE c_acctbal >= 0 AND c_nationkey = 3")
def row_policy(spark: SparkSession, d: str) -> DataFrame:
    from plumbline.catalog import Rule
    from plumbline.plans import rules

    seen = rules.visible(table(spark, d, "customer"), Rule("visible", predicate="c_acctbal >= 0"))
    return seen.filter("c_nationkey = 3").select("c_custkey")
