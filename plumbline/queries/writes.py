"""Writes as queries: the state after the write, or the rows that RETURNING gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog import parse
from plumbline.operators import dml
from plumbline.queries._registry import query, scratch
from plumbline.session import table


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier")


def _proposed(spark: SparkSession, d: str) -> DataFrame:
    """One row for every supplier: even keys are held, odd ones are new."""
    t = table(spark, d, "supplier")
    return t.select((F.col("s_suppkey") + F.when(F.col("s_suppkey") % 2 == 0, 0).otherwise(1000000000)).alias("s_suppkey"), F.concat(F.lit("new "), "s_name").alias("s_name"), "s_nationkey", (F.col("s_acctbal") + 1).alias("s_acctbal"))


_PROPOSED = "p AS (SELECT s_suppkey + CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 1000000000 END AS s_suppkey, 'new ' || s_name AS s_name, s_nationkey, s_acctbal + 1 AS s_acctbal FROM supplier)"


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier UNION ALL SELECT s_suppkey + 1000000000, 'ins', s_nationkey, 0.5 FROM supplier")
def insert_defaults(spark: SparkSession, d: str) -> DataFrame:
    t = _suppliers(spark, d)
    rows = t.select((F.col("s_suppkey") + 1000000000).alias("s_suppkey"), "s_nationkey")
    return dml.insert(t, rows, {"s_name": F.lit("ins"), "s_acctbal": F.lit(0.5)}).table


@query(f"WITH {_PROPOSED} SELECT coalesce(s.s_suppkey, p.s_suppkey) AS s_suppkey, coalesce(p.s_name, s.s_name) AS s_name, CASE WHEN s.s_suppkey IS NULL THEN p.s_nationkey ELSE s.s_nationkey END AS s_nationkey, CASE WHEN p.s_suppkey IS NULL THEN s.s_acctbal WHEN s.s_suppkey IS NULL THEN p.s_acctbal ELSE s.s_acctbal + p.s_acctbal END AS s_acctbal FROM supplier s FULL JOIN p ON s.s_suppkey = p.s_suppkey")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    return dml.upsert(_suppliers(spark, d), _proposed(spark, d), ["s_suppkey"], {"s_name": F.col("excluded_s_name"), "s_acctbal": F.col("s_acctbal") + F.col("excluded_s_acctbal")}).table


@query(f"WITH {_PROPOSED} SELECT * FROM supplier UNION ALL SELECT * FROM p WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier)")
def upsert_do_nothing(spark: SparkSession, d: str) -> DataFrame:
    return dml.upsert(_suppliers(spark, d), _proposed(spark, d), ["s_suppkey"]).table


@query("SELECT s_suppkey, s_acctbal AS old_balance, s_acctbal * 2 AS new_balance FROM supplier WHERE s_acctbal < 0")
def update_returning(spark: SparkSession, d: str) -> DataFrame:
    w = dml.update(_suppliers(spark, d), {"s_acctbal": F.col("s_acctbal") * 2}, F.col("s_acctbal") < 0)
    return w.returning.select("s_suppkey", F.col("old_s_acctbal").alias("old_balance"), F.col("s_acctbal").alias("new_balance"))


@query("SELECT s_suppkey, CASE WHEN n_regionkey = 1 THEN 'in ' || n_name ELSE s_name END AS s_name, s_nationkey, s_acctbal FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def update_from(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").filter("n_regionkey = 1")
    return dml.update_from(_suppliers(spark, d), nations, F.col("s_nationkey") == F.col("n_nationkey"), ["n_nationkey"], {"s_name": F.concat(F.lit("in "), "n_name")}).table


@query("SELECT * FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def delete_using(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").filter("n_regionkey = 2")
    return dml.delete_using(_suppliers(spark, d), nations, F.col("s_nationkey") == F.col("n_nationkey")).table


@query(f"WITH {_PROPOSED} SELECT action, count(*) AS n, cast(sum(k) AS BIGINT) AS keys FROM (SELECT coalesce(s.s_suppkey, p.s_suppkey) AS k, CASE WHEN s.s_suppkey IS NULL THEN 'INSERT' WHEN p.s_suppkey IS NULL THEN NULL WHEN p.s_suppkey = 4 THEN 'DELETE' ELSE 'UPDATE' END AS action FROM supplier s FULL JOIN p ON s.s_suppkey = p.s_suppkey) WHERE action IS NOT NULL GROUP BY action")
def merge_actions(spark: SparkSession, d: str) -> DataFrame:
    w = dml.merge(_suppliers(spark, d), _proposed(spark, d), ["s_suppkey"], {"s_name": F.col("source_s_name")}, matched_delete=F.col("s_suppkey") == 4)
    return w.returning.groupBy(F.col("_action").alias("action")).agg(F.count(F.lit(1)).alias("n"), F.sum("s_suppkey").alias("keys"))


@query(f"WITH {_PROPOSED} SELECT s_suppkey, s_name FROM p")
def merge_not_matched_by_source(spark: SparkSession, d: str) -> DataFrame:
    w = dml.merge(_suppliers(spark, d), _proposed(spark, d), ["s_suppkey"], {"s_name": F.col("source_s_name")}, not_matched_by_source="delete")
    return w.table.select("s_suppkey", "s_name")


@query("SELECT n_regionkey, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal < 1000 GROUP BY n_regionkey")
def dml_cte_returning(spark: SparkSession, d: str) -> DataFrame:
    """WITH gone AS (DELETE ... RETURNING *) SELECT ... FROM gone: the deleted rows are a DataFrame like any other."""
    gone = dml.delete(_suppliers(spark, d), F.col("s_acctbal") < 1000).returning
    return gone.join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "customer").filter("c_acctbal < 0")
    (orders,) = dml.cascade_delete(gone, "c_custkey", [(table(spark, d, "orders"), "o_custkey", "CASCADE")])
    return orders.table.select("o_orderkey", "o_custkey")


def _twice(spark: SparkSession, d: str) -> DataFrame:
    """Each proposed row and a second one with its key; `turn` says which comes first."""
    p = _proposed(spark, d).withColumn("turn", F.lit(1))
    return p.unionByName(p.withColumns({"s_name": F.concat(F.lit("again "), "s_name"), "s_acctbal": F.col("s_acctbal") + 10, "turn": F.lit(2)}))


_TWICE = f"{_PROPOSED}, q AS (SELECT *, 1 AS turn FROM p UNION ALL SELECT s_suppkey, 'again ' || s_name, s_nationkey, s_acctbal + 10, 2 FROM p)"


@query(f"WITH {_TWICE} SELECT 'raises' AS told, 1::BIGINT AS n UNION ALL SELECT 'kept', count(*) FROM (SELECT s_suppkey FROM supplier UNION SELECT s_suppkey FROM q)")
def upsert_conflict(spark: SparkSession, d: str) -> DataFrame:
    """Two proposed rows for one key: DO UPDATE refuses them, DO NOTHING takes one."""
    t, twice = _suppliers(spark, d), _twice(spark, d).drop("turn")
    try:
        dml.upsert(t, twice, ["s_suppkey"], {"s_name": F.col("excluded_s_name")})
        raised = 0
    except dml.WriteConflict:
        raised = 1
    kept = dml.upsert(t, twice, ["s_suppkey"]).table.agg(F.count(F.lit(1)).alias("n"))
    return spark.createDataFrame([("raises", raised)], "told string, n long").unionByName(kept.select(F.lit("kept").alias("told"), "n"))


@query(f"WITH {_TWICE} SELECT * FROM supplier UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM q WHERE turn = 1 AND s_suppkey NOT IN (SELECT s_suppkey FROM supplier)")
def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    return dml.insert_ignore(_suppliers(spark, d), _twice(spark, d), ["s_suppkey"], [F.col("turn")]).table


@query(f"WITH {_TWICE} SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM q WHERE turn = 2 UNION ALL SELECT * FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM q)")
def replace_into(spark: SparkSession, d: str) -> DataFrame:
    return dml.replace_into(_suppliers(spark, d), _twice(spark, d), ["s_suppkey"], [F.col("turn")]).table


@query(f"WITH {_TWICE}, g AS (SELECT s_suppkey, count(*) AS n, sum(s_acctbal) AS total, max(s_name) FILTER (WHERE turn = 1) AS first, max(s_name) FILTER (WHERE turn = 2) AS last, max(s_nationkey) AS nation FROM q GROUP BY s_suppkey) "
    "SELECT coalesce(s.s_suppkey, g.s_suppkey) AS s_suppkey, coalesce(g.last, s.s_name) AS s_name, coalesce(s.s_nationkey, g.nation) AS s_nationkey, round(coalesce(s.s_acctbal, 0) + coalesce(g.total, 0), 4) AS s_acctbal FROM supplier s FULL JOIN g ON s.s_suppkey = g.s_suppkey")  # fmt: skip
def on_duplicate_key(spark: SparkSession, d: str) -> DataFrame:
    assign = {"s_name": lambda row, new: new["s_name"], "s_acctbal": lambda row, new: row["s_acctbal"] + new["s_acctbal"]}
    out = dml.on_duplicate_key(_suppliers(spark, d), _twice(spark, d), ["s_suppkey"], assign, [F.col("turn")]).table
    return out.withColumn("s_acctbal", F.round("s_acctbal", 4))


@query("SELECT 0::BIGINT AS n")
def truncate_table(spark: SparkSession, d: str) -> DataFrame:
    return dml.truncate(_suppliers(spark, d)).table.agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey")
def create_table_as(spark: SparkSession, d: str) -> DataFrame:
    rows = _suppliers(spark, d).groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return dml.create_table_as(spark, rows, scratch(spark, "ctas"))


@query("SELECT s_suppkey, n_name AS s_name, n_regionkey AS s_nationkey, s_acctbal FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON s_nationkey = n_nationkey")
def update_row_subquery(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").filter("n_regionkey < 3")
    return dml.update_row(_suppliers(spark, d), ["s_name", "s_nationkey"], nations, ["n_name", "n_regionkey"], {"s_nationkey": "n_nationkey"}).table


@query("SELECT s_suppkey, s_acctbal, round(s_acctbal * 1.1, 4) AS gross, upper(s_name) AS shout FROM supplier")
def generated_columns(spark: SparkSession, d: str) -> DataFrame:
    rows = _suppliers(spark, d).select("s_suppkey", "s_acctbal", "s_name")
    return dml.generated(rows, {"gross": F.round(F.col("s_acctbal") * 1.1, 4), "shout": F.upper("s_name")}).drop("s_name")


@query("SELECT c_custkey, c_mktsegment, cast(round(c_acctbal, 1) AS DECIMAL(12, 1)) AS balance, 'ab' AS code FROM customer")
def assignment_coercion(spark: SparkSession, d: str) -> DataFrame:
    """A label of an enum, a number rounded to its column's scale, blanks beyond a column's length cut."""
    declared = parse("CREATE TYPE segment AS ENUM ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'); CREATE TABLE t (c_custkey bigint PRIMARY KEY, c_mktsegment segment, balance numeric(12, 1), code varchar(2))")["t"]
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.col("c_acctbal").alias("balance"), F.lit("ab   ").alias("code"))
    return dml.coerced(declared, rows)


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 11 WHEN n_regionkey = 2 THEN 12 ELSE n_regionkey END AS n_regionkey FROM nation")
def cascade_update(spark: SparkSession, d: str) -> DataFrame:
    moved = table(spark, d, "region").select("r_regionkey", F.when(F.col("r_regionkey").isin(1, 2), F.col("r_regionkey") + 10).otherwise(F.col("r_regionkey")).alias("new_key"))
    (nations,) = dml.cascade_update(moved, "r_regionkey", "new_key", [(table(spark, d, "nation"), "n_regionkey", "CASCADE")])
    return nations.table.select("n_nationkey", "n_regionkey")
