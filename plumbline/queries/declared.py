"""Proofs, rules and notes over declared schemas as queries. Their results are facts, so the SQL beside them lists them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import migrate, session, statement, template
from plumbline.catalog import TPCH, Catalog, Key, Rule, parse
from plumbline.operators import predicates, recursive, windows
from plumbline.plans import facts, failures, rules
from plumbline.queries._registry import query
from plumbline.session import table


def _views(spark: SparkSession, d: str, *names: str) -> dict[str, str]:
    for n in names:
        table(spark, d, n).createOrReplaceTempView(f"declared_{n}")
    return {f"declared_{n}": n for n in names}


def _truths(spark: SparkSession, found: dict[str, bool]) -> DataFrame:
    return spark.createDataFrame(list(found.items()), "statement string, holds boolean")


def _listed(**found: bool) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k.replace('_', ' ')}', {str(v).lower()})" for k, v in found.items()) + ") AS t(statement, holds)"


def _rows(columns: str, *found: tuple) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(str(f) if len(f) > 1 else f"('{f[0]}')" for f in found) + f") AS t({columns})"


@query(_listed(grouped_by_the_fixed_column=True, grouped_by_another=False, fixed_below_the_group=True, distinct_fixed=True, limit_in_a_join=False, joined_to_one_row=True, count_in_a_join=False))
def proof_derived_tables(spark: SparkSession, d: str) -> DataFrame:
    names = _views(spark, d, "orders", "customer")
    texts = {
        "grouped by the fixed column": "SELECT * FROM (SELECT o_custkey AS k, count(*) AS n FROM declared_orders GROUP BY o_custkey) x WHERE k = 5",
        "grouped by another": "SELECT * FROM (SELECT o_custkey AS k, o_orderstatus, count(*) AS n FROM declared_orders GROUP BY o_custkey, o_orderstatus) x WHERE k = 5",
        "fixed below the group": "SELECT o_custkey, count(*) AS n FROM declared_orders WHERE o_custkey = 5 GROUP BY o_custkey",
        "distinct fixed": "SELECT * FROM (SELECT DISTINCT o_custkey AS k FROM declared_orders) x WHERE k = 5",
        "limit in a join": "SELECT * FROM declared_orders, (SELECT * FROM declared_customer LIMIT 1) x",
        "joined to one row": "SELECT * FROM declared_orders, (SELECT max(c_custkey) AS m FROM declared_customer) x WHERE o_orderkey = m",
        "count in a join": "SELECT * FROM declared_orders, (SELECT count(*) AS n FROM declared_customer) x",
    }
    return _truths(spark, {k: facts.at_most_one(spark.sql(q), TPCH, names) for k, q in texts.items()})


@query(_listed(predicate_repeated=True, predicate_missing=False, target_by_key=True, target_by_status=False))
def proof_partial_keys_and_targets(spark: SparkSession, d: str) -> DataFrame:
    """A key that holds among open orders only; and the rows that an UPDATE's WHERE lets it change."""
    orders = replace(TPCH["orders"], keys=(*TPCH["orders"].keys, Key(("o_custkey",), where="o_orderstatus = 'P'", name="one_open")))
    catalog = Catalog(TPCH.tables | {"orders": orders})
    names = _views(spark, d, "orders")
    o = table(spark, d, "orders")
    return _truths(spark, {
        "predicate repeated": facts.at_most_one(spark.sql("SELECT * FROM declared_orders WHERE o_custkey = 5 AND 'P' = o_orderstatus"), catalog, names),
        "predicate missing": facts.at_most_one(spark.sql("SELECT * FROM declared_orders WHERE o_custkey = 5"), catalog, names),
        "target by key": facts.single_target(o, "o_orderkey = 7", catalog, "orders"),
        "target by status": facts.single_target(o, "o_orderstatus = 'O'", catalog, "orders"),
    })


@query(_rows("found", ("orders.o_custkey = supplier.s_suppkey: customer.c_custkey, supplier.s_suppkey",)))
def identity_mixing(spark: SparkSession, d: str) -> DataFrame:
    """A join of keys that name different things; the one beside it, of a foreign key with its key, is fine."""
    names = _views(spark, d, "orders", "supplier", "customer")
    df = spark.sql("SELECT 1 AS x FROM declared_orders JOIN declared_supplier ON o_custkey = s_suppkey JOIN declared_customer ON o_custkey = c_custkey")
    return spark.createDataFrame([(m,) for m in facts.mixed(df, TPCH, names)], "found string")


_PRIORITIES = ("5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT")


@query(f"SELECT o_orderkey, cast(list_position({list(_PRIORITIES)}, o_orderpriority) AS INT) AS rank, o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED') AS early, '5-LOW,4-NOT SPECIFIED,3-MEDIUM' AS some FROM orders")
def enum_order(spark: SparkSession, d: str) -> DataFrame:
    """An enum's labels go by their declaration, not by the alphabet."""
    rank = predicates.enum_rank(F.col("o_orderpriority"), _PRIORITIES)
    some = F.array_join(predicates.enum_range(_PRIORITIES, "5-LOW", "3-MEDIUM"), ",")
    return table(spark, d, "orders").select("o_orderkey", rank.cast("int").alias("rank"), (rank < F.lit(_PRIORITIES.index("3-MEDIUM") + 1)).alias("early"), some.alias("some"))


@query(_rows("found", ("orders.o_orderpriority",)))
def enum_sort_note(spark: SparkSession, d: str) -> DataFrame:
    orders = TPCH["orders"]
    labelled = replace(orders, columns=tuple(replace(c, labels=_PRIORITIES) if c.name == "o_orderpriority" else c for c in orders.columns))
    names = _views(spark, d, "orders")
    df = spark.sql("SELECT o_orderkey FROM declared_orders ORDER BY o_orderpriority, o_orderkey")
    return spark.createDataFrame([(m,) for m in facts.enum_sorts(df, Catalog(TPCH.tables | {"orders": labelled}), names)], "found string")


@query(_listed(**{k: True for k in ("window_in_WHERE", "window_in_GROUP_BY", "window_in_a_join", "window_in_a_window", "aggregate_in_WHERE", "aggregate_in_an_aggregate")}, window_in_SELECT=False, window_over_an_aggregate=False))
def banned_forms(spark: SparkSession, d: str) -> DataFrame:
    """Statements that analysis must refuse, and two that it must take."""
    _views(spark, d, "nation")
    w = "row_number() OVER (ORDER BY n_name)"
    texts = {
        "window in WHERE": f"SELECT 1 FROM declared_nation WHERE {w} = 1", "window in GROUP BY": f"SELECT count(*) FROM declared_nation GROUP BY {w}", "window in a join": f"SELECT 1 FROM declared_nation JOIN declared_nation b ON {w.replace('n_name', 'b.n_name')} = 1",
        "window in a window": "SELECT sum(row_number() OVER (ORDER BY n_name)) OVER () FROM declared_nation", "aggregate in WHERE": "SELECT 1 FROM declared_nation WHERE count(*) = 1", "aggregate in an aggregate": "SELECT sum(count(*)) FROM declared_nation GROUP BY n_regionkey",
        "window in SELECT": f"SELECT {w} FROM declared_nation", "window over an aggregate": "SELECT sum(count(*)) OVER () FROM declared_nation GROUP BY n_regionkey",
    }
    return _truths(spark, {k: facts.refusal(spark, q) is not None for k, q in texts.items()})


@query(_listed(two_in_a_circle=True, three_in_a_circle=True, each_by_itself=False, a_chain=False))
def mutual_recursion(spark: SparkSession, d: str) -> DataFrame:
    texts = {
        "two in a circle": "WITH RECURSIVE a AS (SELECT 1 AS n UNION ALL SELECT n FROM b), b AS (SELECT n + 1 AS n FROM a) SELECT * FROM a",
        "three in a circle": "WITH RECURSIVE a AS (SELECT * FROM b), b AS (SELECT * FROM c), c AS (SELECT * FROM a) SELECT * FROM a",
        "each by itself": "WITH RECURSIVE a AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM a WHERE n < 3), b AS (SELECT 1 AS m UNION ALL SELECT m + 1 FROM b WHERE m < 3) SELECT * FROM a, b",
        "a chain": "WITH a AS (SELECT 1 AS n), b AS (SELECT n FROM a), c AS (SELECT n FROM b) SELECT * FROM c",
    }

    def refused(text: str) -> bool:
        try:
            recursive.check_mutual(text)
        except recursive.MutualRecursion:
            return True
        return False

    return _truths(spark, {k: refused(q) for k, q in texts.items()})


@query(_rows("statement, rule", ("by name", "orders pinned"), ("by name", "lineitem pinned"), ("no witness", "customer witness"), ("no view", "nation via"), ("child alone", "lineitem paired"), ("many rows", "orders single")))
def rule_findings(spark: SparkSession, d: str) -> DataFrame:
    """Pinned through a parent, an EXISTS witness, reads through a view, an aggregate root with its lock, single rows; each broken once and kept once."""
    names = _views(spark, d, "orders", "lineitem", "customer", "nation")
    spark.sql("SELECT * FROM declared_nation").createOrReplaceTempView("declared_places")
    given = {
        "orders": (Rule("pinned", ("o_custkey",)), Rule("aggregate", ("lineitem",), label="o_orderkey"), Rule("single")),
        "customer": (Rule("witness", ("c_custkey", "o_custkey")),),
        "nation": (Rule("via", label="declared_places"),),
    }
    catalog = rules.expanded(Catalog(TPCH.tables | {t: replace(TPCH[t], rules=r) for t, r in given.items()}))
    sources = {n: table(spark, d, n) for n in names.values()}
    texts = {
        "through the parent": "SELECT l_partkey FROM declared_lineitem JOIN declared_orders ON l_orderkey = o_orderkey WHERE o_custkey = 5",
        "by name": "SELECT l_partkey FROM declared_lineitem JOIN declared_orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'",
        "witnessed": "SELECT c_name FROM declared_customer WHERE EXISTS (SELECT 1 FROM declared_orders WHERE o_custkey = c_custkey)",
        "no witness": "SELECT c_name FROM declared_customer",
        "through the view": "SELECT n_name FROM declared_places",
        "no view": "SELECT n_name FROM declared_nation",
    }
    found = [(k, f"{f.table} {f.rule}") for k, q in texts.items() for f in rules.check_reads(spark.sql(q), catalog, sources, names)]
    found += [("both", f"{f.table} {f.rule}") for f in rules.check_writes(catalog, [("lineitem", False), ("orders", True)])]
    found += [("child alone", f"{f.table} {f.rule}") for f in rules.check_writes(catalog, [("lineitem", True)])]
    found += [("many rows", f"{f.table} {f.rule}") for f in rules.check_writes(catalog, [("orders", False)])]
    return spark.createDataFrame(found, "statement string, rule string")


@query(_rows("context, rule", ("none", "orders pinned"), ("support", "orders visible")))
def rule_contexts(spark: SparkSession, d: str) -> DataFrame:
    """A context that waives one rule and requires another."""
    names = _views(spark, d, "orders")
    catalog = Catalog(TPCH.tables | {"orders": replace(TPCH["orders"], rules=(Rule("pinned", ("o_custkey",)),))})
    support = rules.Context("support", frozenset({"orders.pinned"}), (("orders", Rule("visible", predicate="o_orderstatus = 'O'")),))
    df, sources = spark.sql("SELECT o_orderkey FROM declared_orders"), {"orders": table(spark, d, "orders")}
    found = [(n, f"{f.table} {f.rule}") for n, c in (("none", catalog), ("support", support.catalog(catalog))) for f in rules.check_reads(df, c, sources, names)]
    return spark.createDataFrame(found, "context string, rule string")


@query("SELECT c_custkey FROM customer WHERE (c_nationkey = 3 OR c_acctbal > 5000) AND c_mktsegment <> 'BUILDING'")
def policies_mixed(spark: SparkSession, d: str) -> DataFrame:
    return rules.policies(table(spark, d, "customer"), ["c_nationkey = 3", "c_acctbal > 5000"], ["c_mktsegment <> 'BUILDING'"]).select("c_custkey")


@query(_rows("failure", ("P0401",), ("orders_pkey",), ("22012",), ("P0002",)))
def raised_failures(spark: SparkSession, d: str) -> DataFrame:
    """Codes that a trigger raises on an insert, and those that reach a caller through the functions that it calls."""
    orders = replace(TPCH["orders"], raises=(("insert", "P0401"), ("delete", "P0402")))
    own = failures.insert_failures(Catalog(TPCH.tables | {"orders": orders}), "orders", ["o_totalprice"])
    bodies = {"pay": "BEGIN IF n = 0 THEN RAISE EXCEPTION 'none' USING ERRCODE = 'P0002'; END IF; PERFORM share(n); END", "share": "BEGIN SIGNAL SQLSTATE '22012'; END"}
    found = (own & {"P0401", "P0402", "orders_pkey"}) | failures.statement_failures(bodies, "SELECT pay(3)")
    return spark.createDataFrame([(f,) for f in sorted(found)], "failure string")


@query(_rows("place, name", *enumerate(TPCH.load_order())))
def fk_order(spark: SparkSession, d: str) -> DataFrame:
    """Tables with parents before children, as loads and new tables go."""
    return spark.createDataFrame(list(enumerate(TPCH.load_order())), "place int, name string")


@query(_rows("op, kind, field", *migrate.alphabet()))
def change_alphabet(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(migrate.alphabet(), "op string, kind string, field string")


@query(_rows("setting, wanted", ("plumbline.never.set", "1")))
def settings_check(spark: SparkSession, d: str) -> DataFrame:
    held = spark.conf.get("spark.sql.session.timeZone")
    found = session.differences(spark, {"plumbline.never.set": "1", "spark.sql.session.timeZone": held})
    return spark.createDataFrame([(k, v) for k, v, _ in found], "setting string, wanted string")


@query(_rows("name, state", ("broken", "42703")))
def statements_verified(spark: SparkSession, d: str) -> DataFrame:
    """Every expansion of declared statements, analyzed and run over empty tables."""
    t = {"orders": table(spark, d, "orders")}
    declared = {
        "fine": statement.query(int, "SELECT o_orderkey FROM {orders}{{if .day}} WHERE o_orderdate >= CAST({{.day}} AS TIMESTAMP_NTZ){{end}}"),
        "broken": statement.query(int, "SELECT o_orderkey FROM {orders}{{if .who}} WHERE o_nobody = {{.who}}{{end}}"),
    }
    found = statement.verify(spark, t, declared, {"fine": {"day": "1995-01-01"}})
    return spark.createDataFrame([(n, p.partition(":")[0]) for n, p in found], "name string, state string")


@query("SELECT 14::BIGINT AS expansions, true AS sparse, true AS every_off, true AS every_on")
def tmpl_sparse(spark: SparkSession, d: str) -> DataFrame:
    """Twelve independent branches: too many for all 4,096 statements, so none, all, and each alone."""
    text = "SELECT 1 AS x" + "".join(f"{{{{if .c{i}}}}}, {i} AS y{i}{{{{end}}}}" for i in range(12))
    found = template.expand(text)
    whole = "SELECT 1 AS x" + "".join(f", {i} AS y{i}" for i in range(12))
    told = {e.sql for e in found}
    return spark.createDataFrame([(len(found), all(e.sparse for e in found), "SELECT 1 AS x" in told, whole in told)], "expansions long, sparse boolean, every_off boolean, every_on boolean")


@query(_rows("kind, wide", ("tinyint", "int"), ("int", "bigint"), ("mediumint", "int"), ("year", "int unsigned"), ("int unsigned", "bigint unsigned"), ("varchar", "varchar")))
def window_widening(spark: SparkSession, d: str) -> DataFrame:
    def told(kind: str) -> str:
        name, unsigned = windows.widened(kind.split()[0], kind.endswith("unsigned"))
        return name + " unsigned" * unsigned

    return spark.createDataFrame([(k, told(k)) for k in ("tinyint", "int", "mediumint", "year", "int unsigned", "varchar")], "kind string, wide string")


@query("SELECT 'r' AS t, 'area' AS column_name, 'int' AS data_type, 5 AS length UNION ALL SELECT 'r', 'label', 'string', 5")
def ddl_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Column lengths and generated columns from DDL."""
    t = parse("CREATE TABLE r (w int PRIMARY KEY, h int, area int GENERATED ALWAYS AS (w * h) STORED, label varchar(5))")["r"]
    return spark.createDataFrame([("r", c.name, c.type, c.length or len(c.generated)) for c in t.columns if c.length or c.generated], "t string, column_name string, data_type string, length int")


@query(_rows("used", *((f"{t}.{c}",) for t, c in (("orders", "o_orderkey"), ("orders", "o_custkey"), ("orders", "o_orderstatus"), ("customer", "c_custkey"), ("customer", "c_nationkey"), ("nation", "n_nationkey")))))
def columns_used(spark: SparkSession, d: str) -> DataFrame:
    names = _views(spark, d, "orders", "customer", "nation")
    text = "SELECT o_orderkey FROM declared_orders JOIN declared_customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' AND c_nationkey IN (SELECT n_nationkey FROM declared_nation)"
    return spark.createDataFrame([(c,) for c in sorted(facts.columns_used(spark.sql(text), names))], "used string")


@query(_rows("name, type, source", ("since", "timestamp_ntz", "orders.o_orderdate"), ("who", "bigint", "orders.o_custkey"), ("state", "string", "orders.o_orderstatus")))
def parameter_types(spark: SparkSession, d: str) -> DataFrame:
    text = "SELECT o_orderkey FROM {orders} WHERE o_orderdate >= :since AND :who = o_custkey AND o_orderstatus IN (:state, 'P') AND length(:other) > 3"
    found = facts.parameter_types(spark, text, {"orders": table(spark, d, "orders")})
    return spark.createDataFrame([(n, *t) for n, t in sorted(found.items())], "name string, type string, source string")


@query(_rows("state, condition, line, col", ("42703", "UNRESOLVED_COLUMN.WITH_SUGGESTION", 2, 7), ("42601", "PARSE_SYNTAX_ERROR", 1, 1), ("42883", "UNRESOLVED_ROUTINE", 1, 8)))
def diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """SQLSTATE, condition and place of an unknown column, a syntax error and an unknown function; a right statement has none."""
    t = {"orders": table(spark, d, "orders")}
    texts = ("SELECT o_orderkey FROM {orders}\nWHERE o_nothing = 1", "SELEC 1", "SELECT no_such_function(o_orderkey) FROM {orders}", "SELECT o_orderkey FROM {orders}")
    found = [x for x in (facts.diagnose(spark, q, t) for q in texts) if x]
    return spark.createDataFrame([(x.state, x.condition, x.line, x.column) for x in found], "state string, condition string, line int, col int")


_BEFORE = "CREATE TABLE a (id int PRIMARY KEY, name varchar(10), old int); CREATE TABLE b (id int PRIMARY KEY, a_id int REFERENCES a (id)); CREATE TABLE gone (x int)"
_AFTER = "CREATE TABLE a (id bigint PRIMARY KEY, label varchar(20) NOT NULL, n int DEFAULT 1 CHECK (n > 0)); CREATE TABLE c (id int PRIMARY KEY); CREATE TABLE b (id int PRIMARY KEY, a_id int REFERENCES a (id) ON DELETE CASCADE, c_id int REFERENCES c (id))"


@query(_rows("place, statement", *enumerate([
    "ALTER TABLE a RENAME COLUMN name TO label", "ALTER TABLE b DROP CONSTRAINT b_a_id_fkey", "ALTER TABLE a DROP COLUMN old", "DROP TABLE gone", "ALTER TABLE a ALTER COLUMN id TYPE bigint", "ALTER TABLE a ALTER COLUMN label SET NOT NULL",
    "CREATE TABLE c (id integer NOT NULL)", "ALTER TABLE a ADD COLUMN n integer DEFAULT 1", "ALTER TABLE b ADD COLUMN c_id integer", "ALTER TABLE c ADD CONSTRAINT c_pkey PRIMARY KEY (id)", "ALTER TABLE a ADD CONSTRAINT a_n_check CHECK (n > 0)",
    "ALTER TABLE b ADD CONSTRAINT b_a_id_fkey FOREIGN KEY (a_id) REFERENCES a (id) ON DELETE CASCADE", "ALTER TABLE b ADD CONSTRAINT b_c_id_fkey FOREIGN KEY (c_id) REFERENCES c (id)",
])))
def ddl_plan(spark: SparkSession, d: str) -> DataFrame:
    """Statements from one schema to the next, in an order that works."""
    found = migrate.ddl(parse(_BEFORE), parse(_AFTER), migrate.Intents({"a.name": "label"}))
    return spark.createDataFrame(list(enumerate(found)), "place int, statement string")


@query("SELECT 'nation' AS name, count(*) AS n FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 'customer', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 1 UNION ALL SELECT 'supplier', count(*) FROM supplier "
    "UNION ALL SELECT 'homeless', count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1 UNION ALL SELECT 'orders', count(*) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 1")  # fmt: skip
def cascade_walk(spark: SparkSession, d: str) -> DataFrame:
    """A region goes: its nations, their customers and these customers' orders with it; suppliers stay without a nation."""
    from plumbline.operators import dml

    def acting(t, action):
        return replace(t, foreign=tuple(replace(f, on_delete=action) for f in t.foreign))

    actions = {"nation": "CASCADE", "customer": "CASCADE", "orders": "CASCADE", "supplier": "SET NULL"}
    tables = Catalog({n: acting(TPCH[n], a) for n, a in actions.items()} | {"region": TPCH["region"]})
    frames = {n: table(spark, d, n) for n in ("nation", "customer", "orders", "supplier")}
    after = dml.cascade_walk(tables, frames, "region", table(spark, d, "region").filter("r_regionkey = 1"))
    counts = [after[n].table.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in frames]
    counts.append(after["supplier"].table.filter("s_nationkey IS NULL").agg(F.count(F.lit(1)).alias("n")).select(F.lit("homeless").alias("name"), "n"))
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("SELECT 'c_mktsegment' AS column_name, 'no label' AS reason, count(*) AS n FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') UNION ALL SELECT 'c_name', 'too long', count(*) FROM customer WHERE length(c_name) > 12 HAVING count(*) > 0 UNION ALL SELECT 'c_custkey', 'out of range', count(*) FROM customer WHERE c_custkey > 127")
def audit_store_errors(spark: SparkSession, d: str) -> DataFrame:
    from plumbline import audit

    declared = parse("CREATE TYPE seg AS ENUM ('BUILDING', 'MACHINERY'); CREATE TABLE t (c_custkey tinyint, c_name varchar(12), c_mktsegment seg)")["t"]
    return audit.store_errors(declared, table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"))


@query(_rows("statement, kind", ("plain", "immutable"), ("clock", "stable"), ("draw", "volatile")))
def volatility(spark: SparkSession, d: str) -> DataFrame:
    texts = {"plain": "SELECT upper('a') AS x", "clock": "SELECT current_timestamp() AS x", "draw": "SELECT rand() + 1 AS x"}
    return spark.createDataFrame([(k, facts.volatility(spark.sql(q))) for k, q in texts.items()], "statement string, kind string")


@query(_listed(by_the_key=False, by_another_column=True))
def group_by_legality(spark: SparkSession, d: str) -> DataFrame:
    """Columns beside GROUP BY that a declared key determines, and ones that none does."""
    from plumbline.operators import rows

    def refused(keys):
        try:
            rows.check_dependent(TPCH["customer"], keys, ["c_name"])
        except rows.NotDependent:
            return True
        return False

    return _truths(spark, {"by the key": refused(["c_custkey", "c_nationkey"]), "by another column": refused(["c_nationkey"])})


@query(_rows("table_name, constraint_type, columns", ("nation", "PRIMARY KEY", "n_nationkey"), ("nation", "FOREIGN KEY", "n_regionkey")))
def catalog_constraints(spark: SparkSession, d: str) -> DataFrame:
    from plumbline.sources import tables as sources

    kept = sources.tables_table(spark, TPCH).filter("table_type = 'BASE TABLE'")
    return sources.constraints_table(spark, TPCH).join(kept, "table_name").filter("table_name = 'nation'").select("table_name", "constraint_type", "columns")
