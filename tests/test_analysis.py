"""Templates, statements, proofs, failure modes, rules, differences."""

import enum
import random
from dataclasses import dataclass, field, replace

import pytest
from pyspark.sql import functions as F

from plumbline import audit, migrate, template
from plumbline.catalog import TPCH, Catalog, Check, Key, Rule, Table, constraint_name, parse
from plumbline.catalog import Column as C
from plumbline.plans import facts, failures, rules
from plumbline.statement import ManyRows, NoRows, Session, UnknownLabel, check_shape, dataclass_source, one, query, snake
from plumbline.streaming import windows as streams


def test_expansions():
    t = "SELECT 1 {{if .a}}WHERE x = {{.a}}{{else if .b}}WHERE y{{else}}LIMIT 1{{end}}{{if .c}} AND z{{end}}"
    assert len(template.expand(t)) == 6
    assert len(template.expand("{{if .a}}A{{end}}{{if .a}}B{{end}}")) == 2
    assert {e.sql for e in template.expand("f({{range .xs}}{{.}},{{end}})")} == {"f()", "f(:p1,)", "f(:p1,:p2,)"}
    many = "".join(f"{{{{if .c{i}}}}}X{i}{{{{end}}}}" for i in range(9))
    found = template.expand(many)
    assert len(found) == 11 and all(e.sparse for e in found)
    assert {"", "X0", "".join(f"X{i}" for i in range(9))} <= {e.sql for e in found}


def test_render_binds_and_guards():
    t = "SELECT {{.a}}, {{.a}}{{range .xs}}, {{.}}{{end}} {{if and (gt .n 1) (not .off)}}WHERE {{.s}}{{end}}"
    r = template.render(t, {"a": 1, "xs": [5, 6], "n": 2, "off": False, "s": "x'; DROP"})
    assert r.sql == "SELECT :p1, :p1, :p2, :p3 WHERE :p4" and r.args == {"p1": 1, "p2": 5, "p3": 6, "p4": "x'; DROP"}
    template.guard(t, r)
    with pytest.raises(template.TemplateError):
        template.guard("SELECT {{.a}}", template.Rendered("SELECT :p1 OR 1", {}))
    assert template.evaluate(template.condition('or (eq .s "a" "b") (len .xs)'), {"s": "b", "xs": []}) is True
    for bad in ("{{if .a}}", "{{end}}", "{{frob .x}}", "{{else}}"):
        with pytest.raises(template.TemplateError):
            template.parse(bad)


def test_hazards():
    assert len(template.hazards("SELECT '{{.a}}' FROM t -- {{.b}}\nORDER BY {{.c}}")) == 3
    assert template.hazards("SELECT {{.a}} ORDER BY x") == []


class Status(enum.Enum):
    OPEN = "O"
    FINAL = "F"


@dataclass
class Money:
    o_totalprice: float


@dataclass
class Order:
    o_orderkey: int
    status: Status = field(metadata={"column": "o_orderstatus"})
    money: Money = field(metadata={"embedded": True})


def test_statements(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    s = Session(spark, {"orders": orders})
    q = query(Order, "SELECT o_orderkey, o_orderstatus, o_totalprice FROM {orders} WHERE o_orderstatus = {{.s}} ORDER BY o_orderkey")
    assert q.check(spark, {"orders": orders}) == []
    got = s.collect(q, {"s": "F"})
    assert got[0].status is Status.FINAL and got[0].money.o_totalprice > 0
    assert next(s.run(q, {"s": "F"})) == got[0] == s.first(q, {"s": "F"})
    with pytest.raises(UnknownLabel):
        s.collect(q, {"s": "P"})
    with pytest.raises(NoRows):
        s.get(q, {"s": "none"})
    with pytest.raises(ManyRows):
        s.find(q, {"s": "F"})
    key = one(int, "SELECT max(o_orderkey) AS k FROM {orders}")
    assert s.batch([(key, None), (q, {"s": "O"})])[0] == [s.get(key)]
    bad = query(Order, "SELECT o_orderkey, nope FROM {orders}{{if .x}} WHERE o_totalprice{{end}}")
    assert any("42703" in p for p in bad.check(spark, {"orders": orders}))
    assert check_shape(Order, orders.schema) and snake("customerID") == "customer_id" and snake("HTTPServer") == "http_server"
    assert "o_totalprice: float | None" in dataclass_source("Row", orders.schema)


def test_proofs_are_sound(spark):
    """Whatever is proved to give one row at most does so on random rows."""
    rng = random.Random(7)
    catalog = Catalog({n: Table(n, (C("id", "int", False), C("a", "int"), C("u", "int", False)), (Key(("id",), True, name=f"{n}_pkey"), Key(("u",), name=f"{n}_u_key"))) for n in ("t1", "t2")})
    names = {"pr_t1": "t1", "pr_t2": "t2"}
    proved = 0
    where = ["x.id = 1", "x.u = 2", "x.a = 1", "x.id = y.id", "x.a = y.u", "x.id > 1", "y.id = 2", "x.u = y.a", "x.id IN (1, 2)", "x.id = x.a", "x.id = 1 OR x.a = 1"]
    for turn in range(40):
        for t in ("t1", "t2"):
            ids = rng.sample(range(5), 4)
            us = rng.sample(range(5), 4)
            spark.createDataFrame([(i, rng.choice([None, 0, 1, 2]), u) for i, u in zip(ids, us, strict=True)], "id int, a int, u int").createOrReplaceTempView(f"pr_{t}")
        how = rng.choice(["JOIN", "LEFT JOIN", "CROSS JOIN", "FULL JOIN"])
        on = "" if how == "CROSS JOIN" else " ON " + " AND ".join(rng.sample([w for w in where if "y" in w], rng.randrange(1, 3)))
        text = f"SELECT * FROM pr_t1 x {how} pr_t2 y{on} WHERE " + " AND ".join(rng.sample(where, rng.randrange(1, 4)))
        text = rng.choice([text, f"SELECT count(*) AS n FROM ({text})", f"{text} LIMIT 1", f"SELECT x.a, count(*) AS n FROM pr_t1 x WHERE x.id = 1 GROUP BY x.a"])
        df = spark.sql(text)
        if facts.at_most_one(df, catalog, names | {"x": "t1", "y": "t2"}):
            proved += 1
            assert len(df.limit(2).collect()) <= 1, text
    assert proved >= 5


def test_advice(spark):
    assert any("LIMIT" in a for a in facts.advice(spark.range(5).limit(2)))
    assert facts.advice(spark.range(5).orderBy("id").limit(2)) == []


def test_names():
    assert constraint_name("orders", ("user_id", "note"), "key") == "orders_user_id_note_key"
    assert len(constraint_name("t" * 70, ("c" * 70,), "fkey")) == 63
    assert constraint_name("t", (), "check", frozenset({"t_check"})) == "t_check1"


DDL = """
CREATE TYPE mood AS ENUM ('sad', 'ok', 'happy'); -- ordered
CREATE DOMAIN yen AS bigint CHECK (VALUE >= 0);
CREATE TABLE users (id bigserial PRIMARY KEY, email varchar(50) UNIQUE NOT NULL, m mood DEFAULT 'ok', balance yen, tags text[]);
CREATE TABLE posts (id int, line int, user_id bigint REFERENCES users ON DELETE CASCADE, n numeric(6,2) CHECK (n > 0), PRIMARY KEY (id, line), UNIQUE (user_id, n));
CREATE UNIQUE INDEX live ON posts (user_id) WHERE n > 5;
CREATE VIEW v AS SELECT 1;
ALTER TABLE posts ADD COLUMN note text; ALTER TABLE posts RENAME COLUMN note TO remark;
"""


def test_ddl():
    c = parse(DDL)
    users, posts = c["users"], c["posts"]
    assert users.column("m").labels == ("sad", "ok", "happy") and users.column("balance").unit == "yen" and users.column("tags").type == "array<string>"
    assert [k.name for k in posts.keys] == ["posts_pkey", "posts_user_id_n_key", "live"]
    assert posts.foreign[0].parent == ("id",) and posts.foreign[0].on_delete == "CASCADE"
    assert users.checks[0].predicate == "balance >= 0" and posts.column("remark").type == "string"
    assert c.load_order().index("users") < c.load_order().index("posts")
    assert parse("DROP TABLE posts", c).tables.keys() == {"users", "v"}


def test_failure_modes():
    c = parse(DDL)
    assert failures.insert_failures(c, "users", ["email", "balance"]) == {"users_email_key", "users_balance_check", "users_email_not_null"}
    assert "users_email_key" not in failures.insert_failures(c, "users", ["email"], ("email",))
    assert failures.update_failures(c, "posts", ["n"]) == {"posts_n_check", "posts_user_id_n_key"}
    assert failures.delete_failures(TPCH, "nation") == {"customer_c_nationkey_fkey", "supplier_s_nationkey_fkey"}
    assert failures.delete_failures(c, "users") == set()
    assert failures.expectations({"a", "b"}, {"b", "c"}) == ({"c"}, {"a"})


def test_verify_raises_the_constraint(spark):
    c = parse("CREATE TABLE p (id int PRIMARY KEY); CREATE TABLE t (id int PRIMARY KEY, p int REFERENCES p (id), n int CHECK (n > 0))")
    parents = {"p": spark.createDataFrame([(1,)], "id int")}
    schema = "id int, p int, n int"
    good = spark.createDataFrame([(1, 1, 5), (2, None, None)], schema)
    failures.verify(c, "t", good, parents)
    for row, name in (((None, 1, 1), "t_id_not_null"), ((3, 9, 1), "t_p_fkey"), ((3, 1, 0), "t_n_check"), ((1, 1, 1), "t_pkey")):
        with pytest.raises(failures.ConstraintViolation) as e:
            failures.verify(c, "t", spark.createDataFrame([row], schema), parents, good)
        assert e.value.constraint == name


def test_audits(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 3, 9), (2, 0, 1), (2, 1, 2)], "k int, lo int, hi int")
    assert [r.lo for r in audit.overlaps(df, ["k"], "lo", "hi").collect()] == [3]
    before, after = (spark.createDataFrame(x, "id int, s string") for x in ([(1, "a"), (2, "a"), (3, "b")], [(1, "b"), (2, "c"), (3, "b")]))
    assert [tuple(r) for r in audit.transitions(before, after, ["id"], "s", [("a", "b")]).collect()] == [(2, "a", "c")]
    assert audit.report(TPCH["region"], spark.createDataFrame([(1, None), (1, "x")], "r_regionkey int, r_name string"), {}).filter("violations > 0").count() == 2


def test_rules(spark):
    rule = (Rule("visible", predicate="gone IS NULL"), Rule("pinned", ("tenant",)), Rule("sensitive", ("mail",), label="pii"), Rule("immutable", ("id",)), Rule("transitions", ("state",), moves=(("a", "b"),)))
    cols = tuple(C(n, "string") for n in ("id", "tenant", "mail", "state", "gone"))
    catalog = Catalog({"memo": Table("memo", cols, rules=rule)})
    df = spark.createDataFrame([("1", "t", "m", "a", None)], "id string, tenant string, mail string, state string, gone string").alias("memo")
    sources = {"memo": df}
    kinds = lambda q, **k: {f.rule for f in rules.check_reads(q, catalog, sources, **k)}
    assert kinds(df.select("id", "mail")) == {"visible", "pinned", "sensitive"}
    assert kinds(df.filter("gone IS NULL AND tenant = 't'").select("id")) == set()
    assert kinds(df.filter("tenant = 't'").select("mail"), waived=frozenset({"memo.visible"}), may_read=frozenset({"pii"})) == set()
    assert {f.rule for f in rules.check_update(catalog, "memo", {"id": "1", "state": "b"}, {"state": "a"})} == {"immutable"}
    assert {f.rule for f in rules.check_update(catalog, "memo", {"state": "a"}, {"state": "b"})} == {"transitions"}
    assert rules.visible(df, rule[0]).count() == 1


def test_migration(spark):
    old = parse("CREATE TABLE t (id int PRIMARY KEY, a text, mood enum('x', 'y'))")
    new = parse("CREATE TABLE t (id bigint PRIMARY KEY, b text NOT NULL, mood enum('x', 'z'), n int DEFAULT 3)")
    intents = migrate.Intents({"t.a": "b"}, backfill={"t.b": "'none'"}, relabel={"t.mood": {"y": "z"}})
    changes = migrate.compare(old, new, intents)
    assert [c.op for c in changes] == sorted((c.op for c in changes), key=["drop", "rename", "alter", "add"].index)
    df = spark.createDataFrame([(1, None, "y"), (2, "q", "x")], "id int, a string, mood string")
    out = migrate.rewrite(df, old["t"], new["t"], intents)
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(1, "none", "z", 3), (2, "q", "x", 3)]
    assert out.schema["id"].dataType.simpleString() == "bigint"
    with pytest.raises(migrate.UnsafeMigration):
        migrate.rewrite(df, old["t"], new["t"])
    assert migrate.drift(new, {"t": out}) == [] and migrate.drift(new, {"t": df})
    assert migrate.consumers(changes, {"q1": "SELECT a FROM t", "q2": "SELECT id FROM t"}) == {"q1": ["a"]}
    assert replace(old["t"], checks=(Check("a"),)).checks


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src = str(tmp_path / "in")
    events.repartition(4).write.parquet(src)
    stream = streams.read(spark, src, events, 2)
    q = streams.tumbling(stream, "1 day", ["event_type"], late="400 days").writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted(map(tuple, streams.tumbling(events, "1 day", ["event_type"]).select("start", "event_type", "n").collect()))
    assert sorted(map(tuple, spark.sql("SELECT start, event_type, n FROM days").collect())) == want
    root = str(tmp_path / "state")
    streams.upsert_stream(streams.read(spark, src, events, 2), root, ["event_id"], str(tmp_path / "cp"), ["ts"]).awaitTermination(120)
    from plumbline.operators import dml

    assert dml.current(spark, root).count() == events.count()
