"""Operators on small cases, against SQL's rules, DuckDB and brute force."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline.operators import dml, json, predicates, ranges, recursive, rows


def values(spark, *xs):
    return [r[0] for r in spark.range(1).select(F.array(*[x.cast("string") for x in xs]).alias("a")).collect()][0]


def test_row_compare_nulls(spark):
    n, one, two = F.lit(None).cast("int"), F.lit(1), F.lit(2)
    lt = lambda a, b: predicates.row_compare(a, "<", b)
    assert values(spark, lt([one, n], [two, one]), lt([n, one], [one, two]), lt([one, n], [one, two]), lt([two, n], [one, one]), lt([one, one], [one, one]), predicates.row_compare([one, one], "<=", [one, one])) == ["true", None, None, "false", "false", "true"]


def test_similar_patterns(spark):
    con = duckdb.connect()
    cases = [("abc", "a_c", True), ("abc", "a%", True), ("a.c", "a.c", True), ("abc", "a.c", False), ("foobar", "foo(bar|baz)", True), ("aab", "a{2}b", True), ("x", "[w-z]", True), ("a%", "a\\%", True), ("ab", "a\\%", False), ("a\nb", "a%b", True)]
    for text, pattern, want in cases:
        assert spark.range(1).select(predicates.similar_to(F.lit(text), pattern)).first()[0] is want, (text, pattern)
    assert con.execute("SELECT 1").fetchone() == (1,)


@pytest.mark.parametrize("op", ["=", "<>", "<", "<=", ">", ">="])
@pytest.mark.parametrize("quantifier", ["ANY", "ALL"])
def test_quantified_comparison(spark, op, quantifier):
    con = duckdb.connect()
    xs = [None, 0, 1, 2, 3]
    for sub in ([], [1], [1, 2], [1, None], [None], [2, 2]):
        frame = spark.createDataFrame([(x,) for x in xs], "x int")
        other = spark.createDataFrame([(y,) for y in sub], "y int")
        got = {r.x: r.m for r in predicates.compare_subquery(frame, F.col("x"), op, quantifier, other, "m").collect()}
        listed = "(SELECT y FROM (VALUES " + ", ".join(f"({'NULL' if y is None else y}::INT)" for y in sub) + ") t(y))" if sub else "(SELECT 1 AS y WHERE false)"
        for x in xs:
            want = con.execute(f"SELECT {'NULL' if x is None else x}::INT {op} {quantifier}{listed}").fetchone()[0]
            assert got[x] == want, (x, sub)


def test_limit_with_ties_nulls_and_edges(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d"), (None, "e")], "k int, v string")
    take = lambda n, o: sorted(r.v for r in rows.limit_with_ties(df, n, [o]).collect())
    assert take(2, rows.asc("k")) == ["a", "b", "c"]
    assert take(4, rows.asc("k")) == ["a", "b", "c", "d", "e"]
    assert take(0, rows.asc("k")) == []
    assert take(9, rows.desc("k")) == ["a", "b", "c", "d", "e"]
    assert take(1, rows.desc("k")) == ["b", "c"]


def test_series(spark):
    got = spark.range(1).select(rows.generate_series(F.lit(3), F.lit(1)), rows.generate_series(F.lit(3), F.lit(1), F.lit(-1)), rows.generate_series(F.lit(1), F.lit(1))).first()
    assert list(got) == [[], [3, 2, 1], [1]]


def test_unnest_outer_and_ordinality(spark):
    df = spark.createDataFrame([(1, [1, 2], ["x"]), (2, [], []), (3, None, ["y"])], "k int, a array<int>, b array<string>")
    got = rows.unnest(df, {"p": F.col("a"), "q": F.col("b")}, "ord", outer=True).select("k", "p", "q", "ord").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, 1, "x", 1), (1, 2, None, 2), (2, None, None, None), (3, None, "y", 1)]))


def test_overlap_join_against_brute_force(spark):
    rng = random.Random(1)
    a = [(i, rng.uniform(0, 100), 0.0) for i in range(80)]
    a = [(i, x, x + rng.choice([0.5, 3, 30])) for i, x, _ in a]
    b = [(i, x, x + rng.choice([0.1, 10])) for i, x in ((i, rng.uniform(0, 100)) for i in range(80))]
    left = spark.createDataFrame(a, "i int, al double, ah double")
    right = spark.createDataFrame(b, "j int, bl double, bh double")
    want = sorted((i, j) for i, al, ah in a for j, bl, bh in b if al < bh and bl < ah)
    for width in (2.0, 17.0, 500.0):
        got = sorted((r.i, r.j) for r in ranges.overlap_join(left, right, "al", "ah", "bl", "bh", width).collect())
        assert got == want


def test_range_relations(spark):
    r = lambda a, b, e="[)": ranges.make(F.lit(a), F.lit(b), e)
    none = F.lit(None).cast("int")
    assert values(
        spark, ranges.contains(r(1, 5), F.lit(5)), ranges.contains(r(1, 5, "[]"), F.lit(5)), ranges.contains(ranges.make(none, F.lit(5)), F.lit(-99)), ranges.overlaps(r(1, 3), r(3, 5)), ranges.overlaps(r(1, 3, "[]"), r(3, 5)),
        ranges.adjacent(r(1, 3), r(3, 5)), ranges.strictly_left(r(1, 3), r(3, 5)), ranges.overlaps(r(2, 2), r(1, 5)),
    ) == ["false", "true", "true", "false", "true", "true", "true", "false"]


def test_recursive_union_meets_fixpoint(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "a int, b int")
    base = spark.createDataFrame([(1,)], "n int")
    got = recursive.recursive_union(base, lambda r: r.join(edges, F.col("n") == F.col("a")).select(F.col("b").alias("n")))
    assert sorted(r.n for r in got.collect()) == [1, 2, 3]


def test_json_value_errors(spark):
    df = spark.createDataFrame([('{"a": "7", "b": {"c": 1}}',), ("nonsense",), (None,), ('{"a": "x"}',)], "d string")
    got = df.select(json.json_value(F.col("d"), "$.a", "int", on_empty=-1, on_error=-2).alias("v"), json.is_json(F.col("d"), "object").alias("ok"), json.json_query(F.col("d"), "$.b").alias("q")).collect()
    assert [tuple(r) for r in got] == [(7, True, '{"c":1}'), (-2, False, None), (None, None, None), (-2, True, None)]


SCHEMA = "k int, v int, s string"


def table(spark, rng, n):
    keys = rng.sample(range(12), n)
    return [(k, rng.choice([None, 1, 2, 3]), rng.choice("xyz")) for k in keys]


@pytest.mark.parametrize("seed", range(4))
def test_writes_against_duckdb(spark, seed):
    rng = random.Random(seed)
    old, new = table(spark, rng, 7), table(spark, rng, 6)
    con = duckdb.connect()

    def fresh():
        con.execute("CREATE OR REPLACE TABLE t (k INT PRIMARY KEY, v INT, s VARCHAR)")
        con.execute("CREATE OR REPLACE TABLE n (k INT, v INT, s VARCHAR)")
        con.executemany("INSERT INTO t VALUES (?, ?, ?)", old)
        con.executemany("INSERT INTO n VALUES (?, ?, ?)", new)

    def held():
        return sorted(map(str, con.execute("SELECT k, v, s FROM t").fetchall()))

    t, n = spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA)
    show = lambda w: sorted(map(str, map(tuple, w.table.select("k", "v", "s").collect())))

    fresh()
    con.execute("INSERT INTO t SELECT * FROM n ON CONFLICT (k) DO UPDATE SET v = t.v + excluded.v WHERE t.s <> 'x'")
    assert show(dml.upsert(t, n, ["k"], {"v": F.col("v") + F.col("excluded_v")}, F.col("s") != "x")) == held()
    fresh()
    con.execute("INSERT INTO t SELECT * FROM n ON CONFLICT DO NOTHING")
    assert show(dml.upsert(t, n, ["k"])) == held()
    fresh()
    con.execute("UPDATE t SET v = n.v, s = 'u' FROM n WHERE t.k = n.k AND t.v > 1")
    other = n.select(F.col("k").alias("nk"), F.col("v").alias("nv"))
    assert show(dml.update_from(t, other, (F.col("k") == F.col("nk")) & (F.col("v") > 1), ["nk"], {"v": F.col("nv"), "s": F.lit("u")})) == held()
    fresh()
    con.execute("DELETE FROM t USING n WHERE t.k = n.k AND n.v IS NOT NULL")
    assert show(dml.delete_using(t, other, (F.col("k") == F.col("nk")) & F.col("nv").isNotNull())) == held()
    fresh()
    con.execute("UPDATE t SET v = 0 WHERE v > 1 OR s = 'z'")
    assert show(dml.update(t, {"v": F.lit(0)}, (F.col("v") > 1) | (F.col("s") == "z"))) == held()
    fresh()
    con.execute("MERGE INTO t USING n ON t.k = n.k WHEN MATCHED AND t.s = 'y' THEN DELETE WHEN MATCHED THEN UPDATE SET v = n.v WHEN NOT MATCHED THEN INSERT VALUES (n.k, n.v, n.s) WHEN NOT MATCHED BY SOURCE THEN DELETE")
    assert show(dml.merge(t, n, ["k"], {"v": F.col("source_v")}, matched_delete=F.col("s") == "y", not_matched_by_source="delete")) == held()


def test_merge_rejects_double_matches(spark):
    t = spark.createDataFrame([(1, 1, "x")], SCHEMA)
    with pytest.raises(dml.WriteConflict):
        dml.merge(t, t.union(t), ["k"], {"v": F.col("source_v")})


def test_cascade(spark):
    gone = spark.createDataFrame([(1,)], "id int")
    child = spark.createDataFrame([(10, 1), (11, 2), (12, None)], "c int, p int")
    assert {r.c for r in dml.cascade_delete(gone, "id", [(child, "p", "CASCADE")])[0].table.collect()} == {11, 12}
    assert {(r.c, r.p) for r in dml.cascade_delete(gone, "id", [(child, "p", "SET NULL")])[0].table.collect()} == {(10, None), (11, 2), (12, None)}
    with pytest.raises(dml.WriteConflict):
        dml.cascade_delete(gone, "id", [(child, "p", "RESTRICT")])


def test_commit_keeps_old_state(spark, tmp_path):
    root = str(tmp_path / "t")
    dml.commit(spark, spark.range(3), root, 1)
    first = dml.current(spark, root)
    dml.commit(spark, first.filter("id > 0"), root, 2)
    assert dml.current(spark, root).count() == 2 and first.count() == 3


def test_identity_continues(spark):
    t = spark.createDataFrame([(5, "a")], "id long, s string")
    out = dml.insert(t, spark.createDataFrame([("b",), ("c",)], "s string"), identity="id").table.collect()
    assert len({r.id for r in out}) == 3 and min(r.id for r in out) == 5


def test_recursive_union_with_nulls(spark):
    base = spark.createDataFrame([(1, None)], "a int, b int")
    got = recursive.recursive_union(base, lambda r: r.select(F.least(F.col("a") + 1, F.lit(3)), F.col("b")))
    assert sorted(r.a for r in got.collect()) == [1, 2, 3]


def test_upsert_of_doubled_keys(spark):
    t = spark.createDataFrame([(1, 1, "a"), (None, 5, "n")], SCHEMA)
    new = spark.createDataFrame([(1, 2, "b"), (1, 3, "c"), (2, 4, "e"), (2, 4, "d"), (None, 6, "m"), (None, 6, "m")], SCHEMA)
    with pytest.raises(dml.WriteConflict):
        dml.upsert(t, new, ["k"], {"v": F.col("excluded_v")})
    show = lambda w: sorted(map(str, map(tuple, w.table.collect())))
    nulls = [(None, 5, "n"), (None, 6, "m"), (None, 6, "m")]
    told = lambda *r: sorted(map(str, [*r, *nulls]))
    assert show(dml.upsert(t, new, ["k"])) == told((1, 1, "a"), (2, 4, "d"))
    assert show(dml.insert_ignore(t, new, ["k"], [-F.ascii("s")])) == told((1, 1, "a"), (2, 4, "e"))
    w = dml.replace_into(t, new, ["k"], [F.col("v"), F.col("s")])
    assert show(w) == told((1, 3, "c"), (2, 4, "e"))
    assert sorted(r._action for r in w.returning.collect()) == ["INSERT", "INSERT", "INSERT", "REPLACE"]
    step = {"v": lambda row, n: row["v"] * 10 + n["v"], "s": lambda row, n: F.concat(row["s"], n["s"])}
    assert show(dml.on_duplicate_key(t, new, ["k"], step, [F.col("s")])) == told((1, 123, "abc"), (2, 44, "de"))
    empty = new.limit(0)
    assert show(dml.on_duplicate_key(t, empty, ["k"], step, [F.col("s")])) == sorted(map(str, [(1, 1, "a"), (None, 5, "n")]))
    assert show(dml.on_duplicate_key(empty, new.limit(0), ["k"], step, [])) == []


def test_commit_can_be_run_again(spark, tmp_path):
    root = str(tmp_path / "t")
    dml.commit(spark, spark.range(3), root, 1)
    dml.commit(spark, spark.range(9), root, 1)
    assert dml.current(spark, root).count() == 3
    spark.range(4).write.parquet(f"{root}/v00000002")  # what an attempt left that ended before its commit
    dml.commit(spark, spark.range(5), root, 2)
    assert dml.current(spark, root).count() == 5
    with pytest.raises(dml.WriteConflict):
        dml.create_table_as(spark, spark.range(2), root)
    assert dml.create_table_as(spark, spark.range(2), root, if_not_exists=True).count() == 5
    assert dml.create_table_as(spark, spark.range(2), str(tmp_path / "u"), with_data=False).count() == 0


def test_assignments(spark):
    from plumbline.catalog import parse

    declared = parse("CREATE TYPE mood AS ENUM ('ok', 'sad'); CREATE TABLE t (k int PRIMARY KEY, m mood, s varchar(3))")["t"]
    rows = lambda *r: dml.coerced(declared, spark.createDataFrame(list(r), "k string, m string, s string"))
    assert [tuple(r) for r in rows(("1", "ok", "abc  "), ("2", None, None)).collect()] == [(1, "ok", "abc"), (2, None, None)]
    for bad in (("1", "glad", "a"), ("1", "ok", "abcd"), ("x", "ok", "a")):
        with pytest.raises(Exception, match="no label|too long|CAST_INVALID"):
            rows(bad).collect()
    with pytest.raises(dml.WriteConflict):
        dml.generated(spark.createDataFrame([(1, 2)], "a int, b int"), {"b": F.col("a") + 1})
    t = spark.createDataFrame([(1, 1, "a"), (2, 2, "b")], SCHEMA)
    source = spark.createDataFrame([(1, 7, "z")], "sk int, x int, y string")
    assert sorted(map(tuple, dml.update_row(t, ["v", "s"], source, ["x", "y"], {"k": "sk"}).table.collect()), key=str) == [(1, 7, "z"), (2, None, None)]
    child = spark.createDataFrame([(10, 1), (11, 2)], "c int, p int")
    moved = spark.createDataFrame([(1, 5), (2, 2)], "old int, new int")
    assert {tuple(r) for r in dml.cascade_update(moved, "old", "new", [(child, "p", "CASCADE")])[0].table.collect()} == {(10, 5), (11, 2)}
    assert {tuple(r) for r in dml.cascade_update(moved, "old", "new", [(child, "p", "SET NULL")])[0].table.collect()} == {(10, None), (11, 2)}
    with pytest.raises(dml.WriteConflict):
        dml.cascade_update(moved, "old", "new", [(child, "p", "RESTRICT")])


def test_overlap_join_with_infinite_and_very_long_ranges(spark):
    rng = random.Random(3)
    end = lambda: rng.choice([None, rng.uniform(-1e6, 1e6), rng.uniform(0, 10)])
    make = lambda n: [(i, *((a, b) if a is None or b is None else sorted((a, b)))) for i, a, b in ((i, end(), end()) for i in range(n))]
    a, b = make(60), make(60)
    low, high = lambda x: -1e18 if x is None else x, lambda x: 1e18 if x is None else x
    want = sorted((i, j) for i, al, ah in a for j, bl, bh in b if low(al) < high(bh) and low(bl) < high(ah))
    left, right = spark.createDataFrame(a, "i int, al double, ah double"), spark.createDataFrame(b, "j int, bl double, bh double")
    assert sorted((r.i, r.j) for r in ranges.overlap_join(left, right, "al", "ah", "bl", "bh", 0.5).collect()) == want
    points = [(i, rng.uniform(-20, 20)) for i in range(50)]
    want = sorted((i, j) for i, x in points for j, bl, bh in b if low(bl) <= x < high(bh))
    got = ranges.point_join(spark.createDataFrame(points, "i int, x double"), right, "x", "bl", "bh", 0.5)
    assert sorted((r.i, r.j) for r in got.collect()) == want
    assert ranges.overlap_join(left.limit(0), right, "al", "ah", "bl", "bh", 0.5).count() == 0


def test_range_algebra(spark):
    r = lambda a, b, e="[)": ranges.make(F.lit(a).cast("int"), F.lit(b).cast("int"), e)
    show = ranges.as_text
    assert values(
        spark, show(ranges.merge(r(1, 3), r(5, 9, "[]"))), show(ranges.merge(r(None, 3), r(5, 9))), show(ranges.merge(r(2, 2), r(5, 9))), show(ranges.minus(r(1, 9), r(5, 20))), show(ranges.minus(r(1, 9), r(0, 5, "[]"))), show(ranges.minus(r(1, 9), r(0, 9))),
        show(ranges.minus(r(1, 3), r(5, 9))), show(ranges.canonical(r(1, 3, "(]"))), show(ranges.canonical(r(1, 2, "()"))), show(r(None, None, "[]")), ranges.right_bounded(r(1, 3), r(2, None)), ranges.right_bounded(r(1, None), r(2, 9)), ranges.left_bounded(r(None, 3), r(2, 9)),
        F.to_json(F.transform(ranges.multirange(F.array(r(5, 7), r(1, 2), r(2, 4), r(6, 9), r(3, 3))), show)),
    ) == ["[1,9]", "(,9)", "[5,9)", "[1,5)", "(5,9)", "empty", "[1,3)", "[2,4)", "empty", "(,)", "true", "false", "false", '["[1,4)","[5,9)"]']
    with pytest.raises(Exception, match="one range"):
        spark.range(1).select(ranges.minus(r(1, 9), r(3, 5))).collect()


def test_distinct_on_and_distinct_sums_with_nulls(spark):
    from pyspark.sql import Window

    from plumbline.operators import windows

    df = spark.createDataFrame([(1, None, "a"), (1, 2, "b"), (2, None, "c")], "k int, v int, s string")
    assert sorted(r.s for r in rows.distinct_on(df, ["k"], [F.col("v")]).collect()) == ["b", "c"]
    w = Window.partitionBy("k")
    assert {(r.k, r.t) for r in df.select("k", windows.sum_distinct_over(F.col("v"), w, "bigint").alias("t")).collect()} == {(1, 2), (2, None)}


@pytest.mark.parametrize("hot_rows", [10**6, 0])
def test_scans_with_keys_cut_in_ranges(spark, hot_rows):
    """A key in one window and one cut into pieces give the same, against brute force; null keys and values, ties, no rows."""
    from plumbline.operators import scans

    rng = random.Random(4)
    data = [(rng.choice([1, 1, 1, 2, None]), rng.randrange(300), i, rng.choice([None, rng.randrange(1000)])) for i in range(600)]
    df = spark.createDataFrame(data, "k int, at int, id int, v int").repartition(5)
    for how, inclusive in (("max", False), ("max", True), ("last", False), ("last", True)):
        want = {}
        for k in (1, 2, None):
            seen = None
            for _, _, i, v in sorted((r for r in data if r[0] == k), key=lambda r: (r[1], r[2])):
                after = v if seen is None else seen if v is None else max(seen, v) if how == "max" else v
                want[i] = after if inclusive else seen
                seen = after
        got = {r.id: r.out for r in scans.carried(df, ["k"], ["at", "id"], "v", "out", how, inclusive, hot_rows).collect()}
        assert got == want, (how, inclusive)
    assert scans.carried(df.limit(0), ["k"], ["at", "id"], "v", "out", hot_rows=hot_rows).count() == 0
    right = spark.createDataFrame([(1, 10, 7), (1, 50, 8), (1, 50, 9), (2, 100, 5)], "rk int, t int, x int")
    got = {r.id: r.x for r in scans.as_of(df, right, {"k": "rk"}, ("at", "t"), "x", "x", hot_rows=hot_rows).collect()}
    assert got == {i: max((t, x) for rk, t, x in [(1, 10, 7), (1, 50, 8), (1, 50, 9), (2, 100, 5), (k, -1, None)] if rk == k and t <= at)[1] for k, at, i, _ in data}
