"""Scalar functions by SQL name, each on known values."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import registry as fn

def mysql_cases():
    day = F.lit("2024-01-06").cast("date")
    ts = F.lit("2024-02-29 13:05:07").cast("timestamp")
    null = F.lit(None).cast("int")
    return [
        ("GREATEST", (F.lit(1), null), None), ("LEAST", (F.lit(3), F.lit(2)), 2), ("ACOS", (F.lit(2.0),), None), ("LOG", (F.lit(0.0),), None), ("LOG", (F.lit(2.0), F.lit(8.0)), 3.0), ("SQRT", (F.lit(-1.0),), None),
        ("TRUNCATE", (F.lit(-1.999), 1), -1.9), ("DIV", (F.lit(-7), F.lit(2)), -3), ("DIV", (F.lit(7), F.lit(0)), None), ("MOD", (F.lit(7), F.lit(0)), None), ("INTERVAL", (F.lit(23), F.lit(1), F.lit(15), F.lit(30)), 2), ("INTERVAL", (null, F.lit(1)), -1),
        ("ELT", (F.lit(2), F.lit("a"), F.lit("b")), "b"), ("FIELD", (F.lit("b"), F.lit("a"), F.lit("b")), 2), ("FIELD", (F.lit("z"), F.lit("a")), 0), ("MAKE_SET", (F.lit(5), F.lit("a"), F.lit("b"), F.lit("c")), "a,c"), ("EXPORT_SET", (F.lit(5), "Y", "N", ",", 4), "Y,N,Y,N"),
        ("QUOTE", (F.lit("Don't"),), "'Don\\'t'"), ("ORD", (F.lit("é"),), 0xC3A9), ("INSERT", (F.lit("Quadratic"), F.lit(3), F.lit(4), F.lit("What")), "QuWhattic"), ("INSERT", (F.lit("Quadratic"), F.lit(-1), F.lit(4), F.lit("What")), "Quadratic"),
        ("STRCMP", (F.lit("a"), F.lit("b")), -1), ("SPACE", (F.lit(3),), "   "), ("SUBSTRING_INDEX", (F.lit("a.b.c"), ".", 2), "a.b"), ("TO_DAYS", (day,), 739256), ("FROM_DAYS", (F.lit(739256),), "2024-01-06"), ("TO_SECONDS", (F.lit("2009-11-29").cast("timestamp"),), 63426672000),
        ("PERIOD_ADD", (F.lit(200801), F.lit(2)), 200803), ("PERIOD_DIFF", (F.lit(200802), F.lit(200703)), 11), ("MAKEDATE", (F.lit(2011), F.lit(32)), "2011-02-01"), ("MAKEDATE", (F.lit(2011), F.lit(0)), None), ("SEC_TO_TIME", (F.lit(2378),), "00:39:38"), ("SEC_TO_TIME", (F.lit(-400000),), "-111:06:40"),
        ("TIME_TO_SEC", (F.lit("22:23:00"),), 80580), ("DATE_FORMAT", (ts, "%Y-%m-%d %H:%i:%s"), "2024-02-29 13:05:07"), ("DATE_FORMAT", (ts, "it's %W"), "it's Thursday"), ("STR_TO_DATE", (F.lit("01,5,2013"), "%d,%c,%Y"), "2013-05-01 00:00:00"), ("WEEK", (day,), 0), ("WEEK", (F.lit("2008-02-20").cast("date"),), 7),
        ("YEARWEEK", (F.lit("1987-01-01").cast("date"),), 198652), ("INET_ATON", (F.lit("10.0.5.9"),), 167773449), ("INET_NTOA", (F.lit(167773449),), "10.0.5.9"), ("INET_ATON", (F.lit("10.0.5.999"),), None), ("IS_IPV4", (F.lit("10.0.5.256"),), False), ("IS_IPV6", (F.lit("::1"),), True), ("IS_IPV6", (F.lit("1:2"),), False),
        ("IS_IPV6", (F.lit("fe80::1:2.3.4.5"),), True), ("IS_UUID", (F.lit("6ccd780c-baba-1026-9564-5b8c656024db"),), True), ("FORMAT_BYTES", (F.lit(512),), " 512 bytes"), ("FORMAT_BYTES", (F.lit(18446644073709551615.0),), "16.00 EiB"), ("JSON_LENGTH", (F.lit("[1,2,{}]"),), 3), ("JSON_LENGTH", (F.lit('{"a":1}'),), 1),
        ("JSON_VALID", (F.lit("{"),), False), ("JSON_UNQUOTE", (F.lit('"a\\"b"'),), 'a"b'), ("JSON_QUOTE", (F.lit('a"b'),), '"a\\"b"'), ("JSON_MERGE_PATCH", (F.lit('{"a":1,"b":2}'), F.lit('{"b":null,"c":3}')), '{"a":1,"c":3}'), ("JSON_CONTAINS", (F.lit("[1,2]"), F.lit("2")), True), ("IF", (null.cast("boolean"), F.lit(1), F.lit(2)), 2),
        ("CRC32", (F.lit("MySQL"),), 3259397556), ("CONV", (F.lit("a"), 16, 2), "1010"), ("OCT", (F.lit("12"),), "14"), ("MATCH", (F.lit("The quick, quick fox"), ["Quick", "dog", "fox"]), 2),
    ]


def postgres_cases():
    null = F.lit(None).cast("int")
    return [
        ("num_nulls", (F.lit(1), null, null), 2), ("initcap", (F.lit("hi THOMAS-lee o'neil"),), "Hi Thomas-Lee O'Neil"), ("similarity", (F.lit("word"), F.lit("word")), 1.0), ("unaccent", (F.lit("Hôtel Ångström"),), "Hotel Angstrom"), ("difference", (F.lit("Anne"), F.lit("Ann")), 4), ("nlevel", (F.lit("a.b.c"),), 3),
        ("subpath", (F.lit("a.b.c.d"), 1, 2), "b.c"), ("lca", (F.lit("1.2.3"), F.lit("1.2.4.5")), "1.2"), ("ltree_isparent", (F.lit("a.b"), F.lit("a.b.c")), True), ("isn_ok", (F.lit("978-0-393-04002-9"),), True), ("isn_ok", (F.lit("978-0-393-04002-8"),), False), ("div", (F.lit(-7), F.lit(2)), -3),
        ("digest", (F.lit("abc"), "sha256"), "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"), ("hmac", (F.lit("what do ya want for nothing?"), b"Jefe"), "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"),
        ("earth_distance", (F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)), 20037605.73), ("word_similarity", (F.lit("word"), F.lit("words")), 0.8),
    ]


@pytest.mark.parametrize("dialect,cases", [("mysql", mysql_cases), ("postgres", postgres_cases)])
def test_known_values(spark, dialect, cases):
    cases = cases()
    columns = [fn.lookup(name, dialect)(*args).cast("string").alias(f"c{i}") for i, (name, args, _) in enumerate(cases)]
    row = spark.range(1).select(*columns).first()
    wrong = []
    for i, (name, _, want) in enumerate(cases):
        got = row[i]
        if isinstance(want, bool):
            ok = got == str(want).lower()
        elif isinstance(want, (int, float)):
            ok = got is not None and abs(float(got) - want) <= 1e-6 * max(1, abs(want))
        else:
            ok = got == want
        if not ok:
            wrong.append((name, got, want))
    assert wrong == []


def test_json_merge_patch_recurses(spark):
    cases = [
        ('{"a":{"b":1,"c":2},"d":3}', '{"a":{"b":9,"c":null,"e":{"f":null,"g":1}}}', '{"a":{"b":9,"e":{"g":1}},"d":3}'),
        ('{"a":[1],"n":null}', '{"a":{"b":1}}', '{"a":{"b":1},"n":null}'), ('{"a":1}', "[2]", "[2]"), ("[1]", '{"a":null,"b":1}', '{"b":1}'), ('{"a":1}', None, None),
    ]
    rows = spark.createDataFrame(cases, "a string, b string, want string").coalesce(1)
    assert [r.got for r in rows.select(fn.lookup("JSON_MERGE_PATCH", "mysql")(F.col("a"), F.col("b")).alias("got")).collect()] == [c[2] for c in cases]


def test_lookup():
    with pytest.raises(NotImplementedError):
        fn.lookup("SLEEP")
    with pytest.raises(KeyError):
        fn.lookup("NO_SUCH")
    assert len(fn.MYSQL) > 140


def test_hstore(spark):
    a, b = (F.create_map(F.lit("x"), F.lit(p), F.lit(q), F.lit(p)) for p, q in (("1", "y"), ("2", "z")))
    row = spark.range(1).select(fn.hstore_concat(a, b), fn.hstore_delete(a, "x"), fn.hstore_slice(a, ["y"])).first()
    assert row[0] == {"x": "2", "y": "1", "z": "2"} and row[1] == {"y": "1"} and row[2] == {"y": "1"}


def test_formats_without_a_pattern():
    with pytest.raises(ValueError):
        fn.mysql_format("%U")


def test_json_changes(spark):
    doc = F.lit('{"a": 1, "b": [2, 3]}')
    call = lambda name, *a: fn.lookup(name)(doc, *a)
    row = list(
        spark.range(1).select(
            call("JSON_SET", "$.a", 10, "$.c", [1]), call("JSON_INSERT", "$.a", 10, "$.c", True), call("JSON_REPLACE", "$.a", 10, "$.c", 1), call("JSON_REMOVE", "$.b[0]"), call("JSON_ARRAY_APPEND", "$.b", 4, "$.a", 2),
            call("JSON_ARRAY_INSERT", "$.b[1]", 9), call("JSON_DEPTH"), call("JSON_TYPE"), call("JSON_MERGE_PRESERVE", F.lit('{"a": 5}')), call("JSON_CONTAINS", F.lit('{"b": [3]}')), call("JSON_OVERLAPS", F.lit('{"a": 1}')),
            fn.lookup("JSON_SEARCH")(F.lit('["abc", [{"k": "10"}, "def"], {"x": "abc"}]'), "abc", True), call("JSON_CONTAINS_PATH", False, "$.z", "$.b"), fn.lookup("JSON_SET")(F.lit("{"), "$.a", 1),
        ).first()
    )
    assert row == [
        '{"a": 10, "b": [2, 3], "c": [1]}', '{"a": 1, "b": [2, 3], "c": true}', '{"a": 10, "b": [2, 3]}', '{"a": 1, "b": [3]}', '{"a": [1, 2], "b": [2, 3, 4]}',
        '{"a": 1, "b": [2, 9, 3]}', 3, "OBJECT", '{"a": [1, 5], "b": [2, 3]}', True, True, '["$[0]", "$[2].x"]', True, None,
    ]


def test_jsonpath():
    from plumbline.functions.json_udf import JsonPath, PathError

    doc = {"xs": [{"v": 1, "t": "ab"}, {"v": 5, "t": "cd"}, {"t": None}], "n": {"m": [10, 20, 30]}}
    cases = {
        "$.xs[*].v": [1, 5], "$.xs ? (@.v > 1).t": ["cd"], '$.xs[*] ? (@.t like_regex "^a" || @.v == 5).v': [1, 5], "$.n.m[last]": [30], "$.n.m[0 to 1]": [10, 20], "$.n.m.size()": [3], "$.xs[*] ? (exists(@.v) && !(@.v < 5)).v": [5],
        "$.xs[*].t.type()": ["string", "string", "null"], '$.xs[*].t ? (@ starts with "c")': ["cd"], "$.missing": [], "$.xs[*] ? (@.t == null).t": [None], "$.**.m[1]": [20],
    }
    for path, want in cases.items():
        assert JsonPath(path).query(doc) == want, path
    for bad in ("$.", "$ ? (", "xs", "$.a ? (@.b ~ 1)"):
        with pytest.raises((PathError, ValueError)):
            JsonPath(bad)


def test_datetime_text(spark):
    texts = ["2024-02-29 13:05:07.5", "2024-02-29T13:05", "20240229", "Jan 8, 1999", "8 January 1999", "1/8/1999", "infinity", "epoch", "nonsense", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(fn.lookup("timestamp_in", "postgres")(F.col("t")).cast("string")).collect()
    assert [r[0] for r in rows] == ["2024-02-29 13:05:07.5", None, "2024-02-29 00:00:00", "1999-01-08 00:00:00", "1999-01-08 00:00:00", "1999-01-08 00:00:00", "9999-12-31 23:59:59.999999", "1970-01-01 00:00:00", None, None]
    spans = {"1 year 2 mons 3 days 04:05:06": (14, 3, 14706000000), "P1Y2M3DT4H5M6S": (14, 3, 14706000000), "2 weeks ago": (0, -14, 0), "-1:30": (0, 0, -5400000000), "1.5 hours": (0, 0, 5400000000), "@ 1 minute": (0, 0, 60000000), "one day": None}
    rows = spark.createDataFrame([(t,) for t in spans], "t string").select("t", fn.lookup("interval_in", "postgres")(F.col("t")).alias("i")).collect()
    assert {r.t: tuple(r.i) if r.i else None for r in rows} == spans


def test_mysql_times(spark):
    from plumbline.functions import registry as fn

    c = lambda *xs: [r for r in spark.range(1).select(*[x.alias(f"c{i}") for i, x in enumerate(xs)]).first()]
    lit = F.lit
    assert c(
        fn.addtime(lit("2007-12-31 23:59:59.999999"), lit("1 1:1:1.000002")), fn.addtime(lit("01:00:00.999999"), lit("02:00:00.999998")), fn.subtime(lit("2007-12-31 23:59:59.999999"), lit("1 1:1:1.000002")), fn.subtime(lit("01:00:00.999999"), lit("02:00:00.999998")),
        fn.timediff(lit("2000-01-01 00:00:00"), lit("2000-01-01 00:00:00.000001")), fn.timediff(lit("2008-12-31 23:59:59.000001"), lit("2008-12-30 01:01:01.000002")), fn.timediff(lit("2000-01-01 00:00:00"), lit("10:00:00")),
        fn.maketime(lit(12), lit(15), lit(30)), fn.maketime(lit(12), lit(60), lit(30)), fn.time_format(lit("100:00:00"), "%H %k %h %I %l"), fn.time_format(lit("13:05:09.5"), "%r|%T|%f%%"), fn.addtime(lit("x"), lit("01:00:00")),
    ) == ["2008-01-02 01:01:01.000001", "03:00:01.999997", "2007-12-30 22:58:58.999997", "-00:59:59.999999", "-00:00:00.000001", "46:58:57.999999", None, "12:15:30", None, "100 100 04 04 4", "01:05:09 PM|13:05:09|500000%", None]


def test_arrays_and_words(spark):
    from plumbline.functions import registry as fn

    a, none = F.array(F.lit(3), F.lit(4)), F.array().cast("array<int>")
    row = spark.range(1).select(fn.array_dims(a), fn.array_upper(none), fn.array_ndims(none), fn.trim_array(a, 1), fn.trim_array(a, 5), fn.levenshtein_less_equal(F.lit("kitten"), F.lit("sitting"), 2), fn.levenshtein_less_equal(F.lit("kitten"), F.lit("sitting"), 3),
                                fn.soundex_like(F.lit("Robert"), F.lit("Rupert")), F.round(fn.strict_word_similarity(F.lit("word"), F.lit("two words")), 6), fn.strict_word_similarity(F.lit("word"), F.lit("one word here"))).first()
    assert list(row) == ["[1:2]", None, None, [3], [], 3, 3, True, 0.571429, 1.0]
