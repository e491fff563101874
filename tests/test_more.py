"""Geometry, XML, views and user-defined functions on known values."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import geometry as geo
from plumbline.functions import udf
from plumbline.operators import views, xml


def one(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_geometry(spark):
    p = lambda x, y: geo.point(F.lit(x), F.lit(y))
    ring = geo.line(p(0, 0), p(4, 0), p(4, 3), p(0, 3), p(0, 0))
    path = geo.line(p(0, 0), p(3, 4), p(3, 6))
    got = one(
        spark, geo.area(ring), geo.length(path), geo.centroid(ring), geo.contains(ring, p(1, 1)), geo.contains(ring, p(5, 1)), geo.is_closed(ring), geo.is_closed(path), geo.as_text(path, "LINESTRING"),
        geo.geohash(p(-5.6, 42.6), 5), geo.mbr_touches(geo.envelope(ring), geo.envelope(geo.line(p(4, 0), p(6, 2)))), geo.mbr_covers(geo.envelope(ring), geo.envelope(path)), F.round(geo.distance_sphere(p(0, 0), p(180, 0)), 3),
    )
    assert got[0] == 12 and got[1] == 7 and tuple(got[2]) == (2, 1.5) and got[3:7] == [True, False, True, False]
    assert got[7] == "LINESTRING(0 0,3 4,3 6)" and got[8] == "ezs42" and got[9:11] == [True, False] and abs(got[11] - 20015042.813723423) < 0.01
    back = one(spark, geo.from_text(F.lit("POLYGON((0 0, 1.5 0, 0 1, 0 0))")), geo.from_text(F.lit("POINT(1 2)")), geo.from_text(F.lit("CIRCLE(1)")))
    assert [tuple(x) for x in back[0]] == [(0, 0), (1.5, 0), (0, 1), (0, 0)] and tuple(back[1][0]) == (1, 2) and back[2] is None


def test_xml(spark):
    got = one(spark, xml.element("a", xml.escape(F.lit("<&>")), attributes={"k": F.lit('"q"'), "n": F.lit(None)}), xml.element("e"), xml.forest({"x": F.lit(1), "y": F.lit(None)}), xml.comment(F.lit("c")), xml.processing("p", F.lit("v")))
    assert got == ['<a k="&quot;q&quot;">&lt;&amp;&gt;</a>', "<e/>", "<x>1</x>", "<!--c-->", "<?p v?>"]


def test_views(spark):
    base = spark.createDataFrame([(1, "a", True), (2, "b", False)], "id int, s string, live boolean")
    view = views.View({"key": "id", "label": "s", "on": "live"}, "live", check=True)
    assert [r.key for r in view.read(base).collect()] == [1]
    assert sorted(r.s for r in view.update(base, {"label": F.lit("z")}).table.collect()) == ["b", "z"]
    assert view.delete(base).table.count() == 1
    new = spark.createDataFrame([(3, "c", True)], "key int, label string, on boolean")
    assert view.insert(base, new).table.count() == 3
    with pytest.raises(views.CheckOption):
        view.insert(base, new.withColumn("on", F.lit(False)))
    with pytest.raises(views.CheckOption):
        view.update(base, {"on": F.lit(False)})


def test_strict_and_fold(spark):
    add = udf.strict(lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    assert one(spark, add(F.lit(1), F.lit(None).cast("int")), add(F.lit(1), F.lit(2)), udf.fold(F.array(F.lit(2), F.lit(5)), F.lit(0), lambda s, x: s + x * x, lambda s: s + 1)) == [None, 3, 30]
