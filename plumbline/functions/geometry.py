"""Planar geometry over arrays of points, and WKT: built-in functions only.

A point is a struct (x, y); a line an array of points; a polygon its outer ring, first point repeated at the end.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: MySQL's default radius for ST_Distance_Sphere in metres (fixed value).
SPHERE_RADIUS = 6_370_986.0


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def collect(p: Column, *order: Column) -> Column:
    """ST_Collect: a group's points as one array, nulls left out, in the order of `order` (x, then y, without it)."""
    keys = [o.alias(f"k{i}") for i, o in enumerate(order)] or [p["x"].alias("k0"), p["y"].alias("k1")]
    return F.transform(F.array_sort(F.collect_list(F.when(p.isNotNull(), F.struct(*keys, p.alias("p"))))), lambda s: s["p"])


def line(*points: Column) -> Column:
    return F.array(*points)


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, v: a + v)


def _segments(path: Column, f) -> Column:
    """f(p, q) for each pair of neighbours."""
    return F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda i: f(F.element_at(path, i), F.element_at(path, i + 1)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2))


def distance_sphere(a: Column, b: Column, radius: float = SPHERE_RADIUS) -> Column:
    """Great-circle metres between longitude/latitude points."""
    p, q = F.radians(a["y"]), F.radians(b["y"])
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(b["x"] - a["x"]) / 2), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def length(path: Column) -> Column:
    return F.when(F.size(path) < 2, 0.0).otherwise(_sum(_segments(path, distance)))


def num_points(path: Column) -> Column:
    return F.size(path)


def point_n(path: Column, n: int) -> Column:
    return F.try_element_at(path, F.lit(n))


def start_point(path: Column) -> Column:
    return F.try_element_at(path, F.lit(1))


def end_point(path: Column) -> Column:
    return F.try_element_at(path, F.lit(-1))


def is_closed(path: Column) -> Column:
    return start_point(path) == end_point(path)


def swap_xy(p: Column) -> Column:
    return point(p["y"], p["x"])


def _signed(ring: Column) -> Column:
    return _sum(_segments(ring, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])) / 2


def area(ring: Column) -> Column:
    return F.abs(_signed(ring))


def centroid(ring: Column) -> Column:
    cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]
    scale = 6 * _signed(ring)
    cx = _sum(_segments(ring, lambda p, q: (p["x"] + q["x"]) * cross(p, q))) / scale
    cy = _sum(_segments(ring, lambda p, q: (p["y"] + q["y"]) * cross(p, q))) / scale
    return point(cx, cy)


def contains(ring: Column, p: Column) -> Column:
    """Whether a point lies inside the ring: an odd number of edges cross the ray to its right."""
    crossed = _segments(ring, lambda a, b: ((a["y"] > p["y"]) != (b["y"] > p["y"])) & (p["x"] < (b["x"] - a["x"]) * (p["y"] - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]))
    return F.size(F.filter(crossed, lambda c: F.coalesce(c, F.lit(False)))) % 2 == 1


def envelope(path: Column) -> Column:
    """The bounding box as struct (x0, y0, x1, y1)."""
    xs, ys = F.transform(path, lambda p: p["x"]), F.transform(path, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def mbr_intersects(a: Column, b: Column) -> Column:
    return (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])


def mbr_disjoint(a: Column, b: Column) -> Column:
    return ~mbr_intersects(a, b)


def mbr_covers(a: Column, b: Column) -> Column:
    return (a["x0"] <= b["x0"]) & (a["y0"] <= b["y0"]) & (a["x1"] >= b["x1"]) & (a["y1"] >= b["y1"])


def mbr_equals(a: Column, b: Column) -> Column:
    return mbr_covers(a, b) & mbr_covers(b, a)


def mbr_touches(a: Column, b: Column) -> Column:
    inner = (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])
    return mbr_intersects(a, b) & ~inner


def _number(v: Column) -> Column:
    text = v.cast("string")
    return F.regexp_replace(text, r"\.0$", "")


def as_text(path: Column, kind: str) -> Column:
    """WKT of a POINT, LINESTRING, MULTIPOINT or POLYGON."""
    pair = lambda p: F.concat_ws(" ", _number(p["x"]), _number(p["y"]))
    if kind == "POINT":
        return F.concat(F.lit("POINT("), pair(path), F.lit(")"))
    inner = F.array_join(F.transform(path, pair), ",")
    return F.concat(F.lit(f"{kind}("), inner, F.lit(")")) if kind in ("LINESTRING", "MULTIPOINT") else F.concat(F.lit("POLYGON(("), inner, F.lit("))"))


def from_text(wkt: Column) -> Column:
    """The points of a WKT POINT, LINESTRING or one-ring POLYGON, as an array; null for other text."""
    body = F.regexp_extract(wkt, r"(?i)^\s*(?:POINT|LINESTRING|POLYGON)\s*\(+([^()]*)\)+\s*$", 1)
    points = F.transform(F.split(body, r"\s*,\s*"), lambda t: F.split(F.trim(t), r"\s+"))
    return F.when(body != "", F.transform(points, lambda c: point(c[0].try_cast("double"), c[1].try_cast("double"))))


_BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash(p: Column, n: int) -> Column:
    """The geohash of n letters: the bits of longitude and latitude in turn."""
    bits = 5 * n
    x = F.floor((p["x"] + 180) / 360 * 2 ** math.ceil(bits / 2)).cast("long")
    y = F.floor((p["y"] + 90) / 180 * 2 ** (bits // 2)).cast("long")
    nx, ny = math.ceil(bits / 2), bits // 2
    letters = []
    for letter in range(n):
        value = F.lit(0)
        for b in range(5 * letter, 5 * letter + 5):
            bit = F.shiftright(x, nx - 1 - b // 2) if b % 2 == 0 else F.shiftright(y, ny - 1 - b // 2)
            value = value * 2 + bit % 2
        letters.append(F.substring(F.lit(_BASE32), 1, 32).substr((value + 1).cast("int"), F.lit(1)))
    return F.concat(*letters)


def geometry_type(wkt: Column) -> Column:
    """POINT, LINESTRING ... of a WKT text."""
    return F.upper(F.regexp_extract(wkt, r"(?i)^\s*(GEOMETRYCOLLECTION|MULTIPOINT|MULTILINESTRING|MULTIPOLYGON|POINT|LINESTRING|POLYGON)\b", 1))


def dimension(wkt: Column) -> Column:
    kind = geometry_type(wkt)
    return F.when(kind.endswith("POINT"), 0).when(kind.endswith("LINESTRING"), 1).when(kind.endswith("POLYGON"), 2)


def is_empty(path: Column) -> Column:
    return F.size(path) == 0


def _turn(a: Column, b: Column, c: Column) -> Column:
    """The sign of the turn from a over b to c: 1 to the left, -1 to the right, 0 straight on."""
    return F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))


def _between(a: Column, b: Column, p: Column) -> Column:
    """Whether p, in line with a and b, lies between them."""
    return p["x"].between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & p["y"].between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))


def segments_meet(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether the segments ab and cd have a point in common."""
    abc, abd, cda, cdb = _turn(a, b, c), _turn(a, b, d), _turn(c, d, a), _turn(c, d, b)
    apart = (abc * abd < 0) & (cda * cdb < 0)
    touch = ((abc == 0) & _between(a, b, c)) | ((abd == 0) & _between(a, b, d)) | ((cda == 0) & _between(c, d, a)) | ((cdb == 0) & _between(c, d, b))
    return apart | touch


def _edges(path: Column) -> Column:
    return _segments(path, lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def lines_meet(one: Column, other: Column) -> Column:
    """ST_Intersects of two lines (or rings' boundaries): edge against edge within the two geometries."""
    return F.exists(_edges(one), lambda e: F.exists(_edges(other), lambda f: segments_meet(e["p"], e["q"], f["p"], f["q"])))


def polygons_meet(one: Column, other: Column) -> Column:
    """ST_Intersects of two polygons: boundaries meet, or one holds the other."""
    return lines_meet(one, other) | contains(one, start_point(other)) | contains(other, start_point(one))


def polygons_disjoint(one: Column, other: Column) -> Column:
    return ~polygons_meet(one, other)


def polygon_within(one: Column, other: Column) -> Column:
    """Whether one lies inside other, boundaries apart."""
    return ~lines_meet(one, other) & contains(other, start_point(one))


def same_points(one: Column, other: Column) -> Column:
    """ST_Equals of point sets."""
    return (F.size(F.array_except(one, other)) == 0) & (F.size(F.array_except(other, one)) == 0)


def is_simple(path: Column) -> Column:
    """Whether no two edges of a line meet but neighbours at their common point (and the ends of a closed line)."""
    n = F.size(path) - 1
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.filter(F.sequence(F.lit(1), n), lambda j: (j > i + 1) & ~(is_closed(path) & (i == 1) & (j == n))), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    at = lambda k: F.element_at(path, k.cast("int"))
    return ~F.exists(pairs, lambda e: segments_meet(at(e["i"]), at(e["i"] + 1), at(e["j"]), at(e["j"] + 1)))


def is_valid(ring: Column) -> Column:
    """Whether a ring is closed, has an area and doesn't cross itself."""
    return (F.size(ring) >= 4) & is_closed(ring) & (area(ring) > 0) & is_simple(ring)


def make_envelope(a: Column, b: Column) -> Column:
    """ST_MakeEnvelope: the rectangle between two corners, as a ring."""
    return F.array(point(a["x"], a["y"]), point(b["x"], a["y"]), point(b["x"], b["y"]), point(a["x"], b["y"]), point(a["x"], a["y"]))


def envelope_ring(path: Column) -> Column:
    """ST_Envelope as a ring."""
    box = envelope(path)
    return make_envelope(point(box["x0"], box["y0"]), point(box["x1"], box["y1"]))


def point_at_distance(path: Column, d: Column) -> Column:
    """The point so far along a line; its end beyond that."""
    steps = F.aggregate(
        _edges(path),
        F.struct(d.cast("double").alias("left"), F.lit(None).cast("struct<x:double,y:double>").alias("at")),
        lambda s, e: F.struct(
            (s["left"] - distance(e["p"], e["q"])).alias("left"),
            F.when(s["at"].isNotNull(), s["at"]).when((s["left"] <= distance(e["p"], e["q"])) & (distance(e["p"], e["q"]) > 0), point(e["p"]["x"] + (e["q"]["x"] - e["p"]["x"]) * s["left"] / distance(e["p"], e["q"]), e["p"]["y"] + (e["q"]["y"] - e["p"]["y"]) * s["left"] / distance(e["p"], e["q"]))).alias("at"),
        ),
    )
    return F.coalesce(steps["at"], end_point(path))


def interpolate(path: Column, fraction: Column) -> Column:
    """ST_LineInterpolatePoint."""
    return point_at_distance(path, length(path) * fraction)


def point_line_distance(p: Column, path: Column) -> Column:
    """The least distance of a point from a line."""

    def from_edge(a: Column, b: Column) -> Column:
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        square = dx * dx + dy * dy
        t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / square))).otherwise(0.0)
        return distance(p, point(a["x"] + t * dx, a["y"] + t * dy))

    return F.array_min(_segments(path, from_edge))


def hausdorff_distance(one: Column, other: Column) -> Column:
    """The greatest of the least distances from the points of each to those of the other."""
    far = lambda a, b: F.array_max(F.transform(a, lambda p: F.array_min(F.transform(b, lambda q: distance(p, q)))))
    return F.greatest(far(one, other), far(other, one))


def buffer_point(p: Column, radius: Column, corners: int = 32) -> Column:
    """ST_Buffer of a point: a regular polygon on the circle."""
    angles = [2 * math.pi * i / corners for i in range(corners)] + [0.0]
    return F.array(*[point(p["x"] + radius * math.cos(a), p["y"] + radius * math.sin(a)) for a in angles])


def as_geojson(path: Column, kind: str) -> Column:
    """GeoJSON of a POINT, LINESTRING, MULTIPOINT or POLYGON."""
    pair = lambda p: F.concat(F.lit("["), p["x"].cast("string"), F.lit(", "), p["y"].cast("string"), F.lit("]"))
    names = {"POINT": "Point", "LINESTRING": "LineString", "MULTIPOINT": "MultiPoint", "POLYGON": "Polygon"}
    inner = pair(path) if kind == "POINT" else F.concat(F.lit("["), F.array_join(F.transform(path, pair), ", "), F.lit("]"))
    inner = F.concat(F.lit("["), inner, F.lit("]")) if kind == "POLYGON" else inner
    return F.concat(F.lit(f'{{"type": "{names[kind]}", "coordinates": '), inner, F.lit("}"))


def from_geojson(text: Column) -> Column:
    """The points of a GeoJSON Point, LineString, MultiPoint or one-ring Polygon as an array; null for others."""
    v = F.try_parse_json(text)
    kind = F.try_variant_get(v, "$.type", "string")
    pairs = F.when(kind == "Point", F.array(F.try_variant_get(v, "$.coordinates", "array<double>"))).when(kind.isin("LineString", "MultiPoint"), F.try_variant_get(v, "$.coordinates", "array<array<double>>")).when(kind == "Polygon", F.try_variant_get(v, "$.coordinates[0]", "array<array<double>>"))
    return F.transform(pairs, lambda c: point(F.get(c, F.lit(0)), F.get(c, F.lit(1))))


def point_from_geohash(text: Column) -> Column:
    """The middle of a geohash's cell."""
    digits = F.transform(F.split(F.lower(text), ""), lambda c: F.instr(F.lit(_BASE32), c) - 1)
    bits = F.flatten(F.transform(digits, lambda v: F.transform(F.array(*map(F.lit, (16, 8, 4, 2, 1))), lambda b: F.when(v.bitwiseAND(b) != 0, 1).otherwise(0))))

    def middle(first: int, span: float) -> Column:
        own = F.filter(bits, lambda _, i: i % 2 == first)
        whole = F.aggregate(own, F.lit(0.0), lambda s, b: s * 2 + b)
        return (whole + 0.5) / F.pow(F.lit(2.0), F.size(own)) * span - span / 2

    return point(middle(0, 360.0), middle(1, 180.0))


def lat_from_geohash(text: Column) -> Column:
    return point_from_geohash(text)["y"]


def long_from_geohash(text: Column) -> Column:
    return point_from_geohash(text)["x"]


def geometry_n(points: Column, n: int) -> Column:
    """The n-th of a collection's points, from 1."""
    return F.try_element_at(points, F.lit(n))


def num_geometries(points: Column) -> Column:
    return F.size(points)
