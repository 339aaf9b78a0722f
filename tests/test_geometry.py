"""Geospatial functions by known values."""

import pytest
from test_engine import TABLES, TYPES

from orrery.functions import postgis
from orrery.functions.geometry import from_binary, from_text, to_binary, to_text
from orrery.schema import Schema
from orrery.session import Engine

RING = "POLYGON((0 0,4 0,4 4,0 4,0 0),(1 1,2 1,2 2,1 2,1 1))"
UNIT = "POLYGON((0 0,1 0,1 1,0 1,0 0))"
NEXT = "POLYGON((1 0,2 0,2 1,1 1,1 0))"
OVER = "POLYGON((0.5 0.5,3 0.5,3 3,0.5 3,0.5 0.5))"
GOLDEN = [
    ("area", (RING,), 15.0), ("perimeter", (RING,), 20.0), ("length", ("LINESTRING(0 0,3 4,3 10)",), 11.0), ("astext", ("POINT Z (1 2 3)",), "POINT Z (1 2 3)"), ("asewkt", ("SRID=4326;POINT(1 2)",), "SRID=4326;POINT(1 2)"),
    ("distance", ("POINT(0 0)", "LINESTRING(3 -1,3 5)"), 3.0), ("distance", ("POINT(3 3)", RING), 0.0), ("contains", (RING, "POINT(3 3)"), True), ("contains", (RING, "POINT(1.5 1.5)"), False), ("contains", (RING, "POINT(0 0)"), False), ("covers", (RING, "POINT(0 0)"), True),
    ("within", ("POINT(3 3)", RING), True), ("touches", (UNIT, NEXT), True), ("overlaps", (UNIT, OVER), True), ("overlaps", (UNIT, NEXT), False), ("intersects", (UNIT, NEXT), True), ("disjoint", (UNIT, "POINT(5 5)"), True), ("equals", ("LINESTRING(0 0,1 1)", "LINESTRING(1 1,0 0)"), True),
    ("crosses", ("LINESTRING(0 0,2 2)", "LINESTRING(0 2,2 0)"), True), ("convexhull", ("MULTIPOINT(0 0,1 1,2 0,2 2,0 2)",), "POLYGON((0 0,0 2,2 2,2 0,0 0))"), ("centroid", ("LINESTRING(0 0,4 0)",), "POINT(2 0)"), ("centroid", (UNIT,), "POINT(0.5 0.5)"),
    ("lineinterpolatepoint", ("LINESTRING(0 0,10 0)", 0.25), "POINT(2.5 0)"), ("linesubstring", ("LINESTRING(0 0,10 0,10 10)", 0.25, 0.75), "LINESTRING(5 0,10 0,10 5)"), ("linelocatepoint", ("LINESTRING(0 0,10 0)", "POINT(3 7)"), 0.3), ("simplify", ("LINESTRING(0 0,1 0.1,2 0,3 5)", 0.5), "LINESTRING(0 0,2 0,3 5)"),
    ("geohash", ("POINT(-126 48)",), "c0w3hf1s70w3hf1s70w3"), ("asencodedpolyline", ("LINESTRING(-120.2 38.5,-120.95 40.7,-126.453 43.252)",), "_p~iF~ps|U_ulLnnqC_mqNvxq`@"), ("linefromencodedpolyline", ("_p~iF~ps|U_ulLnnqC_mqNvxq`@",), "SRID=4326;LINESTRING(-120.2 38.5,-120.95 40.7,-126.453 43.252)"),
    ("asgeojson", ("LINESTRING(1 2,3 4.5)",), '{"type":"LineString","coordinates":[[1,2],[3,4.5]]}'), ("geomfromgeojson", ('{"type":"Point","coordinates":[1,2]}',), "SRID=4326;POINT(1 2)"), ("segmentize", ("LINESTRING(0 0,4 0)", 2.0), "LINESTRING(0 0,2 0,4 0)"), ("reverse", ("LINESTRING(0 0,1 1)",), "LINESTRING(1 1,0 0)"),
    ("snaptogrid", ("LINESTRING(0.1 0.2,3.9 4.2)", 1.0), "LINESTRING(0 0,4 4)"), ("isvalidreason", ("POLYGON((0 0,2 2,2 0,0 2,0 0))",), "Self-intersection"), ("isvalid", (RING,), True), ("issimple", ("LINESTRING(0 0,2 2,2 0,0 2)",), False), ("boundary", (UNIT,), "LINESTRING(0 0,1 0,1 1,0 1,0 0)"),
    ("frechetdistance", ("LINESTRING(0 0,100 0)", "LINESTRING(0 0,50 50,100 0)"), 70.7106781186548), ("hausdorffdistance", ("LINESTRING(0 0,2 0)", "MULTIPOINT(0 1,1 0,2 1)"), 1.0), ("azimuth", ("POINT(0 0)", "POINT(1 1)"), 0.785398163397448), ("linecrossingdirection", ("LINESTRING(25 169,89 114,40 70,86 43)", "LINESTRING(20 140,71 74,161 53)"), -1),
    ("locatebetween", ("LINESTRING M (0 0 0,10 0 10)", 2.0, 4.0), "LINESTRINGM(2 0 2,4 0 4)"), ("interpolatepoint", ("LINESTRING M (0 0 0,10 0 20)", "POINT(5 5)"), 10.0), ("addpoint", ("LINESTRING(0 0,1 1)", "POINT(2 2)", 0), "LINESTRING(2 2,0 0,1 1)"), ("removepoint", ("LINESTRING(0 0,1 1,2 2)", 1), "LINESTRING(0 0,2 2)"),
    ("translate", ("POINT(1 1)", 2.0, 3.0), "POINT(3 4)"), ("scale", ("POINT(1 2)", 2.0, 3.0), "POINT(2 6)"), ("flipcoordinates", ("POINT(1 2)",), "POINT(2 1)"), ("force3d", ("POINT(1 2)",), "POINT(1 2 0)"), ("shiftlongitude", ("POINT(-10 5)",), "POINT(350 5)"), ("numinteriorrings", (RING,), 1), ("geometryn", ("MULTIPOINT(1 1,2 2)", 2), "POINT(2 2)"),
    ("makeline", ("POINT(0 0)", "POINT(1 1)"), "LINESTRING(0 0,1 1)"), ("collect", ("POINT(0 0)", "POINT(1 1)"), "MULTIPOINT((0 0),(1 1))"), ("relatematch", ("101202FFF", "TTTTTTFFF"), True), ("relatematch", ("FF1202FFF", "TTTTTTFFF"), False), ("assvg", ("LINESTRING(0 0,1 2)",), "M 0 0 L 1 -2"), ("closestpoint", ("LINESTRING(0 0,10 0)", "POINT(4 4)"), "POINT(4 0)"),
]


@pytest.mark.parametrize(("name", "args", "value"), GOLDEN)
def test_golden(name, args, value):
    kinds = postgis._kinds(postgis.FUNCTIONS[name][0], len(args))
    got = postgis._shown(postgis.FUNCTIONS[name][2](*[postgis._argument(a, k) for a, k in zip(args, kinds, strict=True)]))
    assert got == (pytest.approx(value) if isinstance(value, float) else value)


def test_round_trips():
    for text in ("SRID=3;MULTIPOLYGON(((0 0,1 0,1 1,0 0)),((5 5,6 5,6 6,5 5)))", "GEOMETRYCOLLECTION(POINT(1 2),LINESTRING(0 0,1 1))", "LINESTRING(0 0 1,1 1 2)", "POINT EMPTY", "MULTILINESTRING((0 0,1 1),(2 2,3 3))"):
        a = from_text(text)
        assert from_text(to_text(a, extended=True)) == a
        for order in ("NDR", "XDR"):
            assert from_binary(to_binary(a, order, extended=True)) == a


def test_in_queries(spark):
    e = Engine(spark, Schema(TYPES), {n: spark.createDataFrame(*t) for n, t in TABLES.items()})
    got = e.query("select Ship { d := postgis::distance(postgis::makepoint(<float64>.tons, 0.0), 'POINT(40 3)'), t := postgis::astext(postgis::point(<float64>.id, 2.0)) } order by .name").collect()
    assert [tuple(r) for r in got] == [(3.0, "POINT(2 2)"), (pytest.approx(50.0899), "POINT(1 2)")]
    box = e.query("select postgis::extent_agg(postgis::point(<float64>Ship.tons, 1.0))").first()[0]
    assert (box["xmin"], box["xmax"], box["ymin"]) == (40.0, 90.0, 1.0)
    assert e.query("select { o := postgis::op_left('POINT(0 0)', 'POINT(1 1)'), x := postgis::xmax(postgis::expand(postgis::to_box2d('LINESTRING(0 0,5 5)'), 1.0)), n := postgis::op_distance_box('POINT(0 0)', 'POINT(3 4)') }").first() == (True, 6.0, 5.0)
