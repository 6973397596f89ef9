"""Map extracts: every kind of element there and back, and the layers made of them."""

import pytest
from pyspark.sql import functions as F

from kerbside.operators.geometry import polygon_area
from kerbside.sources import osm


def node(i, x, y, **tags):
    return ("node", i, x, y, tags, None, None, None)


def way(i, refs, **tags):
    return ("way", i, None, None, tags, refs, None, None)


ROWS = [
    *[node(i, float(i % 10), float(i // 10)) for i in range(100)],
    node(1000, 2.5, 3.5, amenity="clinic", name="é"), node(-4, -27.1234567, -38.7654321, amenity="bank"),
    way(1, [0, 1, 12], highway="primary"), way(2, [55, 56], highway="footway"), way(3, [99, 12345], highway="primary"),
    way(4, [0, 4, 44, 40, 0], landuse="forest"), way(5, [60, 63, 93]), way(6, [93, 90, 60]), way(7, [71, 72, 82, 81, 71]),
    ("relation", 8, None, None, {"type": "multipolygon", "leisure": "park"}, [5, 6, 7, 1000], ["outer", "outer", "inner", ""], ["way", "way", "way", "node"]),
    ("relation", 9, None, None, {"type": "route"}, [1], [""], ["way"]),
]


@pytest.fixture(scope="module")
def extract(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("osm") / "a.osm.pbf"
    path.write_bytes(osm.encode(ROWS))
    return osm.elements(spark, f"file://{path}")


def test_elements(extract):
    got = {(r["kind"], r["id"]): r for r in extract.collect()}
    assert len(got) == len(ROWS)
    for kind, i, x, y, tags, refs, roles, members in ROWS:
        r = got[kind, i]
        assert (dict(r["tags"]), r["refs"], r["roles"], r["members"]) == (tags, refs, roles, members)
        assert (r["lon"], r["lat"]) == ((None, None) if x is None else pytest.approx((x, y), abs=1e-7))


def test_points_and_lines(extract):
    assert {(r["id"], r["amenity"]) for r in osm.points(extract, ["amenity", "healthcare"]).collect()} == {(1000, "clinic"), (-4, "bank")}
    assert [r["id"] for r in osm.points(extract, ["amenity"], (0, 0, 9, 9)).collect()] == [1000]
    roads = {r["id"]: [(p["x"], p["y"]) for p in r["rings"][0]] for r in osm.lines(extract, ["highway"]).collect()}
    assert roads == {1: [(0.0, 0.0), (1.0, 0.0), (2.0, 1.0)], 2: [(5.0, 5.0), (6.0, 5.0)]}  # way 3 has one node here
    assert [r["id"] for r in osm.lines(extract, ["highway"], (4, 4, 5.5, 9)).collect()] == [2]
    assert [r["id"] for r in osm.lines(extract, ["highway"], where=F.col("tags")["highway"] == "primary").collect()] == [1]


def test_polygons(extract):
    got = {r["id"]: r for r in osm.polygons(extract, ["landuse", "leisure"]).withColumn("a", polygon_area(F.col("rings"))).collect()}
    assert {i: (r["a"], r["landuse"], r["leisure"]) for i, r in got.items()} == {4: (16.0, "forest", None), -8: (9.0 - 1.0, None, "park")}
    assert [r["id"] for r in osm.polygons(extract, ["landuse", "leisure"], (0, 5, 9, 9)).collect()] == [-8]


def test_extracts_written_by_tasks(spark, tmp_path):
    schema = "kind string, id long, lon double, lat double, tags map<string,string>, refs array<long>, roles array<string>, members array<string>"
    rows = spark.createDataFrame([(*r[:4], {k: str(v) for k, v in r[4].items()}, *r[5:]) for r in ROWS], schema).repartition(5)
    out = osm.write_extracts(rows, f"file://{tmp_path}/all")
    assert sum(r["elements"] for r in out.collect()) == len(ROWS)
    got = {(r["kind"], r["id"]): (dict(r["tags"]), r["refs"]) for r in osm.elements(spark, f"file://{tmp_path}/all").collect()}
    assert got == {(r[0], r[1]): (r[4], r[5]) for r in ROWS}
    assert osm.write_extracts(rows.limit(0), f"file://{tmp_path}/none").count() == 0
