"""Shapes that are no rectangles: distances, buffers, zones, outlines, projections, and files of shapes and bands."""

import io
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside import config
from kerbside.operators import geometry, raster, spatial
from kerbside.sources import geotiff, readers, sinks

SHAPE = "rings array<array<struct<x: double, y: double>>>"


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def segment(p, a, b):
    a, b, p = map(np.array, (a, b, p))
    t = np.clip(((p - a) @ (b - a)) / max((b - a) @ (b - a), 1e-300), 0, 1)
    return float(np.hypot(*(p - a - t * (b - a))))


def test_distance_to_triangles_and_lines(spark):
    rng = np.random.default_rng(1)
    tri = {i: rng.uniform(0, 1000, 2) + rng.uniform(-60, 60, (3, 2)) for i in range(12)}
    points = {i: rng.uniform(-200, 1200, 2) for i in range(80)}
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in points.items()], "k int, x double, y double")
    shapes = spark.createDataFrame([(i, [ring(*t)]) for i, t in tri.items()], f"t int, {SHAPE}")

    def inside(p, t):
        s = [np.cross(np.append(t[(i + 1) % 3] - t[i], 0), np.append(p - t[i], 0))[2] for i in range(3)]
        return all(x > 0 for x in s) or all(x < 0 for x in s)

    for closed in (True, False):
        got = {r["k"]: r["d"] for r in spatial.nearest_shape(df, shapes, "k", "t", closed, 30.0).collect()}
        for k, p in points.items():
            sides = lambda t: [segment(p, t[i], t[(i + 1) % 3]) for i in range(3 if closed else 2)]  # noqa: B023, E731
            want = min(0.0 if closed and inside(p, t) else min(sides(t)) for t in tri.values())
            assert got[k] == pytest.approx(want, abs=1e-9)
    one = df.crossJoin(shapes.filter("t = 0")).select("k", geometry.shape_distance(F.col("x"), F.col("y"), F.col("rings"), True).alias("d"))
    assert all(r["d"] == pytest.approx(0.0 if inside(points[r["k"]], tri[0]) else min(segment(points[r["k"]], tri[0][i], tri[0][(i + 1) % 3]) for i in range(3))) for r in one.collect())


def test_buffers(spark):
    r = 10.0
    lines = [(1, ring((0, 0), (100, 0))), (2, ring((0, 0), (100, 0), (100, 100))), (3, ring((5, 5))), (4, ring((0, 0), (50, 0), (0, 1)))]
    df = spark.createDataFrame(lines, "k int, path array<struct<x: double, y: double>>")
    got = {x["k"]: x["a"] for x in geometry.with_buffer_area(df, "path", r, "a").collect()}
    assert got[1] == pytest.approx(2000 + math.pi * 100) and got[3] == pytest.approx(math.pi * 100)
    assert got[2] == pytest.approx(4000 + math.pi * 100 + (math.pi / 4 - 1) * 100)  # a bend: less what overlaps inside it
    assert 1000 + math.pi * 100 < got[4] < 1150 + math.pi * 100  # there and back again: counted once
    points = [(50.0, 9.0), (50.0, 11.0), (110.0, 0.0), (100.0, 50.0), (100.0, 50.0), (None, 1.0)]
    near = spatial.buffer_count(df, spark.createDataFrame(points, "x double, y double"), "k", r, "n")
    assert {x["k"]: x["n"] for x in near.collect()} == {1: 2, 2: 4, 3: 0, 4: 1}


def test_buffers_of_any_path():
    """Exact areas in closed form; random tangles against a count of small cells, closed outlines with the same area."""
    exact = lambda path, r: geometry._boundary(np.array(path, float), r).area()
    assert exact([(0, 0), (100, 0), (0, 0)], 35.5) == pytest.approx(7100 + math.pi * 35.5**2)
    assert exact([(0, 0), (100, 0), (50, 0), (50, 50), (50, -50)], 10) == pytest.approx(2 * (2000 + math.pi * 100) - 400)
    assert exact([(0, 0), (100, 0), (100, 100), (0, 100), (0, 0)], 10) == pytest.approx(8000 + math.pi * 100 - 400)
    assert exact([(0, 0), (10, 0), (20, 0), (20, 0), (5, 0), (40, 0)], 3) == pytest.approx(240 + math.pi * 9)
    assert exact([(1, 1), (1, 1)], 2) == pytest.approx(4 * math.pi)
    rng = np.random.default_rng(3)
    for n in (2, 4, 7, 12) * 5:
        path, r = rng.normal(0, 30, (n, 2)), rng.uniform(3, 20)
        edge = geometry._boundary(path, r)
        lo, hi, h = path.min(axis=0) - r, path.max(axis=0) + r, 0.5
        x, y = np.meshgrid(np.arange(lo[0], hi[0], h) + h / 2, np.arange(lo[1], hi[1], h) + h / 2)
        near = np.zeros(x.shape, bool)
        for p, q in zip(path[:-1], path[1:]):
            d = q - p
            t = np.clip(((x - p[0]) * d[0] + (y - p[1]) * d[1]) / (d @ d), 0, 1)
            near |= np.hypot(x - p[0] - t * d[0], y - p[1] - t * d[1]) <= r
        assert edge.area() == pytest.approx(near.sum() * h * h, rel=0.01)
        rings = geometry._outline(edge, 64)
        signed = sum(a["x"] * b["y"] - b["x"] * a["y"] for k in rings for a, b in zip(k, [*k[1:], k[0]])) / 2
        assert signed == pytest.approx(edge.area(), rel=1e-3)
        # the same path backwards, and with points put in, has the same buffer
        again = np.insert(path[::-1], 1, (path[-1] + path[-2]) / 2, axis=0)
        assert geometry._boundary(again, r).area() == pytest.approx(edge.area())


def test_measures_of_odd_shapes(spark):
    star = ring((0, 0), (4, 0), (4, 4), (2, 1))
    hole, island = ring((10, 10), (20, 10), (20, 20), (10, 20)), ring((14, 14), (14, 16), (16, 16), (16, 14))
    outer = ring((5, 5), (25, 5), (25, 25), (5, 25), (5, 5))
    df = spark.createDataFrame([(1, [star]), (2, [hole, outer, island])], f"k int, {SHAPE}")
    c = geometry.polygon_centroid(F.col("rings"))
    got = {r["k"]: r for r in df.select("k", geometry.polygon_area(F.col("rings")).alias("a"), c.alias("c")).collect()}
    assert got[1]["a"] == pytest.approx(6.0) and got[2]["a"] == pytest.approx(400 - 100 + 4)
    assert (got[2]["c"]["x"], got[2]["c"]["y"]) == pytest.approx((15.0, 15.0))
    bent = spark.createDataFrame([(ring((0, 0), (2, 0), (2, 2)),)], "path array<struct<x: double, y: double>>")
    row = bent.select(geometry.line_centroid(F.col("path")).alias("c"), geometry.line_length(F.col("path")).alias("l")).first()
    assert (row["c"]["x"], row["c"]["y"], row["l"]) == (1.5, 0.5, 4.0)


def test_zones_of_a_triangle(spark):
    pixels = [(r, c, c + 0.5, r + 0.5, float(r * 10 + c) if (r + c) % 3 else None) for r in range(10) for c in range(10)]
    px = spark.createDataFrame(pixels, "row int, col int, x double, y double, value double")
    shapes = spark.createDataFrame([(1, [ring((0, 0), (7.3, 0), (0, 7.3))], 1), (2, [ring((3, 3), (3.1, 3), (3, 3.1))], 3), (3, [ring((0, 0), (4, 0), (4, 4), (0, 4))], 2)], f"k int, {SHAPE}, place int")
    got = {r["k"]: r for r in raster.zonal_shapes(shapes, px, "k", "value", 2.0).collect()}
    own = [v for _, _, x, y, v in pixels if x + y < 7.3 and v is not None]
    assert (got[1]["cells"], got[1]["total"]) == (len(own), sum(own)) and got[1]["mean"] == pytest.approx(np.mean(own))
    assert got[2]["cells"] == 0 and got[2]["mean"] is None
    marks = {(r["row"], r["col"]): r["k"] for r in raster.rasterized(shapes, px, "k", "place", 2.0).collect()}
    assert marks[0, 0] == 3 and marks[0, 5] == 1 and marks[9, 9] is None
    lines = spark.createDataFrame([(1, ring((0, 0), (5, 5)))], "k int, path array<struct<x: double, y: double>>")
    near = [v for _, _, x, y, v in pixels if v is not None and segment((x, y), (0, 0), (5, 5)) <= 1.1]
    one = raster.zonal_buffers(lines, px, "k", "value", 1.1).first()
    assert (one["cells"], one["total"]) == (len(near), sum(near))


def test_dissolve_leaves_outlines(spark):
    square = lambda x, y: [ring((x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1))]
    frame = [(x, y) for x in range(4) for y in range(4) if not (x in (1, 2) and y in (1, 2))]
    rows = [("frame", square(*p), 1, "a") for p in frame] + [("corner", square(10, 10), 2, "b"), ("corner", square(11, 11), 3, "c"), ("one", square(20, 0), 4, "d")]
    df = spark.createDataFrame(rows, f"g string, {SHAPE}, n int, label string").repartition(3)
    got = {r["g"]: r for r in spatial.dissolve(df, "g", sums=["n"], firsts=["label"]).withColumn("a", geometry.polygon_area(F.col("rings"))).collect()}
    assert (got["frame"]["a"], got["frame"]["parts"], got["frame"]["n"], len(got["frame"]["rings"])) == (12.0, 12, 12, 2)
    assert (got["corner"]["a"], len(got["corner"]["rings"]), got["one"]["a"]) == (2.0, 2, 1.0)
    assert all(len({tuple(p) for p in map(tuple, r)}) == len(r) for x in got.values() for r in x["rings"])


@pytest.mark.parametrize(("lon", "lat", "south"), [(27.14, 38.42, False), (28.9, 41.0, False), (24.1, -33.5, True)])
def test_utm_there_and_back(spark, lon, lat, south):
    e, n = spatial.to_utm(F.lit(lon), F.lit(lat), 35, south)
    back = spatial.from_utm(F.col("e"), F.col("n"), 35, south)
    row = spark.range(1).select(e.alias("e"), n.alias("n")).select("e", "n", back[0].alias("lon"), back[1].alias("lat")).first()
    assert (row["lon"], row["lat"]) == pytest.approx((lon, lat), abs=1e-8) and 1e5 < row["e"] < 9e5 and row["n"] > 0


def test_bilinear_ignores_missing_neighbours(spark):
    px = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (1, 0, None), (1, 1, 5.0)], "row int, col int, v double")
    at = spark.createDataFrame([("a", 0.0, 0.5), ("b", 0.5, 0.5), ("c", 1.0, 0.0), ("d", 9.0, 9.0), ("e", 0.4, 0.6)], "k string, r double, c double")
    got = {r["k"]: r["v"] for r in raster.resampled(px, at, "v", bilinear=True).collect()}
    assert (got["a"], got["b"], got["c"], got["d"]) == (2.0, 3.0, None, None)
    assert {r["k"]: r["v"] for r in raster.resampled(px, at, "v").collect()}["e"] == 3.0


@pytest.mark.parametrize("kind", ["u1", "u2", "i2", "i4", "f4", "f8"])
def test_bands(spark, tmp_path, kind):
    rng = np.random.default_rng(6)
    v = rng.integers(1, 100, (70, 33)).astype(kind)
    (tmp_path / "a.tif").write_bytes(geotiff.encode(v, 100.0, 200.0, 2.0, 5.0, 7, rows=16))
    got, (r0, c0), (x0, y0, dx, dy) = geotiff.decode((tmp_path / "a.tif").read_bytes())
    want = np.where(v == 7, np.nan, v.astype(float))
    assert np.array_equal(got, want, equal_nan=True) and (r0, c0, x0, y0, dx, dy) == (0, 0, 100.0, 200.0, 2.0, 5.0)
    box = (110.5, 0.0, 121.0, 160.0)
    rows = geotiff.pixels(spark, str(tmp_path / "a.tif"), box).collect()
    assert {(r["row"], r["col"]) for r in rows} == {(r, c) for r in range(8, 40) for c in range(5, 11)}
    assert all((r["value"] is None and v[r["row"], r["col"]] == 7) or r["value"] == v[r["row"], r["col"]] for r in rows)
    assert all((r["x"], r["y"]) == (101.0 + 2 * r["col"], 197.5 - 5 * r["row"]) for r in rows)


def test_no_band():
    with pytest.raises(ValueError):
        geotiff.decode(b"GIF89a..")


def test_publish_survives_a_fault(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    sinks.publish(spark.range(3), path)
    broken = sinks._fs

    class Store:
        def __init__(self, store):
            self.store = store

        def __getattr__(self, name):
            return getattr(self.store, name)

        def rename(self, a, b):
            if str(a.toString()).endswith(".new"):
                raise OSError("cut short")
            return self.store.rename(a, b)

    monkeypatch.setattr(sinks, "_fs", lambda s, p: (broken(s, p)[0], Store(broken(s, p)[1])))
    with pytest.raises(OSError):
        sinks.publish(spark.range(9), path)
    monkeypatch.setattr(sinks, "_fs", broken)
    assert sinks.recover(spark, path) and spark.read.parquet(path).count() == 3
    sinks.publish(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and not sinks.recover(spark, path)


def test_workbook_and_report(spark, tmp_path):
    df = spark.createDataFrame([(1, "a & <b>", 2.5, None), (2, None, -1.0, True)], "k int, t string, v double, f boolean")
    sinks.workbook(spark, f"file://{tmp_path}/w.xlsx", {"one": df, "two": df.select("k")})
    with zipfile.ZipFile(io.BytesIO((tmp_path / "w.xlsx").read_bytes())) as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
        assert "a &amp; &lt;b&gt;" in sheet and '<c r="C2"><v>2.5</v></c>' in sheet and z.read("xl/workbook.xml").decode().count("<sheet ") == 2
    with pytest.raises(ValueError):
        sinks.workbook(spark, f"file://{tmp_path}/w.xlsx", {"one": df}, most_rows=1)
    sinks.html_report(spark, f"file://{tmp_path}/r.html", "A & B", {"one": df})
    page = (tmp_path / "r.html").read_text(encoding="utf-8")
    assert "A &amp; B" in page and "<td>a &amp; &lt;b&gt;</td>" in page


def test_uncertainty_outputs(spark, tmp_path):
    roads = spark.createDataFrame([(i, i / 10, i / 10 + 0.2) for i in range(11)], "road_id int, q05 double, q95 double")
    runs = spark.createDataFrame([(i, i / 10, i / 20) for i in range(11)], "run int, spearman double, overlap double")
    sinks.uncertainty_outputs(roads, roads, runs, runs, f"file://{tmp_path}/out")
    text = (tmp_path / "out" / "summary.json").read_text()
    assert '"p50": 0.5' in text and spark.read.parquet(f"{tmp_path}/out/roads").count() == 11


def test_settings_files_and_adapters(tmp_path):
    (tmp_path / "izmir.yaml").write_text("city_id: izmir\nname: İzmir\nbbox: [26, 38, 28, 39]\nseason: ['06-01', '08-31']\n", encoding="utf-8")
    (tmp_path / "van.json").write_text('{"city_id": "van", "name": "Van", "bbox": [43, 38, 44, 39]}')
    assert sorted(config.load_cities(str(tmp_path))) == ["izmir", "van"] and config.load_city(str(tmp_path / "izmir.yaml")).season == ("06-01", "08-31")
    (tmp_path / "other.json").write_text('{"city_id": "van", "name": "Van", "bbox": [43, 38, 44, 39]}')
    with pytest.raises(ValueError):
        config.load_cities(str(tmp_path))
    (tmp_path / "a.py").write_text("def fetch_population_data(c): return 1\ndef build_neighbourhood_layer(a, b, c): return 2\n")
    assert config.load_adapter(str(tmp_path / "a.py")).build_neighbourhood_layer(1, 2, 3) == 2
    (tmp_path / "b.py").write_text("x = 1\n")
    with pytest.raises(ValueError):
        config.load_adapter(str(tmp_path / "b.py"))
    assert config.valid_year("2026") and not config.valid_year("1826") and not config.valid_year("20266")
    assert config.csv_resource({"success": True, "result": {"resources": [{"format": "pdf"}, {"format": " csv", "url": "u"}]}}) == "u"
    with pytest.raises(ValueError):
        config.csv_resource({"success": True, "result": {"resources": []}})


def test_all_tables_or_none(spark):
    put, tables = [], {"a": spark.range(1), "b": spark.range(0)}
    with pytest.raises(ValueError):
        config.replaced_together(tables, lambda n, df: "" if df.count() else "empty", lambda n, df: put.append(n))
    config.replaced_together({"a": spark.range(1)}, lambda n, df: "", lambda n, df: put.append(n))
    assert put == ["a"]


def test_season_over_new_year(spark):
    days = spark.createDataFrame([("2020-12-31",), ("2020-01-15",), ("2020-06-01",)], "d string").select(F.to_date("d").alias("d"))
    assert [r["s"] for r in days.select(config.in_season(F.col("d"), "12-01", "01-31").alias("s")).collect()] == [True, True, False]


def test_feature_kinds(spark, tmp_path):
    lines = [
        '{"type": "Feature", "properties": {"k": 1}, "geometry": {"type": "Point", "coordinates": [1, 2.5]}}',
        '{"type": "Feature", "properties": {"k": 2}, "geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4, 9]]}}',
        '{"type": "Feature", "properties": {"k": 3, "o": {"a": 1}}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1]]], [[[5, 5], [6, 5], [6, 6]], [[5.1, 5], [5.2, 5], [5.2, 5.1]]]]}}',
        '{"type": "Feature", "properties": {"k": "x"}, "geometry": null}',
    ]
    (tmp_path / "a.json").write_text("\n".join(lines))
    (tmp_path / "b.json").write_text('{"type": "FeatureCollection",\n"features": [' + ",\n".join(lines) + "]}")
    for name in ("a.json", "b.json"):
        got = [(r["k"], r["kind"], r["rings"] and [len(x) for x in r["rings"]]) for r in readers.features(spark, str(tmp_path / name), "k int, o string").collect()]
        assert got == [(1, "Point", [1]), (2, "LineString", [2]), (3, "MultiPolygon", [3, 3, 3]), (None, None, None)]
