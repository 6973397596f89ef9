"""Unions of polygons, cells along pieces and numbering, against brute force on awkward shapes."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside.operators import blocks, dissolve, geometry, scanlines, spatial

RINGS = "array<array<struct<x: double, y: double>>>"


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def box(x0, y0, x1, y1):
    return ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))


def covered(shapes, x, y):
    out = np.zeros(x.shape, bool)
    for rings in shapes:
        odd = np.zeros(x.shape, bool)
        for r in rings:
            for p, q in zip(r, [*r[1:], r[0]]):
                if p["y"] != q["y"]:
                    odd ^= ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"])
        out |= odd
    return out


def united(spark, rows, **settings):
    df = spark.createDataFrame(rows, f"g string, v int, rings {RINGS}").repartition(3)
    out = dissolve.union(df, "g", sums=["v"], **settings).withColumn("a", geometry.signed_area(F.col("rings")))
    return {r["g"]: r for r in out.collect()}


def test_union_of_boxes(spark):
    rows = [
        ("touch", 1, [box(0, 0, 2, 2)]), ("touch", 2, [box(2, 1, 4, 5)]),  # along a part of an edge
        ("cross", 1, [box(0, 4, 10, 6)]), ("cross", 1, [box(4, 0, 6, 10)]),
        ("twice", 1, [box(0, 0, 3, 3)]), ("twice", 1, [list(reversed(box(0, 0, 3, 3)))]),
        ("inside", 1, [box(0, 0, 9, 9)]), ("inside", 1, [box(2, 2, 4, 4)]),
        ("hole", 1, [box(0, 0, 9, 9), box(3, 3, 6, 6)]), ("hole", 1, [box(4, 4, 5, 5)]),
        ("filled", 1, [box(0, 0, 9, 9), box(3, 3, 6, 6)]), ("filled", 1, [box(3, 3, 6, 6)]),
        ("frame", 1, [box(0, 0, 6, 1)]), ("frame", 1, [box(0, 5, 6, 6)]), ("frame", 1, [box(0, 0, 1, 6)]), ("frame", 1, [box(5, 0, 6, 6)]),
        ("corner", 1, [box(0, 0, 1, 1)]), ("corner", 1, [box(1, 1, 2, 2)]), ("flat", 1, [ring((0, 0), (1, 1), (2, 2))]), (None, 5, [box(0, 0, 1, 1)]), (None, 5, [box(0.5, 0, 1.5, 1)]),
    ]
    got = united(spark, rows)
    want = {"touch": (12, 1), "cross": (36, 1), "twice": (9, 1), "inside": (81, 1), "hole": (73, 3), "filled": (81, 1), "frame": (20, 2), "corner": (2, 2), None: (1.5, 1)}
    for g, (area, rings) in want.items():
        assert got[g]["a"] == pytest.approx(area) and len(got[g]["rings"]) == rings, g
    assert got["touch"]["v"] == 3 and got["cross"]["parts"] == 2 and got["flat"]["parts"] == 1
    assert united(spark, []) == {}


@pytest.mark.parametrize("size", [None, 3.0, 50.0])
def test_union_of_random_polygons(spark, size):
    rng, rows = random.Random(5), []
    for g in "abc":
        for _ in range(9):
            cx, cy, n = rng.uniform(0, 40), rng.uniform(0, 40), rng.randint(3, 8)
            turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
            star = ring(*[(cx + rng.uniform(3, 14) * math.cos(t), cy + rng.uniform(3, 14) * math.sin(t)) for t in turns])
            rows.append((g, 1, [star if rng.random() < 0.5 else star[::-1]]))
    got = united(spark, rows, size=size)
    x, y = np.meshgrid(np.arange(-16, 56, 0.1) + 0.05, np.arange(-16, 56, 0.1) + 0.05)
    for g in "abc":
        want = covered([r for k, _, r in rows if k == g], x, y)
        assert got[g]["a"] == pytest.approx(want.sum() * 0.01, rel=0.01)
        again = covered([[[p.asDict() for p in r] for r in got[g]["rings"]]], x, y)
        assert (again != want).mean() < 0.002


def test_cells_grow_with_length(spark):
    rng = random.Random(2)
    rows = [(i, *(rng.choice([0.0, 3.0, -7.5, rng.uniform(-50, 50)]) for _ in range(4))) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, px double, py double, qx double, qy double")
    for size, reach in ((5.0, 0.0), (2.0, 3.5), (11.0, 2.0)):
        cells = spatial.cells_along(*[F.col(c) for c in ("px", "py", "qx", "qy")], size, reach)
        for r in df.select("*", cells.alias("c")).collect():
            have = {(c["cx"], c["cy"]) for c in r["c"]}
            assert len(have) == len(r["c"])
            for _ in range(60):
                t, a, d = rng.random(), rng.uniform(0, 2 * math.pi), rng.uniform(0, reach)
                x, y = r["px"] + t * (r["qx"] - r["px"]) + d * math.cos(a), r["py"] + t * (r["qy"] - r["py"]) + d * math.sin(a)
                assert (math.floor(x / size), math.floor(y / size)) in have
    long = spark.createDataFrame([(0.0, 0.0, 30_000.0, 30_000.0)], "px double, py double, qx double, qy double")
    n = long.select(F.size(spatial.cells_along(*[F.col(c) for c in ("px", "py", "qx", "qy")], 10.0, 5.0)).alias("n")).first()["n"]
    assert n < 20_000  # its box has nine million


def test_zones_by_scanlines(spark):
    """Shapes with holes, spikes and parts off the grid, against a test of each pixel's centre."""
    rng = random.Random(8)
    grid = blocks.Grid(100.0, 50.0, 2.0, 1.0, 37, 29)
    shapes = []
    for k in range(30):
        cx, cy = rng.uniform(90, 180), rng.uniform(15, 55)
        turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(rng.randint(3, 9)))
        star = lambda s: ring(*[(cx + s * rng.uniform(2, 30) * math.cos(t), cy + s * rng.uniform(2, 20) * math.sin(t)) for t in turns])  # noqa: B023, E731
        shapes.append((k, [star(1.0), star(0.3)] if k % 3 else [star(1.0)]))
    shapes += [(30, [box(0, 0, 10, 10)]), (31, [box(0, -500, 900, 900)]), (32, [ring((110, 30), (120, 30), (130, 30))])]
    pixels = [(r, c, None if rng.random() < 0.2 else rng.uniform(0, 9)) for r in range(29) for c in range(37)]
    df = spark.createDataFrame(shapes, f"k int, rings {RINGS}")
    values = spark.createDataFrame(pixels, "row int, col int, v double").repartition(3)
    x, y = np.meshgrid(100 + 2 * (np.arange(37) + 0.5), 50 - (np.arange(29) + 0.5))
    held = {k: covered([rings], x, y) for k, rings in shapes}
    for size in (5, 256):
        got = {r["k"]: r for r in scanlines.zonal(df, values, "k", "v", grid, size).collect()}
        for k, inside in held.items():
            some = [v for r, c, v in pixels if v is not None and inside[r, c]]
            assert got[k]["cells"] == len(some) and got[k]["mean"] == (pytest.approx(sum(some) / len(some)) if some else None)
            assert got[k]["total"] == (pytest.approx(sum(some)) if some else None)
    marked = {(r["row"], r["col"]): r["k"] for r in scanlines.rasterized(df.withColumn("o", -F.col("k")), grid, "k", "o").collect()}
    want = {(r, c): min(k for k in held if held[k][r, c]) for r in range(29) for c in range(37) if any(h[r, c] for h in held.values())}
    assert marked == want


def test_nested_buffers(spark):
    rng = random.Random(9)
    lines = [(k, ring(*[(rng.uniform(0, 30), rng.uniform(0, 30)) for _ in range(rng.randint(1, 4))])) for k in range(12)] + [(99, ring((500, 500), (501, 500)))]
    places = [(c + 0.5, r + 0.5, None if rng.random() < 0.1 else rng.random()) for r in range(30) for c in range(30)]
    df = spark.createDataFrame(lines, "k int, path array<struct<x: double, y: double>>")
    got = {r["k"]: r for r in scanlines.nested_buffers(df, spark.createDataFrame(places, "x double, y double, v double"), "k", "v", (4.0, 1.0, 2.5)).collect()}

    def far(p, path):
        ends = [((a["x"], a["y"]), (b["x"], b["y"])) for a, b in zip(path, path[1:])]
        out = math.inf
        for (ax, ay), (bx, by) in ends:
            d = (bx - ax) ** 2 + (by - ay) ** 2
            t = max(0.0, min(1.0, ((p[0] - ax) * (bx - ax) + (p[1] - ay) * (by - ay)) / d)) if d else 0.0
            out = min(out, math.hypot(p[0] - ax - t * (bx - ax), p[1] - ay - t * (by - ay)))
        return out

    for k, path in lines:
        for i, radius in enumerate((4.0, 1.0, 2.5)):
            some = [v for x, y, v in places if v is not None and far((x, y), path) <= radius]
            assert got[k][f"cells_{i}"] == len(some) and got[k][f"mean_{i}"] == (pytest.approx(sum(some) / len(some)) if some else None)


def test_geometries_of_other_writers(spark):
    """Envelopes, both byte orders, heights and measures, many parts; what isn't known is refused."""
    import struct

    from kerbside.sources import readers, sinks

    def head(flags, extra=b""):
        return b"GP\x00" + bytes([flags]) + struct.pack("<i", 4326) + extra

    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]
    want = [ring(*square)]
    body = lambda o, code, dims: struct.pack(f"{o}BIII"[:1] + "BIII", o == "<", code, 1, 4) + b"".join(struct.pack(f"{o}{dims}d", *p, *[9.0] * (dims - 2)) for p in square)
    for order in "<>":
        for code, dims in ((3, 2), (1003, 3), (2003, 3), (3003, 4)):
            assert readers._wkb_rings(head(1) + body(order, code, dims)) == want
    assert readers._wkb_rings(head(1 | 1 << 1, struct.pack("<4d", 0, 4, 0, 4)) + body("<", 3, 2)) == want
    assert readers._wkb_rings(head(1 | 4 << 1, bytes(64)) + body("<", 3, 2)) == want
    many = struct.pack("<BII", 1, 6, 2) + body("<", 3, 2) + body(">", 3, 2)
    assert readers._wkb_rings(head(1) + many) == want * 2
    assert readers._wkb_rings(head(1) + struct.pack("<BIdd", 1, 1, 5.0, 6.0)) == [ring((5, 6))]
    assert readers._wkb_rings(head(1 | 1 << 4) + struct.pack("<BII", 1, 3, 0)) == []
    for bad in (b"XX" + bytes(20), head(1 | 5 << 1), head(1) + struct.pack("<BII", 1, 10, 1)):
        with pytest.raises(ValueError):
            readers._wkb_rings(bad)
    # parts with holes, an island in a hole, and two lines, there and back
    shape = [box(0, 0, 9, 9), box(1, 1, 5, 5), box(2, 2, 3, 3), box(20, 0, 24, 4), box(21, 1, 22, 2)]
    assert [len(p) for p in sinks._parts(shape)] == [2, 1, 2]
    rows = [(1, "Polygon", shape), (2, "LineString", [ring((0, 0), (1, 1)), ring((5, 5), (6, 6), (7, 5))]), (3, "Polygon", [box(0, 0, 1, 1)])]
    df = spark.createDataFrame(rows, f"k long, kind string, rings {RINGS}")
    path = f"{__import__('tempfile').mkdtemp()}/a.gpkg"
    sinks.geopackage(spark, f"file://{path}", {"t": df})
    back = {r["k"]: r for r in readers.geopackage(spark, f"file://{path}", "t", "k bigint").withColumn("a", geometry.polygon_area(F.col("rings"))).collect()}
    assert back[1]["a"] == pytest.approx(81 - 16 + 1 + 16 - 1) and len(back[1]["rings"]) == 5 and [len(r) for r in back[2]["rings"]] == [2, 3]


def test_numbers_in_order_of_appearance(spark):
    from kerbside.operators import quality

    rows = [(3, "b<br>a<br>b"), (1, "c"), (2, None), (5, ""), (4, "a<br>d<br>"), (6, "c<br>c")]
    df = spark.createDataFrame(rows, "k long, t string").repartition(3)
    tokens, dictionary = quality.compressed_in_order(df, "k", "t")
    assert {r["piece"]: r["token"] for r in dictionary.collect()} == {"c": 0, "b": 1, "a": 2, "d": 3, "": 4}
    assert {r["k"]: r["tokens"] for r in tokens.collect()} == {1: [0], 3: [1, 2, 1], 4: [2, 3, 4], 5: [4], 6: [0, 0]}
    assert {r["k"]: r["t"] for r in quality.expanded(tokens, dictionary, "k", "t").collect()} == {k: t for k, t in rows if t is not None}
    assert quality.compressed_in_order(df.limit(0), "k", "t")[1].count() == 0


def test_footprints_by_class_and_boxes(spark):
    shapes = [(1, "a", [box(0, 0, 2, 2)]), (2, "a", [box(10, 0, 12, 2)]), (3, "b", [box(5, 5, 6, 6), box(5.4, 5.4, 5.6, 5.6)]), (4, None, [box(0, 8, 1, 9)])]
    df = spark.createDataFrame(shapes, f"t int, kind string, rings {RINGS}")
    places = spark.createDataFrame([(1, 1.0, 1.0), (2, 6.0, 1.0), (3, 5.5, 5.5), (4, None, 1.0)], "k int, x double, y double")
    got = {r["k"]: (r["d_a"], r["d_b"], r["d_c"]) for r in spatial.nearest_shape_by_class(places, df, "k", "t", "kind", ["a", "b", "c"], size=4.0).collect()}
    far = math.hypot(4, 4)
    assert got[1] == (0.0, pytest.approx(far), None) and got[2] == (pytest.approx(4.0), pytest.approx(4.0), None) and got[4] == (None, None, None)
    assert got[3][1] == pytest.approx(0.1)  # in the hole
    areas = df.withColumns({"x": F.col("rings")[0][0]["x"] + 1, "y": F.col("rings")[0][0]["y"] + 1})
    b = spatial.chosen_box(areas, places, "k", 5.0, 50.0, 0.5, 1.0, 4.0).first()
    assert (b["variant"], b["x0"], b["y0"], b["x1"], b["y1"]) == ("whole", -1.0, -1.0, 13.0, 10.0) and b["coverage"] == pytest.approx(1 / 3)
    assert spatial.chosen_box(areas.limit(0), places, "k", 5.0, 50.0, 0.5, 1.0, 4.0).count() == 0


@pytest.mark.parametrize("k", [1, 2, 5])
def test_fine_breaks_are_those_of_all_values(spark, k):
    from kerbside.operators import jenks

    rng = np.random.default_rng(k)
    cases = [rng.lognormal(0, 1, 4000), np.round(rng.normal(0, 2, 4000), 1), np.array([1.0, 2, 2, 7]), np.full(5, 3.0), np.concatenate([rng.random(2000), 100 + rng.random(2000)])]
    for v in cases:
        u, n = np.unique(v, return_counts=True)
        df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "v double").repartition(3)
        got = jenks.natural_breaks(df, "v", k, most_distinct=0, cells=64)
        assert got == jenks.optimal_breaks(u, n, k) and got[0] == v.min() and got[-1] == v.max()
        if k > 1:
            seen = df.filter("v is not null and not isnan(v)").select(jenks.classify(F.col("v"), got, list("abcde")).alias("c"))
            assert seen.filter("c is null").count() == 0
    assert jenks.natural_breaks(df.limit(0), "v", k) == [] == jenks.natural_breaks(df.filter("v is null"), "v", k, most_distinct=0)
