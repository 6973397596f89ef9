"""Queries of shapes: diamonds and bent lines of nations, over customers' places and the pixel table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.operators import blocks, dissolve, geometry, raster, robustness, scanlines, spatial
from kerbside.plans import bindings as b
from kerbside.plans.index_queries import rounded
from kerbside.plans.raster_queries import _PIXELS, _pixels
from kerbside.plans.spatial_queries import _C, _customers
from kerbside.scratch import Scratch


def _point(x, y):
    return F.struct(x.alias("x"), y.alias("y"))


def _diamonds(spark: SparkSession, d: str, modulus: int = 900, unit: float = 1.0) -> DataFrame:
    """``n_nationkey, rings``: corners right, up, left and down of a centre."""
    k = F.col("n_nationkey")
    cx, cy, r = (k * 67 % modulus).cast("double") * unit, (k * 113 % modulus).cast("double") * unit, (40.25 + k * 3) * unit
    ring = F.array(_point(cx + r, cy), _point(cx, cy + r), _point(cx - r, cy), _point(cx, cy - r))
    return b.table(spark, d, "nation").select("n_nationkey", F.array(ring).alias("rings"))


_DIAMONDS = """dm AS (SELECT n_nationkey, CAST(n_nationkey * 67 % 900 AS DOUBLE) AS cx, CAST(n_nationkey * 113 % 900 AS DOUBLE) AS cy, 40.25 + n_nationkey * 3 AS r FROM nation),
uv AS (SELECT c_custkey, n_nationkey, r, abs(x - cx) AS u, abs(y - cy) AS v FROM c, dm),
ds AS (SELECT c_custkey, n_nationkey, CASE WHEN u + v < r THEN 0.0 ELSE sqrt((u - t) ** 2 + (v - (r - t)) ** 2) END AS dist
  FROM (SELECT *, greatest(0.0, least(CAST(r AS DOUBLE), (u - v + r) / 2)) AS t FROM uv))"""


def boundary_distance(spark: SparkSession, d: str) -> DataFrame:
    out = spatial.nearest_shape(_customers(spark, d), _diamonds(spark, d), "c_custkey", "n_nationkey", closed=True, size=240.0)
    return rounded(out.select("c_custkey", "d"), "d")


def footprint_distance_by_class(spark: SparkSession, d: str) -> DataFrame:
    """Distances to the nearest footprint of three classes, and of one that has none."""
    shapes = _diamonds(spark, d).withColumn("kind", (F.col("n_nationkey") % 3).cast("int"))
    out = spatial.nearest_shape_by_class(_customers(spark, d), shapes, "c_custkey", "n_nationkey", "kind", [0, 1, 2, 9], start=60.0)
    return rounded(out, "d_0", "d_1", "d_2", "d_9")


def chosen_box(spark: SparkSession, d: str) -> DataFrame:
    """The box of the dense cluster of diamonds: whole or core, by what part of the places in it they hold."""
    k = F.col("n_nationkey")
    areas = _diamonds(spark, d).withColumns({"x": (k * 67 % 900).cast("double"), "y": (k * 113 % 900).cast("double")})
    return rounded(spatial.chosen_box(areas, _customers(spark, d), "c_custkey", 100.0, 250.0, 20.0, 10.0, 100.0), "coverage")


def _bent(spark: SparkSession, d: str) -> DataFrame:
    """``n_nationkey, path``: 80 to the right, then 60 up."""
    k = F.col("n_nationkey")
    x, y = (k * 67 % 900).cast("double"), (k * 113 % 900).cast("double")
    return b.table(spark, d, "nation").select("n_nationkey", F.array(_point(x, y), _point(x + 80, y), _point(x + 80, y + 60)).alias("path"))


_BENT = """bt AS (SELECT n_nationkey, CAST(n_nationkey * 67 % 900 AS DOUBLE) AS bx, CAST(n_nationkey * 113 % 900 AS DOUBLE) AS b_y FROM nation),
bd AS (SELECT c_custkey, n_nationkey, least(
    sqrt((x - greatest(bx, least(bx + 80, x))) ** 2 + (y - b_y) ** 2),
    sqrt((x - (bx + 80)) ** 2 + (y - greatest(b_y, least(b_y + 60, y))) ** 2)) AS dist FROM c, bt)"""


def line_distance(spark: SparkSession, d: str) -> DataFrame:
    lines = _bent(spark, d).select("n_nationkey", F.array("path").alias("rings"))
    out = spatial.nearest_shape(_customers(spark, d), lines, "c_custkey", "n_nationkey", closed=False)
    return rounded(out.select("c_custkey", "d"), "d")


def buffer_density(spark: SparkSession, d: str) -> DataFrame:
    """Places within 35.5 of a line, and per area of that buffer."""
    out = spatial.buffer_count(_bent(spark, d), _customers(spark, d), "n_nationkey", 35.5, "near")
    out = geometry.with_buffer_area(out, "path", 35.5, "area")
    return rounded(out.select("n_nationkey", "near", (F.col("near") / F.col("area") * 1000).alias("density")), "density")


def _tangled(spark: SparkSession, d: str) -> DataFrame:
    """``s_suppkey, path``: there and back, a cross drawn in one go, and a square that closes on itself."""
    k = F.col("s_suppkey")
    x, y, n = (k * 67 % 900).cast("double"), (k * 113 % 900).cast("double"), 100 + (k % 50).cast("double")
    hairpin = F.array(_point(x, y), _point(x + n, y), _point(x + n / 4, y), _point(x + n / 2, y), _point(x, y))
    cross = F.array(_point(x, y), _point(x + n, y), _point(x + n / 2, y), _point(x + n / 2, y + n / 2), _point(x + n / 2, y - n / 2))
    square = F.array(_point(x, y), _point(x + n, y), _point(x + n, y + n), _point(x, y + n), _point(x, y))
    return b.table(spark, d, "supplier").select("s_suppkey", F.when(k % 3 == 0, hairpin).when(k % 3 == 1, cross).otherwise(square).alias("path"))


def buffer_areas(spark: SparkSession, d: str) -> DataFrame:
    """Areas within 10 of paths that come near themselves, exactly and by their outlines."""
    out = geometry.with_buffer(geometry.with_buffer_area(_tangled(spark, d), "path", 10.0, "area"), "path", 10.0, "rings")
    own = geometry.polygon_area(F.col("rings"))
    near = F.abs(own / F.col("area") - 1) < 0.002  # arcs are cut short
    return rounded(out.select("s_suppkey", "area", F.size("rings").alias("n_rings"), near.alias("outline_agrees")), "area", digits=5)


_AREA = 2 * 35.5 * 140 + math.pi * 35.5**2 + (math.pi / 4 - math.tan(math.pi / 4)) * 35.5**2


def _centres(spark: SparkSession, d: str) -> DataFrame:
    return _pixels(spark, d).withColumns({"x": F.col("col") + 0.5, "y": F.col("row") + 0.5})


def _small_diamonds(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    cx, cy, r = (k * 7 % 50).cast("double"), (k * 11 % 40).cast("double"), 3.25 + k % 5
    ring = F.array(_point(cx + r, cy), _point(cx, cy + r), _point(cx - r, cy), _point(cx, cy - r))
    return b.table(spark, d, "nation").select("n_nationkey", F.array(ring).alias("rings"), (k * 7 % 25).alias("place"))


_SMALL = """sd AS (SELECT n_nationkey, n_nationkey * 7 % 50 AS cx, n_nationkey * 11 % 40 AS cy, 3.25 + n_nationkey % 5 AS r, n_nationkey * 7 % 25 AS place FROM nation),
inside AS (SELECT n_nationkey, place, p_partkey, row, col, value FROM px JOIN sd ON abs(col + 0.5 - cx) + abs(row + 0.5 - cy) < r)"""


def zonal_polygon_mean(spark: SparkSession, d: str) -> DataFrame:
    out = raster.zonal_shapes(_small_diamonds(spark, d), _centres(spark, d), "n_nationkey", "value", 8.0)
    return rounded(out, "mean", "total", digits=4)


def zonal_buffer_mean(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    x, y = (k * 7 % 50).cast("double"), (k * 11 % 40).cast("double")
    lines = b.table(spark, d, "nation").select("n_nationkey", F.array(_point(x, y), _point(x + 4, y), _point(x + 4, y + 3)).alias("path"))
    return rounded(raster.zonal_buffers(lines, _centres(spark, d), "n_nationkey", "value", 1.3), "mean", "total", digits=4)


def rasterized_units(spark: SparkSession, d: str) -> DataFrame:
    pixels = _centres(spark, d).select("p_partkey", "row", "col", "x", "y")
    return raster.rasterized(_small_diamonds(spark, d), pixels, "n_nationkey", "place", 8.0).select("p_partkey", "n_nationkey")


def _mirrored(spark: SparkSession, d: str) -> DataFrame:
    """The small diamonds on a lattice whose rows run down from 1000."""
    flip = lambda p: _point(p["x"], 1000.0 - p["y"])
    return _small_diamonds(spark, d).withColumn("rings", F.transform("rings", lambda r: F.transform(r, flip)))


def _lattice(pixels: DataFrame) -> blocks.Grid:
    return blocks.Grid(0.0, 1000.0, 1.0, 1.0, 50, pixels.agg(F.max("row")).first()[0] + 1)


def zonal_scanlines(spark: SparkSession, d: str) -> DataFrame:
    """``zonal_polygon_mean`` by intervals of rows and running sums."""
    p = _pixels(spark, d)
    out = scanlines.zonal(_mirrored(spark, d), p, "n_nationkey", "value", _lattice(p), size=16)
    return rounded(out, "mean", "total", digits=4)


def rasterized_scanlines(spark: SparkSession, d: str) -> DataFrame:
    """``rasterized_units`` by intervals of rows."""
    p = _pixels(spark, d)
    marked = scanlines.rasterized(_mirrored(spark, d), _lattice(p), "n_nationkey", "place")
    return p.join(marked, ["row", "col"], "left").select("p_partkey", "n_nationkey")


_RADII = (1.3, 2.2, 3.4)


def _hooks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    x, y = (k * 7 % 47).cast("double"), (k * 11 % 40).cast("double")
    return b.table(spark, d, "supplier").select("s_suppkey", F.array(_point(x, y), _point(x + 4, y), _point(x + 4, y + 3)).alias("path"), "s_nationkey")


def nested_buffer_means(spark: SparkSession, d: str) -> DataFrame:
    """Pixels within three radii of each line, met once."""
    out = scanlines.nested_buffers(_hooks(spark, d), _centres(spark, d), "s_suppkey", "value", _RADII)
    return rounded(out, *[f"mean_{i}" for i in range(len(_RADII))], digits=4)


def buffer_sensitivity_sampled(spark: SparkSession, d: str) -> DataFrame:
    """How the ranking of lines by what is around them moves with the width of the buffer that is sampled."""
    lines = _hooks(spark, d)
    means = scanlines.nested_buffers(lines, _centres(spark, d), "s_suppkey", "value", _RADII)
    means = Scratch(spark, "widths").table(means, "means")
    scores = {10 * (i + 1): means.select(F.col("s_suppkey").alias("road_id"), F.round(f"mean_{i}", 6).alias("score")) for i in range(len(_RADII))}
    types = lines.select(F.col("s_suppkey").alias("road_id"), F.col("s_nationkey").cast("string").alias("highway"))
    return rounded(robustness.buffer_sensitivity(scores, types)[0], "spearman", "overlap", "median_change", "moved_share")


def dissolved_outline(spark: SparkSession, d: str) -> DataFrame:
    """Unit squares of one brand's parts as one shape a brand: area, centre and sum by its outline."""
    p = _pixels(spark, d).join(b.table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey")
    x, y = F.col("col").cast("double"), F.col("row").cast("double")
    square = F.array(_point(x, y), _point(x + 1, y), _point(x + 1, y + 1), _point(x, y + 1))
    p = p.select("p_brand", F.array(square).alias("rings"), F.col("red").alias("n"))
    shapes = dissolve.union(p, "p_brand", sums=["n"])
    return rounded(shapes.select("p_brand", "parts", "n", geometry.signed_area(F.col("rings")).alias("area")), "area", digits=4)


def dissolved_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Squares of one brand's parts that reach half over their neighbours, every fifth one twice, as one shape a brand."""
    p = _pixels(spark, d).join(b.table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey")
    x, y = F.col("col").cast("double"), F.col("row").cast("double")
    square = F.array(_point(x, y), _point(x, y + 1.5), _point(x + 1.5, y + 1.5), _point(x + 1.5, y))
    p = p.select("p_partkey", "p_brand", F.array(square).alias("rings"))
    shapes = dissolve.union(p.unionByName(p.filter("p_partkey % 5 = 0")), "p_brand")
    return rounded(shapes.select("p_brand", "parts", geometry.signed_area(F.col("rings")).alias("area")), "area", digits=4)


def _frames(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles with a rectangular hole, one a nation."""
    k = F.col("n_nationkey")
    x0, y0 = (k * 67 % 700).cast("double") - 0.5, (k * 113 % 700).cast("double") - 0.5
    w, h = 150.0 + k * 4, 260.0 - k * 3

    def ring(ax, ay, bx, by):
        return F.array(_point(ax, ay), _point(bx, ay), _point(bx, by), _point(ax, by))

    hole = ring(x0 + 10, y0 + 10, x0 + 10 + w * (k % 5) / 6, y0 + 70)
    return b.table(spark, d, "nation").select("n_nationkey", F.array(hole, ring(x0, y0, x0 + w, y0 + h)).alias("rings"))


_FRAMES = """fr AS (SELECT *, (x1 - x0) * (y1 - y0) AS outer_area, (hx1 - hx0) * 60 AS hole_area FROM (SELECT n_nationkey, n_nationkey * 67 % 700 - 0.5 AS x0, n_nationkey * 113 % 700 - 0.5 AS y0,
  n_nationkey * 67 % 700 - 0.5 + 150.0 + n_nationkey * 4 AS x1, n_nationkey * 113 % 700 - 0.5 + 260.0 - n_nationkey * 3 AS y1,
  n_nationkey * 67 % 700 + 9.5 AS hx0, n_nationkey * 67 % 700 + 9.5 + (150.0::DOUBLE + n_nationkey * 4) * (n_nationkey % 5) / 6 AS hx1, n_nationkey * 113 % 700 + 9.5 AS hy0 FROM nation))"""


def holed_measures(spark: SparkSession, d: str) -> DataFrame:
    c = geometry.polygon_centroid(F.col("rings"))
    out = _frames(spark, d).select("n_nationkey", geometry.polygon_area(F.col("rings")).alias("area"), c["x"].alias("cx"), c["y"].alias("cy"))
    return rounded(out, "area", "cx", "cy", digits=4)


def smallest_holed_polygon(spark: SparkSession, d: str) -> DataFrame:
    return spatial.smallest_polygon(_customers(spark, d), _frames(spark, d), "c_custkey", "n_nationkey", 100.0).select("c_custkey", "n_nationkey")


def utm_round_trip(spark: SparkSession, d: str) -> DataFrame:
    lon, lat = F.col("x") / 400 + 26, F.col("y") / 100 - 5
    p = _customers(spark, d).withColumns({"lon": lon, "lat": lat})
    east, north = spatial.to_utm(F.col("lon"), F.col("lat"), 35, south=True)
    back = spatial.from_utm(F.col("e"), F.col("n"), 35, south=True)
    out = p.withColumns({"e": east, "n": north}).select("c_custkey", back[0].alias("lon"), back[1].alias("lat"))
    return rounded(out, "lon", "lat")


def _places(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return b.table(spark, d, "supplier").select("s_suppkey", (k * 7 % 45 + (k % 4) / 5).alias("r"), (k * 13 % 47 + (k % 7) / 8).alias("c"))


_PLACES = "pl AS (SELECT s_suppkey, s_suppkey * 7 % 45 + (s_suppkey % 4) / 5::DOUBLE AS r, s_suppkey * 13 % 47 + (s_suppkey % 7) / 8::DOUBLE AS c FROM supplier)"


def _holes(spark: SparkSession, d: str) -> DataFrame:
    return _pixels(spark, d).withColumn("value", F.when(F.col("p_partkey") % 5 != 0, F.col("value")))


def resampled_nearest(spark: SparkSession, d: str) -> DataFrame:
    return raster.resampled(_holes(spark, d), _places(spark, d), "value").select("s_suppkey", "value")


def resampled_bilinear(spark: SparkSession, d: str) -> DataFrame:
    return rounded(raster.resampled(_holes(spark, d), _places(spark, d), "value", bilinear=True).select("s_suppkey", "value"), "value")


def masked_density(spark: SparkSession, d: str) -> DataFrame:
    unit = F.when(F.col("p_partkey") % 3 != 0, F.col("red"))
    return _pixels(spark, d).select("p_partkey", raster.masked_by(F.col("value") / 7, unit).alias("density"))


def _widths(spark: SparkSession, d: str) -> tuple[dict[int, DataFrame], DataFrame]:
    c = b.table(spark, d, "customer")
    score = lambda w: F.col("c_acctbal") + F.col("c_custkey") * w % 997
    scores = {w: c.select(F.col("c_custkey").alias("road_id"), F.when(F.col("c_custkey") % (w + 1) != 0, score(w)).alias("score")) for w in (10, 30, 50)}
    return scores, c.select(F.col("c_custkey").alias("road_id"), F.col("c_mktsegment").alias("highway"))


def buffer_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(robustness.buffer_sensitivity(*_widths(spark, d))[0], "spearman", "overlap", "median_change", "moved_share")


def buffer_sensitivity_types(spark: SparkSession, d: str) -> DataFrame:
    return rounded(robustness.buffer_sensitivity(*_widths(spark, d), least=5)[1], "mean_change", "median_change")


_WIDTHS = (
    ", ".join(
        f"""w{w} AS (SELECT c_custkey, CASE WHEN s IS NOT NULL THEN (rank() OVER (ORDER BY s NULLS LAST) + (count(*) OVER (PARTITION BY s) - 1) / 2.0) / count(s) OVER () END AS r{w}
  FROM (SELECT c_custkey, CASE WHEN c_custkey % {w + 1} <> 0 THEN c_acctbal + c_custkey * {w} % 997 END AS s FROM customer))"""
        for w in (10, 30, 50)
    )
    + ", t AS (SELECT * FROM w10 JOIN w30 USING (c_custkey) JOIN w50 USING (c_custkey) WHERE r10 IS NOT NULL AND r30 IS NOT NULL AND r50 IS NOT NULL)"
)


_HOOKS = """hk AS (SELECT s_suppkey, s_suppkey * 7 % 47 AS bx, s_suppkey * 11 % 40 AS b_y FROM supplier),
hd AS (SELECT s_suppkey, value, least(sqrt((col + 0.5 - greatest(bx, least(bx + 4, col + 0.5))) ** 2 + (row + 0.5 - b_y) ** 2),
  sqrt((col + 0.5 - bx - 4) ** 2 + (row + 0.5 - greatest(b_y, least(b_y + 3, row + 0.5))) ** 2)) AS dist
  FROM hk LEFT JOIN px ON col + 0.5 BETWEEN bx - 4 AND bx + 8 AND row + 0.5 BETWEEN b_y - 4 AND b_y + 7)"""
_RANKED = ", ".join(
    f"""n{i} AS (SELECT s_suppkey, CASE WHEN s IS NOT NULL THEN (rank() OVER (ORDER BY s NULLS LAST) + (count(*) OVER (PARTITION BY s) - 1) / 2.0) / count(s) OVER () END AS r{i}
  FROM (SELECT s_suppkey, round(avg(value) FILTER (dist <= {r}), 6) AS s FROM hd GROUP BY 1))"""
    for i, r in enumerate(_RADII)
)


QUERIES = {
    f.__name__: f
    for f in (
        boundary_distance, footprint_distance_by_class, chosen_box, line_distance, buffer_density, buffer_areas, zonal_polygon_mean, zonal_buffer_mean, rasterized_units, dissolved_outline, dissolved_overlaps, zonal_scanlines, rasterized_scanlines, nested_buffer_means, buffer_sensitivity_sampled, holed_measures,
        smallest_holed_polygon, utm_round_trip, resampled_nearest, resampled_bilinear, masked_density, buffer_sensitivity, buffer_sensitivity_types,
    )
}

SQL = {
    "boundary_distance": f"WITH {_C}, {_DIAMONDS} SELECT c_custkey, round(min(dist), 6) AS d FROM ds GROUP BY 1",
    "footprint_distance_by_class": f"WITH {_C}, {_DIAMONDS} SELECT c_custkey, "
    + ", ".join(f"round(min(dist) FILTER (n_nationkey % 3 = {i}), 6) AS d_{i}" for i in (0, 1, 2))
    + ", CAST(NULL AS DOUBLE) AS d_9 FROM ds GROUP BY 1",
    "chosen_box": f"""WITH {_C}, {_DIAMONDS}, m AS (SELECT median(cx) AS mx, median(cy) AS my FROM dm), e AS (SELECT dm.*, sqrt((cx - mx) ** 2 + (cy - my) ** 2) AS far FROM dm, m),
k AS (SELECT * FROM e WHERE far <= (SELECT least(250.0, greatest(100.0, 2.5 * median(far))) FROM e)),
w AS (SELECT 'whole' AS variant, min(cx - r) - 20 AS x0, min(cy - r) - 20 AS y0, max(cx + r) + 20 AS x1, max(cy + r) + 20 AS y1 FROM k UNION ALL
  SELECT 'core', CASE WHEN count(*) >= 6 THEN quantile_cont(cx, 0.1) - 10 ELSE min(cx - r) - 20 END, CASE WHEN count(*) >= 6 THEN quantile_cont(cy, 0.1) - 10 ELSE min(cy - r) - 20 END,
    CASE WHEN count(*) >= 6 THEN quantile_cont(cx, 0.9) + 10 ELSE max(cx + r) + 20 END, CASE WHEN count(*) >= 6 THEN quantile_cont(cy, 0.9) + 10 ELSE max(cy + r) + 20 END FROM k),
b AS (SELECT variant, floor(x0 / 10 + 1e-9) * 10 AS x0, floor(y0 / 10 + 1e-9) * 10 AS y0, ceil(x1 / 10 - 1e-9) * 10 AS x1, ceil(y1 / 10 - 1e-9) * 10 AS y1 FROM w),
h AS (SELECT c_custkey, x, y, EXISTS (SELECT 1 FROM dm WHERE abs(x - cx) + abs(y - cy) < r) AS held FROM c),
v AS (SELECT b.*, coalesce((SELECT avg(CASE WHEN held THEN 1.0 ELSE 0.0 END) FROM h WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1), 0.0) AS coverage FROM b)
SELECT c.variant, c.x0, c.y0, c.x1, c.y1, round(c.coverage, 6) AS coverage FROM v c, v o
WHERE c.variant <> o.variant AND (c.variant = 'core') = (SELECT max(coverage) FILTER (variant = 'whole') < 0.9 AND max(coverage) FILTER (variant = 'core') > max(coverage) FILTER (variant = 'whole') + 0.02 FROM v)""",
    "line_distance": f"WITH {_C}, {_BENT} SELECT c_custkey, round(min(dist), 6) AS d FROM bd GROUP BY 1",
    "buffer_density": f"WITH {_C}, {_BENT} SELECT n_nationkey, count(*) FILTER (dist <= 35.5) AS near, round(count(*) FILTER (dist <= 35.5) / {_AREA!r}::DOUBLE * 1000, 6) AS density FROM bd GROUP BY 1",
    "buffer_areas": """WITH p AS (SELECT s_suppkey, 100 + s_suppkey % 50 AS n FROM supplier)
SELECT s_suppkey, round(CASE s_suppkey % 3 WHEN 0 THEN 20 * n + pi() * 100 WHEN 1 THEN 2 * (20 * n + pi() * 100) - 400 ELSE 4 * 20 * n + pi() * 100 - 400 END, 5) AS area,
  CASE s_suppkey % 3 WHEN 2 THEN 2 ELSE 1 END AS n_rings, true AS outline_agrees FROM p""",
    "zonal_polygon_mean": f"WITH {_PIXELS}, {_SMALL} SELECT n_nationkey, round(avg(value), 4) AS mean, round(sum(value), 4) AS total, count(value) AS cells FROM nation LEFT JOIN inside USING (n_nationkey) GROUP BY 1",
    "zonal_buffer_mean": f"""WITH {_PIXELS}, ln AS (SELECT n_nationkey, n_nationkey * 7 % 50 AS bx, n_nationkey * 11 % 40 AS b_y FROM nation)
SELECT n_nationkey, round(avg(value), 4) AS mean, round(sum(value), 4) AS total, count(value) AS cells FROM ln LEFT JOIN px ON least(
  sqrt((col + 0.5 - greatest(bx, least(bx + 4, col + 0.5))) ** 2 + (row + 0.5 - b_y) ** 2), sqrt((col + 0.5 - bx - 4) ** 2 + (row + 0.5 - greatest(b_y, least(b_y + 3, row + 0.5))) ** 2)) <= 1.3 GROUP BY 1""",
    "nested_buffer_means": f"WITH {_PIXELS}, {_HOOKS} SELECT s_suppkey, "
    + ", ".join(f"round(avg(value) FILTER (dist <= {r}), 4) AS mean_{i}, count(value) FILTER (dist <= {r}) AS cells_{i}" for i, r in enumerate(_RADII))
    + " FROM hd GROUP BY 1",
    "buffer_sensitivity_sampled": f"WITH {_PIXELS}, {_HOOKS}, {_RANKED}, t AS (SELECT * FROM n0 JOIN n1 USING (s_suppkey) JOIN n2 USING (s_suppkey) WHERE r0 IS NOT NULL AND r1 IS NOT NULL AND r2 IS NOT NULL) "
    + " UNION ALL ".join(
        f"""SELECT {10 * (i + 1)} AS buffer_m, 10 AS reference_m, count(*) AS roads, round(corr(r0, r{i}), 6) AS spearman,
  round(count(*) FILTER (r0 > 0.9 AND r{i} > 0.9) * 1.0 / greatest(count(*) FILTER (r0 > 0.9), 1), 6) AS overlap,
  round(median(abs(r{i} - r0)) * 100, 6) AS median_change, round(avg(CASE WHEN abs(r{i} - r0) > 0.2 THEN 1.0 ELSE 0.0 END), 6) AS moved_share FROM t"""
        for i in (1, 2)
    ),
    "rasterized_units": f"WITH {_PIXELS}, {_SMALL}, m AS (SELECT p_partkey, arg_max(n_nationkey, place) AS n_nationkey FROM inside GROUP BY 1) SELECT p_partkey, n_nationkey FROM px LEFT JOIN m USING (p_partkey)",
    "dissolved_outline": f"WITH {_PIXELS} SELECT p_brand, count(*) AS parts, CAST(sum(red) AS BIGINT) AS n, CAST(count(*) AS DOUBLE) AS area FROM px JOIN part USING (p_partkey) GROUP BY 1",
    "dissolved_overlaps": f"""WITH {_PIXELS}, h AS (SELECT DISTINCT p_brand, 2 * row + i AS r, 2 * col + j AS c FROM px JOIN part USING (p_partkey), range(0, 3) a(i), range(0, 3) b(j)),
n AS (SELECT p_brand, count(*) + count(*) FILTER (p_partkey % 5 = 0) AS parts FROM part GROUP BY 1)
SELECT p_brand, any_value(parts) AS parts, round(count(*) / 4.0, 4) AS area FROM h JOIN n USING (p_brand) GROUP BY 1""",
    "holed_measures": f"""WITH {_FRAMES} SELECT n_nationkey, round(outer_area - hole_area, 4) AS area,
  round((outer_area * (x0 + x1) / 2 - hole_area * (hx0 + hx1) / 2) / (outer_area - hole_area), 4) AS cx,
  round((outer_area * (y0 + y1) / 2 - hole_area * (hy0 + 30)) / (outer_area - hole_area), 4) AS cy FROM fr""",
    "smallest_holed_polygon": f"""WITH {_C}, {_FRAMES}, h AS (SELECT c_custkey, arg_min(n_nationkey, (outer_area - hole_area, n_nationkey)) AS n_nationkey FROM c JOIN fr
  ON x > x0 AND x < x1 AND y > y0 AND y < y1 AND NOT (x > hx0 AND x < hx1 AND y > hy0 AND y < hy0 + 60) GROUP BY 1) SELECT c_custkey, n_nationkey FROM c LEFT JOIN h USING (c_custkey)""",
    "utm_round_trip": f"WITH {_C} SELECT c_custkey, round(x / 400 + 26, 6) AS lon, round(y / 100 - 5, 6) AS lat FROM c",
    "resampled_nearest": f"""WITH {_PIXELS}, {_PLACES} SELECT s_suppkey, CASE WHEN p_partkey % 5 <> 0 THEN value END AS value FROM pl LEFT JOIN px ON row = CAST(floor(r + 0.5) AS INT) AND col = CAST(floor(c + 0.5) AS INT)""",
    "resampled_bilinear": f"""WITH {_PIXELS}, {_PLACES}, q AS (SELECT s_suppkey, floor(r) + i AS row, floor(c) + j AS col,
  CASE WHEN i = 1 THEN r - floor(r) ELSE 1 - (r - floor(r)) END * CASE WHEN j = 1 THEN c - floor(c) ELSE 1 - (c - floor(c)) END AS w FROM pl, range(0, 2) a(i), range(0, 2) b(j))
SELECT s_suppkey, round(sum(value * w) / nullif(sum(w) FILTER (value IS NOT NULL), 0), 6) AS value FROM q LEFT JOIN (SELECT * FROM px WHERE p_partkey % 5 <> 0) p ON p.row = q.row AND p.col = q.col GROUP BY 1""",
    "masked_density": f"WITH {_PIXELS} SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN round_even(value / 7, 1) END AS density FROM px",
    "buffer_sensitivity": f"WITH {_WIDTHS} "
    + " UNION ALL ".join(
        f"""SELECT {w} AS buffer_m, 10 AS reference_m, count(*) AS roads, round(corr(r10, r{w}), 6) AS spearman,
  round(count(*) FILTER (r10 > 0.9 AND r{w} > 0.9) * 1.0 / greatest(count(*) FILTER (r10 > 0.9), 1), 6) AS overlap,
  round(median(abs(r{w} - r10)) * 100, 6) AS median_change, round(avg(CASE WHEN abs(r{w} - r10) > 0.2 THEN 1.0 ELSE 0.0 END), 6) AS moved_share FROM t"""
        for w in (30, 50)
    ),
    "buffer_sensitivity_types": f"""WITH {_WIDTHS} SELECT c_mktsegment AS highway, count(*) AS roads, round(avg((r50 - r10) * 100), 6) AS mean_change, round(median(abs((r50 - r10) * 100)), 6) AS median_change
  FROM t JOIN customer USING (c_custkey) GROUP BY 1 HAVING count(*) >= 5""",
}
SQL |= {"zonal_scanlines": SQL["zonal_polygon_mean"], "rasterized_scanlines": SQL["rasterized_units"]}
