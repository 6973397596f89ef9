"""Queries over rasters as blocks: bands made of the part table, written as tiles by Spark's tasks and read back by ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.operators import blocks, raster
from kerbside.plans.index_queries import rounded
from kerbside.plans.raster_queries import _PIXELS, SQL as _RASTER_SQL, _pixels
from kerbside.scratch import Scratch
from kerbside.sources import geotiff

_SIDE = 48  # of a block: not a divisor of the band's width, so that pieces are cut


def _written(spark: SparkSession, bands: list[tuple[str, DataFrame, blocks.Grid]]) -> str:
    scratch = Scratch(spark, "bands")
    folder = scratch.path("tiles")
    for name, rows, grid in bands:
        made = blocks.packed(rows.select("row", "col", "value"), grid, raster=F.lit(name), size=32)
        geotiff.write_tiles(made, folder, scratch, tile=96, kind="f8", packing="lzw", inner=16)
    return folder


def _rows_of(spark: SparkSession, d: str) -> int:
    return _pixels(spark, d).agg(F.max("row")).first()[0] + 1


def _cells(some: DataFrame) -> DataFrame:
    return geotiff.exploded(some).filter("value is not null").select("row", "col", "value")


def raster_common_grid(spark: SparkSession, d: str) -> DataFrame:
    """The median of three scenes whose frames differ by whole pixels and by a part of one."""
    height, scenes = _rows_of(spark, d), []
    for s in range(3):
        v = F.when((F.col("p_partkey") + s) % 3 != 0, F.col("value") + 7 * s).alias("value")
        rows = _pixels(spark, d).filter((F.col("row") >= s) & (F.col("col") >= 2 * s)).select((F.col("row") - s).alias("row"), (F.col("col") - 2 * s).alias("col"), v)
        scenes.append((f"s{s}", rows, blocks.Grid(500_000.0 + 30 * (2.1 * s), 4_400_000.0 - 30 * (s + 0.3 * (s > 0)), 30.0, 30.0, 50 - 2 * s, height - s, 32635)))
    path = _written(spark, scenes)
    grid = blocks.common_grid(geotiff.blocks(spark, path, values=False))
    pieces = blocks.aligned(geotiff.blocks(spark, path), grid, _SIDE)
    # a scene is several tiles: its name is what comes before their places
    scene = F.regexp_extract("raster", r"([^/]+)-\d+-\d+\.tif$", 1)
    return rounded(_cells(blocks.composite(pieces.withColumn("raster", scene), grid, _SIDE)), "value")


#: Left tops of two bands of 30 m pixels in neighbouring zones, which overlap; the second comes from the other zone.
_WEST, _EAST = (755_300.0, 4_430_000.0), (244_000.0, 4_430_600.0)


def _warp_value(s: int) -> Column:
    k = F.col("p_partkey")
    return F.when(k % (7 + s) != 0, (k * 37 % 50 + F.col("row") * 3 + 100 * s).cast("double")).alias("value")


def raster_warp(spark: SparkSession, d: str) -> DataFrame:
    """Bands of two zones as one, in the first's zone and on its lattice; where both are valid, the second's value."""
    height = _rows_of(spark, d)
    rows = lambda s: _pixels(spark, d).select("row", "col", _warp_value(s))
    bands = [("a", rows(0), blocks.Grid(*_WEST, 30.0, 30.0, 50, height, 32635)), ("b", rows(1), blocks.Grid(*_EAST, 30.0, 30.0, 50, height, 32636))]
    path = _written(spark, bands)
    grid = blocks.common_grid(geotiff.blocks(spark, path, values=False), epsg=32635)
    # tiles of a band are halves of one picture: warp the band's own blocks, on its own lattice
    whole = blocks.joined(geotiff.blocks(spark, path), F.regexp_extract("raster", r"([^/]+)-\d+-\d+\.tif$", 1))
    return rounded(_cells(blocks.composite(blocks.warped(whole, grid, _SIDE), grid, _SIDE, how="last")), "value", digits=2)


def raster_window_median(spark: SparkSession, d: str) -> DataFrame:
    """``window3x3_median`` over blocks that get their neighbours' rims."""
    v = F.when(raster.usable(F.col("qa")) | (F.col("p_partkey") % 4 == 0), F.col("value")).alias("value")
    grid = blocks.Grid(0.0, 0.0, 1.0, 1.0, 50, _rows_of(spark, d))
    made = blocks.packed(_pixels(spark, d).select("row", "col", v), grid, raster=F.lit("m"), size=20)
    return rounded(_cells(blocks.window_median(made)), "value")


def _transverse(lon: str, lat: str, zone: int) -> tuple[str, str]:
    """SQL of easting and northing, by the series to third order."""
    n = (1 / 298.257223563) / (2 - 1 / 298.257223563)
    a = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    c = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * n**0.5 / (1 + n)
    t = f"sinh(atanh(sin(radians({lat}))) - {e!r} * atanh({e!r} * sin(radians({lat}))))"
    lam = f"radians({lon} - {zone * 6 - 183})"
    xi, eta = f"atan2({t}, cos({lam}))", f"atanh(sin({lam}) / sqrt(1 + {t} * {t}))"
    east = " + ".join([eta, *(f"{x!r} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, x in enumerate(c, 1))])
    north = " + ".join([xi, *(f"{x!r} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, x in enumerate(c, 1))])
    return f"500000.0::DOUBLE + {0.9996 * a!r} * ({east})", f"{0.9996 * a!r} * ({north})"


def _degrees(east: str, north: str, zone: int) -> tuple[str, str]:
    """SQL of longitude and latitude, the way back."""
    n = (1 / 298.257223563) / (2 - 1 / 298.257223563)
    a = 0.9996 * 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    b = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    g = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi, eta = f"(({north}) / {a!r})", f"((({east}) - 500000.0::DOUBLE) / {a!r})"
    x = "(" + " - ".join([xi, *(f"{v!r} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, v in enumerate(b, 1))]) + ")"
    y = "(" + " - ".join([eta, *(f"{v!r} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, v in enumerate(b, 1))]) + ")"
    chi = f"asin(sin({x}) / cosh({y}))"
    lat = " + ".join([chi, *(f"{v!r} * sin({2 * j} * {chi})" for j, v in enumerate(g, 1))])
    return f"degrees(atan2(sinh({y}), cos({x}))) + {zone * 6 - 183}", f"degrees({lat})"


def _warp_sql() -> str:
    there, back = _degrees("e", "n", 35), _transverse("lon", "lat", 36)
    out_lon, out_lat = _degrees("e", "n", 36)
    out = _transverse("lon", "lat", 35)
    (ax, ay), (bx, by) = _WEST, _EAST
    return f"""WITH {_PIXELS}, h AS (SELECT max(row) + 1 AS h FROM px),
v AS (SELECT s, row, col, CAST(p_partkey * 37 % 50 + row * 3 + 100 * s AS DOUBLE) AS v FROM px, range(0, 2) t(s) WHERE p_partkey % (7 + s) <> 0),
rim AS (SELECT {bx} + 1500 * x AS e, {by} - 30 * h * y AS n FROM h, (SELECT i / 64 AS x, j AS y FROM range(0, 65) a(i), range(0, 2) b(j) UNION ALL SELECT j, i / 64 FROM range(0, 65) a(i), range(0, 2) b(j))),
rd AS (SELECT {out_lon} AS lon, {out_lat} AS lat FROM rim), rp AS (SELECT {out[0]} AS e, {out[1]} AS n FROM rd),
g AS (SELECT {ax} + floor((least(min(e), {ax}) - {ax}) / 30 + 1e-6) * 30 AS x0, {ay} - floor(({ay} - greatest(max(n), {ay})) / 30 + 1e-6) * 30 AS y0,
  greatest(max(e), {ax} + 1500) AS x1, least(min(n), {ay} - 30 * any_value(h)) AS y1 FROM rp, h),
t AS (SELECT r, c, x0 + (c + 0.5) * 30 AS e, y0 - (r + 0.5) * 30 AS n FROM g, range(0, 20000) a(r), range(0, 200) b(c) WHERE y0 - r * 30 > y1 AND x0 + c * 30 < x1),
td AS (SELECT r, c, e, n, {there[0]} AS lon, {there[1]} AS lat FROM t), tp AS (SELECT r, c, e, n, {back[0]} AS oe, {back[1]} AS o_n FROM td),
p AS (SELECT r, c, 0 AS s, ({ay} - n) / 30 AS fr, (e - {ax}) / 30 AS fc FROM tp UNION ALL SELECT r, c, 1, ({by} - o_n) / 30, (oe - {bx}) / 30 FROM tp),
i AS (SELECT *, fr - 0.5 AS ur, fc - 0.5 AS uc FROM p, h WHERE fr >= 0 AND fr < h AND fc >= 0 AND fc < 50),
w AS (SELECT r, c, i.s, sum(v * (1 - abs(ur - row)) * (1 - abs(uc - col))) AS t, sum((1 - abs(ur - row)) * (1 - abs(uc - col))) AS w
  FROM i JOIN v ON v.s = i.s AND row BETWEEN floor(ur) AND floor(ur) + 1 AND col BETWEEN floor(uc) AND floor(uc) + 1 GROUP BY 1, 2, 3)
SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, round(arg_max(t / w, s), 2) AS value FROM w WHERE w > 1e-6 GROUP BY 1, 2"""


QUERIES = {f.__name__: f for f in (raster_common_grid, raster_warp, raster_window_median)}

SQL = {
    "raster_common_grid": f"""WITH {_PIXELS}, s AS (SELECT row, col, s, CASE WHEN (p_partkey + s) % 3 <> 0 THEN value + 7 * s END AS value FROM px, range(0, 3) t(s) WHERE row >= s AND col >= 2 * s)
SELECT row, col, round(median(value), 6) AS value FROM s GROUP BY 1, 2 HAVING count(value) > 0""",
    "raster_warp": _warp_sql(),
    "raster_window_median": f"SELECT * FROM ({_RASTER_SQL['window3x3_median']}) WHERE value IS NOT NULL",
}
