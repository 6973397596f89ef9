"""Queries over a pixel table: parts on a grid of 50 columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.operators import raster
from kerbside.plans import bindings as b
from kerbside.plans.index_queries import rounded


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    return b.table(spark, d, "part").select(
        key,
        F.floor(key / 50).cast("int").alias("row"),
        (key % 50).cast("int").alias("col"),
        F.col("p_retailprice").alias("value"),
        F.call_function("shiftleft", F.lit(1), (key % 10).cast("int")).alias("qa"),
        (key * 37 % 20000 + 5000).alias("red"),
        (key * 91 % 20000 + 6000).alias("nir"),
    )


_PIXELS = """px AS (SELECT p_partkey, CAST(p_partkey // 50 AS INT) AS row, CAST(p_partkey % 50 AS INT) AS col, p_retailprice AS value,
  1 << CAST(p_partkey % 10 AS INT) AS qa, p_partkey * 37 % 20000 + 5000 AS red, p_partkey * 91 % 20000 + 6000 AS nir FROM part)"""


def bitmask_valid(spark: SparkSession, d: str) -> DataFrame:
    return _pixels(spark, d).select("p_partkey", raster.usable(F.col("qa")).alias("valid"))


def calibrate_pixels(spark: SparkSession, d: str) -> DataFrame:
    p = _pixels(spark, d).select(
        "p_partkey", raster.thermal_celsius(F.col("red") * 2).alias("lst"), raster.night_celsius(F.nullif(F.col("nir"), F.lit(6091))).alias("night")
    )
    return rounded(p, "lst", "night")


def ndvi(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_pixels(spark, d).select("p_partkey", raster.ndvi(F.col("red"), F.col("nir")).alias("ndvi")), "ndvi")


def _scenes(spark: SparkSession, d: str) -> DataFrame:
    """Four scenes of each pixel, some missing."""
    scene = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("scene")
    p = _pixels(spark, d).select("*", scene)
    v = F.when((F.col("p_partkey") + F.col("scene")) % 3 != 0, F.col("value") + F.col("scene") * 7)
    return p.select("row", "col", "scene", v.alias("value"))


_SCENES = f"""{_PIXELS}, sc AS (SELECT row, col, s AS scene, CASE WHEN (p_partkey + s) % 3 <> 0 THEN value + s * 7 END AS value FROM px, range(0, 4) t(s))"""


def pixel_median(spark: SparkSession, d: str) -> DataFrame:
    return rounded(raster.composite_median(_scenes(spark, d), "value"), "value")


def pixel_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(raster.composite_mean(_scenes(spark, d), "value"), "value")


def mosaic_last_valid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(raster.mosaic(_scenes(spark, d), "value", "scene"), "value")


def window3x3_median(spark: SparkSession, d: str) -> DataFrame:
    p = _pixels(spark, d).withColumn("value", F.when(raster.usable(F.col("qa")) | (F.col("p_partkey") % 4 == 0), F.col("value")))
    return rounded(raster.window_median(p, "value"), "value")


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    r0, c0 = (k * 7 % 40).cast("int"), (k * 13 % 45).cast("int")
    return b.table(spark, d, "supplier").select(
        "s_suppkey", r0.alias("r0"), (r0 + 2).alias("r1"), c0.alias("c0"), (c0 + (k % 4).cast("int")).alias("c1")
    )


_BOXES = """bx AS (SELECT s_suppkey, s_suppkey * 7 % 40 AS r0, s_suppkey * 7 % 40 + 2 AS r1, s_suppkey * 13 % 45 AS c0, s_suppkey * 13 % 45 + s_suppkey % 4 AS c1 FROM supplier)"""


def zonal_mean_box(spark: SparkSession, d: str) -> DataFrame:
    p = _pixels(spark, d).filter(raster.usable(F.col("qa")))
    return rounded(raster.zonal(_boxes(spark, d), p, "s_suppkey", "value"), "mean", "total", digits=4)


def unit_calibration(spark: SparkSession, d: str) -> DataFrame:
    p = _pixels(spark, d)
    unit = F.when(F.col("col") < 40, (F.floor(F.col("col") / 10) * 100 + F.floor(F.col("row") / 10)).cast("long"))
    cells = p.select("p_partkey", unit.alias("unit"), F.when(F.col("row") >= 10, F.col("value")).otherwise(F.lit(0.0)).alias("value"))
    units = cells.filter("unit is not null").select("unit").distinct().withColumn("official", (F.col("unit") * 10 + 5).cast("double"))
    out = raster.calibrate(cells, units, "unit", "value", "official").select("p_partkey", "unit", "calibrated")
    return rounded(out, "calibrated")


def lattice_snap(spark: SparkSession, d: str) -> DataFrame:
    lo, hi = F.col("p_retailprice"), F.col("p_retailprice") + F.col("p_size") * 10
    first, n = raster.snapped(lo, hi, 100.0, 30.0)
    return b.table(spark, d, "part").select("p_partkey", first.alias("first"), n.alias("cells"))


QUERIES = {
    f.__name__: f
    for f in (
        bitmask_valid, calibrate_pixels, ndvi, pixel_median, pixel_mean, mosaic_last_valid, window3x3_median, zonal_mean_box,
        unit_calibration, lattice_snap,
    )
}

SQL = {
    "bitmask_valid": f"WITH {_PIXELS} SELECT p_partkey, (qa & 63) = 0 AS valid FROM px",
    "calibrate_pixels": f"""WITH {_PIXELS} SELECT p_partkey, CASE WHEN red > 0 THEN round(red * 2 * 0.00341802::DOUBLE + 149.0::DOUBLE - 273.15::DOUBLE, 6) END AS lst,
  CASE WHEN nir <> 6091 THEN round(nir * 0.02::DOUBLE - 273.15::DOUBLE, 6) END AS night FROM px""",
    "ndvi": f"""WITH {_PIXELS}, r AS (SELECT p_partkey, red * 2.75e-5 - 0.2::DOUBLE AS r, nir * 2.75e-5 - 0.2::DOUBLE AS n FROM px)
SELECT p_partkey, CASE WHEN r >= 0 AND n >= 0 AND n + r <> 0 THEN round(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (n - r) / (n + r))), 6) END AS ndvi FROM r""",
    "pixel_median": f"WITH {_SCENES} SELECT row, col, round(median(value), 6) AS value FROM sc GROUP BY 1, 2",
    "pixel_mean": f"WITH {_SCENES} SELECT row, col, round(avg(value), 6) AS value FROM sc GROUP BY 1, 2",
    "mosaic_last_valid": f"WITH {_SCENES} SELECT row, col, round(arg_max(value, scene) FILTER (value IS NOT NULL), 6) AS value FROM sc GROUP BY 1, 2",
    "window3x3_median": f"""WITH {_PIXELS}, v AS (SELECT row, col, CASE WHEN (qa & 63) = 0 OR p_partkey % 4 = 0 THEN value END AS value FROM px),
e AS (SELECT min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM px),
n AS (SELECT a.row, a.col, median(z.value) AS m, count(z.value) AS k FROM v a JOIN v z ON z.row BETWEEN a.row - 1 AND a.row + 1 AND z.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY 1, 2)
SELECT row, col, CASE WHEN k >= 5 AND row > r0 AND row < r1 AND col > c0 AND col < c1 THEN round(m, 6) END AS value FROM n, e""",
    "zonal_mean_box": f"""WITH {_PIXELS}, {_BOXES}
SELECT s_suppkey, round(avg(value), 4) AS mean, round(sum(value), 4) AS total, count(value) AS cells
FROM bx LEFT JOIN px ON row BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1 AND (qa & 63) = 0 GROUP BY 1""",
    "unit_calibration": f"""WITH {_PIXELS}, c AS (SELECT p_partkey, CASE WHEN col < 40 THEN CAST(col // 10 * 100 + row // 10 AS BIGINT) END AS unit, CASE WHEN row >= 10 THEN value ELSE 0.0 END AS value FROM px),
s AS (SELECT unit, CASE WHEN sum(value) > 0 THEN (unit * 10 + 5) / sum(value) ELSE 0.0 END AS f FROM c WHERE unit IS NOT NULL GROUP BY 1)
SELECT p_partkey, unit, round(value * f, 6) AS calibrated FROM c LEFT JOIN s USING (unit)""",
    "lattice_snap": """SELECT p_partkey, CAST(floor((p_retailprice - 100.0) / 30.0) AS BIGINT) AS first,
  CAST(ceil((p_retailprice + p_size * 10 - 100.0) / 30.0) - floor((p_retailprice - 100.0) / 30.0) AS BIGINT) AS cells FROM part""",
}
