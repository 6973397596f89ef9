"""Spatial queries: customers and suppliers at integer places, boxes and polygons of nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.operators import spatial
from kerbside.plans import bindings as b
from kerbside.plans.index_queries import rounded


def _at(key: str):
    return (F.col(key) * 37 % 1009).cast("double").alias("x"), (F.col(key) * 91 % 997).cast("double").alias("y")


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "customer").select("c_custkey", *_at("c_custkey"))


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "supplier").select("s_suppkey", *_at("s_suppkey"), (F.col("s_suppkey") % 4).cast("int").alias("class"))


_C = "c AS (SELECT c_custkey, CAST(c_custkey * 37 % 1009 AS DOUBLE) AS x, CAST(c_custkey * 91 % 997 AS DOUBLE) AS y FROM customer)"
_S = "s AS (SELECT s_suppkey, CAST(s_suppkey * 37 % 1009 AS DOUBLE) AS x, CAST(s_suppkey * 91 % 997 AS DOUBLE) AS y, s_suppkey % 4 AS class FROM supplier)"
_CROWD = f"{_C}, {_S}".replace("c AS", "c0 AS").replace("s AS", "s0 AS") + """, c AS (SELECT c_custkey, x * x * x / 1000 AS x, y * y * y / 1000 AS y FROM c0),
s AS (SELECT s_suppkey, x * x * x / 1000 AS x, y * y * y / 1000 AS y FROM s0)"""
_D = "sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y))"


def nearest_facility(spark: SparkSession, d: str) -> DataFrame:
    out = spatial.nearest(_customers(spark, d), _suppliers(spark, d), "c_custkey", "s_suppkey", 50.0)
    return rounded(out.select("c_custkey", "d"), "d")


def _crowded(df: DataFrame) -> DataFrame:
    """Most places in one corner, the rest far apart."""
    cube = lambda c: F.col(c) * F.col(c) * F.col(c) / 1000
    return df.withColumns({"x": cube("x"), "y": cube("y")})


def nearest_crowded(spark: SparkSession, d: str) -> DataFrame:
    """The nearest supplier where density differs by orders of magnitude."""
    out = spatial.nearest(_crowded(_customers(spark, d)), _crowded(_suppliers(spark, d)), "c_custkey", "s_suppkey")
    return rounded(out.select("c_custkey", "d"), "d", digits=4)


def nearest_crowded_path(spark: SparkSession, d: str) -> DataFrame:
    """The nearest of straight pieces from each supplier to the same corner: short and very long ones."""
    s = _crowded(_suppliers(spark, d))
    ends = F.array(*[F.struct((F.col("x") * k).alias("x"), (F.col("y") * k).alias("y")) for k in (1.0, 0.25)])
    out = spatial.nearest_shape(_crowded(_customers(spark, d)), s.select("s_suppkey", F.array(ends).alias("rings")), "c_custkey", "s_suppkey", closed=False)
    return rounded(out.select("c_custkey", "d"), "d", digits=4)


def nearest_by_class(spark: SparkSession, d: str) -> DataFrame:
    out = spatial.nearest_by_class(_customers(spark, d), _suppliers(spark, d), "c_custkey", "s_suppkey", "class", range(4), 50.0)
    out = out.withColumnsRenamed({f"d_{k}": f"d{k}" for k in range(4)})
    return rounded(out, "d0", "d1", "d2", "d3")


def radius_count(spark: SparkSession, d: str) -> DataFrame:
    return spatial.radius_count(_suppliers(spark, d), _customers(spark, d), "s_suppkey", 150.0, "near").select("s_suppkey", "near")


def _polygons(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping rectangles, one a nation."""
    k = F.col("n_nationkey")
    x0, y0 = (k * 67 % 700).cast("double"), (k * 113 % 700).cast("double")
    x1, y1 = x0 + 120.5 + k * 4, y0 + 200.5 - k * 3
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(p(x0 - 0.5, y0 - 0.5), p(x1, y0 - 0.5), p(x1, y1), p(x0 - 0.5, y1))
    return b.table(spark, d, "nation").select("n_nationkey", F.array(ring).alias("rings"))


_BOX = """n AS (SELECT n_nationkey, n_nationkey * 67 % 700 - 0.5 AS x0, n_nationkey * 113 % 700 - 0.5 AS y0,
  n_nationkey * 67 % 700 + 120.5 + n_nationkey * 4 AS x1, n_nationkey * 113 % 700 + 200.5 - n_nationkey * 3 AS y1 FROM nation),
hit AS (SELECT c_custkey, n_nationkey, (x1 - x0) * (y1 - y0) AS area FROM c JOIN n ON x > x0 AND x < x1 AND y > y0 AND y < y1)"""


def point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    return spatial.within(_customers(spark, d), _polygons(spark, d), ["n_nationkey"], 100.0).select("c_custkey", "n_nationkey")


def smallest_polygon(spark: SparkSession, d: str) -> DataFrame:
    return spatial.smallest_polygon(_customers(spark, d), _polygons(spark, d), "c_custkey", "n_nationkey", 100.0).select("c_custkey", "n_nationkey")


def coverage_share(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spatial.coverage(_customers(spark, d), _polygons(spark, d), "c_custkey", 100.0), "coverage")


def nearest_grid_point(spark: SparkSession, d: str) -> DataFrame:
    grid = spark.createDataFrame([(i, 250.0 * (i % 4), 300.0 * (i // 4)) for i in range(12)], "grid int, lon double, lat double")
    p = _customers(spark, d).select("c_custkey", F.col("x").alias("lon"), (F.col("y") / 20).alias("lat"))
    return spatial.nearest_grid_point(p, grid.withColumn("lat", F.col("lat") / 20), "c_custkey", "grid")


def fitted_box(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spatial.fitted_box(_customers(spark, d), 100.0, 300.0), "x0", "x1", "y0", "y1")


def opening_view(spark: SparkSession, d: str) -> DataFrame:
    p = _customers(spark, d).withColumn("visible", F.col("x") > 700)
    return rounded(spatial.opening_view(p, "visible"), "x0", "x1", "y0", "y1")


def polygon_measures(spark: SparkSession, d: str) -> DataFrame:
    p = _polygons(spark, d)
    ring = F.col("rings")[0]
    return rounded(p.select("n_nationkey", spatial.ring_area(ring).alias("area"), spatial.line_length(ring).alias("open_length")), "area", "open_length", digits=4)


def utm_zones(spark: SparkSession, d: str) -> DataFrame:
    lon = (F.col("c_custkey") * 37 % 3600) / 10.0 - 180
    return b.table(spark, d, "customer").select("c_custkey", spatial.utm_zone(lon).alias("zone"))


def dissolve_units(spark: SparkSession, d: str) -> DataFrame:
    """Polygons of a region's nations as one of several parts, with their summed count."""
    n = _polygons(spark, d).join(b.table(spark, d, "nation").select("n_nationkey", "n_regionkey"), "n_nationkey")
    sizes = b.table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    j = n.join(sizes, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return j.groupBy("n_regionkey").agg(F.count("*").alias("parts"), F.sum("n").alias("customers"))


QUERIES = {
    f.__name__: f
    for f in (
        nearest_facility, nearest_crowded, nearest_crowded_path, nearest_by_class, radius_count, point_in_polygon, smallest_polygon, coverage_share, nearest_grid_point,
        fitted_box, opening_view, polygon_measures, utm_zones, dissolve_units,
    )
}

SQL = {
    "nearest_facility": f"WITH {_C}, {_S} SELECT c_custkey, round(min({_D}), 6) AS d FROM c, s GROUP BY 1",
    "nearest_crowded": f"WITH {_CROWD} SELECT c_custkey, round(min({_D}), 4) AS d FROM c, s GROUP BY 1",
    "nearest_crowded_path": f"""WITH {_CROWD}, e AS (SELECT c_custkey, c.x AS x, c.y AS y, s.x AS px, s.y AS py, s.x * 0.25 - s.x AS dx, s.y * 0.25 - s.y AS dy FROM c, s),
t AS (SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, ((x - px) * dx + (y - py) * dy) / (dx * dx + dy * dy))) END AS t FROM e)
SELECT c_custkey, round(min(sqrt((x - (px + t * dx)) ** 2 + (y - (py + t * dy)) ** 2)), 4) AS d FROM t GROUP BY 1""",
    "nearest_by_class": f"WITH {_C}, {_S} SELECT c_custkey, "
    + ", ".join(f"round(min({_D}) FILTER (class = {k}), 6) AS d{k}" for k in range(4))
    + " FROM c, s GROUP BY 1",
    "radius_count": f"WITH {_C}, {_S} SELECT s_suppkey, count(*) FILTER ({_D} <= 150) AS near FROM s, c GROUP BY 1",
    "point_in_polygon": f"WITH {_C}, {_BOX} SELECT c_custkey, n_nationkey FROM hit",
    "smallest_polygon": f"WITH {_C}, {_BOX}, m AS (SELECT c_custkey, arg_min(n_nationkey, (area, n_nationkey)) AS n_nationkey FROM hit GROUP BY 1) SELECT c_custkey, n_nationkey FROM c LEFT JOIN m USING (c_custkey)",
    "coverage_share": f"WITH {_C}, {_BOX} SELECT round(avg(CASE WHEN c_custkey IN (SELECT c_custkey FROM hit) THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM c",
    "nearest_grid_point": f"""WITH {_C}, p AS (SELECT c_custkey, x AS lon, y / 20 AS lat FROM c), k AS (SELECT cos(radians(avg(lat))) AS k FROM p),
g AS (SELECT CAST(i AS INT) AS grid, 250.0 * (i % 4) AS glon, 300.0 * (i // 4) / 20 AS glat FROM range(0, 12) t(i))
SELECT c_custkey, arg_min(grid, (((lon - glon) * k) ** 2 + (lat - glat) ** 2, grid)) AS grid FROM p, g, k GROUP BY 1""",
    "fitted_box": f"""WITH {_C}, m AS (SELECT median(x) AS mx, median(y) AS my FROM c), e AS (SELECT x, y, sqrt((x - mx) ** 2 + (y - my) ** 2) AS d FROM c, m),
r AS (SELECT least(300.0, greatest(100.0, 2.5 * median(d))) AS r FROM e)
SELECT count(*) AS n, round(quantile_cont(x, 0.1), 6) AS x0, round(quantile_cont(x, 0.9), 6) AS x1, round(quantile_cont(y, 0.1), 6) AS y0, round(quantile_cont(y, 0.9), 6) AS y1 FROM e, r WHERE d <= r""",
    "opening_view": f"""WITH {_C}, v AS (SELECT * FROM c WHERE x > 700), p AS (SELECT * FROM v WHERE (SELECT count(*) FROM v) >= 10 UNION ALL SELECT * FROM c WHERE (SELECT count(*) FROM v) < 10)
SELECT round(quantile_cont(x, 0.05), 6) AS x0, round(quantile_cont(x, 0.95), 6) AS x1, round(quantile_cont(y, 0.05), 6) AS y0, round(quantile_cont(y, 0.95), 6) AS y1 FROM p""",
    "polygon_measures": f"WITH {_C}, {_BOX} SELECT n_nationkey, round((x1 - x0) * (y1 - y0), 4) AS area, round(2 * (x1 - x0) + (y1 - y0), 4) AS open_length FROM n",
    "utm_zones": "SELECT c_custkey, CAST(floor(((c_custkey * 37 % 3600) / 10.0) / 6) + 1 AS INT) AS zone FROM customer",
    "dissolve_units": """SELECT n_regionkey, count(*) AS parts, CAST(sum(n) AS BIGINT) AS customers FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) ON n_nationkey = c_nationkey GROUP BY 1""",
}
