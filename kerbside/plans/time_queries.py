"""Queries in time: as-of joins, station summaries, calendar normals, trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.operators import correlation, temporal
from kerbside.plans import bindings as b
from kerbside.plans.index_queries import rounded


def _events(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "events").select("event_id", "ts", (F.col("user_id") % 40).alias("station"), "value", "event_type", "props")


def _wanted(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    days = e.select(F.to_date("ts").alias("day")).distinct()
    return e.select("station").distinct().crossJoin(days).withColumn("pass_at", temporal.overpass_time(F.col("day")))


_EVENTS = "ev AS (SELECT event_id, ts, user_id % 40 AS station, value, event_type, props FROM events)"
_WANTED = f"""{_EVENTS}, wanted AS (SELECT station, day, CAST(day AS TIMESTAMP) + INTERVAL 520 MINUTE AS pass_at
  FROM (SELECT DISTINCT station FROM ev), (SELECT DISTINCT CAST(ts AS DATE) AS day FROM ev))"""
_NEAR = f"""{_WANTED},
near AS (SELECT station, pass_at, arg_min(value, (abs(epoch_us(ts) - epoch_us(pass_at)), ts)) AS value FROM wanted JOIN ev USING (station)
  WHERE abs(epoch_us(ts) - epoch_us(pass_at)) <= 2700000000 GROUP BY 1, 2)"""


def asof_nearest_45min(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    out = temporal.nearest_observation(_wanted(spark, d), e, "station", "pass_at", "ts", "value")
    return rounded(out.filter("value is not null").select("station", "pass_at", "value"), "value")


def scene_station_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _wanted(spark, d).groupBy("station").agg(F.count("*").alias("scenes"), F.min("pass_at").alias("first_at"))


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).withColumn("day", F.to_date("ts"))


def station_day_collapse(spark: SparkSession, d: str) -> DataFrame:
    out = temporal.station_days(_daily(spark, d), "station", "day", ["ts", "event_id"], ["value"], ["value", "event_type"], ["value"])
    out = out.withColumnsRenamed({"largest_value": "largest", "first_event_type": "first_type"})
    return rounded(out, "median_value", "first_value", "largest")


def station_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(temporal.station_summary(_events(spark, d), ["station"], "value"), "mean", "sd", digits=5)


def within_unit_anomaly(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("other", F.col("event_id") % 97 * F.lit(1.0))
    dev = temporal.within_deviation(e, "station", ["value", "other"])
    return rounded(dev.agg(F.count("*").alias("n"), F.corr("value_dev", "other_dev").alias("r")), "r")


def year_unstack(spark: SparkSession, d: str) -> DataFrame:
    p = b.yearly(spark, d)
    return rounded(temporal.year_change(p, "road_id", "lst", *b.YEARS), "change", digits=5)


def calendar_window_normal(spark: SparkSession, d: str) -> DataFrame:
    o = b.table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("grid"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("v")
    )
    wanted = o.filter((F.year("day") == 2000) & (F.dayofmonth("day") == 15) & F.month("day").isin(6, 7, 8)).select("day").distinct()
    out = temporal.calendar_normals(o, wanted, "grid", "day", "v", (1991, 1999))
    return rounded(out, "observed", "normal", "anomaly", digits=4)


def weather_correction(spark: SparkSession, d: str) -> DataFrame:
    out = temporal.weather_corrected(b.complete(spark, d, b.THREE), "lst", (0.0, 0.5, 1.0))
    return rounded(out, "mean_0", "mean_1", "mean_2", "median", digits=4)


def trend_slope(spark: SparkSession, d: str) -> DataFrame:
    means = b.complete(spark, d, b.THREE).groupBy("year").agg(F.avg("lst").alias("lst"))
    return rounded(temporal.trend(means, "lst"), "slope", digits=4)


def spearman_pearson(spark: SparkSession, d: str) -> DataFrame:
    o = b.yearly(spark, d).filter(F.col("year") == 1996)
    return rounded(correlation.spearman(o, "lst", "ndvi"), "pearson", "spearman")


def valid_counts(spark: SparkSession, d: str) -> DataFrame:
    p = b.yearly(spark, d).filter(F.col("year").isin(*b.YEARS))
    wide = p.groupBy("road_id").agg(*[F.max(F.when(F.col("year") == y, F.col("lst"))).alias(f"v{y}") for y in b.YEARS])
    both = F.col(f"v{b.YEARS[0]}").isNotNull() & F.col(f"v{b.YEARS[1]}").isNotNull()
    out = wide.agg(*[F.count(f"v{y}").alias(f"valid_{y}") for y in b.YEARS], F.avg(both.cast("double")).alias("coverage"))
    return rounded(out, "coverage")


QUERIES = {
    f.__name__: f
    for f in (
        asof_nearest_45min, scene_station_pairs, station_day_collapse, station_summary, within_unit_anomaly, year_unstack,
        calendar_window_normal, weather_correction, trend_slope, spearman_pearson, valid_counts,
    )
}

SQL = {
    "asof_nearest_45min": f"WITH {_NEAR} SELECT station, pass_at, round(value, 6) AS value FROM near",
    "scene_station_pairs": f"WITH {_WANTED} SELECT station, count(*) AS scenes, min(pass_at) AS first_at FROM wanted GROUP BY 1",
    "station_day_collapse": f"""WITH {_EVENTS} SELECT station, CAST(ts AS DATE) AS day, round(median(value), 6) AS median_value,
  round(arg_min(value, (ts, event_id)), 6) AS first_value, round(max(value), 6) AS largest, arg_min(event_type, (ts, event_id)) AS first_type FROM ev GROUP BY 1, 2""",
    "station_summary": f"WITH {_EVENTS} SELECT station, count(*) AS pairs, round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS sd FROM ev GROUP BY 1",
    "within_unit_anomaly": f"""WITH {_EVENTS}, x AS (SELECT value - avg(value) OVER (PARTITION BY station) AS a,
  event_id % 97 - avg(event_id % 97) OVER (PARTITION BY station) AS c FROM ev) SELECT count(*) AS n, round(corr(a, c), 6) AS r FROM x""",
    "year_unstack": f"""WITH {b.YEARLY_SQL.strip()}, w AS (SELECT road_id, max(lst) FILTER (year = {b.YEARS[0]}) AS a, max(lst) FILTER (year = {b.YEARS[1]}) AS z FROM yearly GROUP BY 1)
SELECT road_id, round(z - a, 5) AS change FROM w WHERE a IS NOT NULL AND z IS NOT NULL""",
    "calendar_window_normal": """WITH o AS (SELECT o_orderpriority AS grid, CAST(o_orderdate AS DATE) AS day, o_totalprice AS v FROM orders),
w AS (SELECT DISTINCT day FROM o WHERE year(day) = 2000 AND day(day) = 15 AND month(day) IN (6, 7, 8)),
k AS (SELECT DISTINCT strftime(day + CAST(i AS INT), '%m-%d') AS md FROM w, range(-7, 8) t(i)),
n AS (SELECT grid, avg(v) AS normal FROM o WHERE year(day) BETWEEN 1991 AND 1999 AND strftime(day, '%m-%d') IN (SELECT md FROM k) GROUP BY 1),
s AS (SELECT grid, avg(v) AS observed FROM o WHERE day IN (SELECT day FROM w) GROUP BY 1)
SELECT grid, round(observed, 4) AS observed, round(normal, 4) AS normal, round(observed - normal, 4) AS anomaly FROM s JOIN n USING (grid)""",
    "weather_correction": f"""WITH {b.complete_sql(b.THREE)}, m AS (SELECT year, avg(lst) AS mean FROM panel0 GROUP BY 1),
a AS (SELECT year, mean - (SELECT avg(mean) FROM m) AS an FROM m)
SELECT year, round(avg(lst), 4) AS mean_0, round(avg(lst - 0.5 * an), 4) AS mean_1, round(avg(lst - an), 4) AS mean_2, round(median(lst), 4) AS median
FROM panel0 JOIN a USING (year) GROUP BY 1""",
    "trend_slope": f"WITH {b.complete_sql(b.THREE)}, m AS (SELECT year, avg(lst) AS v FROM panel0 GROUP BY 1) SELECT round(regr_slope(v, year), 4) AS slope FROM m",
    "spearman_pearson": f"""WITH {b.YEARLY_SQL.strip()}, o AS (SELECT lst, ndvi FROM yearly WHERE year = 1996 AND lst IS NOT NULL AND ndvi IS NOT NULL),
r AS (SELECT lst, ndvi, rank() OVER (ORDER BY lst) + (count(*) OVER (PARTITION BY lst) - 1) / 2.0 AS a,
  rank() OVER (ORDER BY ndvi) + (count(*) OVER (PARTITION BY ndvi) - 1) / 2.0 AS c FROM o)
SELECT count(*) AS n, round(corr(lst, ndvi), 6) AS pearson, round(corr(a, c), 6) AS spearman FROM r""",
    "valid_counts": f"""WITH {b.YEARLY_SQL.strip()}, w AS (SELECT road_id, max(lst) FILTER (year = {b.YEARS[0]}) AS a, max(lst) FILTER (year = {b.YEARS[1]}) AS z
  FROM yearly WHERE year IN {b.YEARS} GROUP BY 1)
SELECT count(a) AS valid_{b.YEARS[0]}, count(z) AS valid_{b.YEARS[1]}, round(avg(CASE WHEN a IS NOT NULL AND z IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM w""",
}
