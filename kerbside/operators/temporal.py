"""Joins and summaries in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The as-of tolerance, the overpass, the calendar half-window and the climate baseline.
TOLERANCE_S = 45 * 60
OVERPASS = "08:40:00"
HALF_WINDOW_DAYS = 7
BASELINE = (1991, 2020)


def overpass_time(day: Column) -> Column:
    """The overpass on a day, as a timestamp without zone."""
    return F.to_timestamp_ntz(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(f" {OVERPASS}")))


def seconds(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without zone, with microseconds."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts) / 1e6


def nearest_observation(
    wanted: DataFrame, observed: DataFrame, by: str, at: str, ts: str, value: str, tolerance_s: int = TOLERANCE_S
) -> DataFrame:
    """``wanted`` with the ``value`` observed nearest to ``at`` at the same ``by``, within the tolerance (inclusive).

    Both sides get the number of their time window of twice the tolerance; a wanted time
    probes its own and the two windows beside it, so the join is equal on station and
    window, and a station of any length is spread over its windows. Equal gaps go to the
    earlier observation.
    """
    width = 2 * tolerance_s
    left = wanted.withColumn("_w", seconds(F.col(at)))
    left = left.withColumn("_window", F.explode(F.array(*[F.floor(F.col("_w") / width) + i for i in (-1, 0, 1)])))
    right = observed.select(
        F.col(by), F.col(value).alias("_value"), seconds(F.col(ts)).alias("_o")
    ).withColumn("_window", F.floor(F.col("_o") / width))
    gap = F.abs(F.col("_o") - F.col("_w"))
    near = left.join(right, [by, "_window"]).filter(gap <= tolerance_s)
    found = near.groupBy(by, at).agg(F.min_by("_value", F.struct(gap, F.col("_o"))).alias(value))
    return wanted.join(found, [by, at], "left")


def within_deviation(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """Each column less its group's mean; group means are aggregated, then joined."""
    means = df.groupBy(by).agg(*[F.avg(c).alias(f"_{c}") for c in columns])
    out = df.join(means, by).withColumns({f"{c}_dev": F.col(c) - F.col(f"_{c}") for c in columns})
    return out.drop(*[f"_{c}" for c in columns])


def station_summary(pairs: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Count, mean and sample deviation."""
    return pairs.groupBy(*by).agg(F.count("*").alias("pairs"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def year_change(df: DataFrame, by: str, value: str, first: int, last: int) -> DataFrame:
    """The change of a group's mean between two years, where both exist."""
    wide = df.groupBy(by).pivot("year", [first, last]).agg(F.avg(value))
    return wide.filter(F.col(str(first)).isNotNull() & F.col(str(last)).isNotNull()).select(
        by, (F.col(str(last)) - F.col(str(first))).alias("change")
    )


def calendar_normals(daily: DataFrame, wanted_days: DataFrame, by: str, day: str, value: str, baseline=BASELINE, half: int = HALF_WINDOW_DAYS) -> DataFrame:
    """Per group: mean over the wanted days, mean over baseline days within ``half`` calendar days of one, and the anomaly.

    The window is the set of month-days around the wanted days, each once, whatever the year.
    """
    days = wanted_days.select(F.explode(F.sequence(-half + F.lit(0), F.lit(half))).alias("k"), F.col(day).alias("d"))
    window = days.select(F.date_format(F.date_add("d", F.col("k")), "MM-dd").alias("_md")).distinct()
    base = daily.filter(F.year(day).between(*baseline)).withColumn("_md", F.date_format(day, "MM-dd"))
    normal = base.join(F.broadcast(window), "_md", "left_semi").groupBy(by).agg(F.avg(value).alias("normal"))  # at most 366 rows
    seen = daily.join(wanted_days.select(day).distinct(), day, "left_semi").groupBy(by).agg(F.avg(value).alias("observed"))
    return seen.join(normal, by).withColumn("anomaly", F.col("observed") - F.col("normal"))


def trend(yearly_means: DataFrame, value: str, year: str = "year") -> DataFrame:
    """Slope of a value by year, from two years on."""
    return yearly_means.agg(F.when(F.count(value) >= 2, F.regr_slope(value, year)).alias("slope"))


def weather_corrected(panel: DataFrame, value: str, betas: Sequence[float], year: str = "year") -> DataFrame:
    """Per year: the mean of ``value`` less each share of the year's anomaly (``mean_0`` and so on), and the median.

    A year's anomaly is its mean less the mean of all years' means.
    """
    base = panel.groupBy(year).agg(F.avg(value).alias("_mean"))
    normal = base.agg(F.avg("_mean").alias("_normal"))
    anomaly = base.crossJoin(F.broadcast(normal)).select(year, (F.col("_mean") - F.col("_normal")).alias("_anomaly"))  # a row a year
    less = [F.avg(F.col(value) - b * F.col("_anomaly")).alias(f"mean_{i}") for i, b in enumerate(betas)]
    return panel.join(F.broadcast(anomaly), year).groupBy(year).agg(*less, F.median(value).alias("median"))


def station_days(observed: DataFrame, station: str, day: str, order: Sequence[str], medians: Sequence[str], firsts: Sequence[str], largest: Sequence[str]) -> DataFrame:
    """One row a station and day: medians, first values by ``order``, and maxima of columns."""
    first = F.struct(*order)
    return observed.groupBy(station, day).agg(
        *[F.median(c).alias(f"median_{c}") for c in medians],
        *[F.min_by(c, first).alias(f"first_{c}") for c in firsts],
        *[F.max(c).alias(f"largest_{c}") for c in largest],
    )
