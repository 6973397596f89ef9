"""Summaries by area."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbside.functions.text import normalise_name
from kerbside.operators.index import CATEGORIES, HIGH

#: Fixed value: the fewest roads a reliable mean needs.
SUPPORT = 20


def year_of(column: str, year: int) -> Column:
    """A column's values in one year."""
    return F.when(F.col("year") == year, F.col(column))


def area_table(panel: DataFrame, years: Sequence[int], by: Sequence[str]) -> DataFrame:
    """One row for each area: counts, length, means, high-risk shares, change, medians, rank, reliability.

    ``panel`` is long, one row a road and year. Equal means are ranked by the area's name.
    """
    last, first = years[-1], years[0]
    valid = panel.filter(F.col("percent").isNotNull())
    for c in by:
        valid = valid.filter(F.col(c).isNotNull())
    high = F.col("category").isin(*HIGH).cast("double")
    out = [
        F.count(year_of("road_id", last)).alias("roads"),
        (F.sum(year_of("length_m", last)) / 1000).alias("length_km"),
    ]
    for y in years:
        out += [
            F.avg(year_of("percent", y)).alias(f"hvi_mean_{y}"),
            F.avg(F.when(F.col("year") == y, high)).alias(f"high_share_{y}"),
            F.avg(year_of("lst", y)).alias(f"lst_mean_{y}"),
            F.avg(year_of("ndvi", y)).alias(f"ndvi_mean_{y}"),
        ]
    for c in ("population_density", "elderly_share", "child_share", "development_score"):
        out.append(F.median(year_of(c, last)).alias(c))
    table = valid.groupBy(*by).agg(*out)
    if len(years) > 1:
        table = table.withColumn("hvi_change", F.col(f"hvi_mean_{last}") - F.col(f"hvi_mean_{first}"))
    order = Window.orderBy(F.desc(f"hvi_mean_{last}"), *by)  # over areas, not roads
    return table.withColumn("rank", F.row_number().over(order)).withColumn("reliable", F.col("roads") >= SUPPORT)


def category_counts(panel: DataFrame, labels: Sequence[str] = CATEGORIES) -> DataFrame:
    """Roads and length of every category, those without roads too."""
    spark = panel.sparkSession
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(labels)], "ordinal int, category string")
    found = panel.groupBy("category").agg(F.count("*").alias("n"), F.sum("length_m").alias("m"))
    return rows.join(found, "category", "left").select(
        "ordinal", "category", F.coalesce("n", F.lit(0)).alias("roads"), F.coalesce("m", F.lit(0.0)).alias("length_m")
    )


def crosstab(panel: DataFrame, years: Sequence[int], labels: Sequence[str] = CATEGORIES) -> DataFrame:
    """Category in the first year by category in the last: the full table, zeros included."""
    wide = panel.groupBy("road_id").agg(
        F.max(year_of("category", years[0])).alias("before"), F.max(year_of("category", years[-1])).alias("after")
    )
    counts = wide.filter(F.col("before").isin(*labels)).groupBy("before").pivot("after", list(labels)).count()
    rows = panel.sparkSession.createDataFrame([(c,) for c in labels], "before string")
    return rows.join(counts, "before", "left").fillna(0, list(labels))


def weighted_mean(value: Column, weight: Column, poison: bool = False) -> Column:
    """Aggregate: mean by weight over rows that have both. ``poison``: missing if one row lacks the value."""
    both = value.isNotNull() & weight.isNotNull()
    mean = F.sum(F.when(both, value * weight)) / F.nullif(F.sum(F.when(both, weight)), F.lit(0.0))
    return F.when(F.count(F.when(~both, 1)) == 0, mean) if poison else mean


def city_rollup(areas: DataFrame, city: str, years: Sequence[int]) -> DataFrame:
    """One row for each city over its area rows: sums, length-weighted means, the riskiest reliable area."""
    km = F.col("length_km")
    lst = {y: F.round(weighted_mean(F.col(f"lst_mean_{y}"), km), 3) for y in years}
    top = F.coalesce(F.min_by("label", F.when(F.col("reliable"), F.col("rank"))), F.min_by("label", "rank"))
    return areas.groupBy(city).agg(
        F.count("*").alias("areas"),
        F.count_distinct("district").alias("districts"),
        F.sum("roads").alias("roads"),
        F.round(F.sum("length_km"), 1).alias("length_km"),
        lst[years[-1]].alias("lst_mean"),
        F.round(lst[years[-1]] - lst[years[0]], 3).alias("lst_change"),
        top.alias("riskiest"),
        (F.count_distinct("district") == 1).alias("single_district"),
    )


def priority(panel: DataFrame, year: int, count: int = 1000) -> DataFrame:
    """The roads with the largest percent in a year, numbered; ties to the smaller id."""
    best = panel.filter((F.col("year") == year) & F.col("percent").isNotNull())
    best = best.orderBy(F.desc("percent"), "road_id").limit(count)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("percent"), "road_id")))  # ``count`` rows


def best_per_group(df: DataFrame, by: str, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group in an order (Spark limits each group before shuffling)."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("place") <= k)


def supported(df: DataFrame, by: str, least: int = SUPPORT) -> DataFrame:
    """The rows of groups with at least ``least`` rows; counts are aggregated, then joined."""
    big = df.groupBy(by).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select(by)
    return df.join(big, by, "left_semi")


def age_shares(bands: DataFrame, by: str, age: str, people: str, old: int = 65, young: int = 15) -> DataFrame:
    """Per group: the shares of people from ``old`` on and below ``young``, by their band's first age."""
    n, a = F.col(people), F.col(age)
    sums = bands.groupBy(by).agg(
        F.sum(n).cast("double").alias("_all"), F.sum(F.when(a >= old, n)).cast("double").alias("_old"), F.sum(F.when(a < young, n)).cast("double").alias("_young")
    )
    return sums.select(by, (F.col("_old") / F.col("_all")).alias("old_share"), (F.col("_young") / F.col("_all")).alias("young_share"))


def joined_by_names(left: DataFrame, right: DataFrame, names: Sequence[tuple[str, str]], columns: Sequence[str]) -> DataFrame:
    """``left`` with ``columns`` of the row of ``right`` that has the same normalised names, all of ``names`` (ours, theirs)."""
    keys = [f"_key_{i}" for i in range(len(names))]
    ours = left.withColumns({k: normalise_name(F.col(a)) for k, (a, _) in zip(keys, names, strict=True)})
    theirs = right.select(*[normalise_name(F.col(b)).alias(k) for k, (_, b) in zip(keys, names, strict=True)], *columns)
    return ours.join(theirs, keys, "left").drop(*keys)


def dense_core(areas: DataFrame, size: str, most: float, least: int = 5, fallback: int = 8, key: str = "area") -> DataFrame:
    """The areas smaller than ``most``; where those are fewer than ``least``, the ``fallback`` smallest (ties to the smaller key)."""
    small = areas.filter(F.col(size) < most)
    if small.limit(least).count() >= least:
        return small
    return areas.filter(F.col(size).isNotNull()).orderBy(size, key).limit(fallback)
