"""The composite index: components to groups to one score, on rulers shared by all years."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions.scaling import FLOOR, combine, group_score, scale_between, scaled, with_bounds

#: The groups and their components.
GROUPS: dict[str, tuple[str, ...]] = {
    "hazard": ("hazard",),
    "exposure": ("exposure", "built"),
    "vulnerability": ("elderly", "children", "deprivation", "health", "green", "trees"),
}
#: Components that change by year; the others are scaled once per road.
YEARLY = ("hazard", "trees")
#: Raw column of each component, and whether more of it means less risk.
RAW = {
    "hazard": ("risk_score", False),
    "trees": ("ndvi", True),
    "exposure": ("population_density", False),
    "built": ("building_density", False),
    "elderly": ("elderly_share", False),
    "children": ("child_share", False),
    "deprivation": ("development_score", True),
    "health": ("health_distance_m", False),
    "green": ("green_distance_m", False),
}
#: The five categories in ascending order, and those that count as high.
CATEGORIES = ("Düşük", "Orta", "Yüksek", "Kritik", "Aşırı Kritik")
HIGH = ("Kritik", "Aşırı Kritik")
#: Change classes between right-closed edges.
CHANGE_EDGES = (-100, -1, 1, 3, 100)
CHANGES = ("Soğudu", "Değişmedi", "Hafif Isındı", "Belirgin Isındı")


def complete_case(panel: DataFrame, years: Sequence[int], columns: Sequence[str], key: str = "road_id") -> DataFrame:
    """The rows of roads that have every column in every year."""
    have = F.lit(True)
    for c in columns:
        have = have & F.col(c).isNotNull()
    whole = (
        panel.filter(F.col("year").isin(*years) & have)
        .groupBy(key)
        .agg(F.count_distinct("year").alias("n"))
        .filter(F.col("n") == len(set(years)))
        .select(key)
    )
    return panel.filter(F.col("year").isin(*years)).join(whole, key, "left_semi")


def pooled_percent(panel: DataFrame, column: str, out: str, digits: int | None = 1) -> DataFrame:
    """0-100 between the minimum and maximum over all rows; 0 if they are equal."""
    both = with_bounds(panel, [column], robust=False)
    share = scale_between(F.col(column), F.col(f"{column}_lo"), F.col(f"{column}_hi")) * 100
    both = both.withColumn(out, share if digits is None else F.bround(share, digits))
    return both.drop(f"{column}_lo", f"{column}_hi")


def components(panel: DataFrame, key: str = "road_id", raw: Mapping[str, tuple[str, bool]] = RAW, yearly: Sequence[str] = YEARLY) -> DataFrame:
    """A long panel with a 0-1 column for each component of ``raw``: its column, and whether more of it means less risk.

    Static components are scaled over roads (one row each), those of ``yearly`` over all rows.
    """
    static = [c for c in raw if c not in yearly]
    columns = [raw[c][0] for c in static]
    by_year = scaled(panel, [raw[c][0] for c in yearly], invert=[raw[c][0] for c in yearly if raw[c][1]]) if yearly else panel
    for c in yearly:
        by_year = by_year.withColumnRenamed(f"{raw[c][0]}_norm", c)
    if not static:
        return by_year
    roads = panel.groupBy(key).agg(*[F.max(r).alias(r) for r in columns])
    roads = scaled(roads, columns, invert=[raw[c][0] for c in static if raw[c][1]])
    return by_year.join(roads.select(key, *[F.col(f"{raw[c][0]}_norm").alias(c) for c in static]), key)


def group_columns(weights: Mapping[str, float] | None = None, groups: Mapping[str, Sequence[str]] = GROUPS) -> dict[str, Column]:
    """Each group's score from its members."""
    w = weights or {}
    return {g: group_score([F.col(c) for c in m], [w.get(c, 1.0) for c in m]) for g, m in groups.items()}


def group_weight(weights: Mapping[str, float] | None = None, groups: Mapping[str, Sequence[str]] = GROUPS) -> list[float]:
    """A group weighs the mean of its members."""
    w = weights or {}
    return [sum(w.get(c, 1.0) for c in m) / len(m) for m in groups.values()]


def score(
    panel: DataFrame, weights: Mapping[str, float] | None = None, floor: float = FLOOR, out: str = "score", groups: Mapping[str, Sequence[str]] = GROUPS
) -> DataFrame:
    """``panel`` (with component columns) with the scores of ``groups`` rescaled by pooled bounds, and the score."""
    grouped = panel.withColumns({f"raw_{g}": c for g, c in group_columns(weights, groups).items()})
    names = [f"raw_{g}" for g in groups]
    rescaled = scaled(grouped, names, suffix="_scaled")
    for g in groups:
        rescaled = rescaled.withColumnRenamed(f"raw_{g}_scaled", f"group_{g}")
    total = combine([F.col(f"group_{g}") for g in groups], group_weight(weights, groups), floor)
    return rescaled.withColumn(out, total)


def percent_of_range(panel: DataFrame, column: str = "score", out: str = "percent") -> DataFrame:
    """``100 * (score - min) / (max - min)``, unclipped, over all rows."""
    ends = panel.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    share = 100 * (F.col(column) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    value = F.when(F.col("_lo") == F.col("_hi"), F.when(F.col(column).isNotNull(), F.lit(0.0))).otherwise(share)
    return panel.crossJoin(F.broadcast(ends)).withColumn(out, value).drop("_lo", "_hi")  # one row


def year_change(panel: DataFrame, value: str, years: Sequence[int], out: str = "delta", digits: int = 1, key: str = "road_id") -> DataFrame:
    """``key`` and the change, rounded half-even, of ``value`` from the first to the last year; missing where a year is."""
    at = lambda y: F.max(F.when(F.col("year") == y, F.col(value)))
    wide = panel.groupBy(key).agg(at(years[0]).alias("_before"), at(years[-1]).alias("_after"))
    return wide.select(key, F.bround(F.col("_after") - F.col("_before"), digits).alias(out))
