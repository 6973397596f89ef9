"""How firm the ranking is: weight profiles, scenarios, two-factor decomposition."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.functions.ranking import rank_pct, top_share
from kerbside.functions.scaling import combine, group_score, robust_bounds, scale_between
from kerbside.operators.areas import year_of
from kerbside.operators.correlation import top_overlap
from kerbside.operators.index import GROUPS, group_columns, group_weight
from kerbside.scratch import Scratch

#: The weight profiles.
PROFILES: dict[str, dict[str, float]] = {
    "equal": {},
    "heat_priority": {
        "hazard": 2.0, "exposure": 1.2, "trees": 1.0, "elderly": 0.8, "children": 0.8, "health": 0.6, "green": 0.6, "built": 0.6,
        "deprivation": 0.6,
    },
    "equity_priority": {
        "hazard": 1.0, "exposure": 1.2, "trees": 1.0, "elderly": 2.0, "children": 1.5, "health": 1.0, "green": 0.8, "built": 0.7,
        "deprivation": 1.3,
    },
}
#: Targeted share, cooling in degrees, added vegetation.
SHARE, COOLING, GREENING = 0.2, 2.0, 0.15


def normalised_weights(profile: Mapping[str, float], components: Sequence[str]) -> dict[str, float]:
    """A profile's weights over the active components (1.0 where not named), summing to 1."""
    w = {c: profile.get(c, 1.0) for c in components}
    total = sum(w.values())
    return {c: v / total for c, v in w.items()}


def fixed_score(panel: DataFrame, bounds: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """The score of component columns under given group bounds (one row of ``lo_<group>, hi_<group>``)."""
    joined = panel.crossJoin(F.broadcast(bounds))  # one row
    columns = group_columns(weights)
    groups = [scale_between(columns[g], F.col(f"lo_{g}"), F.col(f"hi_{g}")) for g in GROUPS]
    out = joined.withColumn("score", combine(groups, group_weight(weights)))
    return out.drop(*[f"{e}_{g}" for g in GROUPS for e in ("lo", "hi")])


def group_bounds(panel: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Pooled robust bounds of each group's score."""
    bounds = robust_bounds(panel.select(*[c.alias(g) for g, c in group_columns(weights).items()]), list(GROUPS))
    names = [f"{e}_{g} double" for g in GROUPS for e in ("lo", "hi")]
    return panel.sparkSession.createDataFrame([tuple(v for g in GROUPS for v in bounds[g])], ", ".join(names))


def agreement(base: DataFrame, other: DataFrame, key: str = "road_id", share: float = 0.1) -> DataFrame:
    """One row: Spearman, top-share overlap, median change and the part that moves more than 20 points.

    Ranks are taken on each side before rows without a counterpart are dropped.
    """
    a = rank_pct(base.select(key, F.col("score").alias("a")), "a", "ra")
    b = rank_pct(other.select(key, F.col("score").alias("b")), "b", "rb")
    both = a.join(b, key).filter("a is not null and b is not null")
    moved = F.abs(F.col("rb") - F.col("ra")) * 100
    return both.agg(
        F.count("*").alias("n"),
        F.corr("ra", "rb").alias("spearman"),
        (top_overlap(F.col("ra"), F.col("rb"), share) * 100).alias("overlap"),
        F.median(moved).alias("median_change"),
        (F.avg((moved > 20).cast("double")) * 100).alias("moved_share"),
    )


def biggest_movers(base: DataFrame, other: DataFrame, key: str = "road_id", count: int = 500) -> DataFrame:
    """Rows whose percentile rank changes most; ties to the smaller key."""
    a = rank_pct(base.select(key, F.col("score").alias("a")), "a", "ra")
    b = rank_pct(other.select(key, F.col("score").alias("b")), "b", "rb")
    moved = a.join(b, key).withColumn("change", F.round((F.col("rb") - F.col("ra")) * 100, 6))
    return moved.orderBy(F.desc(F.abs("change")), key).limit(count).select(key, "change")


def scenario(panel: DataFrame, weights: Mapping[str, float] | None = None, share: float = SHARE, cooling: float = COOLING, greening: float = GREENING, by: str = "population_density") -> DataFrame:
    """``panel`` (one year, component columns) with ``target``, ``base`` and ``after`` scores.

    The ``share`` of rows with the largest ``by`` are targeted: their surface cools and
    their vegetation grows, both on the panel's own min-max rulers; bounds stay the base's.
    """
    marked = top_share(panel, by, "road_id", share, "target")
    ends = panel.agg(
        F.min("lst").alias("_l0"), F.max("lst").alias("_l1"), F.min("ndvi").alias("_n0"), F.max("ndvi").alias("_n1")
    )
    both = marked.crossJoin(F.broadcast(ends))  # one row
    lst = F.when(F.col("target"), F.col("lst") - cooling).otherwise(F.col("lst"))
    ndvi = F.when(F.col("target"), F.greatest(F.col("_n0"), F.least(F.col("_n1"), F.col("ndvi") + greening))).otherwise(F.col("ndvi"))
    hazard = lambda x: scale_between(x, F.col("_l0"), F.col("_l1"))
    trees = lambda x: 1 - scale_between(x, F.col("_n0"), F.col("_n1"))
    before = both.withColumns({"hazard": hazard(F.col("lst")), "trees": trees(F.col("ndvi"))})
    bounds = group_bounds(before, weights)
    base = fixed_score(before, bounds, weights).select("road_id", F.col("score").alias("base"))
    after = both.withColumns({"hazard": hazard(lst), "trees": trees(ndvi)})
    after = fixed_score(after, bounds, weights).withColumnRenamed("score", "after")
    return after.drop("_l0", "_l1", "_n0", "_n1").join(base, "road_id")


def shapley(panel: DataFrame, years: Sequence[int]) -> DataFrame:
    """``road_id, total, heat, vegetation``: the score's change split between its two yearly components.

    Four scores under the same bounds: each year's hazard with each year's trees.
    """
    t0, t1 = years[0], years[-1]
    bounds = group_bounds(panel)
    static = [c for g in GROUPS.values() for c in g if c not in ("hazard", "trees")]
    wide = panel.groupBy("road_id").agg(
        *[F.max(year_of(c, y)).alias(f"{c}_{y}") for c in ("hazard", "trees") for y in (t0, t1)], *[F.max(c).alias(c) for c in static]
    )
    joined = wide.crossJoin(F.broadcast(bounds))  # one row

    def s(h: int, v: int):
        value = {c: F.col(c) for c in static} | {"hazard": F.col(f"hazard_{h}"), "trees": F.col(f"trees_{v}")}
        groups = [scale_between(group_score([value[c] for c in m]), F.col(f"lo_{g}"), F.col(f"hi_{g}")) for g, m in GROUPS.items()]
        return combine(groups, group_weight())

    out = joined.withColumns({"s00": s(t0, t0), "s10": s(t1, t0), "s01": s(t0, t1), "s11": s(t1, t1)})
    total = F.col("s11") - F.col("s00")
    heat = ((F.col("s10") - F.col("s00")) + (F.col("s11") - F.col("s01"))) / 2
    return out.select("road_id", total.alias("total"), heat.alias("heat"), (total - heat).alias("vegetation"))


def buffer_sensitivity(scores: Mapping[int, DataFrame], types: DataFrame, key: str = "road_id", share: float = 0.1, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """How the ranking moves with the width of the buffers that surfaces are sampled in.

    ``scores``: by width, ``key, score`` of one year; ``types``: ``key, highway``. Ranks are taken for each width and
    compared, over roads that have all, with those of the narrowest. Returns a row for each other width, and for the widest
    a row for each road type of at least ``least`` roads.
    """
    widths = sorted(scores)
    table = None
    for w in widths:
        one = rank_pct(scores[w].select(key, F.col("score").alias("s")), "s", f"r{w}").select(key, f"r{w}")
        table = one if table is None else table.join(one, key)
    table = Scratch(types.sparkSession, "buffers").table(table.dropna(), "ranks")
    a, first, rows = F.col(f"r{widths[0]}"), widths[0], None
    for w in widths[1:]:
        b = F.col(f"r{w}")
        top, moved = a > 1 - share, F.abs(b - a)
        one = table.agg(
            F.lit(w).alias("buffer_m"),
            F.lit(first).alias("reference_m"),
            F.count("*").alias("roads"),
            F.corr(a, b).alias("spearman"),
            (F.count(F.when(top & (b > 1 - share), 1)) / F.greatest(F.count(F.when(top, 1)), F.lit(1))).alias("overlap"),
            (F.median(moved) * 100).alias("median_change"),
            F.avg((moved > 0.2).cast("double")).alias("moved_share"),
        )
        rows = one if rows is None else rows.unionByName(one)
    change = (F.col(f"r{widths[-1]}") - a) * 100
    by_type = (
        table.join(types.select(key, "highway"), key)
        .filter(F.col("highway").isNotNull())
        .groupBy("highway")
        .agg(F.count("*").alias("roads"), F.avg(change).alias("mean_change"), F.median(F.abs(change)).alias("median_change"))
        .filter(F.col("roads") >= least)
    )
    return rows, by_type
