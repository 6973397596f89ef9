"""The domain bound to the test tables, in DataFrames and as SQL for the oracle.

A road is a customer, a neighbourhood a nation, a district a region, the year panel
the years of orders; ``lst`` is a customer-year's mean order price and ``ndvi`` its mean
discount. Means are taken over decimals, so both engines get the same doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.operators.index import GROUPS, RAW, YEARLY, complete_case, components, percent_of_range, pooled_percent, score
from kerbside.scratch import Scratch

YEARS = (1996, 2000)
THREE = (1996, 1998, 2000)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mean2(column: str):
    """The mean of a two-decimal column, exact whatever the order of rows."""
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double") / F.count(column)


def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``road_id, year, lst, ndvi`` of every customer-year."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("road_id"), F.year("o_orderdate").alias("year"), "o_totalprice"
    )
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_discount")
    lst = orders.groupBy("road_id", "year").agg(mean2("o_totalprice").alias("lst"))
    ndvi = (
        orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"])
        .groupBy("road_id", "year")
        .agg(mean2("l_discount").alias("ndvi"))
    )
    return lst.join(ndvi, ["road_id", "year"], "left")


YEARLY_SQL = """
lst_y AS (SELECT o_custkey AS road_id, CAST(year(o_orderdate) AS INT) AS year,
    CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(o_totalprice) AS lst
  FROM orders GROUP BY 1, 2),
ndvi_y AS (SELECT o_custkey AS road_id, CAST(year(o_orderdate) AS INT) AS year,
    CAST(SUM(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / COUNT(l_discount) AS ndvi
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2),
yearly AS (SELECT road_id, year, lst, ndvi FROM lst_y LEFT JOIN ndvi_y USING (road_id, year))"""


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a customer with its place names and static raw columns."""
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    parts = (
        orders.join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy("o_custkey")
        .agg(F.count_distinct("l_partkey").cast("double").alias("building_density"))
    )
    counts = orders.groupBy("o_custkey").agg(F.count("*").cast("double").alias("population_density"))
    shares = (
        orders.join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey")
        .agg(
            (F.count(F.when(F.col("o_orderpriority") == "1-URGENT", 1)) / F.count("*")).alias("elderly_share"),
            (F.count(F.when(F.col("o_orderpriority") == "5-LOW", 1)) / F.count("*")).alias("child_share"),
        )
    )
    development = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(mean2("s_acctbal").alias("development_score"))
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(shares, "c_nationkey", "left")
        .join(development, F.col("c_nationkey") == F.col("s_nationkey"), "left")
        .join(counts, F.col("c_custkey") == counts["o_custkey"], "left")
        .join(parts, F.col("c_custkey") == parts["o_custkey"], "left")
        .select(
            F.col("c_custkey").alias("road_id"),
            F.col("n_name").alias("neighbourhood"),
            F.col("r_name").alias("district"),
            F.col("c_mktsegment").alias("highway"),
            (F.col("c_custkey") % 400 + 50).cast("double").alias("length_m"),
            "population_density",
            "building_density",
            "elderly_share",
            "child_share",
            "development_score",
            F.abs("c_acctbal").alias("health_distance_m"),
            (F.col("c_custkey") * 37 % 1009).cast("double").alias("green_distance_m"),
        )
    )


ROADS_SQL = """
parts_r AS (SELECT o_custkey, CAST(COUNT(DISTINCT l_partkey) AS DOUBLE) AS building_density
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1),
counts_r AS (SELECT o_custkey, CAST(COUNT(*) AS DOUBLE) AS population_density FROM orders GROUP BY 1),
shares_r AS (SELECT c_nationkey,
    CAST(COUNT(*) FILTER (o_orderpriority = '1-URGENT') AS DOUBLE) / COUNT(*) AS elderly_share,
    CAST(COUNT(*) FILTER (o_orderpriority = '5-LOW') AS DOUBLE) / COUNT(*) AS child_share
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
dev_r AS (SELECT s_nationkey, CAST(SUM(CAST(s_acctbal AS DECIMAL(18,2))) AS DOUBLE) / COUNT(s_acctbal) AS development_score
  FROM supplier GROUP BY 1),
roads AS (SELECT c_custkey AS road_id, n_name AS neighbourhood, r_name AS district, c_mktsegment AS highway,
    CAST(c_custkey % 400 + 50 AS DOUBLE) AS length_m, population_density, building_density, elderly_share, child_share,
    development_score, abs(c_acctbal) AS health_distance_m, CAST(c_custkey * 37 % 1009 AS DOUBLE) AS green_distance_m
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN shares_r USING (c_nationkey) LEFT JOIN dev_r ON c_nationkey = s_nationkey
  LEFT JOIN counts_r ON c_custkey = counts_r.o_custkey LEFT JOIN parts_r ON c_custkey = parts_r.o_custkey)"""


def complete(spark: SparkSession, sf_dir: str, years=YEARS) -> DataFrame:
    """The customer-years of customers that have every year, with the pooled risk score."""
    panel = complete_case(yearly(spark, sf_dir), years, ["lst", "ndvi"])
    return pooled_percent(panel, "lst", "risk_score", digits=None)


def complete_sql(years=YEARS) -> str:
    listed = ", ".join(map(str, years))
    return f"""{YEARLY_SQL},
whole AS (SELECT road_id FROM yearly WHERE year IN ({listed}) AND lst IS NOT NULL AND ndvi IS NOT NULL
  GROUP BY 1 HAVING COUNT(DISTINCT year) = {len(set(years))}),
cc AS (SELECT y.* FROM yearly y JOIN whole USING (road_id) WHERE year IN ({listed})),
panel0 AS (SELECT cc.*, CASE WHEN hi = lo THEN 0.0 ELSE 100 * ((lst - lo) / (hi - lo)) END AS risk_score
  FROM cc, (SELECT min(lst) AS lo, max(lst) AS hi FROM cc))"""


STATIC = (
    "population_density",
    "building_density",
    "elderly_share",
    "child_share",
    "development_score",
    "health_distance_m",
    "green_distance_m",
)


def panel(spark: SparkSession, sf_dir: str, years=YEARS) -> DataFrame:
    """The complete panel with names and raw columns; roads with a missing static column are left out."""
    static = roads(spark, sf_dir).dropna(subset=list(STATIC))
    return complete(spark, sf_dir, years).join(static, "road_id")


def panel_sql(years=YEARS) -> str:
    have = " AND ".join(f"{c} IS NOT NULL" for c in STATIC)
    return f"""{complete_sql(years)},{ROADS_SQL},
panel AS (SELECT * FROM panel0 JOIN roads USING (road_id) WHERE {have})"""


def component_panel(spark: SparkSession, sf_dir: str, years=YEARS) -> DataFrame:
    """The panel with components. Each call writes its own: bounds, scores and runs of one query read it often."""
    scratch = Scratch(spark, "panel")
    return scratch.table(components(scratch.table(panel(spark, sf_dir, years), "raw")), "components")


def bounds_sql(column: str, source: str, name: str) -> str:
    return f"""
{name} AS (SELECT CASE WHEN q1 = q2 THEN mn ELSE q1 END AS lo, CASE WHEN q1 = q2 THEN mx ELSE q2 END AS hi
  FROM (SELECT quantile_cont({column}, 0.02) AS q1, quantile_cont({column}, 0.98) AS q2, min({column}) AS mn, max({column}) AS mx FROM {source}))"""


def scale_sql(x: str, bounds: str) -> str:
    lo, hi = f"{bounds}.lo", f"{bounds}.hi"
    return (
        f"(CASE WHEN {x} IS NULL THEN NULL WHEN {lo} IS NULL OR {lo} = {hi} THEN 0.0 "
        f"ELSE greatest(0.0, least(1.0, ({x} - {lo}) / ({hi} - {lo}))) END)"
    )


#: Raw column of each component that is scaled once a road.
_COMPONENTS = {c: RAW[c][0] for c in (*GROUPS["exposure"], *GROUPS["vulnerability"]) if c not in YEARLY}


def components_sql(years=YEARS) -> str:
    """``comp``: the panel with its nine components."""
    parts = [f"{panel_sql(years)},\nper_road AS (SELECT DISTINCT road_id, {', '.join(STATIC)} FROM panel)"]
    parts += [bounds_sql("risk_score", "panel", "b_hazard"), bounds_sql("ndvi", "panel", "b_trees")]
    parts += [bounds_sql(raw, "per_road", f"b_{c}") for c, raw in _COMPONENTS.items()]
    columns = [f"{scale_sql('risk_score', 'b_hazard')} AS hazard", f"1 - {scale_sql('ndvi', 'b_trees')} AS trees"]
    for c, raw in _COMPONENTS.items():
        minus = "1 - " if RAW[c][1] else ""
        columns.append(f"{minus}{scale_sql(raw, f'b_{c}')} AS {c}")
    names = ", ".join(["b_hazard", "b_trees", *[f"b_{c}" for c in _COMPONENTS]])
    parts.append(f"\ncomp AS (SELECT panel.*, {', '.join(columns)} FROM panel, {names})")
    return ",".join(parts)


_GROUPS = {g: list(members) for g, members in GROUPS.items()}


def score_sql(weights: dict[str, float] | None = None, source: str = "comp", tag: str = "", floor: float = 0.05, groups: dict[str, list[str]] = _GROUPS) -> str:
    """``scored<tag>``: group scores, rescaled groups and the score over ``source``."""
    w = weights or {}
    raw, scaled, logs, total = [], [], [], 0.0
    for g, members in groups.items():
        mine = [w.get(c, 1.0) for c in members]
        weighed = " + ".join(f"{c} * {float(x)!r}" for c, x in zip(members, mine, strict=True))
        raw.append(f"({weighed}) / {float(sum(mine))!r} AS raw_{g}")
        scaled.append(f"{scale_sql(f'raw_{g}', f'g_{g}{tag}')} AS group_{g}")
        share = sum(mine) / len(mine)
        total += share
        logs.append(f"{share!r} * ln({floor!r} + {1 - floor!r} * group_{g})")
    bounds = ",".join(bounds_sql(f"raw_{g}", f"raw{tag}", f"g_{g}{tag}") for g in groups)
    names = ", ".join(f"g_{g}{tag}" for g in groups)
    return f"""
raw{tag} AS (SELECT *, {', '.join(raw)} FROM {source}),{bounds},
grouped{tag} AS (SELECT raw{tag}.*, {', '.join(scaled)} FROM raw{tag}, {names}),
scored{tag} AS (SELECT *, exp(({' + '.join(logs)}) / {total!r}) * 100 AS score FROM grouped{tag})"""


def scored(spark: SparkSession, sf_dir: str, years=YEARS) -> DataFrame:
    """The panel with components, groups, score and percent of the pooled range."""
    return percent_of_range(score(component_panel(spark, sf_dir, years)))


def scored_sql(years=YEARS) -> str:
    """``pct``: the scored panel with ``percent``."""
    return f"""{components_sql(years)},{score_sql()},
pct AS (SELECT scored.*, CASE WHEN hi = lo THEN 0.0 ELSE 100 * (score - lo) / (hi - lo) END AS percent
  FROM scored, (SELECT min(score) AS lo, max(score) AS hi FROM scored))"""
