"""Queries of scaling, index, categories and areas."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.functions import ranking, scaling
from kerbside.operators import areas, index, jenks
from kerbside.plans import bindings as b
from kerbside.scratch import Scratch


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that engines that sum in another order agree."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def panel_complete_case(spark: SparkSession, d: str) -> DataFrame:
    return rounded(b.complete(spark, d).select("road_id", "year", "lst", "ndvi"), "lst", "ndvi")


def pooled_minmax_risk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(b.complete(spark, d).select("road_id", "year", "risk_score"), "risk_score")


def year_delta_class(spark: SparkSession, d: str) -> DataFrame:
    wide = index.year_change(b.complete(spark, d), "risk_score", b.YEARS)
    return wide.select("road_id", "delta", scaling.right_closed(F.col("delta"), index.CHANGE_EDGES, index.CHANGES).alias("change"))


def robust_scale(spark: SparkSession, d: str) -> DataFrame:
    x = b.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    out = scaling.scaled(x, ["l_extendedprice"]).groupBy("l_orderkey").agg(F.sum("l_extendedprice_norm").alias("scaled"))
    return rounded(out, "scaled")


def robust_scale_degenerate(spark: SparkSession, d: str) -> DataFrame:
    p = b.table(spark, d, "part").select(
        "p_partkey",
        F.lit(7.0).alias("same"),
        F.nullif(F.col("p_size"), F.lit(1)).cast("double").alias("holes"),
        F.when(F.col("p_partkey") == 1, 1.0).otherwise(0.0).alias("rare"),
    )
    out = scaling.scaled(p, ["same", "holes", "rare"])
    return rounded(out.select("p_partkey", *[f"{c}_norm" for c in ("same", "holes", "rare")]), "holes_norm", "rare_norm")


def inverted_component(spark: SparkSession, d: str) -> DataFrame:
    s = b.table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    return rounded(scaling.scaled(s, ["s_acctbal"], invert=["s_acctbal"]).select("s_suppkey", "s_acctbal_norm"), "s_acctbal_norm")


def informative_components(spark: SparkSession, d: str) -> DataFrame:
    r = b.roads(spark, d).withColumn("constant", F.lit(3.0))
    found = scaling.informative(r, [*b.STATIC, "constant"])
    return spark.createDataFrame([(c,) for c in found], "component string")


def components_norm(spark: SparkSession, d: str) -> DataFrame:
    names = [c for g in index.GROUPS.values() for c in g]
    return rounded(b.component_panel(spark, d).select("road_id", "year", *names), *names)


def group_scores(spark: SparkSession, d: str) -> DataFrame:
    out = b.component_panel(spark, d).select("road_id", "year", *[c.alias(f"raw_{g}") for g, c in index.group_columns().items()])
    return rounded(out, *[f"raw_{g}" for g in index.GROUPS])


def combine_groups(spark: SparkSession, d: str) -> DataFrame:
    names = [f"group_{g}" for g in index.GROUPS]
    return rounded(index.score(b.component_panel(spark, d)).select("road_id", "year", *names), *names)


def hvi_score(spark: SparkSession, d: str) -> DataFrame:
    return rounded(index.score(b.component_panel(spark, d)).select("road_id", "year", "score"), "score")


#: A component more, in a group of its own and in one that there is.
_WIDER = index.RAW | {"noise": ("noise_level", False), "shade": ("canopy", True)}
_WIDER_GROUPS = index.GROUPS | {"exposure": (*index.GROUPS["exposure"], "noise"), "shelter": ("shade",)}


def hvi_score_wider(spark: SparkSession, d: str) -> DataFrame:
    """The index with two components and a group more than it has of itself."""
    more = {"noise_level": (F.col("road_id") % 89).cast("double"), "canopy": (F.col("road_id") * 7 % 61).cast("double")}
    scratch = Scratch(spark, "wider")
    raw = scratch.table(b.panel(spark, d, b.YEARS).withColumns(more), "raw")
    panel = scratch.table(index.components(raw, raw=_WIDER), "components")
    return rounded(index.score(panel, {"noise": 2.0}, groups=_WIDER_GROUPS).select("road_id", "year", "score"), "score")


def hvi_percent(spark: SparkSession, d: str) -> DataFrame:
    return rounded(b.scored(spark, d).select("road_id", "year", "percent"), "percent")


def _categorised(spark: SparkSession, d: str) -> DataFrame:
    p = b.scored(spark, d)
    return p.withColumn("category", jenks.classify(F.col("percent"), jenks.natural_breaks(p, "percent"), index.CATEGORIES))


def hvi_category(spark: SparkSession, d: str) -> DataFrame:
    return _categorised(spark, d).select("road_id", "year", "category")


def hvi_category_fine(spark: SparkSession, d: str) -> DataFrame:
    """The same categories by the search from coarse to fine, which any number of distinct values goes through."""
    p = b.scored(spark, d)
    breaks = jenks.natural_breaks(p, "percent", most_distinct=0, cells=256)
    return p.withColumn("category", jenks.classify(F.col("percent"), breaks, index.CATEGORIES)).select("road_id", "year", "category")


#: Fixed thresholds for the queries after the breaks, so that their oracles need no natural breaks.
_EDGES = [20.0, 40.0, 60.0, 80.0]


def _stepped(spark: SparkSession, d: str) -> DataFrame:
    return b.scored(spark, d).withColumn("category", jenks.classify(F.col("percent"), [0.0, *_EDGES, 100.0], index.CATEGORIES))


_STEPPED_SQL = f"""{b.scored_sql()},
cat AS (SELECT *, CASE WHEN percent <= 20 THEN 'Düşük' WHEN percent <= 40 THEN 'Orta' WHEN percent <= 60 THEN 'Yüksek'
  WHEN percent <= 80 THEN 'Kritik' ELSE 'Aşırı Kritik' END AS category FROM pct)"""


def percentile_rank(spark: SparkSession, d: str) -> DataFrame:
    o = b.table(spark, d, "orders").select("o_orderkey", F.round("o_totalprice", -3).alias("v"))
    return rounded(ranking.rank_pct(o, "v", "rank_pct").select("o_orderkey", "rank_pct"), "rank_pct", digits=9)


def bucket5_labels(spark: SparkSession, d: str) -> DataFrame:
    o = b.table(spark, d, "orders").select("o_orderkey", F.nullif(F.round("o_totalprice", -3), F.lit(1000.0)).alias("v"))
    pct = ranking.rank_pct(o, "v", "rank_pct")
    return pct.select("o_orderkey", ranking.bucket5(F.round("rank_pct", 9)).alias("level"))


def _area(spark: SparkSession, d: str, by: list[str], panel=_stepped) -> DataFrame:
    t = areas.area_table(panel(spark, d), b.YEARS, by)
    means = [c for c, k in t.dtypes if k == "double"]
    return rounded(rounded(t, *means, digits=9), *means, digits=5)  # a half stays a half whatever the order of the sum


def area_table_nation(spark: SparkSession, d: str, panel=_stepped) -> DataFrame:
    return _area(spark, d, ["neighbourhood", "district"], panel)


def area_table_region(spark: SparkSession, d: str, panel=_stepped) -> DataFrame:
    return _area(spark, d, ["district"], panel)


def _area_sql(by: str) -> str:
    y0, y1 = b.YEARS
    means = ", ".join(
        f"round(avg(percent) FILTER (year = {y}), 5) AS hvi_mean_{y}, "
        f"round(avg(CASE WHEN category IN ('Kritik', 'Aşırı Kritik') THEN 1.0 ELSE 0.0 END) FILTER (year = {y}), 5) AS high_share_{y}, "
        f"round(avg(lst) FILTER (year = {y}), 5) AS lst_mean_{y}, round(avg(ndvi) FILTER (year = {y}), 5) AS ndvi_mean_{y}"
        for y in b.YEARS
    )
    medians = ", ".join(
        f"round(median({c}) FILTER (year = {y1}), 5) AS {c}"
        for c in ("population_density", "elderly_share", "child_share", "development_score")
    )
    return f"""WITH {_STEPPED_SQL},
t AS (SELECT {by}, COUNT(*) FILTER (year = {y1}) AS roads, round(SUM(length_m) FILTER (year = {y1}) / 1000, 5) AS length_km, {means}, {medians},
  avg(percent) FILTER (year = {y1}) AS m1, avg(percent) FILTER (year = {y0}) AS m0 FROM cat GROUP BY {by})
SELECT * EXCLUDE (m0, m1), round(m1 - m0, 5) AS hvi_change, CAST(row_number() OVER (ORDER BY m1 DESC, {by}) AS INT) AS rank,
  roads >= 20 AS reliable FROM t"""


def category_counts_full(spark: SparkSession, d: str, panel=_stepped) -> DataFrame:
    return areas.category_counts(panel(spark, d))


def category_crosstab(spark: SparkSession, d: str, panel=_stepped) -> DataFrame:
    t = areas.crosstab(panel(spark, d), b.YEARS)
    return t.toDF("before", *[f"to_{i}" for i in range(5)])


def priority_topk(spark: SparkSession, d: str, count: int = 100) -> DataFrame:
    p = rounded(b.scored(spark, d), "percent")
    return areas.priority(p, b.YEARS[1], count).select("place", "road_id", "percent")


def top_share_flags(spark: SparkSession, d: str) -> DataFrame:
    c = b.table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return ranking.top_share(c, "c_acctbal", "c_custkey", 0.1, "top").select("c_custkey", "top")


def top_share_per_group(spark: SparkSession, d: str) -> DataFrame:
    s = b.table(spark, d, "supplier")
    clouds = F.coalesce(F.nullif(F.abs(F.col("s_acctbal")), F.lit(0.0)), F.lit(999.0))
    best = areas.best_per_group(s.withColumn("cloud", clouds), "s_nationkey", [F.asc("cloud"), F.asc("s_suppkey")], 3)
    return best.select("s_nationkey", "place", "s_suppkey")


def supported_groups(spark: SparkSession, d: str) -> DataFrame:
    p = b.panel(spark, d).filter(F.col("year") == b.YEARS[1])
    return areas.supported(p, "neighbourhood").select("road_id", "neighbourhood")


def city_rollup(spark: SparkSession, d: str, panel=_stepped) -> DataFrame:
    t = areas.area_table(panel(spark, d), b.YEARS, ["neighbourhood", "district"])
    t = t.withColumn("label", F.concat("neighbourhood", F.lit(" ("), "district", F.lit(")"))).withColumn("city", F.col("district"))
    return areas.city_rollup(t, "city", b.YEARS)


def weighted_means(spark: SparkSession, d: str) -> DataFrame:
    p = b.panel(spark, d).withColumn("lst", F.when(F.col("road_id") % 97 != 0, F.col("lst")))
    w = F.greatest(F.col("length_m"), F.lit(0.001))
    out = p.groupBy("district", "year").agg(
        areas.weighted_mean(F.col("lst"), w).alias("lst_mean"), areas.weighted_mean(F.col("lst"), w, poison=True).alias("lst_strict")
    )
    return rounded(out, "lst_mean", "lst_strict", digits=5)


QUERIES = {
    f.__name__: f
    for f in (
        panel_complete_case, pooled_minmax_risk, year_delta_class, robust_scale, robust_scale_degenerate, inverted_component,
        informative_components, components_norm, group_scores, combine_groups, hvi_score, hvi_score_wider, hvi_percent, hvi_category, hvi_category_fine,
        percentile_rank, bucket5_labels, area_table_nation, area_table_region, category_counts_full, category_crosstab,
        priority_topk, top_share_flags, top_share_per_group, supported_groups, city_rollup, weighted_means,
    )
}
#: The same over the natural breaks.
_BY_CATEGORY = (area_table_nation, area_table_region, category_counts_full, category_crosstab, city_rollup)
QUERIES |= {f"{f.__name__}_jenks": partial(f, panel=_categorised) for f in _BY_CATEGORY}
#: The operator's own length.
QUERIES["priority_top1000"] = partial(priority_topk, count=1000)

_NAMES = [c for g in index.GROUPS.values() for c in g]
_RANK = """r AS (SELECT o_orderkey, v, rank() OVER (ORDER BY v NULLS LAST) AS p, count(*) OVER (PARTITION BY v) AS t, count(v) OVER () AS n FROM x),
k AS (SELECT o_orderkey, CASE WHEN v IS NOT NULL THEN round((p + (t - 1) / 2.0) / n, 9) END AS rank_pct FROM r)"""

#: Optimal split of the distinct values by four levels of a self-join; ties to the smaller start.
_JENKS_SQL = f"""WITH {b.scored_sql()},
v AS (SELECT percent AS x, count(*) AS c, row_number() OVER (ORDER BY percent) AS i FROM pct GROUP BY percent),
m AS (SELECT sum(x * c) / sum(c) AS mu FROM v),
s AS (SELECT i, x, sum(c) OVER (ORDER BY i) AS w, sum(c * (x - mu)) OVER (ORDER BY i) AS s1, sum(c * (x - mu) * (x - mu)) OVER (ORDER BY i) AS s2 FROM v, m),
p AS (SELECT 0 AS i, 0.0 AS w, 0.0 AS s1, 0.0 AS s2 UNION ALL SELECT i, w, s1, s2 FROM s),
d1 AS (SELECT i AS j, s2 - s1 * s1 / w AS cost, 0 AS a FROM p WHERE i > 0),
""" + ",\n".join(
    f"""d{k} AS (SELECT q.i AS j, min(d{k - 1}.cost + q.s2 - p.s2 - (q.s1 - p.s1) * (q.s1 - p.s1) / (q.w - p.w)) AS cost,
  arg_min(p.i, d{k - 1}.cost + q.s2 - p.s2 - (q.s1 - p.s1) * (q.s1 - p.s1) / (q.w - p.w)) AS a
  FROM p JOIN d{k - 1} ON d{k - 1}.j = p.i JOIN p q ON q.i > p.i GROUP BY q.i)"""
    for k in range(2, 6)
) + """,
e AS (SELECT (SELECT max(i) FROM v) AS e5), e4 AS (SELECT a AS e4 FROM d5, e WHERE j = e5), e3 AS (SELECT a AS e3 FROM d4, e4 WHERE j = e4),
e2 AS (SELECT a AS e2 FROM d3, e3 WHERE j = e3), e1 AS (SELECT a AS e1 FROM d2, e2 WHERE j = e2),
z AS (SELECT (SELECT x FROM v, e1 WHERE i = e1) AS b1, (SELECT x FROM v, e2 WHERE i = e2) AS b2,
  (SELECT x FROM v, e3 WHERE i = e3) AS b3, (SELECT x FROM v, e4 WHERE i = e4) AS b4)
SELECT road_id, year, CASE WHEN percent <= b1 THEN 'Düşük' WHEN percent <= b2 THEN 'Orta' WHEN percent <= b3 THEN 'Yüksek'
  WHEN percent <= b4 THEN 'Kritik' ELSE 'Aşırı Kritik' END AS category FROM pct, z"""

SQL = {
    "panel_complete_case": f"WITH {b.complete_sql()} SELECT road_id, year, round(lst, 6) AS lst, round(ndvi, 6) AS ndvi FROM cc",
    "pooled_minmax_risk": f"WITH {b.complete_sql()} SELECT road_id, year, round(risk_score, 6) AS risk_score FROM panel0",
    "year_delta_class": f"""WITH {b.complete_sql()},
w AS (SELECT road_id, round(max(risk_score) FILTER (year = {b.YEARS[1]}) - max(risk_score) FILTER (year = {b.YEARS[0]}), 1) AS delta FROM panel0 GROUP BY 1)
SELECT road_id, delta, CASE WHEN delta <= -100 THEN NULL WHEN delta <= -1 THEN 'Soğudu' WHEN delta <= 1 THEN 'Değişmedi'
  WHEN delta <= 3 THEN 'Hafif Isındı' WHEN delta <= 100 THEN 'Belirgin Isındı' END AS change FROM w""",
    "robust_scale": f"""WITH {b.bounds_sql('l_extendedprice', 'lineitem', 'z').strip()}
SELECT l_orderkey, round(sum({b.scale_sql('l_extendedprice', 'z')}), 6) AS scaled FROM lineitem, z GROUP BY 1""",
    "robust_scale_degenerate": f"""WITH p AS (SELECT p_partkey, 7.0::DOUBLE AS same, CAST(nullif(p_size, 1) AS DOUBLE) AS holes,
  CASE WHEN p_partkey = 1 THEN 1.0::DOUBLE ELSE 0.0 END AS rare FROM part),{b.bounds_sql('same', 'p', 'x')},{b.bounds_sql('holes', 'p', 'y')},{b.bounds_sql('rare', 'p', 'z')}
SELECT p_partkey, CAST({b.scale_sql('same', 'x')} AS DOUBLE) AS same_norm, round({b.scale_sql('holes', 'y')}, 6) AS holes_norm, round({b.scale_sql('rare', 'z')}, 6) AS rare_norm FROM p, x, y, z""",
    "inverted_component": f"""WITH {b.bounds_sql('s_acctbal', 'supplier', 'z').strip()}
SELECT s_suppkey, round(1 - {b.scale_sql('s_acctbal', 'z')}, 6) AS s_acctbal_norm FROM supplier, z""",
    "informative_components": f"WITH {b.ROADS_SQL.strip()}, u AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS component, count(DISTINCT {c}) AS n FROM roads" for c in b.STATIC)
    + ") SELECT component FROM u WHERE n > 1",
    "components_norm": f"WITH {b.components_sql()} SELECT road_id, year, {', '.join(f'round({c}, 6) AS {c}' for c in _NAMES)} FROM comp",
    "group_scores": f"WITH {b.components_sql()},{b.score_sql()} SELECT road_id, year, {', '.join(f'round(raw_{g}, 6) AS raw_{g}' for g in index.GROUPS)} FROM raw",
    "combine_groups": f"WITH {b.components_sql()},{b.score_sql()} SELECT road_id, year, {', '.join(f'round(group_{g}, 6) AS group_{g}' for g in index.GROUPS)} FROM grouped",
    "hvi_score": f"WITH {b.components_sql()},{b.score_sql()} SELECT road_id, year, round(score, 6) AS score FROM scored",
    "hvi_score_wider": f"""WITH {b.components_sql()}, more AS (SELECT DISTINCT road_id, CAST(road_id % 89 AS DOUBLE) AS noise_level, CAST(road_id * 7 % 61 AS DOUBLE) AS canopy FROM panel),
{b.bounds_sql("noise_level", "more", "b_noise")},{b.bounds_sql("canopy", "more", "b_shade")},
wide AS (SELECT comp.*, {b.scale_sql("noise_level", "b_noise")} AS noise, 1 - {b.scale_sql("canopy", "b_shade")} AS shade FROM comp JOIN more USING (road_id), b_noise, b_shade),
{b.score_sql({"noise": 2.0}, "wide", groups={g: list(m) for g, m in _WIDER_GROUPS.items()})} SELECT road_id, year, round(score, 6) AS score FROM scored""",
    "hvi_percent": f"WITH {b.scored_sql()} SELECT road_id, year, round(percent, 6) AS percent FROM pct",
    "hvi_category": _JENKS_SQL,
    "hvi_category_fine": _JENKS_SQL,
    "percentile_rank": f"WITH x AS (SELECT o_orderkey, round(o_totalprice, -3) AS v FROM orders), {_RANK} SELECT o_orderkey, rank_pct FROM k",
    "bucket5_labels": f"""WITH x AS (SELECT o_orderkey, nullif(round(o_totalprice, -3), 1000) AS v FROM orders), {_RANK}
SELECT o_orderkey, CASE WHEN rank_pct IS NULL THEN NULL WHEN rank_pct <= 0.2 THEN 'çok düşük' WHEN rank_pct <= 0.4 THEN 'düşük'
  WHEN rank_pct <= 0.6 THEN 'orta' WHEN rank_pct <= 0.8 THEN 'yüksek' ELSE 'çok yüksek' END AS level FROM k""",
    "area_table_nation": _area_sql("neighbourhood, district"),
    "area_table_region": _area_sql("district"),
    "category_counts_full": f"""WITH {_STEPPED_SQL}, l AS (SELECT * FROM (VALUES (0, 'Düşük'), (1, 'Orta'), (2, 'Yüksek'), (3, 'Kritik'), (4, 'Aşırı Kritik')) t(ordinal, category))
SELECT ordinal, l.category, count(road_id) AS roads, coalesce(sum(length_m), 0.0) AS length_m FROM l LEFT JOIN cat ON l.category = cat.category GROUP BY 1, 2""",
    "category_crosstab": f"""WITH {_STEPPED_SQL}, l AS (SELECT * FROM (VALUES ('Düşük'), ('Orta'), ('Yüksek'), ('Kritik'), ('Aşırı Kritik')) t(before)),
w AS (SELECT road_id, max(category) FILTER (year = {b.YEARS[0]}) AS before, max(category) FILTER (year = {b.YEARS[1]}) AS after FROM cat GROUP BY 1)
SELECT l.before, {', '.join(f"count(*) FILTER (after = '{c}') AS to_{i}" for i, c in enumerate(index.CATEGORIES))} FROM l LEFT JOIN w ON l.before = w.before GROUP BY 1""",
    "priority_topk": f"""WITH {b.scored_sql()}, r AS (SELECT road_id, round(percent, 6) AS percent FROM pct WHERE year = {b.YEARS[1]})
SELECT CAST(row_number() OVER (ORDER BY percent DESC, road_id) AS INT) AS place, road_id, percent FROM r ORDER BY percent DESC, road_id LIMIT 100""",
    "top_share_flags": """SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) <= ceil((SELECT count(*) FROM customer) * 0.1) AS top FROM customer""",
    "top_share_per_group": """SELECT s_nationkey, CAST(p AS INT) AS place, s_suppkey FROM (SELECT s_nationkey, s_suppkey,
  row_number() OVER (PARTITION BY s_nationkey ORDER BY coalesce(nullif(abs(s_acctbal), 0), 999), s_suppkey) AS p FROM supplier) WHERE p <= 3""",
    "supported_groups": f"""WITH {b.panel_sql()}, n AS (SELECT * FROM panel WHERE year = {b.YEARS[1]})
SELECT road_id, neighbourhood FROM n WHERE neighbourhood IN (SELECT neighbourhood FROM n GROUP BY 1 HAVING count(*) >= 20)""",
    "city_rollup": f"""WITH {_STEPPED_SQL},
t AS (SELECT neighbourhood, district, count(*) FILTER (year = {b.YEARS[1]}) AS roads, sum(length_m) FILTER (year = {b.YEARS[1]}) / 1000 AS km,
  avg(percent) FILTER (year = {b.YEARS[1]}) AS m1, avg(lst) FILTER (year = {b.YEARS[0]}) AS l0, avg(lst) FILTER (year = {b.YEARS[1]}) AS l1 FROM cat GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (ORDER BY m1 DESC, neighbourhood, district) AS k, neighbourhood || ' (' || district || ')' AS label FROM t),
g AS (SELECT district AS city, count(*) AS areas, count(DISTINCT district) AS districts, CAST(sum(roads) AS BIGINT) AS roads, round(sum(km), 1) AS length_km,
  round(sum(l1 * km) / sum(km), 3) AS lst_mean, round(round(sum(l1 * km) / sum(km), 3) - round(sum(l0 * km) / sum(km), 3), 3) AS lst_change,
  coalesce(arg_min(label, k) FILTER (roads >= 20), arg_min(label, k)) AS riskiest FROM r GROUP BY 1)
SELECT *, districts = 1 AS single_district FROM g""",
    "weighted_means": f"""WITH {b.panel_sql()}, q AS (SELECT district, year, greatest(length_m, 0.001) AS w, CASE WHEN road_id % 97 = 0 THEN NULL ELSE lst END AS v FROM panel)
SELECT district, year, round(sum(v * w) / sum(w) FILTER (v IS NOT NULL), 5) AS lst_mean,
  CASE WHEN count(*) = count(v) THEN round(sum(v * w) / sum(w), 5) END AS lst_strict FROM q GROUP BY 1, 2""",
}
SQL["priority_top1000"] = SQL["priority_topk"].replace("LIMIT 100", "LIMIT 1000")
_LAST = "SELECT road_id, year, CASE"
_JENKS_CAT = _JENKS_SQL.removeprefix("WITH ").replace(f")\n{_LAST}", "),\ncat AS (SELECT pct.*, CASE") + ")"
SQL |= {f"{f.__name__}_jenks": SQL[f.__name__].replace(_STEPPED_SQL, _JENKS_CAT) for f in _BY_CATEGORY}
