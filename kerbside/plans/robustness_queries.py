"""Queries of weight profiles, scenarios, decomposition and Monte Carlo runs."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.operators import correlation, montecarlo, robustness
from kerbside.operators.index import GROUPS, RAW, score
from kerbside.plans import bindings as b
from kerbside.plans.index_queries import rounded
from kerbside.scratch import Scratch

RUNS, SEED = 12, 42
#: The operators' own sizes, for the queries whose names end in ``_500``.
FULL_RUNS, FULL_MOVERS = 500, 500
#: Bins of a continuous decision.
BINS = 10
Y = b.YEARS[1]


def weight_profiles(spark: SparkSession, d: str) -> DataFrame:
    p = b.component_panel(spark, d)
    out = None
    for name, w in robustness.PROFILES.items():
        one = score(p, w).select("road_id", "year", F.lit(name).alias("profile"), F.round("score", 6).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out.filter(F.col("year") == Y)


def profile_weights(spark: SparkSession, d: str) -> DataFrame:
    parts = [c for g in GROUPS.values() for c in g]
    rows = [(n, c, round(w, 9)) for n, p in robustness.PROFILES.items() for c, w in robustness.normalised_weights(p, parts).items()]
    return spark.createDataFrame(rows, "profile string, component string, weight double")


def robustness_overlap(spark: SparkSession, d: str) -> DataFrame:
    p = b.component_panel(spark, d)
    scratch = Scratch(spark, "agreement")
    in_year = lambda df: scratch.table(df.filter(F.col("year") == Y).select("road_id", F.round("score", 8).alias("score")), "scores")
    base, out = in_year(score(p)), None
    for name, w in robustness.PROFILES.items():
        one = robustness.agreement(base, in_year(score(p, w))).withColumn("profile", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return rounded(out, "spearman", "overlap", "median_change", "moved_share")


def rank_movers(spark: SparkSession, d: str, count: int = 50) -> DataFrame:
    p = b.component_panel(spark, d)
    scratch = Scratch(spark, "movers")
    in_year = lambda df: scratch.table(df.filter(F.col("year") == Y).select("road_id", F.round("score", 8).alias("score")), "scores")
    return robustness.biggest_movers(in_year(score(p)), in_year(score(p, robustness.PROFILES["equity_priority"])), count=count)


def scenario_delta(spark: SparkSession, d: str) -> DataFrame:
    p = b.component_panel(spark, d).filter(F.col("year") == Y)
    s = robustness.scenario(p, cooling=20000.0, greening=0.02)
    delta = F.col("after") - F.col("base")
    return rounded(s.select("road_id", "target", F.col("base"), delta.alias("delta")), "base", "delta")


def scenario_summary(spark: SparkSession, d: str) -> DataFrame:
    p = b.component_panel(spark, d).filter(F.col("year") == Y)
    s = robustness.scenario(p, cooling=20000.0, greening=0.02)
    cut = s.agg(F.percentile("elderly_share", F.lit(0.8)).alias("cut"))
    t = F.col("target")
    out = s.crossJoin(F.broadcast(cut)).agg(  # one row
        F.count(F.when(t, 1)).alias("targets"),
        F.avg(F.when(t, (F.col("elderly_share") >= F.col("cut")).cast("double"))).alias("elderly_top_share"),
        F.avg(F.when(t, F.col("after") - F.col("base"))).alias("target_delta"),
        F.avg(F.when(~t, F.col("after") - F.col("base"))).alias("other_delta"),
    )
    return rounded(out, "elderly_top_share", "target_delta", "other_delta")


def shapley(spark: SparkSession, d: str) -> DataFrame:
    return rounded(robustness.shapley(b.component_panel(spark, d), b.YEARS), "total", "heat", "vegetation")


def _runs(spark: SparkSession, d: str, runs: int) -> montecarlo.Runs:
    return montecarlo.simulate(b.component_panel(spark, d), montecarlo.draws(runs, SEED), Scratch(spark, "runs"))


def mc_scores(spark: SparkSession, d: str, runs: int = RUNS) -> DataFrame:
    return rounded(montecarlo.scores(_runs(spark, d, runs), Y).drop("year"), "score")


def mc_rank_quantiles(spark: SparkSession, d: str, runs: int = RUNS) -> DataFrame:
    all_ = _runs(spark, d, runs)
    u = montecarlo.road_uncertainty(montecarlo.run_ranks(all_, Y), all_).drop("base")
    return rounded(u, "q05", "q50", "q95", "top10", "top20")


def mc_area_ranks(spark: SparkSession, d: str, runs: int = RUNS) -> DataFrame:
    panel, scratch = b.component_panel(spark, d), Scratch(spark, "runs")
    areas = panel.filter(F.col("year") == Y).select("road_id", F.col("neighbourhood").alias("area"))
    all_ = montecarlo.simulate(panel, montecarlo.draws(runs, SEED), scratch)
    return rounded(montecarlo.area_uncertainty(montecarlo.scores(all_, Y), areas), "median_rank", "p_first5", "p_first20")


def mc_run_outputs(spark: SparkSession, d: str, runs: int = RUNS) -> DataFrame:
    all_ = _runs(spark, d, runs)
    return rounded(montecarlo.run_outputs(montecarlo.run_ranks(all_, Y), all_), "spearman", "overlap")


def mc_stable_top(spark: SparkSession, d: str, runs: int = RUNS) -> DataFrame:
    all_ = _runs(spark, d, runs)
    return rounded(montecarlo.stable_top(montecarlo.road_uncertainty(montecarlo.run_ranks(all_, Y), all_)), "share")


def mc_default_check(spark: SparkSession, d: str, runs: int = RUNS) -> DataFrame:
    """Run 0 against the published score."""
    panel, scratch = b.component_panel(spark, d), Scratch(spark, "runs")
    all_ = montecarlo.simulate(panel, montecarlo.draws(runs, SEED), scratch)
    ours = montecarlo.scores(all_, Y).filter("run = 0").select("road_id", F.col("score").alias("run0"))
    theirs = score(panel).filter(F.col("year") == Y).select("road_id", F.col("score").alias("published"))
    return rounded(ours.join(theirs, "road_id").agg(F.count("*").alias("n"), F.corr("run0", "published").alias("r")), "r")


def first_order_indices(spark: SparkSession, d: str) -> DataFrame:
    o = b.table(spark, d, "orders").select(
        "o_orderpriority", F.col("o_custkey").cast("double").alias("key"), F.col("o_totalprice").alias("price"), (F.col("o_orderkey") % 97).cast("double").alias("other")
    )
    a = correlation.first_order(o, "o_orderpriority", ["price", "other"])
    c = correlation.first_order(o, "key", ["price", "other"], bins=10)
    return rounded(a.unionByName(c), "s")


def _factors(runs: int) -> dict[str, int | None]:
    """Each decision that differs between runs, and the bins of those with more values than bins, run 0 left out."""
    rows = montecarlo.factor_table(montecarlo.draws(runs, SEED))
    many = lambda f: not isinstance(rows[1][f], str) and len({r[f] for r in rows[1:]}) > BINS
    return {f: BINS if many(f) else None for f in rows[0] if f != "run"}


def mc_first_order_500(spark: SparkSession, d: str) -> DataFrame:
    """Which decision drives the spread: first-order indices of the decisions against the run outputs."""
    table = montecarlo.draw_table(spark, montecarlo.draws(FULL_RUNS, SEED)).fillna("none", ["excluded"])
    found = mc_run_outputs(spark, d, FULL_RUNS).join(F.broadcast(table), "run")
    runs = spark.createDataFrame(found.collect(), found.schema).coalesce(1)  # one row a run
    out = None
    for f, bins in _factors(FULL_RUNS).items():
        one = correlation.first_order(runs, f, ["spearman", "overlap"], bins)
        out = one if out is None else out.unionByName(one)
    return rounded(out, "s")


QUERIES = {
    f.__name__: f
    for f in (
        weight_profiles, profile_weights, robustness_overlap, rank_movers, scenario_delta, scenario_summary, shapley, mc_scores,
        mc_rank_quantiles, mc_area_ranks, mc_run_outputs, mc_stable_top, mc_default_check, first_order_indices,
    )
}

_FULL = (mc_scores, mc_rank_quantiles, mc_area_ranks, mc_run_outputs, mc_stable_top, mc_default_check)
QUERIES |= {f"{f.__name__}_500": partial(f, runs=FULL_RUNS) for f in _FULL}
QUERIES["mc_first_order_500"] = mc_first_order_500
QUERIES["rank_movers_500"] = partial(rank_movers, count=FULL_MOVERS)

# ---- oracles ----

_PARTS = [c for g in GROUPS.values() for c in g]


def _rank(x: str, part: str = "") -> str:
    p = f"PARTITION BY {part}" if part else ""
    also = f"{part}, {x}" if part else x
    return f"((rank() OVER ({p} ORDER BY {x}) + (count(*) OVER (PARTITION BY {also}) - 1) / 2.0) / count(*) OVER ({p}))"


def _profiles_sql(columns: str) -> str:
    parts = [b.components_sql()]
    for n, w in robustness.PROFILES.items():
        parts.append(b.score_sql(w, tag=f"_{n}"))
    return ",".join(parts)


def _fixed_sql(hazard: str, trees: str, source: str, bounds: str = "gb") -> str:
    """The score of a row of ``source`` with other hazard and trees columns, under the bounds in ``gb``."""
    logs = []
    for g, members in b._GROUPS.items():
        names = {"hazard": hazard, "trees": trees}
        raw = "(" + " + ".join(names.get(c, c) for c in members) + f") / {float(len(members))!r}"
        logs.append(f"ln(0.05 + 0.95 * {b.scale_sql(raw, f'g_{g}{bounds}')})")
    return f"(exp(({' + '.join(logs)}) / 3.0) * 100)"


_GB = ", ".join(f"g_{g}gb" for g in b._GROUPS)


def _draw_values(runs: int = RUNS) -> str:
    rows = []
    for r in montecarlo.draws(runs, SEED):
        cells = [str(r["run"]), f"'{r['normalization']}'", f"'{r['aggregation']}'", f"{r['floor']!r}::DOUBLE", f"'{r['excluded'] or 'none'}'"]
        cells += [f"{r[f'g_{g}']!r}::DOUBLE" for g in GROUPS] + [f"{r[f'w_{c}']!r}::DOUBLE" for c in _PARTS]
        rows.append("(" + ", ".join(cells) + ")")
    names = ["run", "normalization", "aggregation", "floor", "excluded", *[f"gw_{g}" for g in GROUPS], *[f"w_{c}" for c in _PARTS]]
    return f"draws AS (SELECT * FROM (VALUES {', '.join(rows)}) t({', '.join(names)}))"


def _mc_sql() -> str:
    """``mc``: run, road_id, year, score."""
    minmax, ranked = [], []
    for c in _PARTS:
        raw, less = RAW[c]
        share = f"({raw} - mn_{c}) / (mx_{c} - mn_{c})"
        minmax.append(f"CASE WHEN mn_{c} = mx_{c} THEN 0.0 ELSE {f'1 - {share}' if less else share} END AS {c}")
        ranked.append(f"{_rank(f'-{raw}' if less else raw)} AS {c}")
    ends = ", ".join(f"min({RAW[c][0]}) AS mn_{c}, max({RAW[c][0]}) AS mx_{c}" for c in _PARTS)
    sums, scaled, bounds, logs, plain = [], [], [], [], []
    for g, members in b._GROUPS.items():
        w = {c: f"(CASE WHEN excluded = '{c}' THEN 0.0 ELSE w_{c} END)" for c in members}
        sums.append(f"({' + '.join(f'{w[c]} * {c}' for c in members)}) / ({' + '.join(w[c] for c in members)}) AS s_{g}")
        bounds.append(
            f"CASE WHEN quantile_cont(s_{g}, 0.02) = quantile_cont(s_{g}, 0.98) THEN min(s_{g}) ELSE quantile_cont(s_{g}, 0.02) END AS lo_{g}, "
            f"CASE WHEN quantile_cont(s_{g}, 0.02) = quantile_cont(s_{g}, 0.98) THEN max(s_{g}) ELSE quantile_cont(s_{g}, 0.98) END AS hi_{g}"
        )
        scaled.append(f"CASE WHEN lo_{g} = hi_{g} THEN 0.0 ELSE greatest(0.0, least(1.0, (s_{g} - lo_{g}) / (hi_{g} - lo_{g}))) END AS x_{g}")
        logs.append(f"gw_{g} * ln(floor + (1 - floor) * x_{g})")
        plain.append(f"gw_{g} * x_{g}")
    total = " + ".join(f"gw_{g}" for g in b._GROUPS)
    return f"""{b.components_sql()},
cube AS (SELECT road_id, year, 'robust' AS normalization, {', '.join(_PARTS)} FROM comp
  UNION ALL SELECT road_id, year, 'minmax', {', '.join(minmax)} FROM comp, (SELECT {ends} FROM comp)
  UNION ALL SELECT road_id, year, 'rank', {', '.join(ranked)} FROM comp),
{_draw_values()},
mraw AS (SELECT run, road_id, year, aggregation, floor, {', '.join(sums)}, {', '.join(f'gw_{g}' for g in b._GROUPS)} FROM cube JOIN draws USING (normalization)),
mb AS (SELECT run, {', '.join(bounds)} FROM mraw GROUP BY 1),
ms AS (SELECT mraw.*, {', '.join(scaled)} FROM mraw JOIN mb USING (run)),
mc AS (SELECT run, road_id, year, CASE WHEN aggregation = 'geometric' THEN exp(({' + '.join(logs)}) / ({total})) * 100 ELSE ({' + '.join(plain)}) / ({total}) * 100 END AS score FROM ms)"""


_RANKS = f"""{_mc_sql()}, m8 AS (SELECT run, road_id, round(score, 8) AS score FROM mc WHERE year = {Y}),
ranks AS (SELECT run, road_id, {_rank('score', 'run')} AS pct FROM m8)"""
_UNC = f"""{_RANKS}, unc AS (SELECT road_id, quantile_cont(pct, 0.05) AS q05, quantile_cont(pct, 0.5) AS q50, quantile_cont(pct, 0.95) AS q95,
  avg(CASE WHEN pct > 0.9 THEN 1.0 ELSE 0.0 END) AS top10, avg(CASE WHEN pct > 0.8 THEN 1.0 ELSE 0.0 END) AS top20 FROM ranks GROUP BY 1)"""


def _agree_sql() -> str:
    parts = []
    for n in robustness.PROFILES:
        parts.append(
            f"""SELECT '{n}' AS profile, count(*) AS n, round(corr(ra, rb), 6) AS spearman,
  round(100.0 * count(*) FILTER (ra > 0.9 AND rb > 0.9) / greatest(count(*) FILTER (ra > 0.9), 1), 6) AS overlap,
  round(median(abs(rb - ra) * 100), 6) AS median_change, round(100 * avg(CASE WHEN abs(rb - ra) * 100 > 20 THEN 1.0 ELSE 0.0 END), 6) AS moved_share
FROM (SELECT road_id, {_rank('score')} AS ra FROM (SELECT road_id, round(score, 8) AS score FROM scored_equal WHERE year = {Y}))
JOIN (SELECT road_id, {_rank('score')} AS rb FROM (SELECT road_id, round(score, 8) AS score FROM scored_{n} WHERE year = {Y})) USING (road_id)"""
        )
    return f"WITH {_profiles_sql('')} " + " UNION ALL ".join(parts)


def _scenario_cte() -> str:
    lst1 = "(CASE WHEN target THEN lst - 20000.0 ELSE lst END)"
    ndvi1 = "(CASE WHEN target THEN greatest(n0, least(n1, ndvi + 0.02)) ELSE ndvi END)"
    h = lambda x: f"(CASE WHEN l0 = l1 THEN 0.0 ELSE greatest(0.0, least(1.0, ({x} - l0) / (l1 - l0))) END)"
    t = lambda x: f"(1 - CASE WHEN n0 = n1 THEN 0.0 ELSE greatest(0.0, least(1.0, ({x} - n0) / (n1 - n0))) END)"
    raws = ", ".join("(" + " + ".join({"hazard": "h0", "trees": "t0"}.get(c, c) for c in m) + f") / {float(len(m))!r} AS raw_{g}" for g, m in b._GROUPS.items())
    bounds = ",".join(b.bounds_sql(f"raw_{g}", "sraw", f"g_{g}gb") for g in b._GROUPS)
    return f"""{b.components_sql()},
sy AS (SELECT *, row_number() OVER (ORDER BY population_density DESC, road_id) <= ceil((SELECT count(*) FROM comp WHERE year = {Y}) * 0.2) AS target FROM comp WHERE year = {Y}),
se AS (SELECT min(lst) AS l0, max(lst) AS l1, min(ndvi) AS n0, max(ndvi) AS n1 FROM sy),
s0 AS (SELECT sy.*, {h('lst')} AS h0, {t('ndvi')} AS t0, {h(lst1)} AS h1, {t(ndvi1)} AS t1 FROM sy, se),
sraw AS (SELECT {raws} FROM s0),{bounds},
sc AS (SELECT road_id, target, elderly_share, {_fixed_sql('h0', 't0', 's0')} AS base, {_fixed_sql('h1', 't1', 's0')} AS after FROM s0, {_GB})"""


def _shapley_sql() -> str:
    static = [c for c in _PARTS if c not in ("hazard", "trees")]
    y0, y1 = b.YEARS
    wide = ", ".join(f"max({c}) FILTER (year = {y}) AS {c}_{y}" for c in ("hazard", "trees") for y in (y0, y1))
    raws = ", ".join("(" + " + ".join(m) + f") / {float(len(m))!r} AS raw_{g}" for g, m in b._GROUPS.items())
    bounds = ",".join(b.bounds_sql(f"raw_{g}", "hraw", f"g_{g}gb") for g in b._GROUPS)
    s = lambda p, q: _fixed_sql(f"hazard_{p}", f"trees_{q}", "hw")
    return f"""WITH {b.components_sql()}, hraw AS (SELECT {raws} FROM comp),{bounds},
hw AS (SELECT road_id, {wide}, {', '.join(f'max({c}) AS {c}' for c in static)} FROM comp GROUP BY 1),
hs AS (SELECT road_id, {s(y0, y0)} AS s00, {s(y1, y0)} AS s10, {s(y0, y1)} AS s01, {s(y1, y1)} AS s11 FROM hw, {_GB})
SELECT road_id, round(s11 - s00, 6) AS total, round(((s10 - s00) + (s11 - s01)) / 2, 6) AS heat, round((s11 - s00) - ((s10 - s00) + (s11 - s01)) / 2, 6) AS vegetation FROM hs"""


def _first_order_sql() -> str:
    cell = lambda f, key, y: f"""SELECT '{f}' AS factor, '{y}' AS output, (sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n)) / max(v) AS s FROM (
  SELECT {key} AS k, count(*) AS n, avg({y}) AS m, (SELECT var_pop({y}) * count({y}) FROM o) AS v FROM o GROUP BY 1)"""  # noqa: E731
    bins = " + ".join(f"CASE WHEN key > (SELECT quantile_cont(key, {i / 10}) FROM o) THEN 1 ELSE 0 END" for i in range(1, 10))
    parts = [cell("o_orderpriority", "o_orderpriority", y) for y in ("price", "other")] + [cell("key", f"({bins})", y) for y in ("price", "other")]
    return f"""WITH o AS (SELECT o_orderpriority, CAST(o_custkey AS DOUBLE) AS key, o_totalprice AS price, CAST(o_orderkey % 97 AS DOUBLE) AS other FROM orders),
u AS ({' UNION ALL '.join(parts)}) SELECT factor, output, round(s, 6) AS s FROM u"""


def _weights_sql() -> str:
    rows = []
    for n, p in robustness.PROFILES.items():
        total = " + ".join(repr(p.get(c, 1.0)) for c in _PARTS)
        rows += [f"('{n}', '{c}', round({p.get(c, 1.0)!r}::DOUBLE / ({total}), 9))" for c in _PARTS]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) t(profile, component, weight)"


SQL = {
    "weight_profiles": f"WITH {_profiles_sql('')} "
    + " UNION ALL ".join(f"SELECT road_id, year, '{n}' AS profile, round(score, 6) AS score FROM scored_{n} WHERE year = {Y}" for n in robustness.PROFILES),
    "profile_weights": _weights_sql(),
    "robustness_overlap": _agree_sql(),
    "rank_movers": f"""WITH {_profiles_sql('')},
a AS (SELECT road_id, {_rank('score')} AS ra FROM (SELECT road_id, round(score, 8) AS score FROM scored_equal WHERE year = {Y})),
z AS (SELECT road_id, {_rank('score')} AS rb FROM (SELECT road_id, round(score, 8) AS score FROM scored_equity_priority WHERE year = {Y})),
m AS (SELECT road_id, round((rb - ra) * 100, 6) AS change FROM a JOIN z USING (road_id)) SELECT road_id, change FROM m ORDER BY abs(change) DESC, road_id LIMIT 50""",
    "scenario_delta": f"WITH {_scenario_cte()} SELECT road_id, target, round(base, 6) AS base, round(after - base, 6) AS delta FROM sc",
    "scenario_summary": f"""WITH {_scenario_cte()} SELECT count(*) FILTER (target) AS targets,
  round(avg(CASE WHEN elderly_share >= (SELECT quantile_cont(elderly_share, 0.8) FROM sc) THEN 1.0 ELSE 0.0 END) FILTER (target), 6) AS elderly_top_share,
  round(avg(after - base) FILTER (target), 6) AS target_delta, round(avg(after - base) FILTER (NOT target), 6) AS other_delta FROM sc""",
    "shapley": _shapley_sql(),
    "mc_scores": f"WITH {_mc_sql()} SELECT run, road_id, round(score, 6) AS score FROM mc WHERE year = {Y}",
    "mc_rank_quantiles": f"WITH {_UNC} SELECT road_id, round(q05, 6) AS q05, round(q50, 6) AS q50, round(q95, 6) AS q95, round(top10, 6) AS top10, round(top20, 6) AS top20 FROM unc",
    "mc_area_ranks": f"""WITH {_mc_sql()}, ar AS (SELECT road_id, neighbourhood AS area FROM comp WHERE year = {Y}),
big AS (SELECT area FROM ar GROUP BY 1 HAVING count(*) >= 20),
mm AS (SELECT run, area, round(avg(score), 8) AS mean FROM mc JOIN ar USING (road_id) JOIN big USING (area) WHERE year = {Y} GROUP BY 1, 2),
pl AS (SELECT run, area, rank() OVER (PARTITION BY run ORDER BY mean DESC) AS place FROM mm)
SELECT area, round(median(place), 6) AS median_rank, round(avg(CASE WHEN place <= 5 THEN 1.0 ELSE 0.0 END), 6) AS p_first5, round(avg(CASE WHEN place <= 20 THEN 1.0 ELSE 0.0 END), 6) AS p_first20 FROM pl GROUP BY 1""",
    "mc_run_outputs": f"""WITH {_RANKS}, z AS (SELECT road_id, pct AS base FROM ranks WHERE run = 0)
SELECT run, round(corr(base, pct), 6) AS spearman, round(count(*) FILTER (base > 0.9 AND pct > 0.9) * 1.0 / greatest(count(*) FILTER (base > 0.9), 1), 6) AS overlap
FROM ranks JOIN z USING (road_id) WHERE run > 0 GROUP BY 1""",
    "mc_stable_top": f"""WITH {_UNC}, t AS (SELECT road_id FROM ranks WHERE run = 0 AND pct > 0.9)
SELECT count(*) AS top, count(*) FILTER (top10 >= 0.9) AS stable, round(count(*) FILTER (top10 >= 0.9) * 1.0 / greatest(count(*), 1), 6) AS share FROM t JOIN unc USING (road_id)""",
    "mc_default_check": f"""WITH {_mc_sql()},{b.score_sql(tag='_p')} SELECT count(*) AS n, round(corr(mc.score, scored_p.score), 6) AS r
FROM mc JOIN scored_p ON mc.road_id = scored_p.road_id AND mc.year = scored_p.year WHERE mc.run = 0 AND mc.year = {Y}""",
    "first_order_indices": _first_order_sql(),
}
SQL |= {f"{f.__name__}_500": SQL[f.__name__].replace(_draw_values(), _draw_values(FULL_RUNS)) for f in _FULL}
SQL["rank_movers_500"] = SQL["rank_movers"].replace("LIMIT 50", f"LIMIT {FULL_MOVERS}")


def _decisions_sql() -> str:
    parts = []
    for f, bins in _factors(FULL_RUNS).items():
        name = f"gw_{f.removeprefix('g_')}" if f.startswith("g_") else f
        key = "(" + " + ".join(f"CASE WHEN {name} > (SELECT quantile_cont({name}, {i / bins}) FROM o) THEN 1 ELSE 0 END" for i in range(1, bins)) + ")" if bins else name
        for y in ("spearman", "overlap"):
            parts.append(
                f"""SELECT '{f}' AS factor, '{y}' AS output, CASE WHEN max(v) = 0 THEN 0.0 ELSE sum(n * (m - a) * (m - a)) / max(v) END AS s FROM (
  SELECT CAST({key} AS VARCHAR) AS k, count(*) AS n, avg({y}) AS m, (SELECT avg({y}) FROM o) AS a, (SELECT var_pop({y}) * count({y}) FROM o) AS v FROM o GROUP BY 1)"""
            )
    return f"""WITH outputs AS ({SQL['mc_run_outputs_500']}), {_draw_values(FULL_RUNS)}, o AS MATERIALIZED (SELECT * FROM outputs JOIN draws USING (run)),
u AS ({' UNION ALL '.join(parts)}) SELECT factor, output, round(s, 6) AS s FROM u"""


SQL["mc_first_order_500"] = _decisions_sql()
