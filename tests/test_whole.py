"""Queries at the operators' own sizes, against brute force over the rows they are made from."""

import collections

import numpy as np
import oracle
import pytest

from kerbside.operators import montecarlo
from kerbside.plans import QUERIES

SMALL = f"{oracle.DATA}/sf0.001"


def test_monte_carlo_makes_the_operators_own_runs(spark):
    scores = collections.defaultdict(dict)
    for r in QUERIES["mc_scores_500"](spark, SMALL).collect():
        scores[r["run"]][r["road_id"]] = r["score"]
    assert set(scores) == {r["run"] for r in montecarlo.draws()} and len(scores) == 500
    ranks = collections.defaultdict(list)
    for one in scores.values():
        v = np.array(list(one.values()))
        for road, x in one.items():
            ranks[road].append(((v < x).sum() + ((v == x).sum() + 1) / 2) / len(v))
    got = {r["road_id"]: r for r in QUERIES["mc_rank_quantiles_500"](spark, SMALL).collect()}
    assert set(got) == set(ranks)
    # scores are rounded here, so two that differ in the seventh digit may tie
    near = 2 / len(ranks)
    for road, pct in ranks.items():
        assert [got[road][q] for q in ("q05", "q50", "q95")] == pytest.approx(np.quantile(pct, [0.05, 0.5, 0.95]), abs=near)
        assert got[road]["top20"] == pytest.approx((np.array(pct) > 0.8).mean(), abs=0.01)
    steps = {round(r["top20"] * 500, 3) for r in got.values()}
    assert all(x == int(x) for x in steps) and any(round(x / 500 * 12, 6) % 1 for x in steps)


def test_categories_are_those_of_the_natural_breaks(spark):
    by_road = collections.defaultdict(dict)
    for r in QUERIES["hvi_category"](spark, SMALL).collect():
        by_road[r["road_id"]][r["year"]] = r["category"]
    names = {r["ordinal"]: r["category"] for r in QUERIES["category_counts_full_jenks"](spark, SMALL).collect()}
    counts = {r["category"]: r["roads"] for r in QUERIES["category_counts_full_jenks"](spark, SMALL).collect()}
    want = collections.Counter(c for years in by_road.values() for c in years.values())
    assert counts == {c: want[c] for c in names.values()}
    assert counts != {r["category"]: r["roads"] for r in QUERIES["category_counts_full"](spark, SMALL).collect()}
    moves = collections.Counter((years[1996], years[2000]) for years in by_road.values())
    got = {r["before"]: r for r in QUERIES["category_crosstab_jenks"](spark, SMALL).collect()}
    assert all(got[a][f"to_{i}"] == moves[a, c] for a in names.values() for i, c in names.items())


def test_first_order_is_of_the_decisions():
    rows = montecarlo.factor_table(montecarlo.draws(50))
    assert {"normalization", "aggregation", "floor", "excluded", "g_hazard", "w_trees"} < set(rows[0])
    assert "w_hazard" not in rows[0]  # the only member of its group: 1 in every run
    assert "mc_first_order_500" in QUERIES
