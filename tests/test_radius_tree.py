"""Counts within a radius by tiles against all pairs: crowds, equal places, borders, missing and infinite coordinates."""

import numpy as np
import pytest

from kerbside.operators import radius_tree, spatial
from kerbside.scratch import Scratch


def places(spark, rows, n=False):
    return spark.createDataFrame([tuple(map(float, r[:2])) + ((int(r[2]),) if n else ()) for r in rows], "x double, y double" + (", n long" if n else "")).repartition(3)


@pytest.mark.parametrize("asking", [50_000, 40])
@pytest.mark.parametrize("radius", [0.0, 7.0, 900.0, 90_000.0])
def test_crowds_and_deserts(spark, monkeypatch, asking, radius):
    monkeypatch.setattr(radius_tree, "ASKING", asking)
    rng = np.random.default_rng(8)
    held = np.unique(np.concatenate([rng.normal(0, 5, (1500, 2)), rng.uniform(-9000, 9000, (300, 2)), rng.integers(-20, 20, (400, 2))]), axis=0)
    n = rng.integers(1, 9, len(held))
    points = np.unique(np.concatenate([rng.normal(0, 6, (200, 2)), rng.uniform(-9000, 9000, (100, 2)), rng.integers(-20, 20, (100, 2))]), axis=0)
    want = ((np.hypot(points[:, None, 0] - held[None, :, 0], points[:, None, 1] - held[None, :, 1]) <= radius) * n).sum(axis=1)
    out = radius_tree.count_within(places(spark, points), places(spark, np.column_stack([held, n]), n=True), radius, Scratch(spark, "radius"), 60)
    got = {(r["x"], r["y"]): r["n"] for r in out.collect()}
    assert [got.get((x, y), 0) for x, y in points] == want.tolist() and 0 not in got.values()


def test_borders_equal_places_and_odd_rows(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0, "a"), (2, 0.0, 0.0, "b"), (None, 3.0, 4.0, "c"), (4, None, 0.0, "d"), (5, float("inf"), 0.0, "e"), (6, 99.0, float("nan"), "f"), (7, 50.0, -0.0, "g")], "k int, x double, y double, s string")
    right = spark.createDataFrame([(3.0, 4.0)] * 3 + [(0.0, -5.0), (0.0, -5.000001), (55.0, 0.0), (None, 0.0), (float("inf"), 0.0), (float("nan"), 0.0)], "x double, y double")
    out = spatial.radius_count(left, right, "k", 5.0, "near")
    assert out.columns == ["k", "x", "y", "s", "near"]
    assert {r["s"]: r["near"] for r in out.collect()} == {"a": 4, "b": 4, "c": 3, "d": 0, "e": 0, "f": 0, "g": 1}
    assert {r["near"] for r in spatial.radius_count(left, right.limit(0), "k", 5.0, "near").collect()} == {0}
    assert spatial.radius_count(left.limit(0), right, "k", 5.0, "near").count() == 0
    whole = spatial.radius_count(left.filter("k < 3").selectExpr("s", "cast(x as int) x", "cast(y as int) y"), right, "s", 5.0, "near")
    assert [r["near"] for r in whole.collect()] == [4, 4]
