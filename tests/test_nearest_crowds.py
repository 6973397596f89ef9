"""Nearest searches from a first radius that holds a crowd: rings are for few pairs, the rest goes by tiles."""

import numpy as np
import pytest

from kerbside.operators import nearest_tree, spatial
from kerbside.scratch import Scratch


def tables(spark, points, places):
    left = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "k int, x double, y double")
    return left, spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(places)], "t int, x double, y double")


def agrees(got, points, places):
    d = np.hypot(points[:, None, 0] - places[None, :, 0], points[:, None, 1] - places[None, :, 1])
    found = {r["k"]: (r["t"], r["d"]) for r in got.collect()}
    assert len(found) == len(points)
    for k, (t, best) in found.items():
        assert best == pytest.approx(d[k].min(), abs=1e-9) and t == int(d[k].argmin())


def looked_at(monkeypatch):
    """The radii of the rings that are joined."""
    radii, join = [], spatial.edge_join
    monkeypatch.setattr(spatial, "edge_join", lambda points, edges, radius, columns: radii.append(radius) or join(points, edges, radius, columns))
    return radii


def test_a_crowded_first_ring_goes_by_tiles(spark, monkeypatch):
    radii, rng = looked_at(monkeypatch), np.random.default_rng(4)
    points, places = rng.integers(0, 40, (900, 2)).astype(float), rng.permutation(1600)[:600]
    places = np.column_stack([places // 40, places % 40]) + 0.25
    left, right = tables(spark, points, places)
    agrees(spatial.nearest(left, right, "k", "t", 50.0), points, places)
    assert radii == []


def test_rings_until_they_are_crowded(spark, monkeypatch):
    radii, rng = looked_at(monkeypatch), np.random.default_rng(5)
    far = rng.uniform(0, 100_000, (300, 2))
    points = np.concatenate([far, rng.uniform(700, 710, (300, 2))])
    places = np.concatenate([far + 1, rng.uniform(0, 1, (2000, 2)) + 900])
    places[:150] = places[-150:] + 0.5
    left, right = tables(spark, points, places)
    agrees(spatial.nearest(left, right, "k", "t", 2.0), points, places)
    assert radii and max(radii) < 100_000


def test_thin_rings_stay_and_equal_places_are_searched_once(spark, monkeypatch):
    radii, rng = looked_at(monkeypatch), np.random.default_rng(6)
    points, places = rng.uniform(0, 1000, (60, 2)), rng.uniform(0, 1000, (50, 2))
    left, right = tables(spark, points, places)
    agrees(spatial.nearest(left, right, "k", "t", 60.0), points, places)
    assert radii
    many = np.repeat(points[:7], 50, axis=0)
    agrees(spatial.nearest(tables(spark, many, places)[0], right, "k", "t"), many, places)


@pytest.mark.parametrize("most_tiles", [32_768, 5])
def test_groups_are_searched_together(spark, monkeypatch, most_tiles):
    monkeypatch.setattr(nearest_tree, "MOST_TILES", most_tiles)
    monkeypatch.setattr(nearest_tree, "ASKING", 90)
    rng = np.random.default_rng(7)
    points = np.unique(np.concatenate([rng.normal(0, 5, (200, 2)), rng.uniform(-9000, 9000, (150, 2))]), axis=0)
    sets = {0: rng.normal(0, 5, (500, 2)), 1: rng.uniform(-9000, 9000, (40, 2)), 3: np.array([[7000.0, 7000.0]])}
    rows = [(g, i, *map(float, [*p, *(p + 0.5 * (g == 0))])) for g, v in sets.items() for i, p in enumerate(v)]
    pieces = spark.createDataFrame(rows, "grp int, t int, px double, py double, qx double, qy double").repartition(3)
    places = spark.createDataFrame(points.tolist(), "x double, y double").repartition(3)
    out = nearest_tree.nearest_of_groups(places, pieces, "t", 4, Scratch(spark, "groups"), 20)
    got = {(r["x"], r["y"], r["grp"]): (r["target"], r["d"]) for r in out.collect()}
    assert len(got) == 3 * len(points)
    for g, v in sets.items():
        one = {(r["k"]): (r["t"], r["d"]) for r in nearest_tree.nearest_pieces(places.selectExpr("struct(x, y) as k", "x", "y"), pieces.filter(f"grp = {g}"), "k", "t", Scratch(spark, "one")).collect()}
        assert {(x, y): got[x, y, g] for x, y in points} == {tuple(k): v for k, v in one.items()}


def test_classes_of_a_crowd(spark, monkeypatch):
    radii, rng = looked_at(monkeypatch), np.random.default_rng(8)
    points, places = rng.integers(0, 30, (800, 2)).astype(float), rng.uniform(0, 30, (900, 2))
    left, right = tables(spark, points, places)
    odd = spark.createDataFrame([(-1, None, 1.0), (None, 3.0, 4.0), (-2, float("nan"), 1.0), (0, 29.0, 29.0)], left.schema)
    right = right.selectExpr("*", "case when t % 5 < 2 then 'a' when t % 5 < 4 then 'b' when t = 4 then 'c' end as kind")
    out = spatial.nearest_by_class(left.unionByName(odd), right, "k", "t", "kind", ["a", "b", "c", "none"], 25.0)
    assert out.columns == ["k", "d_a", "d_b", "d_c", "d_none"] and radii == []
    got = {r["k"]: tuple(r)[1:] for r in out.collect()}
    assert len(got) == out.count() == 803 and got[-1] == got[-2] == (None,) * 4
    at = {**dict(enumerate(points)), None: np.array([3.0, 4.0])}
    masks = [np.arange(900) % 5 < 2, np.isin(np.arange(900) % 5, (2, 3)), np.arange(900) == 4]
    for k, p in at.items():
        both = [p] if k != 0 else [p, np.array([29.0, 29.0])]
        want = [min(np.hypot(*(places[m] - q).T).min() for q in both) for m in masks]
        assert got[k][:3] == pytest.approx(want) and got[k][3] is None
    assert [tuple(r)[1:] for r in spatial.nearest_by_class(left.limit(1), right.limit(0), "k", "t", "kind", ["a", "b"], 25.0).collect()] == [(None, None)]
    assert spatial.nearest_by_class(left, right, "k", "t", "kind", [], 25.0).count() == 800
