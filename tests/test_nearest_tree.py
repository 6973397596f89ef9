"""Nearest search by tiles against all pairs: crowds and deserts, long pieces, ties, hot places."""

import numpy as np
import pytest

from kerbside.operators import nearest_tree
from kerbside.scratch import Scratch


def brute(points, pieces):
    """Distances of all points to all pieces."""
    x, y = points[:, :1], points[:, 1:]
    px, py, qx, qy = (pieces[:, i][None, :] for i in range(4))
    dx, dy = qx - px, qy - py
    square = dx * dx + dy * dy
    t = np.clip(((x - px) * dx + (y - py) * dy) / np.where(square > 0, square, 1), 0, 1)
    return np.hypot(x - (px + t * dx), y - (py + t * dy))


def tables(spark, points, pieces, targets=None):
    targets = list(range(len(pieces))) if targets is None else targets
    p = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(points)], "k int, x double, y double")
    q = spark.createDataFrame([(t, *map(float, r)) for t, r in zip(targets, pieces, strict=True)], f"t {'string' if isinstance(targets[0], str) else 'int'}, px double, py double, qx double, qy double")
    return p, q


def found(spark, p, q, rows=40):
    return {r["k"]: (r["t"], r["d"]) for r in nearest_tree.nearest_pieces(p, q, "k", "t", Scratch(spark, "nearest"), rows).collect()}


@pytest.mark.parametrize("asking", [500_000, 60])
def test_crowds_deserts_and_long_pieces(spark, monkeypatch, asking):
    monkeypatch.setattr(nearest_tree, "ASKING", asking)
    rng = np.random.default_rng(5)
    start = np.concatenate([rng.normal(0, 5, (900, 2)), rng.uniform(-40_000, 40_000, (60, 2))])
    pieces = np.concatenate([start, start + rng.normal(0, 0.5, start.shape)], axis=1)
    pieces[7] = [-30_000, -30_000, 30_000, 30_000]
    pieces[8, 2:] = pieces[8, :2]
    points = np.concatenate([rng.normal(0, 5, (200, 2)), rng.uniform(-40_000, 40_000, (200, 2)), np.repeat([[1.0, 2.0]], 200, axis=0)])
    d = brute(points, pieces)
    got = found(spark, *tables(spark, points, pieces))
    assert len(got) == len(points)
    for k, (t, best) in got.items():
        assert best == pytest.approx(d[k].min(), abs=1e-9) and d[k, t] == pytest.approx(best, abs=1e-9)


def test_ties_go_to_the_smaller_target(spark):
    lattice = np.array([(i, j) for i in range(12) for j in range(12)], float)
    names = [f"n{(i * 89) % 144:03d}" for i in range(144)]
    pieces, points = np.concatenate([lattice, lattice], axis=1), lattice + 0.5
    got = found(spark, *tables(spark, points, np.tile(pieces, (3, 1)), names + sorted(names) + names), 10)
    d = brute(points, pieces)
    least = {i: min(names[i], sorted(names)[i]) for i in range(144)}
    for k, (t, best) in got.items():
        assert best == d[k].min() and t == min(least[i] for i in np.flatnonzero(d[k] == best))


def test_equal_middles_are_cut_by_hash(spark):
    angle = np.linspace(0, np.pi, 500, endpoint=False)
    half = np.stack([np.cos(angle), np.sin(angle)], axis=1) * np.linspace(1, 9, 500)[:, None]
    pieces, points = np.concatenate([-half, half], axis=1), np.random.default_rng(2).normal(0, 8, (150, 2))
    got, d = found(spark, *tables(spark, points, pieces), 20), brute(points, pieces)
    assert all(best == pytest.approx(d[k].min(), abs=1e-9) for k, (_, best) in got.items()) and len(got) == 150


def test_missing_infinite_and_empty(spark):
    p, q = tables(spark, [(0, 0), (5, 5)], [(1, 0, 1, 0), (5, 6, 5, 6)])
    odd = spark.createDataFrame([(7, None, 1.0), (8, float("nan"), 1.0), (9, 1.0, float("inf"))], p.schema)
    bad = spark.createDataFrame([(-1, 0.0, None, 0.0, 0.0), (-2, 0.0, 0.0, float("nan"), 0.0), (-3, float("-inf"), 0.0, 0.0, 0.0)], q.schema)
    want = {0: (0, 1.0), 1: (1, 1.0)}
    assert found(spark, p.unionByName(odd), q.unionByName(bad)) == want
    assert found(spark, p, bad) == {} and found(spark, p, q.limit(0)) == {} and found(spark, p.limit(0), q) == {}
    # a key of several places is one point; a missing target is the smallest
    assert found(spark, p.selectExpr("0 as k", "x", "y"), q) == {0: (0, 1.0)}
    none = spark.createDataFrame([(None, 1.0, 0.0, 1.0, 0.0)], q.schema)
    assert found(spark, p, q.unionByName(none))[0] == (None, 1.0)
