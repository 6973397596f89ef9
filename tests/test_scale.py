"""Order statistics, ranks and packed series where nothing may be looked at whole: bounds lowered, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside.functions import order, ranking, scaling
from kerbside.operators import montecarlo, packed
from kerbside.scratch import Scratch


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.fixture
def few(monkeypatch):
    monkeypatch.setattr(order, "HELD", 20)
    monkeypatch.setattr(order, "ERROR", 0.02)


def test_nth_values_and_quantiles(spark, few):
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal(3000), rng.integers(0, 40, 3000).astype(float)
    y[:1200] = 7.0  # a value of many rows
    df = frame(spark, [(float(a), float(b), None if i % 3 else float(i)) for i, (a, b) in enumerate(zip(x, y))], "x double, y double, z double")
    ranks = [0, 1, 700, 1500, 2998, 2999]
    got = order.nth_values(df, {"x": ranks, "y": ranks})
    assert got == {"x": np.sort(x)[ranks].tolist(), "y": np.sort(y)[ranks].tolist()}
    q = (0.0, 0.02, 0.5, 0.98, 1.0)
    got = order.quantiles(df, {"x": q, "y": q, "z": q})
    for c, v in (("x", x), ("y", y), ("z", np.arange(0, 3000, 3.0))):
        assert got[c] == pytest.approx(np.quantile(v, q).tolist())
    assert order.quantiles(df.limit(0), {"x": q})["x"] == [None] * 5
    assert scaling.robust_bounds(df, ["x"])["x"] == pytest.approx(tuple(np.quantile(x, scaling.ROBUST_QUANTILES)))


def test_running_sums(spark):
    df = frame(spark, [(i % 7, i, i + 1) for i in range(200)], "a int, b int, w int")
    got = {(r["a"], r["b"]): r["s"] for r in order.running(df, ["a", "b"], "w", "s", Scratch(spark, "t")).collect()}
    total = 0
    for a, b, w in sorted((i % 7, i, i + 1) for i in range(200)):
        assert got[a, b] == total
        total += w


def average_ranks(v):
    return np.array([((v < a).sum() + (v <= a).sum() + 1) / 2 for a in v]) / len(v)


def test_ranks_within_groups_and_missing(spark):
    rng = np.random.default_rng(2)
    rows = [(i, None if i % 11 == 0 else "abc"[i % 3], None if i % 5 == 0 else float(rng.integers(0, 12))) for i in range(400)]
    df = frame(spark, rows, "i int, g string, x double")
    got = {r["i"]: (r["p"], r["q"]) for r in ranking.rank_pct(ranking.rank_pct(df, "x", "p"), "x", "q", by=["g"]).collect()}
    assert len(got) == 400
    for pick, at in ((lambda r: True, 0), (lambda r: r[1] == "a", 1), (lambda r: r[1] is None, 1)):
        some = [r for r in rows if pick(r) and r[2] is not None]
        want = average_ranks(np.array([r[2] for r in some]))
        assert [got[r[0]][at] for r in some] == pytest.approx(want.tolist())
    assert all(got[r[0]] == (None, None) for r in rows if r[2] is None)


@pytest.mark.parametrize("share", [0.0, 0.1, 0.37, 1.0])
def test_top_share_with_ties(spark, few, share):
    rng = np.random.default_rng(3)
    rows = [(i, None if i % 9 == 0 else float(rng.integers(0, 6))) for i in range(500)]
    got = {r["k"]: r["t"] for r in ranking.top_share(frame(spark, rows, "k int, x double"), "x", "k", share, "t").collect()}
    full = sorted([r for r in rows if r[1] is not None], key=lambda r: (-r[1], r[0]))
    top = {k for k, _ in full[: int(np.ceil(round(len(full) * share, 9)))]}
    assert got == {k: k in top for k, _ in rows}


def blocks(spark, x, rows=64):
    df = frame(spark, [(i, 2020, *map(float, r)) for i, r in enumerate(x)], "k long, year int, " + ", ".join(f"c{j} double" for j in range(x.shape[1])))
    return packed.pack(df, "k", [f"c{j}" for j in range(x.shape[1])], rows)


@pytest.mark.parametrize("range_rows", [1_000_000, 60])
def test_packed_ranks(spark, range_rows):
    rng = np.random.default_rng(4)
    x = np.stack([rng.standard_normal(700), rng.integers(0, 5, 700).astype(float), np.where(rng.random(700) < 0.2, np.nan, rng.random(700))], axis=1)
    import pyarrow as pa

    def finish(block, ranks):
        return [pa.array(packed.array(block, "ids", "<i8")), *[pa.array(ranks[:, j]) for j in range(3)]]

    scratch = Scratch(spark, "t")
    out = packed.with_ranks(scratch.table(blocks(spark, x), "b"), lambda b: packed.array(b, "x", columns=3), finish, "k long, a double, b double, c double", scratch, range_rows)
    got = np.full(x.shape, np.nan)
    for r in out.collect():
        got[r["k"]] = [r["a"], r["b"], r["c"]]
    for j in range(3):
        ok = ~np.isnan(x[:, j])
        assert got[ok, j] == pytest.approx(average_ranks(x[ok, j])) and np.isnan(got[~ok, j]).all()


def test_packed_quantiles(spark):
    rng = np.random.default_rng(5)
    x = np.stack([rng.random(900), np.where(rng.random(900) < 0.7, 0.25, rng.random(900)), np.where(rng.random(900) < 0.5, np.nan, rng.random(900) ** 4), np.full(900, np.nan)], axis=1)
    q = (0.0, 0.02, 0.5, 0.98, 1.0)
    got = packed.series_quantiles(Scratch(spark, "t").table(blocks(spark, x), "b"), lambda b: packed.array(b, "x", columns=4), 4, q)
    for j in range(3):
        assert got[j] == pytest.approx(np.nanquantile(x[:, j], q))
    assert np.isnan(got[3]).all()


def test_draws_are_fixed_values():
    """The same decisions for a seed, whatever the version: a few of them as literals."""
    rows = montecarlo.draws(4, 42)
    assert [r["normalization"] for r in rows] == LITERALS["normalization"] and [r["aggregation"] for r in rows] == LITERALS["aggregation"]
    assert [r["excluded"] for r in rows] == LITERALS["excluded"]
    assert [r["floor"] for r in rows] == pytest.approx(LITERALS["floor"], abs=1e-12)
    assert [r["g_hazard"] for r in rows] == pytest.approx(LITERALS["g_hazard"], abs=1e-12)
    assert [r["w_trees"] for r in rows] == pytest.approx(LITERALS["w_trees"], abs=1e-12)


def test_constant_columns(spark):
    df = spark.createDataFrame([(1, 2, None), (1, 3, None), (1, None, 4)], "a int, b int, c int")
    assert scaling.without_constants(df).columns == ["b"] and scaling.without_constants(df, keep=["c"]).columns == ["b", "c"]
    text = spark.createDataFrame([("1",), ("x",), (None,), ("3",)], "v string")
    assert [r["o"] for r in scaling.coerced_scale(text, "v", "o").collect()] == [0.0, None, None, 1.0]
    assert [r["o"] for r in scaling.coerced_scale(text.filter(F.col("v") == "x"), "v", "o").collect()] == [0.0]


LITERALS = {
    "normalization": ["robust", "minmax", "robust", "robust"],
    "aggregation": ["geometric", "arithmetic", "arithmetic", "arithmetic"],
    "excluded": [None, None, "green", None],
    "floor": [0.05, 0.08005451473663858, 0.08082319397519246, 0.06957248632542055],
    "g_hazard": [0.3333333333333333, 0.38978953574007763, 0.27616029584538154, 0.4264476865527187],
    "w_trees": [1.0, 0.7274764362455262, 0.9230515720255966, 0.5308835651560633],
}
