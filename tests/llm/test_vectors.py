"""Vectors of several lengths and sizes, dense groups, and how much the subspace join prunes."""

import collections

import numpy as np
import pytest

pytest.importorskip("kerbside.llm")

from kerbside.llm import subspace_join, vp_tree  # noqa: E402
from kerbside.llm.scratch import Scratch  # noqa: E402
from kerbside.llm.vectors import Splits  # noqa: E402


def table(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>").repartition(3)


def brute_links(rows, least=0.9):
    unit = [(i, v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max())) for i, v in rows]
    return [(a, b) for a, x in unit for b, y in unit if a != b and len(x) == len(y) and x @ y >= least]


def components(ids, links):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(3)) for i in range(40)] + [(100 + i, np.array([1.0, 2.0])) for i in range(3)]
    rows += [(200 + i, rng.standard_normal(8)) for i in range(20)] + [(300, np.array([5.0])), (400, np.array([7.0]))]
    links = brute_links(rows)
    n, root = collections.Counter(a for a, _ in links), components([i for i, _ in rows], links)
    for settings in ({}, {"tile_floats": 40}):
        out = subspace_join.near_duplicates(table(spark, rows), Scratch(spark, "t"), **settings).collect()
        assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out} == {i: (n[i], root[i]) for i, _ in rows}
    df = table(spark, rows)
    got = vp_tree.nearest(df.filter("vec_id % 100 = 0"), df, Scratch(spark, "t"), k=2, shard_rows=16).collect()
    want = {}
    for q, x in rows:
        if q % 100 == 0:
            near = sorted((float(np.linalg.norm(x - y)), i) for i, y in rows if i != q and len(x) == len(y))[:2]
            want.update({(q, k + 1): i for k, (_, i) in enumerate(near)})
    assert {(r["query_id"], r["rank"]): r["vec_id"] for r in got} == want


def test_huge_and_tiny_vectors(spark):
    rows = [(0, [1e200, 0]), (1, [2e200, 0]), (2, [1.5e200, 1e199]), (3, [1.0, 1.0]), (4, [1e-200, 0]), (5, [4e-200, 0]), (100, [2e-200, 1e-201])]
    got = vp_tree.nearest(table(spark, rows).filter("vec_id % 100 = 0"), table(spark, rows), Scratch(spark, "t"), k=10).collect()
    near = {q: [r for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 100)}
    assert [r["vec_id"] for r in near[0]] == [2, 1, 3, 4, 5, 100]
    assert near[0][0]["score"] == pytest.approx(0.5099019513592785e200, rel=1e-12) and near[0][5]["score"] == pytest.approx(1e200)
    assert [r["vec_id"] for r in near[100]] == [4, 5, 3, 0, 2, 1]
    assert near[100][0]["score"] == pytest.approx(np.hypot(1, 0.1) * 1e-200, rel=1e-12)


def test_a_dense_group(spark):
    rng = np.random.default_rng(5)
    one = rng.standard_normal(8)
    rows = [(i, one * (1 + i % 7)) for i in range(3000)] + [(5000 + i, rng.standard_normal(8)) for i in range(50)]
    out = {r["vec_id"]: r for r in subspace_join.near_duplicates(table(spark, rows), Scratch(spark, "t"), tile_floats=8 * 1200).collect()}
    links = collections.Counter(a for a, _ in brute_links(rows[2999:]))
    assert all(out[i]["component_id"] == 0 and out[i]["n_links"] >= 2999 for i in range(3000))
    assert all(out[i]["n_links"] == links[i] + (2999 if out[i]["component_id"] == 0 else 0) for i in range(5000, 5050))


def test_pruning(spark):
    """In clusters nearly all pairs of tiles are ruled out by their blocks' boxes, and pieces inside tasks likewise."""
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((60, 64))
    x = np.repeat(centres, 64, axis=0) + 0.02 * rng.standard_normal((60 * 64, 64))
    rows = list(enumerate(x))
    scratch = Scratch(spark, "t")
    tiles = subspace_join.tiles_of(table(spark, rows), scratch, 0.9, 16, 64 * 64, 2048, 29)
    n, kept = tiles.count(), subspace_join.tile_pairs(tiles, 0.9, 16).count()
    assert n >= 30 and kept <= 4 * n < n * (n - 1) / 2 / 3
    out = subspace_join.near_duplicates(table(spark, rows), scratch, tile_floats=64 * 64).collect()
    assert all(r["n_links"] == 63 and r["component_id"] == r["vec_id"] // 64 * 64 for r in out)


def test_splits():
    rng = np.random.default_rng(3)
    x = np.repeat(rng.standard_normal((10, 6)) * 10, 20, axis=0) + 0.01 * rng.standard_normal((200, 6))
    code = Splits.fit(x).code(x)
    assert code.min() == 0 and all(len(set(code[i * 20 : i * 20 + 20]) & set(code[j * 20 : j * 20 + 20])) == 0 for i in range(10) for j in range(i))
    assert set(Splits.fit(np.ones((50, 3))).code(np.ones((4, 3)))) == {0}
    assert Splits.fit(x[:0]).code(x[:2]).tolist() == [0, 0]


def test_shards_are_skipped_and_nothing_is_lost():
    rng = np.random.default_rng(9)
    centres = np.repeat(rng.standard_normal((20, 8)) * 10, 50, axis=0)
    x = centres + 0.1 * rng.standard_normal(centres.shape)
    parts = x.reshape(20, 50, 8)
    means = parts.mean(axis=1)
    radii = np.linalg.norm(parts - means[:, None], axis=2).max(axis=1)
    ask, most = vp_tree.reachable(x[::7], means, radii, np.full(20, 50), 10, 1.0)
    d = np.linalg.norm(x[::7][:, None] - x[None], axis=2)
    near = np.argsort(d, axis=1)[:, 1:11]
    assert ask.sum() <= 2 * len(ask) and all(ask[q, row // 50] for q, rows in enumerate(near) for row in rows)
    assert (most >= np.sort(d, axis=1)[:, 10]).all()


def test_shards_grow_where_centres_would_be_many(spark, monkeypatch):
    rng = np.random.default_rng(10)
    rows = [(i, rng.standard_normal(5)) for i in range(300)]
    df = table(spark, rows)
    run = lambda: [tuple(r) for r in vp_tree.nearest(df.filter("vec_id % 10 = 0"), df, Scratch(spark, "t"), shard_rows=30).orderBy("query_id", "rank").collect()]
    one, seen, own = run(), [], vp_tree._centres
    monkeypatch.setattr(vp_tree, "_centres", lambda shards: seen.append(shards.count()) or own(shards))
    assert one == run() and len(one) == 300
    monkeypatch.setattr(vp_tree, "MOST_CENTRES", 4 * 5 * 8)
    assert one == run() and seen[0] >= 5 and seen[1] <= 4
