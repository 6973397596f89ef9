"""The forest's candidates whatever the batches, and blocks of many tiles, against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("kerbside.llm")

from kerbside.llm import minhash  # noqa: E402
from kerbside.llm.scratch import Scratch  # noqa: E402


@pytest.mark.parametrize("size", [1, 2, 7, 50, 1000])
def test_neighbours_do_not_depend_on_batches(size):
    rng = np.random.default_rng(size)
    rows = sorted((int(rng.integers(0, 2)), int(rng.integers(0, 12)) if rng.random() < 0.6 else 5, int(rng.integers(0, 4)), i) for i in range(400))
    cols = [np.array(c) for c in zip(*rows)]
    batch = pa.RecordBatch.from_arrays([pa.array(cols[0].astype(np.int32)), *map(pa.array, cols[1:])], ["tree", "first", "rest", "id"])
    got, edges = set(), []
    for b in minhash._neighbours(20)([batch.slice(at, size) for at in range(0, 400, size)]):
        for e, t, p, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
            edges.append((t, p, x)) if e else got.add((x, y))
    region = {}
    for t, p, _, _ in rows:
        region[t, p] = region.get((t, p), 0) + 1
    want = {(min(a[3], b[3]), max(a[3], b[3])) for a, b in zip(rows, rows[1:]) if a[:2] == b[:2] and (region[a[:2]] <= 20 or a[2] == b[2])}
    assert got == want and edges == [(rows[0][0], rows[0][1], rows[0][3]), (rows[-1][0], rows[-1][1], rows[-1][3])]


@pytest.mark.parametrize(("tile", "pivots"), [(6, 2), (4, 1)])
def test_blocks_of_many_tiles(spark, tile, pivots):
    """Chains of near copies, whose ends are no near copies: only some tiles' parts meet by the chosen documents."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(3):
        words = [word() for _ in range(60)]
        for _ in range(30):
            at = rng.randrange(0, 59)
            words = [*words[:at], word(), *words[at + 1 :]]
            texts.append(" ".join(words))
    rng.shuffle(texts)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(56)} for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = minhash.near_duplicates(docs, Scratch(spark, "t"), tile_docs=tile, pivots=pivots).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == {i: top(i) for i in range(len(texts))}
