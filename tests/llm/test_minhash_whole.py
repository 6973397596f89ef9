"""How often the forest misses a pair at the threshold."""

import numpy as np
import pytest

pytest.importorskip("kerbside.llm")

from kerbside.llm import minhash  # noqa: E402


def test_trees_are_independent_and_dense_regions_miss_no_more():
    trees = minhash.grown(40, 4, 75)
    places = minhash.tree_orders(trees, 4)
    assert len(np.unique(places)) == places.size and places.max() < trees * 5
    assert (1 - 0.75**5) ** trees <= (1 - 0.75**4) ** 40 < 3e-7
    assert len(minhash.signature(np.arange(9, dtype=np.uint64) << np.uint64(33), trees * 5)) == 2 * trees * 5
    rng, missed = np.random.default_rng(1), 0
    for _ in range(50):  # at depth 5, 40 trees over 96 places miss about 3.5e-4 of these pairs
        agree = rng.random((4000, trees * 5), np.float32) < 0.75
        missed += int((~agree[:, places].all(axis=2).any(axis=1)).sum())
    assert missed <= 1
