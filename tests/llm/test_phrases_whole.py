"""Repeated phrases where hashes mislead, against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("kerbside.llm")

from kerbside.llm import phrase_automata  # noqa: E402
from kerbside.llm.scratch import Scratch  # noqa: E402


def brute(texts, window):
    words = [t.split() for t in texts]
    n = collections.Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if n[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("settings", [{}, {"stream_words": 20, "shard_windows": 50}])
def test_a_false_match_hides_no_repeat(spark, monkeypatch, settings):
    exact = phrase_automata.runs_of

    def blind(words, window, anchor):
        *runs, h = exact(words, window, anchor)
        return *runs, np.zeros_like(h)  # all windows that share anchor and place look alike

    monkeypatch.setattr(phrase_automata, "runs_of", blind)
    rng = random.Random(4)
    words = lambda n: [rng.choice("abcdefghijkl") for _ in range(n)]
    shared = [words(rng.randint(8, 20)) for _ in range(6)]
    texts = [" ".join(words(30)) for _ in range(20)]
    texts += [" ".join(words(9) + s + words(9) + t + words(9)) for s in shared for t in rng.sample(shared, 2)]
    want = brute(texts, 8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = phrase_automata.remove_repeats(docs, Scratch(spark, "t"), window=8, anchor=2, **settings)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out.collect()}
    assert got == dict(enumerate(want)) and sum(w[1] for w in want) > 100


def test_rows_that_share_an_id_are_compared(spark):
    rng = random.Random(6)
    words = lambda n: [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)]
    twice, part = " ".join(words(40)), words(12)
    ids = [7, 7, 3, 3, 5, 9, 9]
    texts = [twice, twice, " ".join(words(5) + part), " ".join(words(30)), " ".join(part + words(9)), " ".join(words(30)), None]
    want = sorted(zip(ids, brute([t or "" for t in texts], 8), strict=True))
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    out = phrase_automata.remove_repeats(docs, Scratch(spark, "t"), window=8, anchor=2).collect()
    assert sorted((r["doc_id"], (r["n_words"], r["n_removed"], r["kept_sha256"])) for r in out) == want
    assert want[-3][1][1] == want[-4][1][1] == 40


def test_rows_without_an_id_are_compared(spark):
    """Their text counts as anywhere else, and they lose what repeats."""
    rng = random.Random(7)
    words = lambda n: [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)]
    part, twice = words(12), " ".join(words(30))
    for ids in ([None, 4, None, 8, 8, None], [None] * 6):
        texts = [" ".join(words(5) + part), " ".join(part + words(9)), twice, twice, " ".join(words(20)), None]
        want = sorted(zip(ids, brute([t or "" for t in texts], 8), strict=True), key=repr)
        docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
        out = phrase_automata.remove_repeats(docs, Scratch(spark, "t"), window=8, anchor=2).collect()
        assert sorted(((r["doc_id"], (r["n_words"], r["n_removed"], r["kept_sha256"])) for r in out), key=repr) == want
