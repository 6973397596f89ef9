"""Rows that share an id: each is judged and taken by itself; archives with ids of their own; many languages."""

import collections
import random

import pytest

pytest.importorskip("kerbside.llm")

from pyspark.sql import functions as F  # noqa: E402

from kerbside.llm import language, minhash, mixing, warc  # noqa: E402
from kerbside.llm.scratch import Scratch  # noqa: E402

A, B = ("the first of two texts about nothing much at all" * 2, "quite another text that shares no words with any other one" * 2)


def parts(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    scratch = Scratch(spark, "t")
    out = collections.Counter((r["doc_id"], r["n_shingles"] > 0, r["component_id"]) for r in minhash.near_duplicates(df, scratch).collect())
    kept = collections.Counter((r["doc_id"], r["text"]) for r in minhash.keep_one(df, scratch).collect())
    return out, kept


def test_links_of_rows_that_share_an_id(spark):
    out, kept = parts(spark, [(7, A), (7, B), (9, B)])
    assert out == collections.Counter({(7, True, 7): 2, (9, True, 7): 1}) and kept == collections.Counter([(7, A), (7, B)])
    out, kept = parts(spark, [(1, A), (7, A), (7, None)])
    assert out == collections.Counter([(1, True, 1), (7, True, 1), (7, False, 7)]) and kept == collections.Counter([(1, A), (7, None)])
    out, kept = parts(spark, [(1, A), (7, A), (7, B), (8, f"{B} end")])
    assert out == collections.Counter([(1, True, 1), (7, True, 1), (7, True, 7), (8, True, 7)]) and kept == collections.Counter([(1, A), (7, B)])


def test_rows_without_an_id_link(spark):
    out, kept = parts(spark, [(None, A), (None, A), (4, f"{A} end"), (None, B), (None, None), (5, "x")])
    assert out == collections.Counter({(None, True, 4): 2, (4, True, 4): 1, (None, True, None): 1, (None, False, None): 1, (5, True, 5): 1})
    assert sum(kept.values()) == 6


def test_many_copies_under_few_ids(spark):
    rows = [(i % 3, A) for i in range(600)] + [(None, A)] * 300 + [(50 + i, f"{A} {'tail ' * (i % 3)}") for i in range(30)] + [(90, B)]
    out, _ = parts(spark, rows)
    assert {c for (_, _, c) in out if c is not None} == {0, 90} and sum(out.values()) == len(rows)


def test_mix_takes_each_row_by_itself(spark):
    """4,000 rows of which many share one id or have none: what is taken stays at the target."""
    rng = random.Random(1)
    rows = [(7 if i % 2 else None, " ".join(["w"] * rng.randint(1, 9)), "abc"[i % 2 + (i % 7 == 0)]) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    target = {r["source"]: r["target"] for r in mixing.decisions(docs, Scratch(spark, "t")).collect()}
    for settings in ({}, {"hot_rows": 10_000}):
        out = mixing.mix(docs, Scratch(spark, "t"), **settings).collect()
        took = collections.Counter()
        for r in out:
            took[r["source"]] += len(r["text"].split())
        assert all(abs(took[s] - target[s]) <= 0.02 * target[s] for s in size)
    few = spark.createDataFrame([(1, "a b", "s"), (1, "c d", "s"), (2, "e", "t")], "doc_id long, text string, source string")
    assert mixing.mix(few.withColumn("row", F.lit("mine")), Scratch(spark, "t")).columns == ["doc_id", "text", "source", "row"]


def test_many_languages(spark):
    """Two thousand languages of four texts each, and the most frequent of more than can be learned."""
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = [["".join(rng.choice(letters) for _ in range(6)) for _ in range(5)] for _ in range(2000)]
    rows = [(" ".join(rng.choice(own[i]) for _ in range(12)), f"l{i:04d}") for i in range(2000) for _ in range(4)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    model = language.fit(df, most_rows=4000, clusters=1, rounds=2)
    assert len(model.languages) == 2000 and len(model.centroids) == 2000
    seen = language.predict(df.filter(F.col("lang") < "l0050"), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in seen) > 0.9 * len(seen)
    some = language.fit(df.unionByName(df.filter("lang < 'l0003'").withColumn("text", F.concat("text", F.lit(" more")))), most_rows=3)
    assert some.languages == ["l0000", "l0001", "l0002"]


def test_record_ids_are_unique(spark):
    pages = [(1, "u", "one"), (1, "u", "two"), (2, "u", "two"), (3, "v", "two"), (3, "u", "two"), (1, "u", "one"), (1, "w", "one"), (4, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    scratch = Scratch(spark, "t")
    archives = warc.write_archives(df, scratch.path("w"), scratch)
    ids, refers = [], []
    for r in archives.collect():
        with open(r["path"].removeprefix("file://"), "rb") as f:
            for frame in warc.frames(f, r["path"]):
                head, _ = warc._headers(frame, "")
                ids.append(head[b"warc-record-id"])
                refers += [head[b"warc-refers-to"]] if b"warc-refers-to" in head else []
    assert len(ids) == len(set(ids)) == len(pages) and set(refers) <= set(ids) and len(refers) == 3
