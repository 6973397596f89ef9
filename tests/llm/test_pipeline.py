"""The pipeline's stages one after another."""

import pytest

pytest.importorskip("kerbside.llm")

import corpus_pipeline  # noqa: E402

from kerbside.llm.scratch import Scratch  # noqa: E402


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    scratch, counts = Scratch(spark, "t"), [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = scratch.table(stage(spark, docs, d), name)
        assert out.columns == docs.columns
        docs = out
        counts.append(docs.count())
    assert counts[1] >= 0.98 * counts[0] and counts[2] == counts[1] and counts[3] <= counts[2]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    texts = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    import hashlib

    assert sorted((r["doc_id"], r["decoded_sha256"]) for r in last.collect()) == sorted(
        (i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts
    )


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100
