"""What a step leaves in the store, moves between tasks or does beside its work."""

import gc
import random

import pytest

pytest.importorskip("kerbside.llm")

from pyspark.sql import functions as F  # noqa: E402

from kerbside.llm import decontaminate, minhash, token_files  # noqa: E402
from kerbside.llm.scratch import Scratch  # noqa: E402


def words(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def test_decontamination_writes_few_files(spark):
    rng = random.Random(5)
    items = [words(rng, 60) for _ in range(40)]
    docs = [(i, f"{words(rng, 20)} {items[i % 40]} {words(rng, 20)}") for i in range(80)]
    held = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        scratch = Scratch(spark, "few")
        out = decontaminate.contamination(
            spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
            spark.createDataFrame(list(enumerate(items)), "item_id long, text string").repartition(3),
            scratch,
        )
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in out.collect()}
        assert got == {i: (100, 60, [str(i % 40)]) for i, _ in docs}
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{scratch.root}/*/part-*")
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        assert len(files) < 250, len(files)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_minhash_moves_only_texts_asked_for(spark):
    texts = spark.range(20_000).select(
        F.when(F.col("id") > 0, F.col("id")).alias("doc_id"), F.xxhash64("id").alias("text_key"), F.lit("x").alias("text")
    )
    rows = texts.filter("doc_id is null or doc_id % 100 = 7").select("doc_id", "text_key")
    got = {tuple(r) for r in minhash.asked_for(texts, rows).select("doc_id", "text_key").collect()}
    assert {tuple(r) for r in rows.collect()} <= got and len(got) < 1500
    assert minhash.asked_for(texts, rows.filter("false")).isEmpty()
    # a table that is too small lets others through, and loses none
    some = minhash.asked_for(texts, rows, most_words=1).select("doc_id", "text_key")
    assert rows.count() == 201 and rows.exceptAll(some).isEmpty()


def test_encoding_searches_no_cycles():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    rng = random.Random(6)
    texts = [words(rng, 300) for _ in range(60)]
    encoder = token_files.LibraryEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    begun = []
    note = lambda phase, info: begun.append(phase)
    gc.collect()
    gc.callbacks.append(note)
    try:
        got = encoder.encode(texts)
    finally:
        gc.callbacks.remove(note)
    assert gc.isenabled() and not begun
    assert got == encoder._ids(texts)


def test_token_files_look_for_distinct_words():
    public_tokenizers = pytest.importorskip("public_tokenizers")

    class Counting(token_files.Held):
        asked = 0

        def get(self, key, *default):
            Counting.asked += 1
            return super().get(key, *default)

    rng = random.Random(7)
    known = [f"w{i}" for i in range(50)]
    texts = [" ".join(rng.choices(known, k=200)) for _ in range(100)]
    encoder = token_files.LibraryEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    encoder.words = Counting()
    assert encoder.encode(texts) == encoder._ids(texts)
    # 50 words, each after a space or at a text's start; 20,000 places
    assert 0 < Counting.asked < 500, Counting.asked


def test_token_files_words_make_no_other_ids():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    encoder = token_files.LibraryEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    library, asked = encoder.library, []

    class Noting:
        def encode_batch_fast(self, texts, **settings):
            found = library.encode_batch_fast(texts, **settings)
            asked.extend((len(t.split()), len(e.ids)) for t, e in zip(texts, found, strict=True))
            return found

    rng = random.Random(8)
    new = sorted({"".join(rng.choices("abcdefgé", k=12)) for _ in range(3000)})
    want = encoder._ids([f" {w}" for w in new])
    encoder.library = Noting()
    assert encoder._word_ids(new) == want
    # nothing is encoded beside the words, and few words at a time
    assert sum(n for _, n in asked) * len(encoder.line) == sum(map(len, want))
    assert sum(n for n, _ in asked) == len(new) and max(n for n, _ in asked) <= 100


def test_token_files_pieces_of_all_kinds():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    encoder = token_files.LibraryEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    encoder.words.most = 20_000
    rng = random.Random(9)
    pieces = [
        "a", "Then", "wörd", "你好", "don't", "'s", "it's.", "x.", "x.,", "..", "$$", "3.5", "3.", "½", "²!", "a-b", "a_b)", "́", "é́.",
        "x\xa0y", "\xa0", "a\tb", "\t", "x\x1cy", "\x00", "a\x85b", "　", "﻿", "😀", "😀!", "<|endoftext|>", "x<|endoftext|>", "Ġ", "Ċ", "Ġx.", "​", "ﬁ,",
    ]
    for _ in range(60):
        texts = [None, "", "\n", " ", "x "]
        for _ in range(20):
            some = [rng.choice(pieces) if rng.random() < 0.5 else "".join(rng.choices("abcé.,!", k=4)) for _ in range(rng.randrange(12))]
            texts.append("".join(w + rng.choices([" ", "\n", "  ", " \n", "\n\n"], [80, 15, 1, 1, 1])[0] for w in some)[: rng.choice([-1, None])])
        assert encoder.encode(texts) == encoder._ids([t or "" for t in texts])
