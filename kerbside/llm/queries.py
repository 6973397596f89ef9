"""The registered queries of the operators: whole tables, production parameters, digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.llm import (
    bpe,
    conversation_trie,
    decontaminate,
    fill_in_middle,
    language,
    line_dedup,
    minhash,
    mixing,
    phrase_automata,
    subspace_join,
    token_files,
    vp_tree,
    warc,
)
from kerbside.llm.scratch import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe() -> str:
    """The vocabulary file that the queries name; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def held_out(doc_id: Column) -> Column:
    """The fold that language ID never learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op1_subspace_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    out = subspace_join.near_duplicates(vectors, Scratch(spark, "op1"), least=0.9)
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_decode(docs, byte_bpe()).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.drop_common_lines(docs, Scratch(spark, "op3"))
    return out.select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_dropped").alias("n_dropped"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = minhash.near_duplicates(docs, Scratch(spark, "op4"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op5_vp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    queries = vectors.filter(F.col("vec_id") % 100 == 0)
    return vp_tree.nearest(queries, vectors, Scratch(spark, "op5"), k=10, relax=1.0)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.filter(~held_out(F.col("doc_id"))))
    out = language.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = token_files.write_token_files(docs, Scratch(spark, "op7").path("tokens"), byte_bpe(), end_id=0)
    out = token_files.read_token_files(spark, manifest, vocabulary=50_257)
    return out.select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def op8_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return phrase_automata.remove_repeats(docs, Scratch(spark, "op8"), window=35).drop("kept")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    scratch = Scratch(spark, "op9")
    archives = warc.write_archives(pages, scratch.path("warc"), scratch, least_bytes=0)
    return warc.read_archives(spark, archives, with_payload=False).drop("url", "payload")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = mixing.decisions(docs, Scratch(spark, "op10"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    out = decontaminate.contamination(docs, items, Scratch(spark, "op11"), window=10)
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(_table(spark, sf_dir, "conversations"), Scratch(spark, "op12"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = fill_in_middle.transform(docs, rate=100, spm=50, seed=7)
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_subspace_join": op1_subspace_join,
    "op2_bpe": op2_bpe,
    "op3_line_dedup": op3_line_dedup,
    "op4_minhash": op4_minhash,
    "op5_vp_tree": op5_vp_tree,
    "op6_language_id": op6_language_id,
    "op7_token_files": op7_token_files,
    "op8_phrase_automata": op8_phrase_automata,
    "op9_warc": op9_warc,
    "op10_mixing": op10_mixing,
    "op11_decontamination": op11_decontamination,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_fill_in_middle": op13_fill_in_middle,
}
