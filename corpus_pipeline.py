"""The corpus pipeline: five stages over ``documents``, each written and read again.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and
returns a DataFrame. All but the last return the columns of ``documents``, extra ones included. What becomes of
null or empty texts, repeated rows and empty tables is in each stage's docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.llm import bpe, language, line_dedup, minhash, mixing
from kerbside.llm.queries import byte_bpe
from kerbside.llm.scratch import Scratch
from kerbside.llm.text import free


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the centroids know; the rejected go.

    Null and empty texts and texts without a letter are rejected. Rows that share a ``doc_id`` are judged
    each by its own text; all columns stay as they are, whatever their names. With no labelled
    row no language is known and every document is rejected; an empty table stays empty.
    """
    names = tuple(free(n, docs.columns) for n in ("lang_pred", "score", "rejected"))
    seen = language.predict(docs, language.fit(docs), names=names)
    return seen.filter(~F.col(names[2])).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents share; ``n_chars`` follows the text.

    A null or empty text is an empty text. Rows that share a ``doc_id`` lose the same lines; rows without an id
    keep theirs. No row goes; an empty table stays empty.
    """
    counts = tuple(free(n, docs.columns) for n in ("n_lines", "n_dropped"))
    out = line_dedup.drop_common_lines(docs, Scratch(spark, "lines"), counts=counts)
    columns = {"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {}
    return out.withColumns(columns).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest ``doc_id``.

    Null texts and texts without words are in no group and stay, as do rows without an id; rows that share
    a ``doc_id`` are judged each by its own text. An empty table stays empty.
    """
    return minhash.keep_one(docs, Scratch(spark, "near"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document taken more than once is as many rows.

    Null sources are one source. Null and empty texts have no size and are taken as often as the whole
    repetitions of their source. Rows that share a ``doc_id`` get decisions of their own. An empty table stays empty.
    """
    return mixing.mix(docs, Scratch(spark, "mix"))


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, ids`` and the digest of the text that the ids decode to, for each row.

    Null and empty texts have no ids. Other columns take no part.
    """
    out = bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), byte_bpe())
    return out.select(
        "doc_id",
        "lang",
        "source",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("bpe_tokens", bpe_tokens),
]

#: Language ID (a fitted classifier) and BPE ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
