"""Data quality, set operations and dictionary compression."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions.order import running
from kerbside.scratch import Scratch


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One row for each rule: how many rows break it (a missing outcome counts as broken)."""
    wide = df.agg(*[F.count(F.when(~F.coalesce(ok, F.lit(False)), 1)).alias(name) for name, ok in rules.items()])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("rows")) for n in rules])).alias("x")).select("x.*")


def zero_share(df: DataFrame, column: str, warn_at: float = 0.25) -> DataFrame:
    """The part of rows that are zero, and whether that is suspicious."""
    return df.agg(F.avg((F.col(column) == 0).cast("double")).alias("zero_share")).withColumn("warn", F.col("zero_share") > warn_at)


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of ``left`` that ``right`` lacks."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")


def centre_aliases(ours: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    """``ours, theirs``: the one unmatched centre name of ours with the one centre name of theirs; empty if not one each."""
    centre = (F.col(key) == "MERKEZ") | F.col(key).endswith(" MERKEZ")
    mine = missing_keys(ours, theirs, key).filter(centre)
    other = theirs.select(key).distinct().filter(centre)
    one = lambda df, name: df.agg(F.count("*").alias("n"), F.min(key).alias(name)).filter("n = 1").drop("n")
    pair = one(mine, "ours").crossJoin(F.broadcast(one(other, "theirs")))  # one row a side
    return pair.join(ours.select(F.col(key).alias("theirs")).distinct(), "theirs", "left_anti").select("ours", "theirs")


def content_digest(df: DataFrame) -> DataFrame:
    """One row: row count and order-free digests of the rows."""
    h = F.xxhash64(*df.columns)
    return df.agg(F.count("*").alias("rows"), F.bit_xor(h).alias("mix"), F.sum(F.shiftright(h, 20)).alias("total"))


def compressed(df: DataFrame, key: str, text: str, separator: str = "<br>") -> tuple[DataFrame, DataFrame]:
    """``(tokens, dictionary)``: each text as the numbers of its pieces, and the pieces.

    A piece's number is a 64-bit hash of it, so it is the same in every partition and run
    and no task has to number all pieces.
    """
    pieces = df.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, f"\\Q{separator}\\E")).alias("pos", "piece"))
    dictionary = pieces.select("piece").distinct().withColumn("token", F.xxhash64("piece"))
    tokens = (
        pieces.withColumn("token", F.xxhash64("piece"))
        .groupBy(key)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("tokens"))
    )
    return tokens, dictionary


def compressed_in_order(df: DataFrame, key: str, text: str, separator: str = "<br>") -> tuple[DataFrame, DataFrame]:
    """``(tokens, dictionary)`` with dense numbers from 0 in the order in which pieces are first seen, rows by ``key``.

    A piece's place is the smallest (key, position) it has; places are range-partitioned and counted up, so no task sees
    all pieces, and no hash stands for a piece: the texts come back exactly.
    """
    scratch = Scratch(df.sparkSession, "pieces")
    pieces = df.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, f"\\Q{separator}\\E")).alias("pos", "piece"))
    pieces = scratch.table(pieces, "pieces")
    first = pieces.groupBy("piece").agg(F.min(F.struct(key, "pos")).alias("at")).select("piece", f"at.{key}", "at.pos", F.lit(1).alias("one"))
    numbers = running(first, [key, "pos", "piece"], "one", "token", scratch)
    dictionary = scratch.table(numbers.select("piece", F.col("token").cast("long").alias("token")), "dictionary")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "token")))
    tokens = pieces.join(dictionary, "piece").groupBy(key).agg(F.transform(ordered, lambda x: x["token"]).alias("tokens"))
    return tokens, dictionary


def expanded(tokens: DataFrame, dictionary: DataFrame, key: str, text: str, separator: str = "<br>") -> DataFrame:
    """The texts again."""
    pieces = tokens.select(key, F.posexplode("tokens").alias("pos", "token")).join(dictionary, "token")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "piece")))
    return pieces.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), separator).alias(text))
