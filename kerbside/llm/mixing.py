"""Mixing sources to target weights, with DataFrame functions only.

Capped water-filling: a source's target is its share of the budget by weight,
clamped at ``max_epochs`` times its size; what clamping frees is shared again by
weight among the others, until none is above. Documents are then repeated whole
``floor(ratio)`` times, and the fractional repetition is sampled by document.

Defined results: null texts have size 0; null sources are one source, last in
order; an empty table gives an empty mix; a source of size 0 has target 0 and its
documents are taken once per whole repetition of size 0 (nothing). Rows that share a
``doc_id`` are separate rows, each with a decision of its own. Other columns, whatever their names, are kept by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbside.llm.scratch import Scratch
from kerbside.llm.text import free

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """``place`` of each source by code point, null last, without one task seeing all sources.

    Sources are range-partitioned and written; positions within a partition get
    the number of sources before it from a table of one row per partition.
    """
    n = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch.table(
        sizes.repartitionByRange(n, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()),
        "sources",
    )
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")
    )
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return (
        dealt.withColumn("at", F.row_number().over(inside) - 1)
        .join(before, "part")
        .withColumn("place", F.col("at") + F.col("before"))
        .drop("part", "at", "before")
    )


def source_targets(docs: DataFrame, weights: list[int], max_epochs: int, scratch: Scratch) -> DataFrame:
    """``source, source_size, n_docs, target``: one row per source.

    ``weights`` repeat along the sources in code-point order. The water level is
    found in rounds of one aggregate over the source table, each of which clamps
    every source above its cap; the driver sees three numbers a round.
    """
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = scratch.table(
        _ranked(sizes, scratch)
        .withColumn("weight", weight.cast("long"))
        .withColumn("cap", F.col("source_size") * max_epochs),
        "weighed",
    )
    total = table.agg(F.sum("source_size")).first()[0] or 0
    spare, rest, clamped = total, None, -1
    over = F.lit(False)
    while True:
        row = table.agg(
            F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0)).alias("capped"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("rest"),
            F.count(F.when(over, 1)).alias("n"),
        ).first()
        spare, rest = total - row["capped"], row["rest"]
        if row["n"] == clamped or not rest:
            break
        clamped = row["n"]
        # cap < weight * spare / rest, in integers wide enough not to round
        over = over | (
            F.col("cap").cast("decimal(38,0)") * F.lit(rest) < F.col("weight").cast("decimal(38,0)") * F.lit(spare)
        )
    share = (F.col("weight") * F.lit(spare)).cast("double") / F.lit(float(rest or 1))
    return table.select(
        "source", "source_size", "n_docs", F.when(over, F.col("cap").cast("double")).otherwise(share).alias("target")
    )


def decisions(
    docs: DataFrame,
    scratch: Scratch,
    weights: list[int] = [5, 2, 1],
    max_epochs: int = 3,
    seed: int = 17,
    bucket: int = 256,
    hot_rows: int = 1024,
    row: str | None = None,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every row of ``docs``, and its column ``row`` (long) if that is given.

    The fractional repetition is drawn in buckets of about ``bucket`` documents
    of one source (a hash of ``doc_id`` deals a source of any size over as many
    buckets as it needs). In a bucket, largest first, a document is taken when
    what the fraction still owes is above a seeded uniform share of its size:
    small documents make up for what large ones left, so a source's words stay
    near its target while every document can be drawn. ``copies`` is whole plus
    drawn repetitions, ``taken`` is ``copies * size``. Rows of an id that more than ``hot_rows`` rows share (or that
    have none) are numbered instead, and the fraction takes every so many of those that are alike.
    """
    own = F.lit(0).cast("long") if row is None else F.col(row).cast("long")
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), own.alias("row"))
    targets = scratch.table(source_targets(sized, weights, max_epochs, scratch), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    by = targets.select(
        F.col("source").alias("of"),
        "source_size",
        "target",
        F.floor(ratio).alias("whole"),
        (ratio - F.floor(ratio)).alias("fraction"),
        F.ceil(F.col("n_docs") / bucket).alias("buckets"),
    )
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    counts = sized.groupBy(F.col("doc_id").alias("hot")).agg(F.count("*").alias("n")).filter(F.col("n") > hot_rows)
    hot = scratch.table(counts, "hot-ids")
    shared = hot.agg(F.sum("n")).first()[0] or 0
    few = sized.join(hot, sized["doc_id"].eqNullSafe(hot["hot"]), "left_anti") if shared else sized
    marked = lambda rows: (
        rows.join(by, rows["source"].eqNullSafe(by["of"]))
        .drop("of")
        .withColumn("key", key)
        .withColumn("u", F.conv(F.substring("key", 9, 8), 16, 10).cast("double") / F.lit(2.0**32))
    )
    dealt = marked(few).withColumn("bucket", F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % F.col("buckets"))
    rows = F.sort_array(
        F.collect_list(F.struct((-F.col("size")).alias("largest"), "key", "doc_id", "size", "u", "row"))
    )

    def draw(acc: Column, x: Column) -> Column:
        owed = acc["owed"] + F.col("fraction") * x["size"]
        extra = F.when(owed > x["u"] * x["size"], F.lit(1)).otherwise(F.lit(0))
        return F.struct(
            (owed - extra * x["size"]).alias("owed"), F.concat(acc["extra"], F.array(extra)).alias("extra")
        )

    start = F.struct(F.lit(0.0).alias("owed"), F.array().cast("array<int>").alias("extra"))
    per_source = ["source_size", "target", "whole", "fraction"]
    drawn = (
        dealt.groupBy("source", "bucket", *per_source)
        .agg(rows.alias("rows"))
        .withColumn("extra", F.aggregate("rows", start, draw)["extra"])
        .select("source", *per_source, F.explode(F.arrays_zip("rows", "extra")).alias("x"))
    )
    copies = (F.col("whole") + F.col("x.extra")).cast("long")
    out = drawn.select(
        F.col("x.rows.doc_id").alias("doc_id"),
        "source",
        F.col("x.rows.size").alias("size"),
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("x.rows.size")).alias("taken"),
        F.col("x.rows.row").alias("row"),
    )
    named = (lambda x: x.drop("row")) if row is None else (lambda x: x.withColumnRenamed("row", row))
    if not shared:
        return named(out)
    many = marked(sized.join(hot, sized["doc_id"].eqNullSafe(hot["hot"]), "left_semi"))
    return named(out.unionByName(_numbered(many, shared, scratch).select(*out.columns)))


def _numbered(rows: DataFrame, count: int, scratch: Scratch, most: int = 100_000) -> DataFrame:
    """Decisions of rows that may be alike: equal ones are numbered, and the n-th is drawn when n fractions pass a whole number.

    They are numbered in parts of about ``most`` rows, each after the rows of the parts before it. Which
    part a row is in doesn't matter: the numbers, and so the decisions of equal rows, are the same.
    """
    alike = ["source", "doc_id", "size"]
    parts = max(8, -(-count // most))
    held = scratch.table(rows.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(parts))), "shared")
    sums = held.groupBy(*alike, "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*alike).orderBy("part")) - F.col("n")  # ``parts`` rows a group
    base = sums.select(*[F.col(c).alias(f"of_{c}") for c in (*alike, "part")], before.alias("base"))
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in (*alike, "part")]
    place = F.row_number().over(Window.partitionBy(*alike, "part").orderBy("key"))
    numbered = held.withColumn("place", place).join(base, same).withColumn("number", F.col("base") + F.col("place"))
    passed = lambda n: F.floor(n * F.col("fraction") + F.col("u"))
    copies = (F.col("whole") + passed(F.col("number")) - passed(F.col("number") - 1)).cast("long")
    return numbered.withColumn("copies", copies).withColumn("taken", copies * F.col("size"))


def mix(docs: DataFrame, scratch: Scratch, **settings) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it; columns unchanged.

    Rows get numbers (``docs`` is written with them), so that those that share a ``doc_id``, or have none, are taken
    each by its own decision. Which of such rows are taken, if they are of one source and size, may differ between runs.
    """
    times, row, of, copy = (free(c, docs.columns) for c in ("copies", "row", "row_of", "copy"))
    own = scratch.table(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    copies = decisions(own, scratch, row=row, **settings).filter("copies > 0")
    copies = copies.select(F.col(row).alias(of), F.col("copies").alias(times))
    return (
        own.join(copies, own[row] == copies[of])
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))))
        .select(*docs.columns)
    )
