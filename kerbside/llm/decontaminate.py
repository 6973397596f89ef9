"""Benchmark decontamination: a prefix-filtered set join, with DataFrame functions only.

A window is ``window`` consecutive words of a benchmark item (an item with fewer words, but not none, is one
window). A window is the set of its shingles with their places. Its prefix is its rarest shingle in the documents: a
document without it can't hold the window, and a window with a shingle that no document has is dropped at once. Where
a document has a prefix, the window's place in the document follows from the shingle's place in the window; it must
lie inside the document (length and position), and then the shingles that cover the window must be at their places.
Shingles are compared by their words, so nothing hangs on a hash.

Everything but the first pass works on what documents share with the benchmark. That pass looks each shingle of a
document up in a broadcast table of at most ``most_shingles`` shingles of bounded size; more shingles are looked
up in as many passes as they fill tables. A document is known by the SHA-256 of its text, so copies are judged once.

Defined results: null and empty texts, and texts without words, have no words and no hit; rows that share a
``doc_id`` (or have none) are judged each by its own text; rows that share an ``item_id`` are one item; the windows of
rows without an ``item_id`` hit words, but are no item that counts or is listed. Without items nothing is hit; without
documents the result is empty. Extra columns take no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbside.llm.scratch import Scratch

#: What lies between words, in texts that may have capitals: all of ASCII but letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of a shingle that is held as it is; a longer one is held as its SHA-256.
_HELD = 200


def _split(text: Column) -> Column:
    """Words of a text; splitting between them takes a fraction of the time of matching each."""
    return F.array_remove(F.split(text, BETWEEN), "")


def _words(text: Column) -> Column:
    return _split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER))


def _text_key(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _exploded(df: DataFrame, keep: list[str], size: int) -> DataFrame:
    """``keep``, ``at`` (from 0), ``shingle``: every ``size`` consecutive ``words`` of each row."""
    n = F.greatest(F.size("words") - (size - 1), F.lit(0))
    shifted = F.arrays_zip(*[F.slice("words", F.lit(k + 1), n) for k in range(size)])
    rows = df.filter(F.size("words") >= size).select(*keep, F.posexplode(shifted).alias("at", "w"))
    text = F.concat_ws(" ", *[F.col("w")[str(k)] for k in range(size)])
    return rows.select(*keep, "at", F.lit(size).alias("size"), text.alias("shingle"))


def _held(shingle: Column) -> Column:
    return F.when(F.octet_length(shingle) > _HELD, F.sha2(shingle, 256)).otherwise(shingle)


def item_windows(items: DataFrame, window: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """``window, length, words`` of each distinct window, ``window, item_id`` of the items that hold it, and the number
    of windows of all items."""
    words = items.select("item_id", _words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(window))
    places = F.explode(F.sequence(F.lit(1), F.size("words") - n + 1))
    each = words.select("item_id", "words", n.alias("length"), places.alias("at")).select(
        "item_id", "length", F.array_join(F.slice("words", F.col("at"), F.col("length")), " ").alias("text")
    )
    count = words.agg(F.sum(F.size("words") - n + 1)).first()[0] or 0
    each = scratch.table(each.distinct(), "item-windows", count)
    distinct = each.select("text", "length").distinct().withColumn("window", F.monotonically_increasing_id())
    distinct = scratch.table(distinct, "windows", count)  # written, so that numbers stay
    members = each.filter(F.col("item_id").isNotNull()).join(distinct.drop("length"), "text").select("window", "item_id")
    members = scratch.table(members, "members", count)
    return distinct.select("window", "length", F.split("text", " ").alias("words")), members, count


def _window_shingles(windows: DataFrame, sizes: list[int], shingle: int) -> DataFrame:
    """``window, length, at, size, shingle``: windows shorter than a shingle are one shingle."""
    of = lambda s: F.col("length") >= s if s == shingle else F.col("length") == s
    return reduce(DataFrame.unionByName, [_exploded(windows.filter(of(s)), ["window", "length"], s) for s in sizes])


def shared_shingles(docs: DataFrame, shingles: DataFrame, sizes: list[int], most: int, scratch: Scratch) -> DataFrame:
    """``key, n, at, size, id`` of each benchmark shingle in each distinct text of ``docs(text)``.

    ``shingles(id, size, held)`` is looked up in blocks of about ``most`` rows of at most 200 bytes of text each.
    """
    texts = docs.select(_text_key(F.col("text")).alias("key"), _words(F.col("text")).alias("words"))
    texts = texts.select("key", "words", F.size("words").alias("n"))
    hashed = lambda c: F.xxhash64("size", c)
    table = shingles.select("id", "held", hashed("held").alias("hash"), F.col("size").alias("of_size"))
    blocks = max(1, -(-shingles.count() // most))
    out = []
    for b in range(blocks):
        block = table.filter(F.pmod("hash", F.lit(blocks)) == b)
        for s in sizes:
            rows = _exploded(texts, ["key", "n"], s).withColumn("held", _held(F.col("shingle"))).drop("shingle")
            rows = rows.withColumn("hash", hashed("held")).withColumnRenamed("held", "own")
            own = block.filter(F.col("of_size") == s).drop("of_size")
            met = rows.join(F.broadcast(own), (rows["hash"] == own["hash"]) & (rows["own"] == own["held"]))
            out.append(met.select("key", "n", "at", "size", "id"))
    return scratch.table(reduce(DataFrame.unionByName, out).distinct(), "shared")


def _hits(
    docs: DataFrame, windows: DataFrame, count: int, shingle: int, most_shingles: int, scratch: Scratch
) -> tuple[DataFrame, int]:
    """``key, start, length, window`` of every occurrence of one of ``count`` windows in a distinct text, and the number
    of places looked at: each has one occurrence at most."""
    sizes = sorted({min(r["length"], shingle) for r in windows.select("length").distinct().collect()})  # one row a length
    if not sizes:
        return scratch.spark.createDataFrame([], "key binary, start int, length int, window long"), 0
    of = _window_shingles(windows, sizes, shingle).withColumn("held", _held(F.col("shingle"))).drop("shingle")
    of = scratch.table(of, "window-shingles")
    rows = of.count()
    shingles = of.select("size", "held").distinct().withColumn("id", F.monotonically_increasing_id())
    shingles = scratch.table(shingles, "shingles", rows)
    of = scratch.table(of.join(shingles, ["size", "held"]).select("window", "length", "at", "size", "id"), "numbered", rows)
    shared = shared_shingles(docs, shingles, sizes, most_shingles, scratch)

    counts = shared.groupBy("id").agg(F.count("*").alias("count"))
    ranked = of.join(counts, "id", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    rarest = ranked.groupBy("window", "length").agg(F.min(F.struct("count", "at", "id")).alias("first"))
    alive = scratch.table(rarest.filter("first.count > 0").select("window", "length", "first.at", "first.id"), "prefixes", count)
    # several windows may have one prefix at one place: it is asked for once
    prefixes = alive.select("id", "length", F.col("at").alias("offset")).distinct()
    start = F.col("at") - F.col("offset")
    places = (
        shared.select("key", "n", "at", "id")
        .join(prefixes, "id")
        .filter((start >= 0) & (start + F.col("length") <= F.col("n")))
        .select("key", start.alias("start"), "length")
        .distinct()
    )
    places = scratch.table(places, "places", shared.count())

    size = F.least("length", F.lit(shingle))
    cover = F.array_distinct(  # places of shingles that have every word of a window among them
        F.concat(F.sequence(F.lit(0), F.col("length") - size, size), F.array(F.col("length") - size))
    )
    wanted = places.select("key", "start", "length", size.alias("size"), F.explode(cover).alias("o"))
    wanted = wanted.withColumn("at", F.col("start") + F.col("o"))
    found = (
        wanted.join(shared.select("key", "at", "size", "id"), ["key", "at", "size"])
        .groupBy("key", "start", "length")
        .agg(F.array_sort(F.collect_list(F.struct("o", "id"))).alias("cover"))  # a few to each window
    )
    signed = (
        of.join(alive.select("window"), "window", "left_semi")
        .filter(F.array_contains(cover, F.col("at")))
        .groupBy("window", "length")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("at").alias("o"), "id"))).alias("cover"))
    )
    return found.join(signed, ["length", "cover"]).select("key", "start", "length", "window"), places.count()


def contamination(
    docs: DataFrame, items: DataFrame, scratch: Scratch, window: int = 10, shingle: int = 5, most_shingles: int = 500_000
) -> DataFrame:
    """``doc_id, n_words, n_hit, item_ids`` for every row of ``docs(doc_id, text)`` against ``items(item_id, text)``.

    ``n_hit`` is the number of words inside any occurrence of an item's window, ``item_ids`` the sorted ids (as strings)
    of items with a window in the text.
    """
    windows, members, count = item_windows(items, window, scratch)
    hits, places = _hits(docs, windows, count, shingle, most_shingles, scratch)
    hits = scratch.table(hits, "hits", places)
    end = F.col("start") + F.col("length")
    before = Window.partitionBy("key").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("key", "start", "length").distinct()
    reached = F.coalesce(F.max(end).over(before), F.lit(0))
    fresh = spans.withColumn("fresh", F.greatest(end - F.greatest(F.col("start"), reached), F.lit(0)))
    covered = fresh.groupBy("key").agg(F.sum("fresh").alias("n_hit"))
    held = hits.select("key", "window").distinct().join(members, "window").select("key", "item_id").distinct()
    named = held.groupBy("key").agg(F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("item_ids"))
    found = scratch.table(covered.join(named, "key", "left"), "found", places)
    n_words = F.size(_split(F.coalesce("text", F.lit(""))))
    rows = docs.select("doc_id", _text_key(F.col("text")).alias("key"), n_words.cast("long").alias("n_words"))
    return rows.join(found, "key", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )
