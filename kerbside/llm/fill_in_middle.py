"""Fill-in-middle transformation: documents cut at line ends and put together again with marks.

Units are rows: the matches of a line in each text are exploded with their place, a window sums their lengths, the
cuts that a document asks for meet those sums by place, and an aggregate brings both offsets to the document, whose
text is then cut by ``substring``. Only lengths move between tasks until then. A document is known by its id and the
SHA-256 of its text: rows alike in both have the same cuts, so their units are counted once.

Defined results: null texts are empty; an empty text, and one that contains a mark, stays plain; rows that share a
``doc_id`` draw alike and are each cut by their own text; rows without an id draw as ``null``. An empty table stays
empty. Other columns, whatever their names, are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbside.llm.text import free

UNIT = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _draw(digest: Column, i: int) -> Column:
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def _cuts(rows: DataFrame) -> DataFrame:
    """``key, prefix_end, middle_end``: code points before each cut of ``rows(key, lengths, first, last)``.

    Cuts after no unit are not in the result if both are; the units of a row after its last cut take no part.
    """
    asked = rows.filter("last > 0")
    units = asked.select("key", F.posexplode(F.slice("lengths", F.lit(1), F.col("last"))).alias("at", "length"))
    units = units.groupBy("key", (F.col("at") + 1).alias("unit")).agg(F.min("length").alias("length"))  # of alike rows
    so_far = Window.partitionBy("key").orderBy("unit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = units.select("key", "unit", F.sum(F.col("length").cast("long")).over(so_far).alias("end"))
    requests = asked.groupBy("key").agg(F.min("first").alias("first"), F.min("last").alias("last"))
    requests = requests.withColumnRenamed("key", "of")
    asks = (F.col("unit") == F.col("first")) | (F.col("unit") == F.col("last"))
    met = ends.join(requests.hint("merge"), (ends["key"] == requests["of"]) & asks)
    at = lambda c: F.coalesce(F.max(F.when(F.col("unit") == F.col(c), F.col("end"))), F.lit(0))
    return met.groupBy("key").agg(at("first").alias("prefix_end"), at("last").alias("middle_end"))


def transform(docs: DataFrame, rate: int = 100, spm: int = 50, seed: int = 7) -> DataFrame:
    """``docs`` with ``n, form, prefix_chars, middle_chars, output, restored`` (names that are taken get underscores).

    ``rate`` percent of documents are cut, ``spm`` percent of these with the suffix first. ``restored`` is put together from ``output`` and
    ``form`` alone.
    """
    names = [free(x, docs.columns) for x in ("n", "form", "prefix_chars", "middle_chars", "output", "restored")]
    own = {x: free(x, [*docs.columns, *names]) for x in ("key", "whole", "first", "last", "form0", "prefix_end", "middle_end")}
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    key = F.unhex(F.sha2(F.concat(digest, text), 256))
    n = F.regexp_count(text, F.lit(UNIT))
    a, b = (F.pmod(_draw(digest, i), (n + 1).cast("long")) for i in (0, 1))
    marked = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(text, F.lit(m))
    plain = (text == "") | marked | (_draw(digest, 2) % 100 >= rate)
    form = F.when(plain, "plain").when(_draw(digest, 3) % 100 < spm, "spm").otherwise("psm")
    drawn = docs.select(
        "*",
        key.alias(own["key"]),
        n.cast("long").alias(names[0]),
        form.alias(names[1]),
    )
    units = F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))
    asked = docs.filter(~plain).select(
        key.alias("key"),
        F.transform(units, F.length).alias("lengths"),
        F.least(a, b).cast("int").alias("first"),
        F.greatest(a, b).cast("int").alias("last"),
    )
    cuts = _cuts(asked).toDF("key", own["prefix_end"], own["middle_end"]).withColumnRenamed("key", own["whole"])
    joined = drawn.join(cuts, drawn[own["key"]] == cuts[own["whole"]], "left")
    start, end = (F.coalesce(own[c], F.lit(0)).cast("int") for c in ("prefix_end", "middle_end"))
    prefix, middle = F.substring(text, F.lit(1), start), F.substring(text, start + 1, end - start)
    suffix = F.substring(text, end + 1, F.length(text))
    shape, out = F.col(names[1]), F.col(names[4])
    output = (
        F.when(shape == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(shape == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(text)
    )
    joined = joined.select(
        *[joined[c] for c in docs.columns],
        names[0],
        names[1],
        F.when(shape != "plain", start.cast("long")).alias(names[2]),
        F.when(shape != "plain", (end - start).cast("long")).alias(names[3]),
        output.alias(names[4]),
    )
    return joined.withColumn(names[5], restored(out, shape))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of. Texts hold no mark, so the first of each is the one that was put in."""
    size = len(PREFIX)  # of each mark
    after = lambda x, m: F.substring(x, F.instr(x, m) + size, F.length(x))
    upto = lambda x, m: F.substring(x, F.lit(1), F.instr(x, m) - 1)
    middle = after(output, MIDDLE)
    psm = F.concat(upto(after(output, PREFIX), SUFFIX), middle, upto(after(output, SUFFIX), MIDDLE))
    spm = F.concat(upto(after(output, PREFIX), MIDDLE), middle, upto(after(output, SUFFIX), PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
