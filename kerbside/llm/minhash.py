"""MinHash near-dedup with an LSH forest.

Documents are linked when the Jaccard similarity of their sets of word shingles
reaches ``threshold`` (0.75 by default, five words).

1. A document becomes a set of 64-bit shingle hashes, a fingerprint of the set and a
   MinHash signature. Documents with equal sets are one class from here on.
2. The forest: sorted orders of the classes, each by signature places that no other has. Orders are range-partitioned and sorted by Spark, so they
   spill and a hot region is cut between partitions. Neighbours in an order are
   candidates when their longest common prefix is at least the region's depth:
   ``depth`` places, and one more in a region of more than ``dense`` rows. There are
   as many orders as find a pair at the threshold in dense regions as surely as ``trees`` do elsewhere.
3. Candidates chain into blocks, and every link inside a block counts. Sets are compared
   exactly, by one matrix product of shingle incidences, in tiles of bounded size. A block beyond one tile is
   dealt over tiles, each with the same few of the block's documents beside its own: in a group of near
   copies that joins all tiles, and the work is linear. Only documents that this leaves outside
   their block's largest part are then compared with all others of the block, tile by tile. Only a
   spanning forest of the links leaves a tile.
4. Links are joined into components.

A pair at the threshold is missed when no tree has it. The defaults grow 57 trees of 5 places,
which are independent: ``(1 - 0.75**5)**57``, 2e-7, if all of its regions are dense, and
``(1 - 0.75**4)**57``, 4e-10, if none is; links found are exact.

Defined results: null texts and texts without words have an empty set and are
linked with nothing; a text of fewer than five words has one shingle, its whole word
sequence; rows that share a ``doc_id`` are judged each by its own text, and each is a row of the result; rows without
an id link others too, and their component is the smallest id it has (null if it has none); an empty table gives an empty
result.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbside.llm.components import connected_components
from kerbside.llm.scratch import Scratch
from kerbside.llm.text import U64, mix64, slices, window_hashes, words_of


@functools.cache
def _mixers(places: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(0xF0E57)
    multiply = rng.integers(0, 2**31, places).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    return multiply[:, None], rng.integers(0, 2**32, places).astype(np.uint32)[:, None]


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    words = [w.lower() for w in words_of(text)]
    return np.unique(window_hashes(words, min(size, len(words)))) if words else np.empty(0, U64)


def signature(shingles: np.ndarray, places: int) -> bytes:
    """``places`` 16-bit values."""
    multiply, xor = _mixers(places)
    h = (shingles >> U64(32)).astype(np.uint32)[None, :]
    least = np.full((places, 1), 2**32 - 1, np.uint32)
    for at in range(0, h.shape[1], 1024):
        x = (h[:, at : at + 1024] ^ xor) * multiply
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(least, x.min(axis=1, keepdims=True), out=least)
    # low values crowd at zero; the remainder is spread evenly
    return ((least[:, 0] * np.uint32(2654435761)) >> np.uint32(16)).astype("<u2").tobytes()


def _profiles(size: int, places: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n, key, sig = [], [], []
            for t in b.column(2).to_pylist():
                s = shingle_set(t, size)
                n.append(len(s))
                both = np.array([s.sum(dtype=U64), mix64(s + U64(0x9E3779B97F4A7C15)).sum(dtype=U64)], U64)
                key.append(both.tobytes() + len(s).to_bytes(8, "little") if len(s) else None)
                sig.append(signature(s, places) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())],
                ["doc_id", "text_key", "n_shingles", "set_key", "sig"],
            )

    return run


def grown(trees: int, depth: int, threshold: int) -> int:
    """How many trees miss a pair at the threshold at one place more no oftener than ``trees`` do at ``depth``."""
    share = min(max(threshold, 1), 99) / 100
    return max(trees, math.ceil(trees * math.log1p(-(share**depth)) / math.log1p(-(share ** (depth + 1)))))


def tree_orders(trees: int, depth: int) -> np.ndarray:
    """The signature places each tree sorts by: ``depth`` and one for dense regions, each of one tree only."""
    return np.arange(trees * (depth + 1)).reshape(trees, depth + 1)


def _orders(trees: int, depth: int):
    places = tree_orders(trees, depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2000):
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), "<u2").reshape(b.num_rows, -1).astype(U64)
            own = sig[:, places]  # rows, trees, levels
            first = np.zeros(own.shape[:2], U64)
            for i in range(depth):
                first = (first << U64(16)) | own[:, :, i]
            rest = own[:, :, depth]
            tree = np.broadcast_to(np.arange(trees, dtype=np.int32), first.shape)
            ids = np.repeat(b.column("id").to_numpy(), trees)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tree.ravel()), pa.array(first.ravel().view(np.int64)), pa.array(rest.ravel().view(np.int64)), pa.array(ids)],
                ["tree", "first", "rest", "id"],
            )

    return run


def _neighbours(dense: int):
    """Candidates between neighbours of the sorted orders, and each partition's first and last row.

    Dense regions must share ``rest`` too.
    The first and last rows (``edge`` true, ``a`` the row) let regions cut by partitions hang together.
    """

    def out(edge: bool, tree, first, a, b) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([edge] * len(a), pa.bool_()), pa.array(tree), pa.array(first), pa.array(a), pa.array(b)],
            ["edge", "tree", "first", "a", "b"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows held back: an open region of at most ``dense`` rows, or the last row of a larger one
        held, larger, last = None, False, None
        for b in batches:
            if not b.num_rows:
                continue
            rows = [b.column(c).to_numpy() for c in ("tree", "first", "rest", "id")]
            if last is None:
                yield out(True, *(x[:1] for x in (rows[0], rows[1], rows[3], rows[3])))
            else:
                rows = [np.concatenate([x, y]).astype(y.dtype) for x, y in zip(held, rows, strict=True)]
            last = [x[-1:] for x in rows]
            pairs, held, larger = close(rows, larger, False)
            yield pairs
        if last is not None:
            yield close(held, larger, True)[0]
            yield out(True, *(last[i] for i in (0, 1, 3, 3)))

    def close(rows: list[np.ndarray], larger: bool, end: bool) -> tuple[pa.RecordBatch, list[np.ndarray], bool]:
        """Candidates of the regions that end here; the rows to hold back, and whether their region is a larger one."""
        t, p, r, i = rows
        same = (t[1:] == t[:-1]) & (p[1:] == p[:-1])
        starts = np.flatnonzero(np.concatenate([[True], ~same]))
        n = np.diff(np.append(starts, len(t)))
        many = n > dense
        many[0] |= larger
        keep = int(starts[-1]) if not end and not many[-1] else len(t) - 1
        near = same & (~np.repeat(many, n)[1:] | (r[1:] == r[:-1]))
        near[keep:] = False  # an open region's rows come again
        x, y = i[:-1][near], i[1:][near]
        pairs = out(False, t[1:][near], p[1:][near], np.minimum(x, y), np.maximum(x, y))
        return pairs, [v[keep:].copy() for v in rows], bool(many[-1])

    return run


def _links(sets: list[np.ndarray], threshold: int, columns: int = 4096) -> np.ndarray:
    """Which pairs have ``100 * intersection >= threshold * union``: one product of incidences, in column blocks."""
    sizes = np.array([len(s) for s in sets])
    values, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = times > 1  # a shingle of one set meets no other
    column = np.cumsum(shared) - 1
    keep = shared[code]
    row, column = row[keep], column[code[keep]]
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(shared.sum()), columns):
        lo, hi = np.searchsorted(column, [at, at + columns])
        x = np.zeros((len(sets), columns), np.float32)
        x[row[lo:hi], column[lo:hi] - at] = 1
        both += x @ x.T
    both = both.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - both
    return 100 * both >= threshold * union


def _forest(ids: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each linked id with the smallest id of its component under ``linked``."""
    order = np.argsort(ids)
    ids, linked = ids[order], linked[np.ix_(order, order)]
    label = np.arange(len(ids))
    while True:
        low = np.where(linked, label[None, :], len(ids)).min(axis=1)
        low = np.minimum(low, label)
        low = low[low]
        if (low == label).all():
            break
        label = low
    moved = label != np.arange(len(ids))
    return ids[label[moved]], ids[moved]


def _tiles(size: int, threshold: int):
    """Over rows sorted by (block, x, y): links among the documents of each pair of tiles."""

    def solved(rows: dict[int, str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(list(rows), np.int64)
        return _forest(ids, _links([shingle_set(t, size) for t in rows.values()], threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, {}
        for b in slices(batches):
            a, c = [], []
            keys = zip(*(b.column(k).to_pylist() for k in ("block", "x", "y")), strict=True)
            for k, i, t in zip(keys, b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if k != key:
                    if len(rows) > 1:
                        p, q = solved(rows)
                        a.append(p)
                        c.append(q)
                    key, rows = k, {}
                rows.setdefault(i, t)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(c))], ["a", "b"])
        if len(rows) > 1:
            p, q = solved(rows)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q)], ["a", "b"])

    return run


def _block_links(dealt: DataFrame, compared, pivots: int, scratch: Scratch) -> DataFrame:
    """Links that join each block's documents (``id, block, tile, tiles``) as all of its links would.

    First each tile by itself, with ``pivots`` documents of its block. Two documents of one part need no further look;
    so what is left is every document outside its block's largest part against all documents of the block.
    """
    zero, every = F.lit(0).cast("long"), lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    single = dealt.filter("tiles = 1").select("id", "block", zero.alias("x"), zero.alias("y"))
    many = scratch.table(dealt.filter("tiles > 1"), "many")
    if many.isEmpty():
        return compared(single)
    place = F.row_number().over(Window.partitionBy("block").orderBy(F.xxhash64("id"), "id"))
    chosen = many.withColumn("place", place).filter(F.col("place") <= pivots).select("id", "block", every("tiles").alias("x"))
    own = many.select("id", "block", F.col("tile").alias("x")).unionByName(chosen).distinct()
    first = scratch.table(compared(single.unionByName(own.withColumn("y", F.col("x")))), "tile-links")
    parts = connected_components(first, scratch).toDF("id", "part")
    named = scratch.table(many.join(parts.hint("merge"), "id", "left").withColumn("part", F.coalesce("part", "id")), "parts")
    sizes = named.groupBy("block", "part").agg(F.count("*").alias("n"), F.first("tiles").alias("tiles"))
    largest = sizes.groupBy("block").agg(
        F.max_by("part", F.struct("n", "part")).alias("largest"), F.max("n").alias("most"), F.sum("n").alias("all"), F.first("tiles").alias("of")
    )
    left = F.ceil((F.col("all") - F.col("most")) * F.col("of") / F.col("all")).cast("long")
    open_ = largest.filter("most < all").select("block", "largest", left.alias("rests"))
    both = scratch.table(named.join(open_, "block"), "open")
    rest = both.filter("part <> largest").withColumn("x", F.pmod(F.xxhash64("id", F.lit(1)), F.col("rests")))
    rows = rest.select("id", "block", "x", every("tiles").alias("y")).unionByName(
        both.select("id", "block", every("rests").alias("x"), F.col("tile").alias("y"))
    )
    return first.unionByName(compared(rows.distinct()))


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def asked_for(texts: DataFrame, rows: DataFrame, most_words: int = 1 << 19) -> DataFrame:
    """The rows of ``texts`` whose ``doc_id, text_key`` ``rows`` has, and few others, so that a join moves little.

    ``rows`` become bits by a hash, 64 to a row of a broadcast table of at most ``most_words`` rows; beyond some
    millions of ``rows`` it lets more of the others through, never fewer of those asked for.
    """
    n = rows.count()
    bits = 64 * min(max(n // 2, 1), most_words)
    place = F.pmod(F.xxhash64("doc_id", "text_key", F.lit(64)), F.lit(bits))
    held = rows.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("slot"))
    held = held.agg(F.bit_or(F.expr("shiftleft(1L, int(place & 63))")).alias("bits"))
    met = texts.withColumn("place", place)
    bit = F.getbit("bits", F.col("place").bitwiseAND(F.lit(63)).cast("int"))
    there = (F.shiftright(met["place"], 6) == held["slot"]) & (bit == 1)
    return met.join(F.broadcast(held), there, "left_semi").drop("place")


def near_duplicates(docs: DataFrame, scratch: Scratch, **settings) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row; ``settings`` are those of ``components_of_rows``."""
    return components_of_rows(docs, scratch, **settings).drop("text_key")


def components_of_rows(
    docs: DataFrame,
    scratch: Scratch,
    words: int = 5,
    threshold: int = 75,
    trees: int = 40,
    depth: int = 4,
    dense: int = 64,
    tile_docs: int = 256,
    tile_shingles: int = 500_000,
    pivots: int = 16,
) -> DataFrame:
    """``doc_id, text_key, n_shingles, component_id`` of every row; ``threshold`` in hundredths.

    A row is known by its id and a hash of its text.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key(F.col("text")).alias("text_key"), "text")
    trees = grown(trees, depth, threshold)
    raw = texts.mapInArrow(
        _profiles(words, trees * (depth + 1)), "doc_id long, text_key long, n_shingles long, set_key binary, sig binary"
    )
    profiles = scratch.table(raw, "profiles")
    # a class is known by a number; its text is that of the row with the smallest id
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "sig", "n_shingles")
    classes = profiles.filter("set_key is not null").groupBy("set_key").agg(F.min(first).alias("x"))
    classes = classes.select("set_key", "x.doc_id", "x.text_key", "x.sig", "x.n_shingles")
    classes = scratch.table(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    repeated = not profiles.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    orders = classes.select("id", "sig").mapInArrow(
        _orders(trees, depth), "tree int, first long, rest long, id long"
    )
    found = scratch.table(
        orders.repartitionByRange(max(parts, 2), "tree", "first", "rest", "id")
        .sortWithinPartitions("tree", "first", "rest", "id")
        .mapInArrow(
            _neighbours(dense), "edge boolean, tree int, first long, a long, b long"
        ),
        "neighbours",
    )
    cut = found.filter("edge").groupBy("tree", "first").agg(F.min("a").alias("low"), F.collect_set("a").alias("b"))
    candidates = found.filter("not edge").select("a", "b").unionByName(
        cut.select(F.col("low").alias("a"), F.explode("b").alias("b")).filter("a <> b")
    )
    blocks = connected_components(candidates.distinct(), scratch).toDF("id", "block")
    blocks = scratch.table(
        blocks.join(classes.select("id", "n_shingles"), "id"), "blocks"
    )
    sizes = scratch.table(
        blocks.groupBy("block")
        .agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
        .select("block", F.greatest(F.ceil(F.col("n") / tile_docs), F.ceil(F.col("s") / tile_shingles)).alias("tiles")),
        "block-sizes",
    )
    dealt = blocks.join(sizes.hint("merge"), "block").withColumn(
        "tile", F.when(F.col("tiles") > 1, F.pmod(F.xxhash64("id"), F.col("tiles"))).otherwise(F.lit(0))
    )
    dealt = scratch.table(dealt.select("id", "block", "tile", "tiles"), "dealt")

    def compared(rows: DataFrame) -> DataFrame:
        """Links among the documents of each (block, x, y)."""
        own = rows.join(classes.select("id", F.col("doc_id").alias("of"), F.col("text_key").alias("key")).hint("merge"), "id")
        own = scratch.table(own, "compared")
        some = asked_for(texts, own.select(F.col("of").alias("doc_id"), F.col("key").alias("text_key")))
        if repeated:
            some = some.dropDuplicates(["doc_id", "text_key"])  # a class has one row to compare
        same = some["doc_id"].eqNullSafe(own["of"]) & (some["text_key"] == own["key"])
        of = some.join(own.hint("merge"), same).select("id", "text", "block", "x", "y")
        return (
            of.repartition(parts, "block", "x", "y")
            .sortWithinPartitions("block", "x", "y")
            .mapInArrow(_tiles(words, threshold), "a long, b long")
        )

    links = _block_links(dealt, compared, pivots, scratch)
    labels = connected_components(links, scratch).toDF("id", "component")
    linked = scratch.table(classes.select("id", "set_key", "doc_id").join(labels.hint("merge"), "id", "left"), "linked")
    linked = linked.withColumn("component", F.coalesce("component", "id"))
    least = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = scratch.table(linked.join(least.hint("merge"), "component").select("set_key", "component_id"), "named")
    return (
        profiles.select("doc_id", "text_key", "n_shingles", "set_key")
        .join(named.hint("merge"), "set_key", "left")
        .select("doc_id", "text_key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    )


def keep_one(docs: DataFrame, scratch: Scratch, **settings) -> DataFrame:
    """The documents that stay: of each component those with its smallest ``doc_id``; rows without an id stay.

    A row is judged by its own text: of rows that share an id, those go whose text another, smaller id has too.
    """
    parts = components_of_rows(docs, scratch, **settings)
    gone = parts.filter("doc_id <> component_id").select(F.col("doc_id").alias("gone"), "text_key").distinct()
    same = (docs["doc_id"].cast("long") == gone["gone"]) & (_text_key(docs["text"]) == gone["text_key"])
    return docs.join(gone, same, "left_anti")
