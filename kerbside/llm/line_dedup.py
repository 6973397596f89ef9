"""Line dedup through a sharded minimal perfect hash.

A line's key is the line stripped of ASCII white space with ``A-Z`` lower-cased.
Keys of ``min_chars`` code points or more that ``min_docs`` documents or more hold
are dropped everywhere but in the document with the largest ``doc_id``.

1. Each document sends its distinct line hashes; one aggregate (with map-side
   combine) gives each hash's document count and largest document.
2. Hashes that reach ``min_docs`` are dealt into shards by hash. A shard is a minimal
   perfect hash with three arrays at its numbers: a 64-bit fingerprint (a second
   hash of the line, so no other line passes), the count and the document that keeps
   the line. Shards hold about ``shard_keys`` keys, so there are more of them as
   the corpus grows, and each is a few MB.
3. Documents probe: a document sends each shard its hashes once. A shard is
   copied to ``copies`` partitions and probes go to one of them by ``doc_id``, so a
   line of a third of all documents is spread; probes are streamed past the
   shard in memory and nothing is grouped.
4. Hits, the lines to drop, are gathered by document and taken out of the text.

Defined results: a null or empty text is one empty line and stays an empty text.
Rows that share a ``doc_id`` count as one document; rows without an id keep all their lines.
Other columns are kept; those named as the two counts (``counts``) are replaced. An empty table
gives no rows; texts of any length are whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.llm.perfect_hash import PerfectHash
from kerbside.llm.scratch import Scratch
from kerbside.llm.text import U64, free, hash_bytes, slices

_STRIP = b" \t\n\x0b\x0c\r"


def line_keys(text: str | None, min_chars: int) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text, and the key of each that is long enough."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    keys: list[bytes | None] = []
    for x in lines:
        key = x.strip(_STRIP).lower()
        long = len(key) >= min_chars and (
            len(key) >= 4 * min_chars or len(key.decode("utf-8", "surrogatepass")) >= min_chars
        )
        keys.append(key if long else None)
    return lines, keys


def _hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each key: the one that places it, and the fingerprint."""
    mark = [hashlib.blake2b(k, digest_size=8).digest() for k in keys]
    return hash_bytes(keys), np.frombuffer(b"".join(mark), "<u8").astype(U64)


def _lines_out(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            docs, keys = [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = {k for k in line_keys(t, min_chars)[1] if k is not None}
                keys += own
                docs += [d] * len(own)
            h, f = _hashes(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(h.view(np.int64)), pa.array(f.view(np.int64))],
                ["doc_id", "h", "f"],
            )

    return run


def _build_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard to one row a shard."""

    def made(shard: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        h = t.column("h").to_numpy().view(np.uint64)
        mph = PerfectHash.build(h)
        at, n = mph.lookup(h), mph.n
        arrays = []
        for name, kind in (("f", "<i8"), ("n", "<i8"), ("keeper", "<i8")):
            a = np.zeros(n, kind)
            a[at] = t.column(name).to_numpy()
            arrays.append(a)
        counts = np.minimum(arrays[1], 2**32 - 1).astype("<u4")
        values = [mph.to_bytes(), arrays[0].tobytes(), counts.tobytes(), arrays[2].tobytes()]
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32())] + [pa.array([v], pa.binary()) for v in values],
            ["shard", "mph", "marks", "counts", "keepers"],
        )

    shard, parts = None, []
    for b in batches:
        own = b.column("shard").to_numpy()
        cuts = np.flatnonzero(np.diff(own)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(own)], strict=True):
            if lo == hi:
                continue
            if own[lo] != shard and parts:
                yield made(shard, parts)
                parts = []
            shard = int(own[lo])
            parts.append(b.slice(lo, hi - lo))
    if parts:
        yield made(shard, parts)


def _probe(min_docs: int):
    """Over rows sorted by shard, the shard's own row first: the hits among the probes that follow it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            first = np.flatnonzero(b.column("mph").is_valid().to_numpy(zero_copy_only=False))
            edges = [*([] if len(first) and first[0] == 0 else [0]), *first, b.num_rows]
            docs, h, f = (b.column(c).fill_null(0).to_numpy() for c in ("doc_id", "h", "f"))
            hits = []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if b.column("mph")[lo].is_valid:
                    held = (
                        PerfectHash.from_bytes(b.column("mph")[lo].as_py()),
                        np.frombuffer(b.column("marks")[lo].as_py(), "<i8"),
                        np.frombuffer(b.column("counts")[lo].as_py(), "<u4"),
                        np.frombuffer(b.column("keepers")[lo].as_py(), "<i8"),
                    )
                    lo += 1
                mph, marks, counts, keepers = held  # a shard without its row would be a fault, not an empty result
                at = mph.lookup(h[lo:hi].view(np.uint64))
                known = np.flatnonzero(at >= 0)
                at, own = at[known], known + lo
                drop = (marks[at] == f[own]) & (counts[at] >= min_docs) & (keepers[at] != docs[own])
                hits.append(own[drop])
            own = np.concatenate(hits) if hits else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x[own]) for x in (docs, h, f)], ["doc_id", "h", "f"])

    return run


def lines_to_drop(
    docs: DataFrame,
    scratch: Scratch,
    min_chars: int = 20,
    min_docs: int = 3,
    shard_keys: int = 50_000,
    least_copies: int = 16,
) -> DataFrame:
    """``doc_id, h, f``: the hashes of the lines that each document loses."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    lines = scratch.table(ids.mapInArrow(_lines_out(min_chars), "doc_id long, h long, f long"), "lines")
    common = scratch.table(
        lines.distinct()
        .groupBy("h", "f")
        .agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
        .filter(F.col("n") >= min_docs)
        # two lines with one placing hash and different fingerprints: the hash can't place both
        .groupBy("h")
        .agg(F.collect_list(F.struct("f", "n", "keeper")).alias("x")),
        "common",
    )
    shards = max(1, math.ceil(common.count() / shard_keys))
    copies = max(least_copies, math.ceil(2 * parts / shards))
    shard = F.pmod(F.shiftright("h", 17), F.lit(shards)).cast("int").alias("shard")
    arrays = (
        common.filter(F.size("x") == 1)
        .select(shard, "h", F.col("x")[0]["f"].alias("f"), F.col("x")[0]["n"].alias("n"), F.col("x")[0]["keeper"].alias("keeper"))
        .repartition(parts, "shard")
        .sortWithinPartitions("shard")
        .mapInArrow(_build_shards, "shard int, mph binary, marks binary, counts binary, keepers binary")
    )
    index = scratch.table(arrays, "index")
    blobs = ["mph", "marks", "counts", "keepers"]
    asked = lines.select(
        shard,
        F.pmod(F.xxhash64("doc_id"), F.lit(copies)).cast("int").alias("copy"),
        F.lit(1).alias("later"),
        "doc_id",
        "h",
        "f",
        *[F.lit(None).cast("binary").alias(c) for c in blobs],
    )
    told = index.select(
        "shard",
        F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"),
        F.lit(0).alias("later"),
        *[F.lit(None).cast("long").alias(c) for c in ("doc_id", "h", "f")],
        *blobs,
    )
    # shards without a common line have no row and nothing to drop
    asked = asked.join(F.broadcast(index.select("shard")), "shard", "left_semi") if shards <= 100_000 else asked
    hits = (
        told.unionByName(asked)
        .repartition(max(parts, min(shards * copies, 4 * parts)), "shard", "copy")
        .sortWithinPartitions("shard", "copy", "later")
        .mapInArrow(_probe(min_docs), "doc_id long, h long, f long")
    )
    # colliding placing hashes (about keys**2 / 2**65) are settled by an equal join of their own
    odd = common.filter(F.size("x") > 1).select("h", F.explode("x").alias("x")).select("h", "x.*")
    more = lines.join(odd, ["h", "f"]).filter("keeper <> doc_id").select("doc_id", "h", "f")
    return hits.unionByName(more).distinct()


def _cut(at_text: int, at_lines: int, min_chars: int, names: list[str]):
    """Takes the listed lines out of each text; text and counts come last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            kept, n_lines, n_dropped = [], [], []
            for text, drop in zip(b.column(at_text).to_pylist(), b.column(at_lines).to_pylist(), strict=True):
                if not drop:
                    kept.append(text or "")
                    n_lines.append((text or "").count("\n") + 1)
                    n_dropped.append(0)
                    continue
                lines, keys = line_keys(text, min_chars)
                own = [(i, k) for i, k in enumerate(keys) if k is not None]
                h, f = _hashes([k for _, k in own])
                gone = {(x["h"], x["f"]) for x in drop}
                out = {
                    i
                    for (i, _), x, y in zip(own, h.view(np.int64).tolist(), f.view(np.int64).tolist(), strict=True)
                    if (x, y) in gone
                }
                rest = b"\n".join(x for i, x in enumerate(lines) if i not in out)
                kept.append(rest.decode("utf-8", "surrogatepass"))
                n_lines.append(len(lines))
                n_dropped.append(len(out))
            cols = [c for i, c in enumerate(b.columns) if i not in (at_text, at_lines)]
            cols += [pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def drop_common_lines(
    docs: DataFrame,
    scratch: Scratch,
    min_chars: int = 20,
    min_docs: int = 3,
    counts: tuple[str, str] = ("_n_lines", "_n_dropped"),
    **sizes,
) -> DataFrame:
    """``docs`` with ``text`` shortened, and with the numbers of lines before and of dropped lines under ``counts``."""
    docs = docs.drop(*counts)
    lines, of = free("lines", docs.columns), free("lines_of", docs.columns)
    gone = (
        lines_to_drop(docs, scratch, min_chars, min_docs, **sizes)
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("h", "f")).alias(lines))
        .withColumnRenamed("doc_id", of)
    )
    joined = docs.join(gone, docs["doc_id"].cast("long") == gone[of], "left").drop(of)
    fields = [f for f in joined.schema.fields if f.name not in ("text", lines)]
    fields += [T.StructField("text", T.StringType()), *(T.StructField(c, T.LongType()) for c in counts)]
    names = joined.columns
    cut = _cut(names.index("text"), names.index(lines), min_chars, [f.name for f in fields])
    return joined.mapInArrow(cut, T.StructType(fields)).select(*docs.columns, *counts)
