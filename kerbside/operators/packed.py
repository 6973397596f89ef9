"""Ranks and quantiles of many series at once, over rows packed into blocks of numpy arrays.

A block is one row of a table: some thousand rows of a panel as binary columns. A function turns a block
into a matrix of one row for each of its rows and one column for each series, which is never stored: series are
cheap to compute again and dear to move. Spark deals blocks, moves what has to meet, and counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from kerbside.scratch import Scratch

Block = dict[str, object]
Matrix = Callable[[Block], np.ndarray]
#: Cells of 0..1 that bracket a quantile in the first pass, and rows of a series that meet in one task.
CELLS, RANGE_ROWS = 256, 1_000_000


def blocks_of(batch: pa.RecordBatch) -> Iterator[Block]:
    for r in range(batch.num_rows):
        yield {n: batch.column(n)[r].as_py() for n in batch.schema.names}


def array(block: Block, name: str, kind: str = "<f8", columns: int | None = None) -> np.ndarray:
    """A binary column of a block as an array, or as a matrix of so many columns."""
    x = np.frombuffer(block[name], kind)
    return x if columns is None else x.reshape(-1, columns)


def pack(df: DataFrame, key: str, columns: Sequence[str], rows: int = 4096) -> DataFrame:
    """``block long, n int, ids binary, years binary, x binary``: ``key`` and ``year``, and ``columns`` as one matrix."""
    names = list(columns)
    dealt = df.select(F.col(key).cast("long").alias("id"), F.col("year").cast("int").alias("year"), *[F.col(c).cast("double").alias(c) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            for lo in range(0, b.num_rows, rows):
                some = b.slice(lo, rows)
                x = np.stack([some.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1).astype("<f8")
                ids, years = some.column("id").to_numpy().astype("<i8"), some.column("year").to_numpy().astype("<i4")
                values = [number, some.num_rows, ids.tobytes(), years.tobytes(), np.ascontiguousarray(x).tobytes()]
                kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["block", "n", "ids", "years", "x"])
                number += 1

    return dealt.mapInArrow(run, "block long, n int, ids binary, years binary, x binary")


# ---- ranks ----


def _values(matrix: Matrix, cuts: np.ndarray):
    """Of each block, series and range: the distinct values in ascending order and how many rows have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in blocks_of(b):
                out = []
                for j, x in enumerate(matrix(block).T):
                    v, n = np.unique(x[~np.isnan(x)], return_counts=True)
                    at = np.searchsorted(v, cuts[j], side="left") if len(cuts) else []
                    edges = [0, *at, len(v)]
                    out += [(j, r, block["block"], v[lo:hi].tobytes(), n[lo:hi].astype("<i4").tobytes(), int(n[lo:hi].sum())) for r, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if hi > lo]
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
                cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
                yield pa.RecordBatch.from_arrays(cols, ["series", "range", "block", "v", "n", "rows"])

    return run


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (series, range): each block's distinct values as percentile ranks, ties averaged."""

    def made(rows: list[Block]) -> pa.RecordBatch:
        parts = [array(r, "v") for r in rows]
        v, of = np.unique(np.concatenate(parts), return_inverse=True)
        n = np.bincount(of, weights=np.concatenate([array(r, "n", "<i4") for r in rows])).astype(np.int64)
        pct = (rows[0]["below"] + np.cumsum(n) - n + (n + 1) / 2) / rows[0]["all"]
        ends = np.cumsum([0, *map(len, parts)])
        out = [pct[of[lo:hi]].tobytes() for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
        cols = [pa.array([r[c] for r in rows], k) for c, k in (("block", pa.int64()), ("series", pa.int32()), ("range", pa.int32()))]
        return pa.RecordBatch.from_arrays([*cols, pa.array(out, pa.binary())], ["block", "series", "range", "pct"])

    key, rows = None, []
    for b in batches:
        for row in blocks_of(b):
            if (row["series"], row["range"]) != key and rows:
                yield made(rows)
                rows = []
            key = (row["series"], row["range"])
            rows.append(row)
    if rows:
        yield made(rows)


def _cuts(blocks: DataFrame, matrix: Matrix, ranges: int, most: int = 64) -> np.ndarray:
    """Values that cut each series into about equal ranges, from at most ``most`` blocks: they only deal the work."""
    if ranges < 2:
        return np.empty((0, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = np.arange(1, ranges) / ranges
        for b in batches:
            for block in blocks_of(b):
                x = np.nanquantile(matrix(block), q, axis=0).T
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], ["x"])

    total = blocks.count()
    some = blocks.filter(F.pmod(F.xxhash64("block"), F.lit(1 << 20)) <= int(min(1.0, most / max(1, total)) * (1 << 20)))
    found = [np.frombuffer(r["x"], "<f8").reshape(-1, ranges - 1) for r in some.limit(2 * most).mapInArrow(run, "x binary").collect()]
    return np.nanmedian(np.stack(found), axis=0) if found else np.empty((0, 0))


def with_ranks(blocks: DataFrame, matrix: Matrix, finish, schema: str, scratch: Scratch, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``finish(block, ranks)`` of every block, as a table of ``schema``: ``ranks`` has the percentile rank of each
    element of ``matrix(block)`` among its series in all blocks, ties averaged; missing elements have none.

    Only distinct values and their counts move, so a value that many rows have is one entry a block. A series with
    more rows than ``range_rows`` is ranked in ranges, which its rows are cut into by value, plus the counts of lower ranges.
    """
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = blocks.agg(F.sum("n")).first()[0] or 0
    cuts = _cuts(blocks, matrix, -(-rows // range_rows))
    values = scratch.table(
        blocks.mapInArrow(_values(matrix, cuts), "series int, range int, block long, v binary, n binary, rows long"), "values"
    )
    sums = values.groupBy("series", "range").agg(F.sum("rows").alias("s"))
    totals = sums.groupBy("series").agg(F.sum("s").alias("all"), F.collect_list(F.struct("range", "s")).alias("of"))  # a row a range
    lower = F.aggregate(F.filter("of", lambda x: x["range"] < F.col("range")), F.lit(0).cast("long"), lambda a, x: a + x["s"])
    places = sums.join(totals, "series").select("series", "range", "all", lower.alias("below"))
    ranked = (
        values.join(places, ["series", "range"])
        .repartition(parts, "series", "range")
        .sortWithinPartitions("series", "range", "block")
        .mapInArrow(_ranked, "block long, series int, range int, pct binary")
    )
    own = [f for f in blocks.schema.fields if f.name != "block"]
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in own]
    told = blocks.select("block", F.lit(-1).alias("series"), F.lit(0).alias("range"), F.lit(None).cast("binary").alias("pct"), *[f.name for f in own])
    both = told.unionByName(ranked.select("block", "series", "range", "pct", *empty))
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    own_names = [f.name for f in blocks.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Over rows sorted by (block, series, range): the block, then the ranks of its distinct values."""
        block, found = None, {}

        def close() -> pa.RecordBatch:
            x = matrix(block)
            out = np.full(x.shape, np.nan)
            for j, pct in found.items():
                ok = ~np.isnan(x[:, j])
                out[ok, j] = np.concatenate(pct)[np.unique(x[ok, j], return_inverse=True)[1]]
            return pa.RecordBatch.from_arrays(finish(block, out), names)

        for b in batches:
            for r in range(b.num_rows):
                series = b.column("series")[r].as_py()
                if series < 0:
                    if block is not None:
                        yield close()
                    block, found = {n: b.column(n)[r].as_py() for n in own_names}, {}
                else:
                    found.setdefault(series, []).append(np.frombuffer(b.column("pct")[r].as_py(), "<f8"))
        if block is not None:
            yield close()

    return both.repartition(parts, "block").sortWithinPartitions("block", "series", "range").mapInArrow(run, schema)


# ---- quantiles ----


def _counted(matrix: Matrix, series: int):
    """How many elements of each series fall into each cell of 0..1, over all blocks of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((series, CELLS), np.int64)
        for b in batches:
            for block in blocks_of(b):
                x = matrix(block)
                cell = np.clip((np.nan_to_num(x) * CELLS).astype(np.int64), 0, CELLS - 1) + np.arange(series) * CELLS
                n += np.bincount(cell[~np.isnan(x)], minlength=series * CELLS).reshape(series, CELLS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n.ravel()[at])], ["cell", "n"])

    return run


def _within(matrix: Matrix, wanted: np.ndarray):
    """The elements of the wanted cells, with their series and cell, each value once a block with its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in blocks_of(b):
                x = matrix(block)
                cell = np.clip((np.nan_to_num(x) * CELLS).astype(np.int64), 0, CELLS - 1)
                i, j = np.nonzero(wanted[np.arange(x.shape[1]), cell] & ~np.isnan(x))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(j * CELLS + cell[i, j]), pa.array(x[i, j])], ["cell", "v"]
                )

    return run


def _chosen(places: dict[int, list[int]]):
    """Over rows sorted by (cell, v) with counts ``n``: the values at the wanted places of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, seen = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            c, v, n = (b.column(k).to_numpy() for k in ("cell", "v", "n"))
            starts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            out = []
            for lo, hi in zip(starts, [*starts[1:], len(c)], strict=True):
                before = seen if c[lo] == cell else 0
                ends = before + np.cumsum(n[lo:hi])
                p = np.asarray(places[int(c[lo])])
                p = p[(p >= before) & (p < ends[-1])]
                out.append((np.full(len(p), c[lo]), p, v[lo + np.searchsorted(ends, p, side="right")]))
                cell, seen = c[lo], int(ends[-1])
            cols = [np.concatenate(x) for x in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["cell", "place", "v"])

    return run


def series_quantiles(blocks: DataFrame, matrix: Matrix, series: int, q: Sequence[float]) -> np.ndarray:
    """Exact linearly interpolated quantiles of each series, whose elements lie in 0..1: ``series`` rows, a column for each q.

    The first pass counts cells, and Spark finds those that hold a wanted order statistic: at most two a series and quantile reach
    the driver. The second pass sorts the elements of those cells alone. No element reaches the driver but the quantiles.
    """
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = blocks.mapInArrow(_counted(matrix, series), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    counted = counted.withColumn("series", F.floor(F.col("cell") / CELLS))
    own = Window.partitionBy("series")  # at most CELLS rows
    below = F.sum("n").over(own.orderBy("cell")) - F.col("n")
    counted = counted.withColumns({"below": below, "total": F.sum("n").over(own)})
    holds = F.lit(False)
    for x in q:
        for end in (F.floor, F.ceil):
            place = end(F.lit(float(x)) * (F.col("total") - 1))
            holds = holds | ((place >= F.col("below")) & (place < F.col("below") + F.col("n")))
    held = counted.filter(holds).select("series", "cell", "below", "n", "total").toArrow()
    of, cells, below, n, total = (held.column(c).to_numpy() for c in ("series", "cell", "below", "n", "total"))
    all_, before = np.zeros(series, np.int64), dict(zip(cells.tolist(), below.tolist(), strict=True))
    all_[of] = total
    wanted, places = np.zeros((series, CELLS), bool), {}
    wanted.ravel()[cells] = True
    at = np.asarray(q)[None, :] * (all_ - 1)[:, None]
    ends = np.stack([np.floor(at), np.ceil(at)]).astype(np.int64)
    for j, cell, lo, count in zip(of.tolist(), cells.tolist(), below.tolist(), n.tolist(), strict=True):
        places[cell] = [p - lo for p in np.unique(ends[:, j]).tolist() if lo <= p < lo + count]
    rows = blocks.mapInArrow(_within(matrix, wanted), "cell long, v double").groupBy("cell", "v").agg(F.count("*").alias("n"))
    chosen = rows.repartition(parts, "cell").sortWithinPartitions("cell", "v").mapInArrow(_chosen(places), "cell long, place long, v double")
    found = {(r["cell"] // CELLS, before[r["cell"]] + r["place"]): r["v"] for r in chosen.collect()}
    out = np.full((series, len(q)), np.nan)
    for j in np.flatnonzero(all_):
        for i in range(len(q)):
            lo, hi = found[j, int(ends[0, j, i])], found[j, int(ends[1, j, i])]
            out[j, i] = lo + (at[j, i] - ends[0, j, i]) * (hi - lo)
    return out
