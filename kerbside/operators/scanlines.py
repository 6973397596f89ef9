"""Zones of a raster by scanlines: no pixel is tested against an edge.

A shape meets each row of pixels it reaches in a few intervals, found from where its edges cross the row's middle. Sums
over an interval are differences of running sums, which each row of the raster has by parts of ``size`` columns.
Work grows with the shapes' heights and the raster, not with the pixels that shapes hold.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.operators.blocks import Grid
from kerbside.operators.geometry import bounds, segments
from kerbside.operators.spatial import edge_join
from kerbside.ship import ship


def intervals(shapes: DataFrame, columns: Sequence[str], grid: Grid) -> DataFrame:
    """``columns, row, c0, c1``: the columns (half-open) of each row whose centres a shape (``rings``) holds, holes left out."""
    to_row = lambda y: (grid.y0 - y) / grid.dy - 0.5
    first = F.greatest(F.ceil(to_row(F.col("y1"))), F.lit(0)).cast("int")
    last = F.least(F.floor(to_row(F.col("y0"))), F.lit(grid.height - 1)).cast("int")
    boxed = shapes.withColumns(bounds(F.col("rings"))).withColumns({"_first": first, "_last": last}).filter("_first <= _last")
    edges = boxed.select(*columns, "_first", "_last", segments(F.col("rings"), closed=True).alias("_e"))
    rows = edges.withColumn("row", F.explode(F.sequence("_first", "_last")))
    y = grid.y0 - (F.col("row") + 0.5) * grid.dy

    def at(e: Column) -> Column:
        """Where an edge crosses the row's middle."""
        p, q = e["p"], e["q"]
        return (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]

    spans = F.filter("_e", lambda e: (e["p"]["y"] > y) != (e["q"]["y"] > y))
    col = lambda x: F.least(F.greatest(F.ceil((x - grid.x0) / grid.dx - 0.5), F.lit(0)), F.lit(grid.width)).cast("int")
    crossed = rows.select(*columns, "row", F.array_sort(F.transform(spans, at)).alias("_x"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("_x") / 2).cast("int") - 1), lambda i: F.struct(col(F.col("_x")[2 * i]).alias("c0"), col(F.col("_x")[2 * i + 1]).alias("c1")))
    out = crossed.filter(F.size("_x") >= 2).select(*columns, "row", F.explode(pairs).alias("i"))
    return out.select(*columns, "row", "i.c0", "i.c1").filter("c0 < c1")


def running_rows(pixels: DataFrame, value: str, size: int = 256) -> DataFrame:
    """``row, part, total, seen``: sums and counts of the valid values before each column of a part of a row."""
    ship(pixels.sparkSession)
    held = pixels.filter(F.col(value).isNotNull()).groupBy("row", F.floor(F.col("col") / size).cast("int").alias("part"))
    held = held.agg(F.collect_list(F.struct((F.col("col") % size).cast("int").alias("at"), F.col(value).cast("double").alias("v"))).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            totals, seen = [], []
            for i in range(b.num_rows):
                cells = b.column("cells").slice(i, 1).flatten()
                v, n = np.zeros(size + 1), np.zeros(size + 1, np.int64)
                at = cells.field("at").to_numpy() + 1
                np.add.at(v, at, cells.field("v").to_numpy())
                np.add.at(n, at, 1)
                totals.append(np.cumsum(v))
                seen.append(np.cumsum(n))
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("part"), pa.array(totals, pa.list_(pa.float64())), pa.array(seen, pa.list_(pa.int64()))], ["row", "part", "total", "seen"]
            )

    return held.mapInArrow(run, "row int, part int, total array<double>, seen array<long>")


def zonal(shapes: DataFrame, pixels: DataFrame, key: str, value: str, grid: Grid, size: int = 256) -> DataFrame:
    """``key, mean, total, cells`` of the valid pixels (``row, col`` of ``grid``) whose centre each shape holds; count 0 is missing."""
    asked = intervals(shapes.select(key, "rings"), [key], grid)
    parts = F.sequence(F.floor(F.col("c0") / size).cast("int"), F.floor((F.col("c1") - 1) / size).cast("int"))
    asked = asked.withColumn("part", F.explode(parts))
    lo = F.greatest(F.col("c0") - F.col("part") * size, F.lit(0)).cast("int")
    hi = F.least(F.col("c1") - F.col("part") * size, F.lit(size)).cast("int")
    met = asked.withColumns({"lo": lo, "hi": hi}).join(running_rows(pixels, value, size), ["row", "part"])
    inside = lambda c: F.col(c)[F.col("hi")] - F.col(c)[F.col("lo")]
    got = met.groupBy(key).agg(F.sum(inside("total")).alias("total"), F.sum(inside("seen")).alias("cells")).filter("cells > 0")
    got = got.select(key, (F.col("total") / F.col("cells")).alias("mean"), "total", "cells")
    return shapes.select(key).join(got, key, "left").withColumn("cells", F.coalesce("cells", F.lit(0).cast("long")))


def rasterized(units: DataFrame, grid: Grid, unit: str, order: str) -> DataFrame:
    """``row, col, unit`` of the pixels whose centre a unit holds; of several the last by ``order``."""
    held = intervals(units, [unit, order], grid).select("row", F.explode(F.sequence(F.col("c0"), F.col("c1") - 1)).alias("col"), unit, order)
    return held.groupBy("row", "col").agg(F.max_by(unit, order).alias(unit))


def nested_buffers(lines: DataFrame, pixels: DataFrame, key: str, value: str, radii: Sequence[float], path: str = "path") -> DataFrame:
    """``key`` and ``mean_<i>, cells_<i>`` of the valid pixels (``x, y``) within the i-th radius of each path, for all radii in one pass.

    Pixels meet paths once, at the widest radius; a pixel adds to the ring of its distance, and every radius sums the rings it holds.
    """
    edges = lines.select(key, F.explode(segments(F.array(path), closed=False)).alias("e"))
    edges = edges.select(key, *[F.col(f"e.{end}.{c}").alias(f"{end}{c}") for end in "pq" for c in "xy"])
    cells = pixels.select("x", "y", value).filter(F.col(value).isNotNull())
    near = edge_join(cells, edges, max(radii), [key]).groupBy(key, "x", "y").agg(F.min("d").alias("d"), F.first(value).alias("v"))
    order = sorted(radii)
    ring = F.lit(0)
    for r in order[:-1]:
        ring = ring + (F.col("d") > r).cast("int")
    rings = near.groupBy(key, ring.alias("ring")).agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    out = []
    for i, r in enumerate(radii):
        within = F.col("ring") <= order.index(r)
        n = F.coalesce(F.sum(F.when(within, F.col("n"))), F.lit(0))
        out += [(F.sum(F.when(within, F.col("s"))) / F.nullif(n, F.lit(0))).alias(f"mean_{i}"), n.alias(f"cells_{i}")]
    got = rings.groupBy(key).agg(*out)
    zero = {f"cells_{i}": F.coalesce(f"cells_{i}", F.lit(0).cast("long")) for i in range(len(radii))}
    return lines.select(key).join(got, key, "left").withColumns(zero)
