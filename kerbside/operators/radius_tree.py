"""How many places lie within a radius of many points, without meeting each of them.

The places are cut into tiles as in ``nearest_tree``, and each tile is known by its box and its number of places. A tile wholly
within the radius of a point is added as it is, one wholly beyond it is left out, and only those that the circle
crosses are asked; a tile does the same with its nodes, and only places of nodes that the circle crosses are measured. So a point's work grows with
the length of its circle, not with what lies in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.operators.nearest_tree import TOGETHER, Boxes, _arrow_schema, _floats, _joined, _least, _most, answered, tiles_of
from kerbside.scratch import Scratch

#: Places in a node; points that ask a tile in one task; nodes whose places are measured together.
NODE, ASKING, MEASURED = 16, 50_000, 65_536
#: What distances to boxes may be off by rounding: boxes so near to the radius are looked into.
_TINY = 1e-12


def _split(tiles: np.ndarray, boxes: Boxes, sums: np.ndarray, radius: float, schema: pa.Schema):
    """For each point the places of the tiles wholly within the radius (``tile`` -1), and a row for each tile that its circle crosses."""
    whole, within, reach = _joined(boxes, TOGETHER), radius * (1 - _TINY), radius * (1 + _TINY)
    of = np.add.reduceat(sums, np.arange(0, len(sums), TOGETHER))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = _floats(b, "x y")
            inner = np.zeros(len(x), np.int64)
            for c in range(len(of)):
                box, lo = tuple(v[c] for v in whole), c * TOGETHER
                full = _most(x, y, box) <= within
                inner[full] += of[c]
                near = np.flatnonzero(~full & (_least(x, y, box) <= reach))
                if not len(near):
                    continue
                some = tuple(v[None, lo : lo + TOGETHER] for v in boxes)
                full = _most(x[near, None], y[near, None], some) <= within
                inner[near] += full @ sums[lo : lo + TOGETHER]
                q, t = np.nonzero(~full & (_least(x[near, None], y[near, None], some) <= reach))
                if len(q):
                    yield out(x[near[q]], y[near[q]], tiles[lo + t], np.zeros(len(q), np.int64))
            some = inner > 0
            yield out(x[some], y[some], np.full(some.sum(), -1), inner[some])

    def out(*columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, schema.types, strict=True)], schema=schema)

    return run


class Counted:
    """Places packed into nodes by strips, each known by its box and its number of places."""

    def __init__(self, places: pa.Table):
        x, y, n = *_floats(places, "x y"), places.column("n").to_numpy()
        strip = np.empty(len(x), np.int64)
        strip[np.argsort(x, kind="stable")] = np.arange(len(x)) // max(1, int(np.sqrt(len(x) * NODE)))
        order = np.lexsort((y, strip))
        x, y, n = x[order], y[order], n[order]
        self.boxes = _joined((x, y, x, y), NODE)
        self.sums = np.add.reduceat(n, np.arange(0, len(n), NODE))
        # the last node is filled up with places that are near nothing
        more = (0, -len(x) % NODE)
        self.x, self.y, self.n = (np.pad(v, more, constant_values=c).reshape(-1, NODE) for v, c in ((x, np.inf), (y, np.inf), (n, 0)))

    def within(self, x: np.ndarray, y: np.ndarray, radius: float, together: int = 256) -> np.ndarray:
        """How many places are within the radius (inclusive) of each point; near points are looked at together."""
        within, reach, total = radius * (1 - _TINY), radius * (1 + _TINY), np.zeros(len(x), np.int64)
        strip = np.empty(len(x), np.int64)
        strip[np.argsort(x, kind="stable")] = np.arange(len(x)) // max(1, int(np.sqrt(len(x) * together)))
        order = np.lexsort((y, strip))
        x0, y0, x1, y1 = self.boxes
        for lo in range(0, len(x), together):
            q = order[lo : lo + together]
            u, v = x[q], y[q]
            gap = np.hypot(np.maximum(np.maximum(x0 - u.max(), u.min() - x1), 0), np.maximum(np.maximum(y0 - v.max(), v.min() - y1), 0))
            full = np.hypot(np.maximum(u.max() - x0, x1 - u.min()), np.maximum(v.max() - y0, y1 - v.min())) <= within
            total[q] += self.sums[full].sum()
            nodes = np.flatnonzero(~full & (gap <= reach))
            some = tuple(b[None, nodes] for b in self.boxes)
            full = _most(u[:, None], v[:, None], some) <= within
            total[q] += full @ self.sums[nodes]
            at, node = np.nonzero(~full & (_least(u[:, None], v[:, None], some) <= reach))
            for part in range(0, len(at), MEASURED):
                a, k = at[part : part + MEASURED], nodes[node[part : part + MEASURED]]
                hit = np.hypot(u[a, None] - self.x[k], v[a, None] - self.y[k]) <= radius
                np.add.at(total, q[a], np.where(hit, self.n[k], 0).sum(axis=1))
        return total


def count_within(points: DataFrame, places: DataFrame, radius: float, scratch: Scratch, tile_rows: int = 32_768) -> DataFrame:
    """``x, y, n``: how many of ``places`` (``x, y`` and their number ``n``, each place once) are within ``radius`` of each of ``points``
    (``x, y``, each once); no row where there are none. Coordinates must be finite. Points are dealt by the tiles that their circles cross.
    """
    places = scratch.table(places.select("x", "y", "n"), "places")
    tiled = tiles_of(places, F.col("x"), F.col("y"), ["x", "y"], tile_rows, scratch)
    edges = [f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in "xy"]
    table = tiled.groupBy("tile").agg(*edges, F.sum("n").alias("n")).orderBy("tile").toArrow()  # a row a tile
    counted = "x double, y double, n long"
    if not table.num_rows:
        return places.limit(0)
    asks = "x double, y double, tile long, n long"
    run = _split(table.column("tile").to_numpy(), tuple(_floats(table, "min_x min_y max_x max_y")), table.column("n").to_numpy(), radius, _arrow_schema(points.sparkSession, asks))
    asked = scratch.table(points.select("x", "y").mapInArrow(run, asks), "asked")

    def solve(held: pa.Table, some: pa.Table) -> pa.Table:
        if not held.num_rows or not some.num_rows:
            return schema.empty_table()
        x, y = _floats(some, "x y")
        return pa.table([x, y, Counted(held).within(x, y, radius)], schema=schema)

    schema = _arrow_schema(points.sparkSession, counted)
    crossed = answered(tiled, asked.filter("tile >= 0").drop("n"), ["x", "y"], solve, counted, scratch, ASKING)
    return asked.filter("tile < 0").select("x", "y", "n").unionByName(crossed).groupBy("x", "y").agg(F.sum("n").alias("n")).filter("n > 0")
