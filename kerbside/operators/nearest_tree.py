"""Nearest search that follows the density of the targets.

A tree of half-planes, fitted on a bounded sample, cuts the targets into tiles of about equal numbers: a dense centre is
many tiles, a desert is one. Each tile is known by the box of what it holds, a table of at most ``MOST_TILES`` rows and a quarter more
whatever the size of the targets. A point first asks the tile whose furthest corner is nearest, which gives a distance;
then it asks the tiles whose boxes are no further than that. So every point is done after two rounds, and no
radius has to be guessed. In a tile, pieces are packed into a tree of boxes that is searched best first. Tiles that
very many points ask are held by several tasks, each with a share of the points.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.scratch import Scratch

#: Most tiles the tree has; targets seen by it for each tile; pieces in a node; points that ask a tile in one task.
MOST_TILES, SEEN, NODE, ASKING = 32_768, 16, 16, 500_000
#: Most parts a long piece is indexed by; tiles whose boxes are looked at together.
MOST_PARTS, TOGETHER = 4096, 64
#: Bits of a tile's number below that of its group of targets.
GROUP = 50

Boxes = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


class Halves:
    """Half-planes that cut a sample into leaves of at most ``size`` places, numbered so that neighbours are near."""

    def __init__(self, places: np.ndarray, size: int):
        self.axis, self.at, self.low, self.high, self.leaf = [], [], [], [], []
        self.leaves = 0
        open_ = [(places, None)]
        while open_:
            own, link = open_.pop()
            node = len(self.axis)
            if link:
                link[0][link[1]] = node
            extent = np.ptp(own, axis=0) if len(own) else np.zeros(2)
            if len(own) <= size or not extent.max():
                self._add(0, 0.0, self.leaves)
                self.leaves += 1
                continue
            axis = int(extent.argmax())
            v = own[:, axis]
            at = np.sort(v)[(len(v) - 1) // 2]
            at = at if at < v.max() else v[v < at].max()
            self._add(axis, at, -1)
            open_ += [(own[v > at], (self.high, node)), (own[v <= at], (self.low, node))]
        self.axis, self.at, self.low, self.high, self.leaf = (np.array(x) for x in (self.axis, self.at, self.low, self.high, self.leaf))

    def _add(self, axis: int, at: float, leaf: int) -> None:
        for held, v in zip((self.axis, self.at, self.low, self.high, self.leaf), (axis, at, 0, 0, leaf), strict=True):
            held.append(v)

    def leaf_of(self, places: np.ndarray) -> np.ndarray:
        node = np.zeros(len(places), np.int64)
        while True:
            inner = np.flatnonzero(self.leaf[node] < 0)
            if not len(inner):
                return self.leaf[node]
            own = node[inner]
            low = places[inner, self.axis[own]] <= self.at[own]
            node[inner] = np.where(low, self.low[own], self.high[own])


def _least(x, y, boxes: Boxes) -> np.ndarray:
    x0, y0, x1, y1 = boxes
    return np.hypot(np.maximum(np.maximum(x0 - x, x - x1), 0), np.maximum(np.maximum(y0 - y, y - y1), 0))


def _most(x, y, boxes: Boxes) -> np.ndarray:
    x0, y0, x1, y1 = boxes
    return np.hypot(np.maximum(x - x0, x1 - x), np.maximum(y - y0, y1 - y))


def _joined(boxes: Boxes, n: int) -> Boxes:
    """The boxes of every n in a row."""
    at = np.arange(0, len(boxes[0]), n)
    return tuple((np.minimum if i < 2 else np.maximum).reduceat(v, at) for i, v in enumerate(boxes))


def _floats(b, names: str) -> list[np.ndarray]:
    return [np.asarray(b.column(n).to_numpy(zero_copy_only=False) if isinstance(b, pa.RecordBatch) else b.column(n).to_numpy(), float) for n in names.split()]


def _asked(tiles: np.ndarray, boxes: Boxes, first: bool, schema: pa.Schema):
    """Rows for the tile that each point asks first, or for the others that its distance so far leaves open; each group of tiles apart."""
    groups = []
    for own in np.split(np.arange(len(tiles)), np.flatnonzero(np.diff(tiles >> GROUP)) + 1):
        part = tuple(v[own] for v in boxes)
        whole = _joined(part, TOGETHER)
        groups.append((tiles[own], part, [tuple(v[c] for v in whole) for c in range(len(whole[0]))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = _floats(b, "x y")
            for names, part, coarse in groups:
                if first:
                    yield out(b, np.arange(len(x)), nearest(x, y, names, part, coarse))
                else:
                    own = b.column("tile").to_numpy()
                    rows = np.flatnonzero(own >> GROUP == names[0] >> GROUP)
                    for q, tile in open_(x[rows], y[rows], _floats(b, "d")[0][rows], names, part, coarse):
                        other = tile != own[rows[q]]
                        if other.any():
                            yield out(b, rows[q[other]], tile[other])

    def nearest(x, y, names, part, coarse) -> np.ndarray:
        bound = np.full(len(x), np.inf)
        for box in coarse:
            np.minimum(bound, _most(x, y, box), out=bound)
        best, tile = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
        for near, lo, some in met(x, y, bound, part, coarse):
            d = _most(x[near, None], y[near, None], some)
            at = d.argmin(axis=1)
            d = d[np.arange(len(near)), at]
            better = d < best[near]
            best[near[better]], tile[near[better]] = d[better], names[lo + at[better]]
        return tile

    def open_(x, y, bound, names, part, coarse) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for near, lo, some in met(x, y, bound, part, coarse):
            q, t = np.nonzero(_least(x[near, None], y[near, None], some) <= bound[near, None] * (1 + 1e-12))
            yield near[q], names[lo + t]

    def met(x, y, bound, part, coarse) -> Iterator[tuple[np.ndarray, int, Boxes]]:
        for c, box in enumerate(coarse):
            near = np.flatnonzero(_least(x, y, box) <= bound * (1 + 1e-12))
            if len(near):
                lo = c * TOGETHER
                yield near, lo, tuple(v[None, lo : lo + TOGETHER] for v in part)

    def out(b: pa.RecordBatch, rows: np.ndarray, tile: np.ndarray) -> pa.RecordBatch:
        held = b.select(["x", "y"]).take(pa.array(rows))
        return pa.RecordBatch.from_arrays([*held.columns, pa.array(tile, pa.int64())], schema=schema)

    return run


class Packed:
    """Pieces packed into nodes by strips of their middles."""

    def __init__(self, pieces: pa.Table):
        ax, ay, bx, by = _floats(pieces, "ax ay bx by")
        mx, my, n = ax + bx, ay + by, len(ax)
        strip = np.empty(n, np.int64)
        strip[np.argsort(mx, kind="stable")] = np.arange(n) // max(1, int(np.sqrt(n * NODE)))
        order = np.lexsort((my, strip))
        self.starts = np.arange(0, n, NODE)
        self.n = np.diff(np.append(self.starts, n))
        reach = (np.minimum(ax, bx), np.minimum(ay, by), np.maximum(ax, bx), np.maximum(ay, by))
        self.boxes = _joined(tuple(v[order] for v in reach), NODE)
        self.ends = [v[order] for v in _floats(pieces, "px py qx qy")]
        ranks = pc.rank(pieces.column("target"), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
        self.rank = ranks[order]
        self.row = np.empty(int(ranks.max()) + 1, np.int64)
        self.row[ranks] = np.arange(n)  # a row of each rank

    def distance(self, x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
        px, py, qx, qy = (v[at] for v in self.ends)
        dx, dy = qx - px, qy - py
        square = dx * dx + dy * dy
        t = np.clip(((x - px) * dx + (y - py) * dy) / np.where(square > 0, square, 1.0), 0, 1)
        return np.hypot(x - (px + t * dx), y - (py + t * dy))

    def search(self, x: np.ndarray, y: np.ndarray, together: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """The row of the nearest piece's target, and the distance."""
        far, none = np.full(len(x), np.inf), np.iinfo(np.int64).max
        rank = np.full(len(x), none)
        strip = np.empty(len(x), np.int64)
        strip[np.argsort(x, kind="stable")] = np.arange(len(x)) // max(1, int(np.sqrt(len(x) * together)))
        order = np.lexsort((y, strip))
        for lo in range(0, len(x), together):
            q = order[lo : lo + together]
            u, v = x[q], y[q]
            x0, y0, x1, y1 = self.boxes
            gap = np.hypot(np.maximum(np.maximum(x0 - u.max(), u.min() - x1), 0), np.maximum(np.maximum(y0 - v.max(), v.min() - y1), 0))
            reach = np.hypot(np.maximum(u.max() - x0, x1 - u.min()), np.maximum(v.max() - y0, y1 - v.min())).min()
            nodes = np.flatnonzero(gap <= reach * (1 + 1e-12))
            least = _least(u[:, None], v[:, None], tuple(b[None, nodes] for b in self.boxes))
            turn = np.argsort(least, axis=1)
            for k in range(len(nodes)):
                near = least[np.arange(len(q)), turn[:, k]] <= far[q] * (1 + 1e-12)
                if not near.any():
                    break
                own, node = q[near], nodes[turn[near, k]]
                at = self.starts[node][:, None] + np.arange(NODE)[None, :]
                held = np.arange(NODE)[None, :] < self.n[node][:, None]
                at = np.where(held, at, self.starts[node][:, None])
                d = self.distance(x[own, None], y[own, None], at)
                low = d.min(axis=1)
                r = np.where(d == low[:, None], self.rank[at], none).min(axis=1)
                better = (low < far[own]) | ((low == far[own]) & (r < rank[own]))
                far[own[better]], rank[own[better]] = low[better], r[better]
        return self.row[rank], far


def _solved(schema: pa.Schema):
    def solve(pieces: pa.Table, points: pa.Table) -> pa.Table:
        if not pieces.num_rows or not points.num_rows:
            return schema.empty_table()
        x, y = _floats(points, "x y")
        row, d = Packed(pieces).search(x, y)
        held = [points.column(n).combine_chunks() for n in ("x", "y", "tile")]
        return pa.Table.from_arrays([*held, pieces.column("target").combine_chunks().take(pa.array(row)), pa.array(d)], schema=schema)

    return solve


def tiles_of(rows: DataFrame, x: Column, y: Column, own: list[str], tile_rows: int, scratch: Scratch, most_tiles: int = MOST_TILES) -> DataFrame:
    """``rows`` (a table) with the ``tile`` that the place ``x, y`` is in; places of too many rows are cut by a hash of the columns ``own``."""
    total = rows.count()
    if total <= tile_rows:
        return rows.withColumn("tile", F.pmod(F.xxhash64(*own), F.lit(1)))  # one tile, but no constant: joins by it stay equal joins
    wanted = min(most_tiles, -(-total // tile_rows))
    placed = rows.withColumns({"_x": x, "_y": y})
    seen = placed.select("_x", "_y").sample(min(1.0, SEEN * wanted / total), 7).toArrow()  # bounded by the tiles
    halves = Halves(np.stack(_floats(seen, "_x _y"), axis=1), max(1, -(-seen.num_rows // wanted)))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = halves.leaf_of(np.stack(_floats(b, "_x _y"), axis=1))
            held = b.select(names)
            yield pa.RecordBatch.from_arrays([*held.columns, pa.array(leaf, pa.int64())], [*held.schema.names, "leaf"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    names = rows.columns
    rows = scratch.table(placed.mapInArrow(dealt, f"{columns}, leaf long"), "dealt")
    # a leaf that is much larger than the sample told (equal middles) is cut by hash
    most = 4 * max(tile_rows, -(-total // wanted))
    subs = rows.groupBy("leaf").agg(F.ceil(F.count("*") / most).alias("subs"))
    tiled = rows.join(F.broadcast(subs), "leaf")  # a row a leaf
    return scratch.table(tiled.withColumn("tile", F.shiftleft("leaf", 32) + F.pmod(F.xxhash64(*own), F.col("subs"))).drop("leaf", "subs"), "tiles")


def answered(tiled: DataFrame, asked: DataFrame, own: list[str], solve, ddl: str, scratch: Scratch, asking: int | None = None) -> DataFrame:
    """Points at their tiles; a tile that many ask is copied, and its points are dealt over the copies by a hash of the columns ``own``."""
    copies = asked.groupBy("tile").agg(F.ceil(F.count("*") / (asking or ASKING)).alias("copies"))
    copies = scratch.table(copies, "copies")
    left = tiled.join(F.broadcast(copies), "tile").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).drop("copies")
    right = asked.join(F.broadcast(copies), "tile").withColumn("copy", F.pmod(F.xxhash64(*own), F.col("copies"))).drop("copies")
    return left.groupBy("tile", "copy").cogroup(right.groupBy("tile", "copy")).applyInArrow(solve, ddl)


def nearest_pieces(points: DataFrame, pieces: DataFrame, key: str, target: str, scratch: Scratch, tile_rows: int = 8192) -> DataFrame:
    """``key, target, d``: the nearest of ``pieces`` (``target, px, py, qx, qy``) for each of ``points`` (``key, x, y``).

    Equal distances go to the smaller target; a missing target is the smallest. Rows that share a key are one point of several
    places; points of one place are searched for once (``points`` is read twice). Rows with a missing or infinite coordinate take no part;
    without pieces or points the result is empty.
    Long pieces are indexed by parts of at most four times the mean extent, which are a quarter more rows at most.
    """
    q = points.select(F.col(key).alias("key"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter(_finite("x y"))
    near = nearest_of_groups(q.select("x", "y").distinct(), pieces.withColumn("grp", F.lit(0)), target, 1, scratch, tile_rows)
    found = q.join(near, ["x", "y"]).groupBy("key").agg(F.min(F.struct("d", "target")).alias("m"))
    return scratch.table(found.select(F.col("key").alias(key), F.col("m.target").alias(target), "m.d"), "found")


def _finite(names: str) -> Column:
    """Of NaN and null false too."""
    return functools.reduce(operator.and_, [F.abs(F.col(c)) < float("inf") for c in names.split()])


def nearest_of_groups(places: DataFrame, pieces: DataFrame, target: str, groups: int, scratch: Scratch, tile_rows: int = 8192) -> DataFrame:
    """``x, y, grp, target, d``: the nearest piece of each group (``grp``, from 0 to below ``groups``) for each of ``places`` (``x, y``, finite, each once).

    All groups are searched in the same two rounds. A group without pieces has no rows; the groups share the tiles' bound.
    """
    spark = places.sparkSession
    ends = ["px", "py", "qx", "qy"]
    p = pieces.select(F.col("grp").cast("int").alias("grp"), F.col(target).alias("target"), *[F.col(c).cast("double").alias(c) for c in ends]).filter(_finite("px py qx qy"))
    p = p.groupBy("grp", *ends).agg(F.min(F.struct("target")).alias("t")).select("grp", *ends, "t.target")
    p = scratch.table(p.withColumn("extent", F.greatest(F.abs(F.col("px") - F.col("qx")), F.abs(F.col("py") - F.col("qy")))), "pieces")
    n, mean = p.agg(F.count("*"), F.avg("extent")).first()
    kind = p.schema["target"].dataType.simpleString()
    if not n:
        return p.limit(0).select(F.col("px").alias("x"), F.col("py").alias("y"), "grp", "target", F.col("qx").alias("d"))

    # parts of pieces: a tile is that of a part's middle, its box is that of its parts
    cut = F.least(F.lit(MOST_PARTS), F.greatest(F.lit(1), F.ceil(F.col("extent") / (4 * mean)))) if mean else F.lit(1)
    p = p.withColumn("of", cut.cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    along = lambda c, i: F.when(F.col("of") == 1, F.col(f"{'q' if i else 'p'}{c}")).otherwise(
        F.col(f"p{c}") + (F.col(f"q{c}") - F.col(f"p{c}")) * ((F.col("i") + i) / F.col("of"))
    )
    parts = p.select("grp", *ends, "target", along("x", 0).alias("ax"), along("y", 0).alias("ay"), along("x", 1).alias("bx"), along("y", 1).alias("by"))
    parts = scratch.table(parts, "parts") if mean else parts  # without an extent, parts are the pieces
    middle = [((F.col(f"a{c}") + F.col(f"b{c}")) / 2) for c in "xy"]
    tiled = tiles_of(parts, *middle, [*ends, "ax", "ay"], tile_rows * groups, scratch, max(1, MOST_TILES // groups))
    tiled = tiled.withColumn("tile", F.col("tile") + F.shiftleft(F.col("grp").cast("long"), GROUP)).drop("grp")
    edge = lambda f, g, c: f(g(f"a{c}", f"b{c}")).alias(f"{'lo' if f is F.min else 'hi'}{c}")
    table = tiled.groupBy("tile").agg(*[edge(f, g, c) for f, g in ((F.min, F.least), (F.max, F.greatest)) for c in "xy"]).orderBy("tile").toArrow()
    boxes, names = tuple(_floats(table, "lox loy hix hiy")), table.column("tile").to_numpy()

    point = "x double, y double, tile long"
    arrow = lambda ddl: _arrow_schema(spark, ddl)
    solved = f"{point}, target {kind}, d double"
    answer = lambda some: answered(tiled, some, ["x", "y"], _solved(arrow(solved)), solved, scratch)
    asked = scratch.table(places.mapInArrow(_asked(names, boxes, True, arrow(point)), point), "asked")
    first = scratch.table(answer(asked), "first")
    others = scratch.table(first.mapInArrow(_asked(names, boxes, False, arrow(point)), point), "others")
    all_ = first.unionByName(answer(others)).groupBy("x", "y", F.shiftright("tile", GROUP).cast("int").alias("grp"))
    return all_.agg(F.min(F.struct("d", "target")).alias("m")).select("x", "y", "grp", "m.target", "m.d")


def _arrow_schema(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)
