"""Spatial joins over plain coordinates, by cells.

Points carry ``x`` and ``y`` in one metric projection. Every join first meets by an equal join
on square cells, then applies the exact predicate. Shapes are arrays of rings or paths (see ``geometry``);
containment counts edge crossings over all rings, so holes and several parts work. Rows with a missing coordinate
are near nothing and in nothing.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.operators import nearest_tree, radius_tree
from kerbside.operators.geometry import bounds, inside, line_length, polygon_area, ring_area, segment_distance, segments
from kerbside.scratch import Scratch

__all__ = ["inside", "line_length", "ring_area"]

#: Most rows of a side that is sent to all tasks.
SMALL = 10_000
#: Most pairs that a ring of a nearest search looks at, for each row of both sides.
MOST_PAIRS = 64


def cell(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(float(size)))


def _finite(*names: str) -> Column:
    """Of missing and NaN false too."""
    return functools.reduce(operator.and_, [F.abs(F.col(c)) < float("inf") for c in names])


def cells_around(x: Column, y: Column, reach: float, size: float) -> Column:
    """The cells that a square of half-width ``reach`` touches, as an array of (cx, cy)."""
    xs = F.sequence(cell(x - reach, size), cell(x + reach, size))
    ys = F.sequence(cell(y - reach, size), cell(y + reach, size))
    return F.flatten(F.transform(xs, lambda a: F.transform(ys, lambda c: F.struct(a.alias("cx"), c.alias("cy")))))


def cells_along(px: Column, py: Column, qx: Column, qy: Column, size: float, reach: float = 0.0) -> Column:
    """The cells that places within ``reach`` of a straight piece can be in, as an array of (cx, cy).

    A column of cells at a time: in it the piece spans a part of its height, widened by the reach. Their number grows with
    the piece's length, not with its box.
    """
    turned = px > qx
    ax, ay, bx, by = (F.when(turned, b).otherwise(a) for a, b in ((px, qx), (py, qy), (qx, px), (qy, py)))
    slope = (by - ay) / F.nullif(bx - ax, F.lit(0.0))

    def column(i: Column) -> Column:
        lo, hi = F.greatest(ax, i * size - reach), F.least(bx, (i + 1) * size + reach)
        # the piece's heights over this column (all of them where it is upright)
        within = lambda y: F.greatest(F.least(ay, by), F.least(F.greatest(ay, by), y))
        y0, y1 = (F.when(slope.isNull(), y).otherwise(within(ay + slope * (x - ax))) for x, y in ((lo, ay), (hi, by)))
        ys = F.sequence(cell(F.least(y0, y1) - reach, size), cell(F.greatest(y0, y1) + reach, size))
        return F.transform(ys, lambda j: F.struct(i.alias("cx"), j.alias("cy")))

    return F.flatten(F.transform(F.sequence(cell(ax - reach, size), cell(bx + reach, size)), column))


def radius_join(left: DataFrame, right: DataFrame, radius: float, right_columns: Sequence[str]) -> DataFrame:
    """Pairs within ``radius`` (inclusive), with their distance ``d``."""
    size = max(radius, 1e-9)
    a = left.withColumn("_c", F.explode(cells_around(F.col("x"), F.col("y"), radius, size))).select("*", "_c.cx", "_c.cy").drop("_c")
    b = right.select(F.col("x").alias("_x"), F.col("y").alias("_y"), *right_columns)
    b = b.withColumn("cx", cell(F.col("_x"), size)).withColumn("cy", cell(F.col("_y"), size))
    d = F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y"))
    return a.join(b, ["cx", "cy"]).withColumn("d", d).filter(F.col("d") <= radius).drop("cx", "cy", "_x", "_y")


def radius_count(left: DataFrame, right: DataFrame, key: str, radius: float, out: str) -> DataFrame:
    """How many of ``right`` lie within ``radius`` (inclusive) of each row; 0 if none.

    Equal places of either side are looked at once, and what lies well within a circle is counted by tiles (see ``radius_tree``).
    """
    places = right.select(*[F.col(c).cast("double").alias(c) for c in "xy"]).filter(_finite("x", "y")).groupBy("x", "y").agg(F.count("*").alias("n"))
    points = left.select(*[F.col(c).cast("double").alias(c) for c in "xy"]).filter(_finite("x", "y")).distinct()
    found = radius_tree.count_within(points, places, radius, Scratch(left.sparkSession, "radius"))
    found = found.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("n").alias(out))
    same = (F.col("x").cast("double") == F.col("_x")) & (F.col("y").cast("double") == F.col("_y"))
    return left.join(found, same, "left").drop("_x", "_y").withColumn(out, F.coalesce(out, F.lit(0)))


def _edges(shapes: DataFrame, columns: Sequence[str], closed: bool, rings: str = "rings") -> DataFrame:
    """A row for each straight piece of each shape: ``px, py, qx, qy`` and ``columns``."""
    e = shapes.select(*columns, F.explode(segments(F.col(rings), closed)).alias("e"))
    return e.select(*columns, *[F.col(f"e.{end}.{c}").alias(f"{end}{c}") for end in "pq" for c in "xy"])


def edge_join(points: DataFrame, edges: DataFrame, radius: float, columns: Sequence[str]) -> DataFrame:
    """Points with the pieces within ``radius`` (inclusive) and their distance ``d``; ``columns`` of the pieces.

    A piece is dealt to the cells along it, a point has one cell.
    """
    at, dealt = _celled(points, edges, radius, columns)
    d = segment_distance(*[F.col(c) for c in ("x", "y", "px", "py", "qx", "qy")])
    return at.join(dealt, ["cx", "cy"]).withColumn("d", d).filter(F.col("d") <= radius).drop("cx", "cy", "px", "py", "qx", "qy")


def _celled(points: DataFrame, edges: DataFrame, radius: float, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Points with their cell, and pieces with each cell that places within ``radius`` of them can be in."""
    size = max(2 * radius, 1e-9)
    grid = cells_along(*[F.col(c) for c in ("px", "py", "qx", "qy")], size, radius)
    dealt = edges.select(*columns, "px", "py", "qx", "qy", F.explode(grid).alias("_c")).select("*", "_c.cx", "_c.cy").drop("_c")
    return points.withColumn("cx", cell(F.col("x"), size)).withColumn("cy", cell(F.col("y"), size)), dealt


def _meetings(points: DataFrame, edges: DataFrame, radius: float) -> float:
    """How many pairs ``edge_join`` would look at."""
    a, b = (t.groupBy("cx", "cy").agg(F.count("*").cast("double").alias(n)) for t, n in zip(_celled(points, edges, radius, []), "ab", strict=True))
    return a.join(b, ["cx", "cy"]).agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0.0


def _nearest_edge(points: DataFrame, edges: DataFrame, key: str, target: str, start: float | None, scratch: Scratch) -> DataFrame:
    """By tiles that follow the targets' density; or, from a first radius ``start``, a ring search: within it, then twice that for rows
    still open, and so on. A hit within the radius is final, and the last radius reaches over both sides' whole extent. A ring that would look at
    more than ``MOST_PAIRS`` pairs a row is left to the tiles, with what is still open.
    """
    open_ = scratch.table(points.select(key, "x", "y").filter(_finite("x", "y")), "open")
    if start is None:
        return nearest_tree.nearest_pieces(open_, edges, key, target, scratch)
    edges = scratch.table(edges.filter(_finite("px", "py", "qx", "qy")), "edges")
    ends = [(F.min(f"{e}{c}"), F.max(f"{e}{c}")) for c in "xy" for e in "pq"]
    n, *box = edges.agg(F.count("*"), *[x for pair in ends for x in pair]).first()
    own = open_.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    kinds = f"{edges.schema[target].dataType.simpleString()}"
    if not n or own[0] is None:
        return open_.select(key, F.lit(None).cast(kinds).alias(target), F.lit(None).cast("double").alias("d")).limit(0)
    width = max(own[1], box[1], box[3]) - min(own[0], box[0], box[2])
    height = max(own[3], box[5], box[7]) - min(own[2], box[4], box[6])
    most = math.hypot(width, height) * 1.001 + 1e-9
    radius = min(most, start)
    found = None
    while True:
        if _meetings(open_, edges, radius) > MOST_PAIRS * (open_.count() + n):
            rest = nearest_tree.nearest_pieces(open_, edges, key, target, scratch)
            return rest if found is None else found.unionByName(rest)
        pairs = edge_join(open_, edges, radius, [target])
        got = pairs.groupBy(key).agg(F.min(F.struct("d", target)).alias("m")).select(key, f"m.{target}", "m.d")
        got = scratch.table(got, "found")
        found = got if found is None else found.unionByName(got)
        open_ = scratch.table(open_.join(got.select(key), key, "left_anti"), "open")
        if radius >= most or open_.isEmpty():
            return found
        radius = min(most, 2 * radius)


def nearest(left: DataFrame, right: DataFrame, key: str, target: str, start: float | None = None) -> DataFrame:
    """``key, target, d``: the nearest of ``right`` for each row of ``left``; equal distances go to the smaller target.

    ``start``: the first radius of a ring search, for targets spread evenly and so thinly that few lie within it; without it, and where
    many do, tiles follow the targets' density, however uneven (see ``nearest_tree``). Rows or targets with a missing coordinate take no part. With no target the result is empty (missing, not 0).
    """
    places = right.select(target, *[F.col(c).alias(f"{e}{c}") for e in "pq" for c in "xy"]).dropna(subset=["px", "py"])
    return _nearest_edge(left, places, key, target, start, Scratch(left.sparkSession, "nearest"))


def nearest_shape(points: DataFrame, shapes: DataFrame, key: str, target: str, closed: bool, start: float | None = None, size: float | None = None) -> DataFrame:
    """``key, target, d``: the nearest shape (``rings``) of each point by its boundary; 0 inside a polygon (``closed``).

    Equal distances go to the smaller target. ``size``: cells of the containment join, by default four radii; ``start`` as in ``nearest``.
    """
    scratch = Scratch(points.sparkSession, "nearest")
    edges = _edges(shapes, [target], closed)
    if not closed:
        return _nearest_edge(points, edges, key, target, start, scratch)
    step = size or (4 * start if start else 1000.0)
    hits = within(points.select(key, "x", "y"), shapes, [target], step).groupBy(key).agg(F.min(target).alias(target))
    hits = scratch.table(hits.withColumn("d", F.lit(0.0)), "inside")
    rest = points.join(hits.select(key), key, "left_anti")
    return hits.unionByName(_nearest_edge(rest, edges, key, target, start, scratch))


def nearest_by_class(points: DataFrame, targets: DataFrame, key: str, target: str, of: str, classes: Sequence, start: float | None = None) -> DataFrame:
    """``key`` and a distance ``d_<class>`` to the nearest target of each class; missing where a class has none.

    All classes are searched together and by tiles (``nearest_tree``), whatever the first radius ``start``. Points of one place are searched for once;
    rows that share a key are one point of several places.
    """
    at = points.select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    own = list(dict.fromkeys(classes))
    if not own:
        return at.select(key).distinct()
    number = F.coalesce(*[F.when(F.col(of) == F.lit(c), i) for i, c in enumerate(own)])
    pieces = targets.select(target, number.alias("grp"), *[F.col(c).alias(f"{e}{c}") for e in "pq" for c in "xy"]).filter("grp is not null")
    places = at.select("x", "y").filter(_finite("x", "y")).distinct()
    found = nearest_tree.nearest_of_groups(places, pieces, target, len(own), Scratch(points.sparkSession, "classes"))
    found = found.groupBy("x", "y").agg(*[F.min(F.when(F.col("grp") == i, F.col("d"))).alias(f"_{i}") for i in range(len(own))])
    return at.join(found, ["x", "y"], "left").groupBy(key).agg(*[F.min(f"_{own.index(c)}").alias(f"d_{c}") for c in classes])


def nearest_shape_by_class(
    points: DataFrame, shapes: DataFrame, key: str, target: str, of: str, classes: Sequence, closed: bool = True, start: float | None = None, size: float | None = None
) -> DataFrame:
    """``key`` and a distance ``d_<class>`` to the nearest footprint of each class, 0 inside one; missing where a class has none."""
    out = points.select(key)
    for c in classes:
        one = nearest_shape(points, shapes.filter(F.col(of) == F.lit(c)), key, target, closed, start, size)
        out = out.join(one.select(key, F.col("d").alias(f"d_{c}")), key, "left")
    return out


def buffer_count(lines: DataFrame, points: DataFrame, key: str, radius: float, out: str, path: str = "path") -> DataFrame:
    """``lines`` with the number of points within ``radius`` of each path (inclusive); 0 if none.

    Points are first counted by place; a place near several pieces of a path counts once.
    """
    places = points.groupBy("x", "y").agg(F.count("*").alias("_n")).filter("x is not null and y is not null")
    edges = _edges(lines.select(key, F.array(path).alias("rings")), [key], closed=False)
    near = edge_join(places, edges, radius, [key]).select(key, "x", "y", "_n").distinct()
    found = near.groupBy(key).agg(F.sum("_n").alias(out))
    return lines.join(found, key, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def within(points: DataFrame, polygons: DataFrame, poly_columns: Sequence[str], size: float) -> DataFrame:
    """Each point with each polygon that holds it (inner)."""
    boxed = polygons.withColumns(bounds(F.col("rings")))
    xs = F.sequence(cell(F.col("x0"), size), cell(F.col("x1"), size))
    ys = F.sequence(cell(F.col("y0"), size), cell(F.col("y1"), size))
    # a column of cells at a time: no row holds all cells of a large polygon
    dealt = boxed.withColumn("cx", F.explode(xs)).withColumn("cy", F.explode(ys)).select("cx", "cy", "rings", "x0", "x1", "y0", "y1", *poly_columns)
    p = points.withColumn("cx", cell(F.col("x"), size)).withColumn("cy", cell(F.col("y"), size))
    box = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    return p.join(dealt, ["cx", "cy"]).filter(box & inside(F.col("x"), F.col("y"), F.col("rings"))).select(*points.columns, *poly_columns)


def smallest_polygon(points: DataFrame, polygons: DataFrame, key: str, poly: str, size: float) -> DataFrame:
    """Every point once: the smallest polygon that holds it (ties to the smaller id), missing if none does."""
    sized = polygons.withColumn("_area", polygon_area(F.col("rings")))
    found = within(points.select(key, "x", "y"), sized, [poly, "_area"], size).groupBy(key).agg(
        F.min(F.struct("_area", poly)).alias("m")
    )
    return points.join(found.select(key, f"m.{poly}"), key, "left")


def coverage(points: DataFrame, polygons: DataFrame, key: str, size: float) -> DataFrame:
    """One row: the part of points that at least one polygon holds."""
    hit = within(points.select(key, "x", "y"), polygons, [], size).select(key).distinct()
    marked = points.select(key).distinct().join(hit.withColumn("_hit", F.lit(1.0)), key, "left")
    return marked.agg(F.avg(F.coalesce("_hit", F.lit(0.0))).alias("coverage"))


def nearest_grid_point(points: DataFrame, grid: DataFrame, key: str, grid_key: str) -> DataFrame:
    """The grid point nearest by equirectangular distance at the points' mean latitude; ties to the smaller id.

    ``points`` and ``grid`` have ``lon`` and ``lat``; the grid is a dozen points (checked).
    """
    if grid.limit(SMALL + 1).count() > SMALL:
        raise ValueError(f"a grid of more than {SMALL} points is no small side; use nearest()")
    mean = points.agg(F.cos(F.radians(F.avg("lat"))).alias("_k"))
    g = grid.agg(F.collect_list(F.struct("lon", "lat", F.col(grid_key).alias("id"))).alias("_g"))
    both = points.crossJoin(F.broadcast(mean)).crossJoin(F.broadcast(g))  # one row each, the second at most SMALL points
    d2 = lambda p: F.pow((F.col("lon") - p["lon"]) * F.col("_k"), 2) + F.pow(F.col("lat") - p["lat"], 2)
    near = F.array_min(F.transform("_g", lambda p: F.struct(d2(p).alias("d"), p["id"].alias("id"))))
    return both.filter(F.size("_g") > 0).groupBy(key).agg(F.min(near)["id"].alias(grid_key))


def fitted_box(points: DataFrame, least: float, most: float) -> DataFrame:
    """One row: the box of the dense cluster: within a clamped multiple of the median distance of the median centre, trimmed at 10%."""
    centre = points.agg(F.median("x").alias("_mx"), F.median("y").alias("_my"))
    d = points.crossJoin(F.broadcast(centre)).withColumn("_d", F.hypot(F.col("x") - F.col("_mx"), F.col("y") - F.col("_my")))
    reach = d.agg(F.least(F.lit(most), F.greatest(F.lit(least), 2.5 * F.median("_d"))).alias("_r"))
    kept = d.crossJoin(F.broadcast(reach)).filter(F.col("_d") <= F.col("_r"))  # one row each
    q = lambda c: F.percentile(c, F.array(F.lit(0.1), F.lit(0.9)))
    return kept.agg(F.count("*").alias("n"), q("x").alias("qx"), q("y").alias("qy")).select(
        "n", F.col("qx")[0].alias("x0"), F.col("qx")[1].alias("x1"), F.col("qy")[0].alias("y0"), F.col("qy")[1].alias("y1")
    )


def chosen_box(
    areas: DataFrame, points: DataFrame, key: str, least: float, most: float, pad: float, step: float, size: float, good: float = 0.9, gain: float = 0.02, trim_from: int = 6
) -> DataFrame:
    """One row, ``variant, x0, y0, x1, y1, coverage``: the box of a dense cluster of ``areas`` (``x, y`` of the centre, ``rings``).

    The cluster is what lies within a clamped multiple of the median distance of the median centre (see ``fitted_box``).
    ``whole`` is the box of its shapes and ``pad`` around; ``core`` that of its centres between the 10% and 90% quantiles and
    one ``step`` around (``trim_from`` areas at least, else as ``whole``); both widened to multiples of ``step``. Coverage is the part of the
    ``points`` (``key, x, y``) in a box that an area holds. The core is taken if the whole covers less than ``good`` and the
    core ``gain`` more. Boxes without a point cover nothing. Without areas the result is empty.
    """
    scratch = Scratch(areas.sparkSession, "box")
    shaped = areas.withColumns({f"_{k}": v for k, v in bounds(F.col("rings")).items()})
    centre = shaped.agg(F.median("x").alias("_mx"), F.median("y").alias("_my"))
    d = shaped.crossJoin(F.broadcast(centre)).withColumn("_d", F.hypot(F.col("x") - F.col("_mx"), F.col("y") - F.col("_my")))  # one row
    reach = d.agg(F.least(F.lit(most), F.greatest(F.lit(least), 2.5 * F.median("_d"))).alias("_r"))
    kept = d.crossJoin(F.broadcast(reach)).filter(F.col("_d") <= F.col("_r"))
    q = lambda c: F.percentile(c, F.array(F.lit(0.1), F.lit(0.9)))
    row = kept.agg(F.count("*").alias("n"), F.min("_x0"), F.min("_y0"), F.max("_x1"), F.max("_y1"), q("x").alias("qx"), q("y").alias("qy")).first()
    boxes = "variant string, x0 double, y0 double, x1 double, y1 double"
    if not row["n"]:
        return areas.sparkSession.createDataFrame([], f"{boxes}, coverage double")
    whole = (row[1] - pad, row[2] - pad, row[3] + pad, row[4] + pad)
    core = (row["qx"][0] - step, row["qy"][0] - step, row["qx"][1] + step, row["qy"][1] + step) if row["n"] >= trim_from else whole
    down, up = lambda v: math.floor(v / step + 1e-9) * step, lambda v: math.ceil(v / step - 1e-9) * step
    best: tuple | None = None
    for name, b in (("whole", whole), ("core", core)):
        b = (down(b[0]), down(b[1]), up(b[2]), up(b[3]))
        inside_ = scratch.table(points.select(key, "x", "y").filter(F.col("x").between(b[0], b[2]) & F.col("y").between(b[1], b[3])), name)
        share = coverage(inside_, areas, key, size).first()["coverage"] or 0.0
        if best is None or share > best[-1] + gain:
            best = (name, *map(float, b), float(share))
        if share >= good:
            break
    return areas.sparkSession.createDataFrame([best], f"{boxes}, coverage double")


def opening_view(points: DataFrame, visible: str, least: int = 10) -> DataFrame:
    """One row: 5% and 95% quantiles of the visible points, of all if fewer than ``least`` are visible."""
    q = F.array(F.lit(0.05), F.lit(0.95))
    seen = lambda c: F.percentile(F.when(F.col(visible), F.col(c)), q)
    both = points.agg(
        F.count(F.when(F.col(visible), 1)).alias("n"), seen("x").alias("sx"), seen("y").alias("sy"), F.percentile("x", q).alias("ax"), F.percentile("y", q).alias("ay")
    )
    pick = lambda s, a, i: F.when(F.col("n") >= least, F.col(s)[i]).otherwise(F.col(a)[i])
    return both.select(pick("sx", "ax", 0).alias("x0"), pick("sx", "ax", 1).alias("x1"), pick("sy", "ay", 0).alias("y0"), pick("sy", "ay", 1).alias("y1"))


def utm_zone(lon: Column) -> Column:
    """Zone number of a longitude."""
    return (F.floor((lon + 180) / 6) + 1).cast("int")


#: The WGS84 ellipsoid, and the projection's scale, false easting and the south's false northing.
_A, _F, _K0, _E0, _N0 = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10_000_000.0


def _series() -> tuple[float, float, tuple[float, ...], tuple[float, ...], tuple[float, ...]]:
    """Third flattening, rectifying radius, and the series of the projection, its inverse and latitude."""
    n = _F / (2 - _F)
    radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forth = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    back = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    latitude = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    return n, radius, forth, back, latitude


def to_utm(lon: Column, lat: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Easting and northing by the series to third order; a millimetre within a zone."""
    _, radius, forth, _, _ = _series()
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    e = (_F * (2 - _F)) ** 0.5
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(forth, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return _E0 + _K0 * radius * east, (_N0 if south else 0.0) + _K0 * radius * north


def from_utm(east: Column, north: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Longitude and latitude of a projected point."""
    _, radius, _, back, latitude = _series()
    xi, eta = (north - (_N0 if south else 0.0)) / (_K0 * radius), (east - _E0) / (_K0 * radius)
    x, y = xi, eta
    for j, b in enumerate(back, 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        y = y - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    phi = chi
    for j, d in enumerate(latitude, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(y), F.cos(x))) + (zone * 6 - 183), F.degrees(phi)


# ---- dissolving ----


def _stitched(edges: pd.DataFrame) -> list[list[dict[str, float]]]:
    """Rings out of the pieces of one outline, in any order."""
    at: dict[tuple[float, float], list[int]] = {}
    ends = [((r.ax, r.ay), (r.bx, r.by)) for r in edges.itertuples()]
    for i, (a, b) in enumerate(ends):
        at.setdefault(a, []).append(i)
        at.setdefault(b, []).append(i)
    used, rings = [False] * len(ends), []
    for i, (first, place) in enumerate(ends):
        if used[i]:
            continue
        used[i], path, seen = True, [first], {first: 0}
        while True:
            if place in seen:  # a loop: cut it off, so that no ring meets itself
                rings.append([{"x": x, "y": y} for x, y in path[seen[place] :]])
                for p in path[seen[place] + 1 :]:
                    del seen[p]
                del path[seen[place] + 1 :]
            else:
                seen[place] = len(path)
                path.append(place)
            step = next((j for j in at[place] if not used[j]), None)
            if step is None:
                break
            used[step] = True
            place = ends[step][1] if ends[step][0] == place else ends[step][0]
    return rings


def dissolve(polygons: DataFrame, by: str, sums: Sequence[str] = (), firsts: Sequence[str] = ()) -> DataFrame:
    """One shape for each value of ``by``, with sums and smallest values (``firsts``) of columns: borders within a group are gone.

    Polygons must not overlap and neighbours must share their corners. A piece that a group has twice is inside it; such
    pieces are counted away by Spark, and only a group's outline meets in one task, to be joined to rings.
    """
    aggregates = [F.sum(c).alias(c) for c in sums] + [F.min(c).alias(c) for c in firsts]
    rows = polygons.groupBy(by).agg(F.count("*").alias("parts"), *aggregates)
    e = _edges(polygons, [by], closed=True).filter((F.col("px") != F.col("qx")) | (F.col("py") != F.col("qy")))
    turned = (F.col("px") > F.col("qx")) | ((F.col("px") == F.col("qx")) & (F.col("py") > F.col("qy")))
    names = {"ax": ("px", "qx"), "ay": ("py", "qy"), "bx": ("qx", "px"), "by": ("qy", "py")}
    e = e.select(by, *[F.when(turned, F.col(q)).otherwise(F.col(p)).alias(n) for n, (p, q) in names.items()])
    outline = e.groupBy(by, *names).agg(F.count("*").alias("n")).filter("n % 2 = 1").drop("n")
    kind = polygons.schema[by].dataType.simpleString()

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({by: [pdf[by].iloc[0]], "rings": [_stitched(pdf)]})

    shapes = outline.groupBy(by).applyInPandas(join, f"{by} {kind}, rings array<array<struct<x: double, y: double>>>")
    return rows.join(shapes, by, "left")
