"""Measures of shapes as column expressions.

A shape is an array of rings or paths, each an array of ``struct<x, y>``. Polygons are rings, in any
order and direction: a ring inside an odd number of others is a hole, so several parts and islands in holes work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def segments(rings: Column, closed: bool) -> Column:
    """The straight pieces of all rings (with the one back to the start) or paths: array of ``struct<p, q>``."""

    def of(ring: Column) -> Column:
        n = F.size(ring)
        last = n - 1 if closed else n - 2
        steps = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(steps, lambda i: F.struct(ring[i].alias("p"), ring[(i + 1) % n].alias("q")))

    return F.flatten(F.transform(rings, of))


def segment_distance(x: Column, y: Column, px: Column, py: Column, qx: Column, qy: Column) -> Column:
    """From a point to a straight piece, ends included."""
    dx, dy = qx - px, qy - py
    along = ((x - px) * dx + (y - py) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), along)), F.lit(0.0))
    return F.hypot(x - (px + t * dx), y - (py + t * dy))


def crossings(x: Column, y: Column, ring: Column) -> Column:
    """How often a ray to the right of a point crosses a ring."""

    def hit(e: Column) -> Column:
        p, q = e["p"], e["q"]
        spans = (p["y"] > y) != (q["y"] > y)
        at = (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"]
        return spans & (x < at)

    return F.size(F.filter(segments(F.array(ring), closed=True), hit))


def inside(x: Column, y: Column, rings: Column) -> Column:
    """Even-odd containment of a point in a polygon's rings (closed or not)."""
    return F.aggregate(rings, F.lit(0), lambda acc, r: acc + crossings(x, y, r)) % 2 == 1


def shape_distance(x: Column, y: Column, rings: Column, closed: bool) -> Column:
    """From a point to the boundary of a shape; 0 inside a polygon."""
    d = F.array_min(
        F.transform(segments(rings, closed), lambda e: segment_distance(x, y, e["p"]["x"], e["p"]["y"], e["q"]["x"], e["q"]["y"]))
    )
    return F.when(inside(x, y, rings), F.lit(0.0)).otherwise(d) if closed else d


def _sums(ring: Column) -> Column:
    """Of a ring: twice its signed area, and six times its signed first moments."""
    x0, y0 = ring[0]["x"], ring[0]["y"]  # about the first corner, against cancellation
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def add(acc: Column, e: Column) -> Column:
        px, py, qx, qy = e["p"]["x"] - x0, e["p"]["y"] - y0, e["q"]["x"] - x0, e["q"]["y"] - y0
        c = px * qy - qx * py
        return F.struct((acc["a"] + c).alias("a"), (acc["mx"] + (px + qx) * c).alias("mx"), (acc["my"] + (py + qy) * c).alias("my"))

    return F.aggregate(segments(F.array(ring), closed=True), zero, add)


def ring_area(ring: Column) -> Column:
    """Area by the shoelace sum."""
    return F.abs(_sums(ring)["a"]) / 2


def signed_area(rings: Column) -> Column:
    """The sum of all rings' areas, those that run with the clock negative: the area of a shape whose holes run the other way."""
    return F.aggregate(rings, F.lit(0.0), lambda acc, r: acc + _sums(r)["a"]) / 2


def _weighed(rings: Column) -> Column:
    """Of each ring: its area, negative for holes, and its own centroid."""

    def of(ring: Column, i: Column) -> Column:
        mx, my = (ring[0]["x"] + ring[1]["x"]) / 2, (ring[0]["y"] + ring[1]["y"]) / 2
        around = F.size(F.filter(rings, lambda s, j: (j != i) & (crossings(mx, my, s) % 2 == 1)))
        s = _sums(ring)
        area = F.abs(s["a"]) / 2 * F.when(around % 2 == 1, -1.0).otherwise(1.0)
        three = F.nullif(3 * s["a"], F.lit(0.0))
        return F.struct(area.alias("area"), (ring[0]["x"] + s["mx"] / three).alias("x"), (ring[0]["y"] + s["my"] / three).alias("y"))

    return F.transform(F.filter(rings, lambda r: F.size(r) >= 3), of)


def polygon_area(rings: Column) -> Column:
    """Area of all rings, holes taken away."""
    return F.aggregate(_weighed(rings), F.lit(0.0), lambda acc, r: acc + r["area"])


def polygon_centroid(rings: Column) -> Column:
    """``struct<x, y>``, weighed by area; missing without area."""
    parts = _weighed(rings)
    total = F.nullif(F.aggregate(parts, F.lit(0.0), lambda acc, r: acc + r["area"]), F.lit(0.0))
    at = lambda c: F.aggregate(parts, F.lit(0.0), lambda acc, r: acc + r["area"] * F.coalesce(r[c], F.lit(0.0))) / total
    return F.when(total.isNotNull(), F.struct(at("x").alias("x"), at("y").alias("y")))


def line_length(points: Column) -> Column:
    pieces = segments(F.array(points), closed=False)
    step = lambda acc, e: acc + F.hypot(e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"])
    return F.when(F.size(points) < 2, F.lit(0.0)).otherwise(F.aggregate(pieces, F.lit(0.0), step))


def line_centroid(points: Column) -> Column:
    """``struct<x, y>``: the mean of the pieces' middles, weighed by length; the first point of a line without length."""
    pieces = segments(F.array(points), closed=False)
    d = lambda e: F.hypot(e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"])
    total = F.nullif(line_length(points), F.lit(0.0))
    at = lambda c: F.aggregate(pieces, F.lit(0.0), lambda acc, e: acc + d(e) * (e["p"][c] + e["q"][c]) / 2) / total
    return F.struct(F.coalesce(at("x"), points[0]["x"]).alias("x"), F.coalesce(at("y"), points[0]["y"]).alias("y"))


def bounds(rings: Column) -> dict[str, Column]:
    """``x0, x1, y0, y1`` of a shape."""
    points = F.flatten(rings)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return {"x0": F.array_min(xs), "x1": F.array_max(xs), "y0": F.array_min(ys), "y1": F.array_max(ys)}


# ---- buffers ----


@dataclass(frozen=True)
class _Boundary:
    """The outline of all places within a radius of a path, in pieces, the inside to their left: arcs (centre, from angle, to
    angle) and straight sides (from, to)."""

    arcs: np.ndarray
    sides: np.ndarray
    radius: float

    def area(self) -> float:
        """By Green's theorem."""
        cx, cy, a, b = self.arcs.T
        r = self.radius
        turned = r * r * (b - a) + r * (cx * (np.sin(b) - np.sin(a)) - cy * (np.cos(b) - np.cos(a)))
        x1, y1, x2, y2 = self.sides.T
        return float((turned.sum() + (x1 * y2 - x2 * y1).sum()) / 2)


def _gaps(low: np.ndarray, high: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a row's intervals (``a`` to ``b``) leave of it: row, from, to."""
    order = np.argsort(a, axis=1)
    a, b = np.take_along_axis(a, order, 1), np.take_along_axis(b, order, 1)
    reach = np.maximum.accumulate(np.concatenate([low[:, None], b], axis=1), axis=1)
    until = np.concatenate([a, high[:, None]], axis=1)
    row, col = np.nonzero(until - reach > 1e-12 * np.maximum(1.0, high[:, None] - low[:, None]))
    return row, reach[row, col], until[row, col]


def _reached(marks: list[np.ndarray], low: np.ndarray, high: np.ndarray, at, p: np.ndarray, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of elements (rows) and pieces: the parts between ``marks`` whose middle (``at`` gives its place) is nearer than ``least`` to the piece."""
    shape = marks[0].shape
    lo, hi = (np.broadcast_to(v[:, None], shape) for v in (low, high))
    full = np.stack([lo, *(np.clip(np.where(np.isnan(m), lo, m), lo, hi) for m in marks), hi], axis=2)
    full.sort(axis=2)
    a, b = full[..., :-1], full[..., 1:]
    x, y = at((a + b) / 2)
    d = (q - p)[None, :, None]
    t = np.clip(((x - p[None, :, None, 0]) * d[..., 0] + (y - p[None, :, None, 1]) * d[..., 1]) / np.maximum((d * d).sum(axis=3), 1e-300), 0, 1)
    near = np.hypot(x - p[None, :, None, 0] - t * d[..., 0], y - p[None, :, None, 1] - t * d[..., 1]) < least
    flat = (len(low), -1)
    return np.where(near, a, low[:, None, None]).reshape(flat), np.where(near, b, low[:, None, None]).reshape(flat)


def _boundary(path: np.ndarray, radius: float, cells: int = 200_000) -> _Boundary:
    """The outline of a path's buffer: circles about its corners and sides along its pieces, less what any piece is nearer to
    than the radius. Each is cut where it meets a piece's own outline; a few are cut at a time, with what lies near them."""
    r, tiny = radius, 1e-9 * radius
    ends = np.stack([path[:-1], path[1:]], axis=1) if len(path) > 1 else np.stack([path, path], axis=1)
    turned = (ends[:, 0, 0] > ends[:, 1, 0]) | ((ends[:, 0, 0] == ends[:, 1, 0]) & (ends[:, 0, 1] > ends[:, 1, 1]))
    ends = np.unique(np.where(turned[:, None, None], ends[:, ::-1], ends), axis=0)  # a piece there and back is one
    long = (ends[:, 0] != ends[:, 1]).any(axis=1)
    ends = ends[long] if long.any() else ends[:1]
    p, q = ends[:, 0], ends[:, 1]
    length = np.hypot(*(q - p).T)
    u = (q - p) / np.where(length > 0, length, 1.0)[:, None]
    n = np.stack([-u[:, 1], u[:, 0]], axis=1)
    corners = np.unique(ends.reshape(-1, 2), axis=0)
    if length.max() > 0:  # sides, the inside to their left
        a, b, out = np.concatenate([q + r * n, p - r * n]), np.concatenate([p + r * n, q - r * n]), np.concatenate([n, -n])
    else:
        a = b = out = np.zeros((0, 2))
    low, high = np.minimum(p, q) - 2 * r, np.maximum(p, q) + 2 * r
    step = max(1, min(24, cells // (9 * len(p))))
    arcs, sides = [], []
    with np.errstate(invalid="ignore", divide="ignore"):
        for at in range(0, len(corners), step):
            c = corners[at : at + step]
            near = ((low <= c.max(axis=0)) & (high >= c.min(axis=0))).all(axis=1)
            pp, qq, uu, nn = p[near], q[near], u[near], n[near]
            marks = []
            for e in (pp, qq):
                to = e[None] - c[:, None]
                d = np.hypot(to[..., 0], to[..., 1])
                half = np.where((d > 0) & (d < 2 * r), np.arccos(np.minimum(d / (2 * r), 1)), np.nan)
                aim = np.arctan2(to[..., 1], to[..., 0])
                marks += [aim - half, aim + half]
            h, lean = ((c[:, None] - pp) * nn).sum(axis=2), np.arctan2(uu[:, 1], uu[:, 0])
            for side in (r, -r):
                sine = (side - h) / r
                turn = np.arcsin(np.where(np.abs(sine) < 1 + 1e-9, np.clip(sine, -1, 1), np.nan))
                marks += [turn + lean, np.pi - turn + lean]
            marks = [(m + np.pi) % (2 * np.pi) - np.pi for m in marks]
            whole = np.full(len(c), np.pi)
            place = lambda t, c=c: (c[:, None, None, 0] + r * np.cos(t), c[:, None, None, 1] + r * np.sin(t))
            i, lo, hi = _gaps(-whole, whole, *_reached(marks, -whole, whole, place, pp, qq, r - tiny))
            arcs.append(np.column_stack([c[i], lo, hi]))
        for at in range(0, len(a), step):
            a1, b1, o1 = a[at : at + step], b[at : at + step], out[at : at + step]
            box = np.minimum(a1, b1).min(axis=0), np.maximum(a1, b1).max(axis=0)
            near = ((low <= box[1]) & (high >= box[0])).all(axis=1)
            pp, qq, nn = p[near], q[near], n[near]
            full = np.hypot(*(b1 - a1).T)
            w = (b1 - a1) / full[:, None]
            marks = []
            for e in (pp, qq):
                to = e[None] - a1[:, None]
                along, off = (to * w[:, None]).sum(axis=2), to[..., 0] * w[:, None, 1] - to[..., 1] * w[:, None, 0]
                reach = np.sqrt(np.where(np.abs(off) < r * (1 + 1e-9), np.maximum(r * r - off * off, 0), np.nan))
                marks += [along - reach, along + reach]
            turn, from_ = (w[:, None] * nn).sum(axis=2), ((a1[:, None] - pp) * nn).sum(axis=2)
            marks += [np.where(turn == 0, np.nan, (side - from_) / turn) for side in (r, -r)]
            place = lambda t, a1=a1, w=w: (a1[:, None, None, 0] + t * w[:, None, None, 0], a1[:, None, None, 1] + t * w[:, None, None, 1])
            none = np.zeros(len(a1))
            cut = _reached(marks, none, full, place, pp, qq, r - tiny)
            # where another side lies on this one, what both have counts once: the earlier's
            others = np.flatnonzero(((np.minimum(a, b) <= box[1] + tiny) & (np.maximum(a, b) >= box[0] - tiny)).all(axis=1))
            same = ((o1[:, None] * out[others]).sum(axis=2) > 1 - 1e-12) & (np.abs(((a[others][None] - a1[:, None]) * o1[:, None]).sum(axis=2)) < tiny)
            same &= others[None] < (at + np.arange(len(a1)))[:, None]
            twice = [np.clip(np.where(same, ((x[others][None] - a1[:, None]) * w[:, None]).sum(axis=2), 0.0), 0.0, full[:, None]) for x in (a, b)]
            i, lo, hi = _gaps(none, full, np.concatenate([cut[0], np.minimum(*twice)], axis=1), np.concatenate([cut[1], np.maximum(*twice)], axis=1))
            sides.append(np.column_stack([a1[i] + lo[:, None] * w[i], a1[i] + hi[:, None] * w[i]]))
    join = lambda parts: np.concatenate(parts) if parts else np.zeros((0, 4))
    return _Boundary(join(arcs), join(sides), r)


def _outline(edge: _Boundary, quarter: int) -> list[list[dict[str, float]]]:
    """Rings of an outline, arcs as ``quarter`` steps a right angle. Where parts end they meet others' starts."""
    r, parts = edge.radius, []
    for cx, cy, a, b in edge.arcs:
        t = np.linspace(a, b, max(2, math.ceil((b - a) / (math.pi / 2) * quarter) + 1))
        parts.append(np.column_stack([cx + r * np.cos(t), cy + r * np.sin(t)]))
    parts += [np.array([[x1, y1], [x2, y2]]) for x1, y1, x2, y2 in edge.sides]
    if not parts:
        return []
    starts = np.array([x[0] for x in parts])
    left, rings = set(range(len(parts))), []
    while left:
        first = i = min(left)
        ring: list[np.ndarray] = []
        while i in left:
            left.discard(i)
            ring.append(parts[i][:-1])
            i = int(np.hypot(*(starts - parts[i][-1]).T).argmin()) if len(left) else first
        rings.append([{"x": float(x), "y": float(y)} for x, y in np.concatenate(ring)])
    return rings


def _each_boundary(paths: pd.Series, radius: float) -> Iterator[tuple[_Boundary, np.ndarray] | None]:
    for x in paths:
        if x is None or not len(x) or any(p is None or p["x"] is None or p["y"] is None for p in x):
            yield None
            continue
        path = np.array([(p["x"], p["y"]) for p in x], float)
        yield _boundary(path - path[0], radius), path[0]


def with_buffer_area(lines: DataFrame, points: str, radius: float, out: str) -> DataFrame:
    """``lines`` with the area within ``radius`` of each path: what several of its pieces reach counts once, ends are round.

    Exact but for rounding, whatever the path: hairpins, crossings, loops (with the hole they leave), repeated points. A path
    of one point has a circle's area; missing and empty paths, and those with a missing coordinate, have none.
    """

    @F.pandas_udf("double")
    def area(paths: pd.Series) -> pd.Series:
        return pd.Series([None if e is None else e[0].area() for e in _each_boundary(paths, radius)], dtype="float64")

    return lines.withColumn(out, area(F.col(points)))


def with_buffer(lines: DataFrame, points: str, radius: float, out: str, quarter: int = 16) -> DataFrame:
    """``lines`` with the outline of each path's buffer: rings, holes among them, arcs as ``quarter`` steps a right angle."""

    @F.pandas_udf("array<array<struct<x: double, y: double>>>")
    def rings(paths: pd.Series) -> pd.Series:
        made = []
        for e in _each_boundary(paths, radius):
            moved = lambda ring, e=e: [{"x": p["x"] + e[1][0], "y": p["y"] + e[1][1]} for p in ring]
            made.append(None if e is None else [moved(ring) for ring in _outline(e[0], quarter)])
        return pd.Series(made, dtype=object)

    return lines.withColumn(out, rings(F.col(points)))
