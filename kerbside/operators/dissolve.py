"""Union of polygons by group, whatever overlaps, touches or repeats.

Edges are cut where they meet another of their group (noding, by a join on the cells that edges pass through), equal
pieces become one, and a piece is part of the outline if exactly one of its sides is covered: by the polygons whose edge
it is, or by any that holds its middle. Outline pieces run with the inside to their left, so rings come out with their
direction: outer ones against the clock, holes with it. Only a group's outline meets in one task, to be joined to rings.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbside.operators.geometry import crossings, segments, signed_area
from kerbside.operators.spatial import cell, cells_along, inside
from kerbside.scratch import Scratch


def _snapped(v: Column, snap: float) -> Column:
    """On a fine lattice, so that places that are the same but for rounding are equal; no negative zero."""
    return F.round(v / snap) * snap + F.lit(0.0)


def _directed(rings: Column) -> Column:
    """Rings with the inside to their left: outer ones against the clock, those inside an odd number of others with it."""

    def turn(ring: Column, i: Column) -> Column:
        mx, my = (ring[0]["x"] + ring[1]["x"]) / 2, (ring[0]["y"] + ring[1]["y"]) / 2
        around = F.size(F.filter(rings, lambda s, j: (j != i) & (crossings(mx, my, s) % 2 == 1)))
        return F.when((signed_area(F.array(ring)) > 0) == (around % 2 == 0), ring).otherwise(F.reverse(ring))

    return F.transform(F.filter(rings, lambda r: F.size(r) >= 3), turn)


def _cuts(edges: DataFrame, size: float, snap: float) -> DataFrame:
    """``edge, cx, cy``: places where an edge (``by, edge, px, py, qx, qy``) meets another of its group, its own ends left out."""
    ends = [F.col(c) for c in ("px", "py", "qx", "qy")]
    dealt = edges.withColumn("_c", F.explode(cells_along(*ends, size, snap)))
    names = ("edge", "px", "py", "qx", "qy")
    both = dealt.alias("a").join(dealt.select("by", "_c", *[F.col(c).alias(f"o_{c}") for c in names]).alias("b"), ["by", "_c"])
    both = both.filter("edge < o_edge").select("by", *names, *[f"o_{c}" for c in names]).dropDuplicates(["edge", "o_edge"])
    dx, dy, ex, ey = F.col("qx") - F.col("px"), F.col("qy") - F.col("py"), F.col("o_qx") - F.col("o_px"), F.col("o_qy") - F.col("o_py")
    cross = dx * ey - dy * ex
    wx, wy = F.col("o_px") - F.col("px"), F.col("o_py") - F.col("py")
    t, u = (wx * ey - wy * ex) / F.nullif(cross, F.lit(0.0)), (wx * dy - wy * dx) / F.nullif(cross, F.lit(0.0))
    met = t.between(0, 1) & u.between(0, 1)
    place = F.struct(_snapped(F.col("px") + t * dx, snap).alias("x"), _snapped(F.col("py") + t * dy, snap).alias("y"))

    def on(px: str, py: str, x: str, y: str, ax: Column, ay: Column) -> Column:
        """An end of the other lies on the piece from (px, py) along (ax, ay)."""
        long = F.hypot(ax, ay)
        vx, vy = F.col(x) - F.col(px), F.col(y) - F.col(py)
        along = (vx * ax + vy * ay) / long
        return (F.abs(vx * ay - vy * ax) / long <= snap) & (along > 0) & (along < long)

    marks = F.array(
        F.struct(F.when(met, F.col("edge")).alias("edge"), place.alias("c")),
        F.struct(F.when(met, F.col("o_edge")).alias("edge"), place.alias("c")),
        *[
            F.struct(F.when(on("px", "py", f"o_{e}x", f"o_{e}y", dx, dy), F.col("edge")).alias("edge"), F.struct(F.col(f"o_{e}x").alias("x"), F.col(f"o_{e}y").alias("y")).alias("c"))
            for e in "pq"
        ],
        *[
            F.struct(F.when(on("o_px", "o_py", f"{e}x", f"{e}y", ex, ey), F.col("o_edge")).alias("edge"), F.struct(F.col(f"{e}x").alias("x"), F.col(f"{e}y").alias("y")).alias("c"))
            for e in "pq"
        ],
    )
    found = both.select(F.explode(F.filter(marks, lambda m: m["edge"].isNotNull())).alias("m"))
    return found.select("m.edge", F.col("m.c.x").alias("cx"), F.col("m.c.y").alias("cy")).distinct()


def _rings(pieces: pd.DataFrame) -> list[list[dict[str, float]]]:
    """Rings of directed pieces; where several leave a place, a ring that comes back to a place of its own is cut off."""
    leaving: dict[tuple[float, float], list[tuple[float, float]]] = {}
    for r in pieces.itertuples():
        leaving.setdefault((r.ax, r.ay), []).append((r.bx, r.by_))
    rings = []
    for start in sorted(leaving):
        while leaving[start]:
            path, at = [start], {start: 0}
            while True:
                place = leaving[path[-1]].pop()
                if place in at:
                    ring = path[at[place] :]
                    rings.append([{"x": x, "y": y} for x, y in ring])
                    for p in ring[1:]:
                        del at[p]
                    del path[at[place] + 1 :]
                    if len(path) == 1:
                        break
                else:
                    at[place] = len(path)
                    path.append(place)
    return rings


def union(
    polygons: DataFrame, by: str, sums: Sequence[str] = (), firsts: Sequence[str] = (), size: float | None = None, snap: float = 1e-6
) -> DataFrame:
    """One shape (``rings``) for each value of ``by``, the number of its ``parts``, sums and smallest values of columns.

    Polygons may overlap, touch along parts of edges, repeat, and have holes. Coordinates are taken to multiples of
    ``snap``. ``size``: side of the cells that edges meet by, by default twice their mean length. Missing ``by`` is a
    group of its own; polygons without an area add nothing to the shape.
    """
    scratch = Scratch(polygons.sparkSession, "dissolve")
    aggregates = [F.sum(c).alias(c) for c in sums] + [F.min(c).alias(c) for c in firsts]
    rows = polygons.groupBy(by).agg(F.count("*").alias("parts"), *aggregates)
    point = lambda p: F.struct(_snapped(p["x"], snap).alias("x"), _snapped(p["y"], snap).alias("y"))
    own = polygons.select(F.col(by).alias("of"), F.transform("rings", lambda r: F.transform(r, point)).alias("rings"))
    own = scratch.table(own.select("of", _directed(F.col("rings")).alias("rings")).withColumn("polygon", F.monotonically_increasing_id()), "polygons")
    groups = scratch.table(own.select("of").distinct().withColumn("by", F.monotonically_increasing_id()), "groups")
    own = scratch.table(own.join(groups, own["of"].eqNullSafe(groups["of"])).select("by", "polygon", "rings"), "numbered")
    e = own.select("by", "polygon", F.explode(segments(F.col("rings"), True)).alias("e"))
    e = e.select("by", "polygon", *[F.col(f"e.{end}.{c}").alias(f"{end}{c}") for end in "pq" for c in "xy"])
    e = scratch.table(e.filter("px <> qx or py <> qy").withColumn("edge", F.monotonically_increasing_id()), "edges")
    mean = e.agg(F.avg(F.hypot(F.col("qx") - F.col("px"), F.col("qy") - F.col("py")))).first()[0]
    if mean is None:
        return rows.withColumn("rings", F.lit(None).cast("array<array<struct<x: double, y: double>>>"))
    step = size or 2 * mean
    cuts = scratch.table(_cuts(e, step, snap), "cuts")
    # an edge's places in order: its ends and where it is cut
    at = (F.col("cx") - F.col("px")) * (F.col("qx") - F.col("px")) + (F.col("cy") - F.col("py")) * (F.col("qy") - F.col("py"))
    marks = cuts.join(e, "edge").select("by", "polygon", "edge", at.alias("at"), "cx", "cy")
    whole = (F.col("qx") - F.col("px")) ** 2 + (F.col("qy") - F.col("py")) ** 2
    first = e.select("by", "polygon", "edge", F.lit(0.0).alias("at"), F.col("px").alias("cx"), F.col("py").alias("cy"))
    last = e.select("by", "polygon", "edge", whole.alias("at"), F.col("qx").alias("cx"), F.col("qy").alias("cy"))
    places = marks.unionByName(first).unionByName(last).dropDuplicates(["edge", "cx", "cy"])
    along = Window.partitionBy("edge").orderBy("at", "cx", "cy")
    parts = places.withColumns({"bx": F.lead("cx").over(along), "by_": F.lead("cy").over(along)}).filter("bx is not null")
    parts = parts.select("by", "polygon", F.col("cx").alias("ax"), F.col("cy").alias("ay"), "bx", "by_")
    # equal pieces, whichever way they run
    turned = (F.col("ax") > F.col("bx")) | ((F.col("ax") == F.col("bx")) & (F.col("ay") > F.col("by_")))
    names = {"ax": ("ax", "bx"), "ay": ("ay", "by_"), "bx": ("bx", "ax"), "by_": ("by_", "ay")}
    parts = parts.select("by", "polygon", turned.alias("turned"), *[F.when(turned, F.col(q)).otherwise(F.col(p)).alias(n) for n, (p, q) in names.items()])
    pieces = parts.groupBy("by", *names).agg(
        F.max((~F.col("turned")).cast("int")).alias("left"), F.max(F.col("turned").cast("int")).alias("right"), F.collect_set("polygon").alias("own")
    )
    pieces = scratch.table(pieces.filter("left <> right").withColumn("piece", F.monotonically_increasing_id()), "pieces")
    # those whose middle another polygon of the group holds are inside
    middle = {"mx": (F.col("ax") + F.col("bx")) / 2, "my": (F.col("ay") + F.col("by_")) / 2}
    xs, ys = F.transform(F.flatten("rings"), lambda p: p["x"]), F.transform(F.flatten("rings"), lambda p: p["y"])
    box = own.select("by", "polygon", "rings", F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))
    wide = 4 * step  # polygons are dealt to coarser cells than edges
    spans = [F.sequence(cell(F.col(f"{c}0"), wide), cell(F.col(f"{c}1"), wide)) for c in "xy"]
    box = box.withColumn("gx", F.explode(spans[0])).withColumn("gy", F.explode(spans[1]))
    asked = pieces.withColumns(middle).withColumns({"gx": cell(F.col("mx"), wide), "gy": cell(F.col("my"), wide)})
    held = asked.join(box, ["by", "gx", "gy"]).filter(
        F.col("mx").between(F.col("x0"), F.col("x1")) & F.col("my").between(F.col("y0"), F.col("y1")) & ~F.array_contains("own", F.col("polygon"))
    )
    held = held.filter(inside(F.col("mx"), F.col("my"), F.col("rings"))).select("piece").distinct()
    outline = pieces.join(held, "piece", "left_anti")
    back = F.col("left") == 0
    outline = outline.select("by", *[F.when(back, F.col(q)).otherwise(F.col(p)).alias(n) for n, (p, q) in names.items()])
    outline = scratch.table(outline, "outline")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"by": [pdf["by"].iloc[0]], "rings": [_rings(pdf)]})

    shapes = outline.groupBy("by").applyInPandas(join, "by long, rings array<array<struct<x: double, y: double>>>")
    shapes = groups.join(shapes, "by").select("of", "rings")
    return rows.join(shapes, rows[by].eqNullSafe(shapes["of"]), "left").drop("of")
