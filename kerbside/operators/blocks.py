"""Rasters as packed blocks on lattices: common grids, composites, reprojection and neighbourhoods.

A block is a row with its first pixel, its edges and its values (``sources.geotiff.BLOCKS``). Blocks of a lattice are
squares of ``size`` pixels by their numbers ``(brow, bcol)``. What moves between tasks is a block, or a piece of one,
never a pixel by itself; a target block gathers one piece or a few of each scene, and only what lies over it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.operators.spatial import _A, _E0, _F, _K0, _N0, _series
from kerbside.ship import ship
from kerbside.sources.geotiff import BLOCKS

_META = [x.split()[0] for x in BLOCKS.split(", ")][:-1]
_PIECES = "raster string, brow int, bcol int, r int, c int, height int, width int, values binary"
_LEAST = 1e-6  # weight of valid pixels below which a mean is missing: a place at a missing pixel's centre has none but for rounding
_WIDTH = 512  # pixels of a side that are resampled at a time


@dataclass(frozen=True)
class Grid:
    """A lattice: its left top corner, the pixel's size, its pixels, and the code of its projection."""

    x0: float
    y0: float
    dx: float
    dy: float
    width: int
    height: int
    epsg: int | None = None


# ---- projections over arrays ----


def _zone(epsg: int) -> tuple[int, bool]:
    if epsg // 100 not in (326, 327) or not 1 <= epsg % 100 <= 60:
        raise ValueError(f"projection {epsg}")
    return epsg % 100, epsg // 100 == 327


def _to_degrees(x: np.ndarray, y: np.ndarray, epsg: int) -> tuple[np.ndarray, np.ndarray]:
    if epsg == 4326:
        return x, y
    zone, south = _zone(epsg)
    _, radius, _, back, latitude = _series()
    xi, eta = (y - (_N0 if south else 0.0)) / (_K0 * radius), (x - _E0) / (_K0 * radius)
    a, b = xi, eta
    for j, k in enumerate(back, 1):
        a = a - k * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
        b = b - k * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
    chi = np.arcsin(np.sin(a) / np.cosh(b))
    phi = chi
    for j, k in enumerate(latitude, 1):
        phi = phi + k * np.sin(2 * j * chi)
    return np.degrees(np.arctan2(np.sinh(b), np.cos(a))) + (zone * 6 - 183), np.degrees(phi)


def _from_degrees(lon: np.ndarray, lat: np.ndarray, epsg: int) -> tuple[np.ndarray, np.ndarray]:
    if epsg == 4326:
        return lon, lat
    zone, south = _zone(epsg)
    _, radius, forth, _, _ = _series()
    phi, lam, e = np.radians(lat), np.radians(lon - (zone * 6 - 183)), (_F * (2 - _F)) ** 0.5
    t = np.sinh(np.arctanh(np.sin(phi)) - e * np.arctanh(e * np.sin(phi)))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t * t))
    east, north = eta, xi
    for j, k in enumerate(forth, 1):
        east = east + k * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
        north = north + k * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
    return _E0 + _K0 * radius * east, (_N0 if south else 0.0) + _K0 * radius * north


def project(x: np.ndarray, y: np.ndarray, source: int | None, target: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of one projection (WGS84 degrees or a UTM zone) in another; a millimetre within a zone and its neighbours' rims."""
    if source == target or source is None or target is None:
        return x, y
    return _from_degrees(*_to_degrees(x, y, source), target)


def _outline(left: float, bottom: float, right: float, top: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    t = np.linspace(0, 1, max(2, steps))
    x, y = left + t * (right - left), bottom + t * (top - bottom)
    one = np.ones_like(t)
    return np.concatenate([x, x, left * one, right * one]), np.concatenate([bottom * one, top * one, y, y])


def _bounds(box: Sequence[float], source: int | None, target: int | None, steps: int = 65) -> tuple[float, float, float, float]:
    x, y = project(*_outline(*box, steps), source, target)
    return float(x.min()), float(y.min()), float(x.max()), float(y.max())


# ---- lattices ----


def extents(blocks: DataFrame) -> DataFrame:
    """One row a raster: its edges, pixel size and projection."""
    return blocks.groupBy("raster").agg(
        F.min("left").alias("left"), F.min("bottom").alias("bottom"), F.max("right").alias("right"), F.max("top").alias("top"),
        F.min("dx").alias("dx"), F.min("dy").alias("dy"), F.min("epsg").alias("epsg"),
    )


def common_grid(blocks: DataFrame, box: Sequence[float] | None = None, margin: float = 0.0, epsg: int | None = None) -> Grid | None:
    """The lattice that all rasters are brought to: projection (if ``epsg`` is not given), pixel size and phase are the first raster's by name.

    It covers what the rasters cover together, or the part of it within ``box`` (west, south, east, north in degrees)
    and ``margin`` around, with its edges on the lattice. In a projection other than the first raster's, edges are whole
    multiples of the pixel. None where nothing is left. Blocks need no values for this.
    """
    ship(blocks.sparkSession)
    each = extents(blocks)
    first = each.orderBy("raster").limit(1).collect()
    if not first:
        return None
    of = first[0]
    target = of["epsg"] if epsg is None else epsg

    def moved(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            at = [_bounds((x.left, x.bottom, x.right, x.top), None if pd.isna(x.epsg) else int(x.epsg), target) for x in p.itertuples()]
            yield pd.DataFrame(at, columns=["left", "bottom", "right", "top"], dtype=float)

    all_ = each.mapInPandas(moved, "left double, bottom double, right double, top double")
    left, bottom, right, top = all_.agg(F.min("left"), F.min("bottom"), F.max("right"), F.max("top")).first()
    if box is not None:
        b = _bounds(box, 4326, target)
        left, bottom, right, top = max(left, b[0] - margin), max(bottom, b[1] - margin), min(right, b[2] + margin), min(top, b[3] + margin)
    if left >= right or bottom >= top:
        return None
    dx, dy = of["dx"], of["dy"]
    x, y = (of["left"], of["top"]) if target == of["epsg"] else (0.0, 0.0)
    tiny = 1e-6  # of a pixel, against what a projection rounds
    left, top = x + math.floor((left - x) / dx + tiny) * dx, y - math.floor((y - top) / dy + tiny) * dy
    return Grid(left, top, dx, dy, math.ceil((right - left) / dx - tiny), math.ceil((top - bottom) / dy - tiny), target)


def packed(pixels: DataFrame, grid: Grid, value: str = "value", raster: Column | str = "raster", size: int = 256) -> DataFrame:
    """Blocks of a pixel table (``row, col``, a value and the raster's name); pixels that aren't there are missing."""
    ship(pixels.sparkSession)
    cell = F.struct((F.col("row") % size * size + F.col("col") % size).cast("int").alias("at"), F.col(value).cast("double").alias("v"))
    name = F.col(raster) if isinstance(raster, str) else raster
    gathered = pixels.groupBy(name.alias("raster"), F.floor(F.col("row") / size).cast("int").alias("brow"), F.floor(F.col("col") / size).cast("int").alias("bcol"))
    gathered = gathered.agg(F.collect_list(cell).alias("cells"))  # at most ``size`` squared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                cells = b.column("cells").slice(i, 1).flatten()
                v = np.full(size * size, np.nan)
                v[cells.field("at").to_numpy()] = cells.field("v").to_numpy(zero_copy_only=False)
                yield _batch(b.column("raster")[i].as_py(), b.column("brow")[i].as_py(), b.column("bcol")[i].as_py(), v.reshape(size, size), grid, size)

    return gathered.mapInArrow(run, BLOCKS)


def _batch(name: str, brow: int, bcol: int, v: np.ndarray, grid: Grid, size: int) -> pa.RecordBatch:
    """One block of a lattice, cut at its edge."""
    r, c = brow * size, bcol * size
    v = v[: min(size, grid.height - r), : min(size, grid.width - c)]
    left, top = grid.x0 + c * grid.dx, grid.y0 - r * grid.dy
    row = [name, r, c, *v.shape, left, top - v.shape[0] * grid.dy, left + v.shape[1] * grid.dx, top, grid.dx, grid.dy, grid.epsg, np.ascontiguousarray(v, "<f8").tobytes()]
    types = [pa.string(), *[pa.int32()] * 4, *[pa.float64()] * 6, pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], [*_META, "values"])


# ---- resampling ----


def _cut(name: str, r: int, c: int, v: np.ndarray, size: int) -> Iterator[tuple]:
    """A window of the target lattice (first pixel r, c) in pieces, one for each target block."""
    for br in range(r // size, (r + v.shape[0] - 1) // size + 1):
        for bc in range(c // size, (c + v.shape[1] - 1) // size + 1):
            lo_r, hi_r = max(r, br * size), min(r + v.shape[0], (br + 1) * size)
            lo_c, hi_c = max(c, bc * size), min(c + v.shape[1], (bc + 1) * size)
            part = v[lo_r - r : hi_r - r, lo_c - c : hi_c - c]
            if not np.isnan(part).all():
                yield name, br, bc, lo_r - br * size, lo_c - bc * size, *part.shape, np.ascontiguousarray(part, "<f8").tobytes()


def _bilinear(v: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Means of the valid ones of four pixels by closeness; r and c count from the first centre."""
    lo_r, lo_c = np.floor(r).astype(int), np.floor(c).astype(int)
    total, weights = np.zeros(r.shape), np.zeros(r.shape)
    for i in (0, 1):
        for j in (0, 1):
            rr, cc = lo_r + i, lo_c + j
            inside = (rr >= 0) & (rr < v.shape[0]) & (cc >= 0) & (cc < v.shape[1])
            x = np.where(inside, v[np.clip(rr, 0, v.shape[0] - 1), np.clip(cc, 0, v.shape[1] - 1)], np.nan)
            w = np.where(np.isnan(x), 0.0, (1 - np.abs(r - rr)) * (1 - np.abs(c - cc)))
            total, weights = total + np.where(w > 0, x * w, 0.0), weights + w
    some = weights > _LEAST
    return np.where(some, total / np.where(some, weights, 1.0), np.nan)


def _resampled(x: dict, grid: Grid, size: int, bilinear: bool) -> Iterator[tuple]:
    """Pieces of the target pixels whose centre lies in this block. With a halo, ``values`` has one more pixel on each side."""
    halo = 1 if bilinear else 0
    v = np.frombuffer(x["values"], "<f8").reshape(x["height"] + 2 * halo, x["width"] + 2 * halo)
    dx, dy = x["dx"], x["dy"]
    for a in range(0, x["height"], _WIDTH):
        for b in range(0, x["width"], _WIDTH):
            h, w = min(_WIDTH, x["height"] - a), min(_WIDTH, x["width"] - b)
            left, top = x["left"] + b * dx, x["top"] - a * dy
            box = _bounds((left, top - h * dy, left + w * dx, top), x["epsg"], grid.epsg, 33)
            c0, c1 = max(0, math.floor((box[0] - grid.x0) / grid.dx) - 1), min(grid.width, math.ceil((box[2] - grid.x0) / grid.dx) + 1)
            r0, r1 = max(0, math.floor((grid.y0 - box[3]) / grid.dy) - 1), min(grid.height, math.ceil((grid.y0 - box[1]) / grid.dy) + 1)
            if c0 >= c1 or r0 >= r1:
                continue
            px, py = np.meshgrid(grid.x0 + (np.arange(c0, c1) + 0.5) * grid.dx, grid.y0 - (np.arange(r0, r1) + 0.5) * grid.dy)
            px, py = project(px, py, grid.epsg, x["epsg"])
            # places in the raster's own pixels, so that neighbouring blocks agree on whose a pixel is
            fc, fr = (px - (x["left"] - x["col"] * dx)) / dx, ((x["top"] + x["row"] * dy) - py) / dy
            own_r, own_c = np.floor(fr + 1e-9).astype(int) - x["row"], np.floor(fc + 1e-9).astype(int) - x["col"]
            own = (own_r >= a) & (own_r < a + h) & (own_c >= b) & (own_c < b + w)
            if not own.any():
                continue
            if bilinear:
                got = _bilinear(v, fr - x["row"] + halo - 0.5, fc - x["col"] + halo - 0.5)
            else:
                got = v[np.clip(own_r, 0, x["height"] - 1), np.clip(own_c, 0, x["width"] - 1)]
            yield from _cut(x["raster"], r0, c0, np.where(own, got, np.nan), size)


def _pieces(blocks: DataFrame, grid: Grid, size: int, bilinear: bool) -> DataFrame:
    ship(blocks.sparkSession)
    types = [pa.string(), *[pa.int32()] * 6, pa.binary()]
    names = [x.split()[0] for x in _PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows = list(_resampled(b.slice(i, 1).to_pylist()[0], grid, size, bilinear))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return blocks.mapInArrow(run, _PIECES)


def aligned(blocks: DataFrame, grid: Grid, size: int = 256) -> DataFrame:
    """Pieces of ``blocks`` on a lattice by the nearest pixel: a raster on the same lattice is copied, flags stay whole."""
    return _pieces(blocks, grid, size, bilinear=False)


def warped(blocks: DataFrame, grid: Grid, size: int = 256) -> DataFrame:
    """Pieces of ``blocks`` on a lattice of another projection, bilinear; blocks get one pixel of their neighbours first."""
    return _pieces(with_halo(blocks), grid, size, bilinear=True)


def composite(pieces: DataFrame, grid: Grid, size: int = 256, how: str = "median", name: str = "composite") -> DataFrame:
    """Blocks of a lattice from pieces of many rasters: ``median`` or ``mean`` of a pixel's valid values, or its ``last`` by the raster's name.

    A task holds the pieces of one target block at a time. Blocks that no piece reaches are not there.
    """
    ship(pieces.sparkSession)
    of = {"median": np.nanmedian, "mean": np.nanmean}

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        brow, bcol = map(int, key)
        layers: dict[str, np.ndarray] = {}
        for x in pdf.itertuples():
            layer = layers.setdefault(x.raster, np.full((size, size), np.nan))
            v, part = np.frombuffer(x.values, "<f8").reshape(x.height, x.width), layer[x.r : x.r + x.height, x.c : x.c + x.width]
            np.copyto(part, v, where=~np.isnan(v))
        if how == "last":
            out = np.full((size, size), np.nan)
            for n in sorted(layers):
                np.copyto(out, layers[n], where=~np.isnan(layers[n]))
        else:
            stack = np.stack([layers[n] for n in sorted(layers)])
            some = ~np.isnan(stack).all(axis=0)
            out = np.full((size, size), np.nan)
            out[some] = of[how](stack[:, some], axis=0)
        return _batch(name, brow, bcol, out, grid, size).to_pandas()

    return pieces.groupBy("brow", "bcol").applyInPandas(run, BLOCKS)


def mapped(blocks: DataFrame, of) -> DataFrame:
    """Blocks with ``of`` (array to array, missing as NaN) over their values."""
    ship(blocks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("values")
            done = [np.asarray(of(np.frombuffer(x, "<f8")), "<f8").tobytes() for x in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(done, b.schema.field(at).type))

    return blocks.mapInArrow(run, BLOCKS)


def joined(blocks: DataFrame, raster: Column, size: int = 256) -> DataFrame:
    """Tiles of rasters as blocks of one raster each (named by ``raster``): rows, columns and edges are those of the whole.

    Tiles of a raster must be on one lattice. Its left top corner is that of its outermost tiles.
    """
    named = blocks.withColumn("raster", raster)
    ends = named.groupBy("raster").agg(F.min("left").alias("_x"), F.max("top").alias("_y"))
    at = {"row": F.round((F.col("_y") - F.col("top")) / F.col("dy")).cast("int"), "col": F.round((F.col("left") - F.col("_x")) / F.col("dx")).cast("int")}
    placed = named.join(ends, "raster").withColumns(at)
    span = lambda c, n: F.explode(F.sequence(F.floor(F.col(c) / size), F.floor((F.col(c) + F.col(n) - 1) / size)))
    dealt = placed.withColumn("br", span("row", "height")).withColumn("bc", span("col", "width"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        name, br, bc = key
        r0, c0, x = int(br) * size, int(bc) * size, pdf.iloc[0]
        v = np.full((size, size), np.nan)
        for y in pdf.itertuples():
            part = np.frombuffer(y.values, "<f8").reshape(y.height, y.width)
            lo_r, hi_r, lo_c, hi_c = max(y.row, r0), min(y.row + y.height, r0 + size), max(y.col, c0), min(y.col + y.width, c0 + size)
            v[lo_r - r0 : hi_r - r0, lo_c - c0 : hi_c - c0] = part[lo_r - y.row : hi_r - y.row, lo_c - y.col : hi_c - y.col]
        ends = int((pdf["row"] + pdf["height"]).max()), int((pdf["col"] + pdf["width"]).max())
        epsg = None if pd.isna(x["epsg"]) else int(x["epsg"])
        return _batch(name, int(br), int(bc), v, Grid(x["_x"], x["_y"], x["dx"], x["dy"], ends[1], ends[0], epsg), size).to_pandas()

    return dealt.groupBy("raster", "br", "bc").applyInPandas(run, BLOCKS)


# ---- neighbourhoods ----


def with_halo(blocks: DataFrame) -> DataFrame:
    """Blocks with one pixel of their neighbours on each side (missing where there is none); place and size stay those without.

    A block sends its rim, not itself, to the eight around it. Blocks of a raster must be of one height and width, but
    for those at its right and lower end.
    """
    ship(blocks.sparkSession)
    shape = blocks.groupBy("raster").agg(F.max("height").alias("bh"), F.max("width").alias("bw"))
    placed = blocks.join(shape, "raster")
    placed = placed.withColumns({"br": F.floor(F.col("row") / F.col("bh")).cast("int"), "bc": F.floor(F.col("col") / F.col("bw")).cast("int")}).drop("bh", "bw")
    fields = [*_META, "values"]
    types = {"raster": pa.string(), "values": pa.binary(), "epsg": pa.int32()} | dict.fromkeys(("left", "bottom", "right", "top", "dx", "dy"), pa.float64())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = b.slice(i, 1).to_pylist()[0]
                v = np.frombuffer(x["values"], "<f8").reshape(x["height"], x["width"])
                rows = [x | {"dr": 0, "dc": 0}]
                for dr in (-1, 0, 1):
                    for dc in (-1, 0, 1):
                        if dr or dc:
                            part = v[{-1: slice(0, 1), 0: slice(None), 1: slice(-1, None)}[dr], {-1: slice(0, 1), 0: slice(None), 1: slice(-1, None)}[dc]]
                            rows.append(x | {"br": x["br"] + dr, "bc": x["bc"] + dc, "dr": dr, "dc": dc, "values": np.ascontiguousarray(part).tobytes()})
                names = [*fields, "br", "bc", "dr", "dc"]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types.get(n, pa.int32())) for n in names], names)

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[(pdf["dr"] == 0) & (pdf["dc"] == 0)]
        if own.empty:
            return own[fields]
        x = own.iloc[0]
        h, w = int(x["height"]), int(x["width"])
        v = np.full((h + 2, w + 2), np.nan)
        v[1:-1, 1:-1] = np.frombuffer(x["values"], "<f8").reshape(h, w)
        for y in pdf.itertuples():
            if not (y.dr or y.dc):
                continue
            rim = np.frombuffer(y.values, "<f8")
            # what came from above (sent down) is the first row, and so on
            rows = slice(1, h + 1) if not y.dr else (0 if y.dr > 0 else h + 1)
            cols = slice(1, w + 1) if not y.dc else (0 if y.dc > 0 else w + 1)
            if y.dr and y.dc:
                v[rows, cols] = rim[0]
            elif y.dr:
                n = min(w, len(rim))
                v[rows, 1 : n + 1] = rim[:n]
            else:
                n = min(h, len(rim))
                v[1 : n + 1, cols] = rim[:n]
        return own.assign(values=[v.astype("<f8").tobytes()])[fields]

    sent = placed.select(*fields, "br", "bc").mapInArrow(send, f"{BLOCKS}, br int, bc int, dr int, dc int")
    return sent.groupBy("raster", "br", "bc").applyInPandas(join, BLOCKS)


def window_median(blocks: DataFrame, least: int = 5) -> DataFrame:
    """Median of each pixel's 3 by 3 neighbourhood where ``least`` pixels are valid; missing elsewhere and at the raster's rim."""
    edges = extents(blocks).select("raster", *[F.col(c).alias(f"_{c}") for c in ("left", "bottom", "right", "top")])
    haloed = with_halo(blocks).join(edges, "raster")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = b.slice(i, 1).to_pylist()[0]
                h, w = x["height"], x["width"]
                around = sliding_window_view(np.frombuffer(x["values"], "<f8").reshape(h + 2, w + 2), (3, 3)).reshape(h, w, 9)
                enough = (~np.isnan(around)).sum(axis=2) >= least
                rim = {"top": (0, None), "bottom": (-1, None), "left": (None, 0), "right": (None, -1)}
                for side, (r, c) in rim.items():
                    if abs(x[side] - x[f"_{side}"]) < 0.5 * x["dx"]:
                        enough[slice(None) if r is None else r, slice(None) if c is None else c] = False
                out = np.full((h, w), np.nan)
                out[enough] = np.nanmedian(around[enough], axis=1)
                row = {n: x[n] for n in _META} | {"values": out.astype("<f8").tobytes()}
                yield pa.RecordBatch.from_pylist([row], schema=b.select([*_META, "values"]).schema)

    return haloed.mapInArrow(run, BLOCKS)
