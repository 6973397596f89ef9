"""Embedding near-dedup by a subspace pigeonhole join.

Two unit vectors with cosine c are at squared distance 2 - 2c. After a seeded
rotation, which spreads distance evenly over the coordinates, the coordinates are split
into blocks, and each block gets the part of that squared distance which is
proportional to its dimensions. A pair within the distance is within the budget of
one block at least, so the union of the blocks' range joins holds every link;
candidates are then verified by cosine in doubles on the original vectors.

Vectors are ordered by a tree of half-spaces (fitted on a bounded sample, applied to all) and packed into
tiles with a bounding box. The range join of a block is first one of boxes: tiles meet by an equal
join on the cells that their boxes, widened by the block's radius, cover along the block's first coordinate,
and are kept if the boxes come within the budget in the whole block. Each surviving pair of
tiles is one row for one task, whose memory is bounded; there the same test of boxes is made for pairs of
smaller pieces, and in what is left squared distances block by block in one product each, the union of
what passes, and the exact check. No pair of vectors leaves a task: a task sends each vector's number
of links, and one edge for each pair of the tiles' own components that are linked. So a
group of any size costs no skew and few rows.

Defined results: vectors that are no usable vector (``vectors.usable``) link with nothing
and are components of their own, and so do vectors of different lengths with each other; rows that
share an id are one vector in the result, which counts a link for each row it meets, and link with
nothing through each other; other columns take no part; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.components import connected_components
from kerbside.llm.scratch import Scratch
from kerbside.llm.vectors import grouped, packed, pieces, sampled_splits, unit, unpacked, usable

#: Relative room for rounding in single precision; candidates are verified in doubles.
ROOM = 1e-4
#: Rows of the pieces of tiles that are compared at a time.
PIECE = 1024


def rotation(dims: int, seed: int = 29) -> np.ndarray:
    """A seeded random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def splits(dims: int, block: int) -> list[slice]:
    return [slice(at, min(at + block, dims)) for at in range(0, dims, block)]


def shares(dims: int, least: float, block: int) -> list[tuple[slice, float]]:
    """Each block and its part of the squared distance, with room for rounding."""
    budget = 2 - 2 * least
    return [(s, budget * (s.stop - s.start) / dims * (1 + ROOM) + 1e-6) for s in splits(dims, block)]


def candidates(a: np.ndarray, b: np.ndarray, least: float, block: int) -> np.ndarray | None:
    """Pairs of rotated unit rows that are within the budget of at least one block; None if the boxes rule all out."""
    out = None
    for s, share in shares(a.shape[1], least, block):
        x, y = a[:, s], b[:, s]
        gap = np.maximum(np.maximum(x.min(0) - y.max(0), y.min(0) - x.max(0)), 0)
        if (gap.astype(np.float64) ** 2).sum() > share:
            continue
        d = x @ y.T
        d *= -2
        d += np.einsum("ij,ij->i", x, x)[:, None]
        d += np.einsum("ij,ij->i", y, y)[None, :]
        out = d <= share if out is None else out | (d <= share)
    return out


def verified(near: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Of candidate pairs of unit rows, those whose cosine reaches ``least``."""
    rows, cols = np.nonzero(near)
    if len(rows) > near.size // 16:
        return near & (a @ b.T >= least)
    for at in range(0, len(rows), 1 << 15):
        r, c = rows[at : at + (1 << 15)], cols[at : at + (1 << 15)]
        near[r, c] = np.einsum("ij,ij->i", a[r], b[c]) >= least
    return near


class Tile:
    """Unit rows, their rotation in single precision, and the ids; cut into pieces."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, seed: int):
        self.ids, self.u = ids, unit(x)
        self.spun = (self.u @ rotation(x.shape[1], seed)).astype(np.float32)
        self.pieces = [slice(at, min(at + PIECE, len(ids))) for at in range(0, len(ids), PIECE)]


def linked(a: Tile, b: Tile, least: float, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``a`` and rows of ``b`` that are linked, some pairs at a time; both ways if they are one tile."""
    for p in a.pieces:
        for q in b.pieces:
            near = candidates(a.spun[p], b.spun[q], least, block)
            if near is None:
                continue
            near &= a.ids[p][:, None] != b.ids[q][None, :]
            i, j = np.nonzero(verified(near, a.u[p], b.u[q], least))
            yield i + p.start, j + q.start


def _different(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of two columns of numbers below ``n``."""
    key = np.unique(a * n + b)
    return key // n, key % n


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each row's least known row of its component) after linking rows ``i`` with rows ``j``."""
    i, j = label[i], label[j]
    apart = i != j
    i, j = _different(i[apart], j[apart], len(label))
    root = np.arange(len(label))
    while len(i):
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            break
        root = low
    return root[label]


TILE = "tile long, dims int, ids binary, vectors binary, component binary, links binary, low array<double>, high array<double>"


def _tiled(tile: int, least: float, block: int, seed: int):
    """Sorted rows to tiles, each with its own links counted and its own components named."""

    def made(number: int, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)  # rows by id, so that a component's least row is its least id
        rank[order] = np.arange(len(ids))
        own = Tile(ids, x, seed)
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for i, j in linked(own, own, least, block):
            links += np.bincount(i, minlength=len(ids))
            label = _joined(label, rank[i], rank[j])
        component = ids[order][label[rank]]
        values = [[number], [x.shape[1]], [ids.tobytes()], [packed(x)], [component.tobytes()], [links.astype("<i8").tobytes()]]
        kinds = [pa.int64(), pa.int32()] + [pa.binary()] * 4
        cols = [pa.array(v, k) for v, k in zip(values, kinds, strict=True)]
        for edge in (own.spun.min(axis=0), own.spun.max(axis=0)):
            cols.append(pa.array([edge.astype(np.float64).tolist()], pa.list_(pa.float64())))
        return pa.RecordBatch.from_arrays(cols, ["tile", "dims", "ids", "vectors", "component", "links", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, x in pieces(batches, 2 * tile):
            yield made(number, ids, x)

    return run


def _pairs(least: float, block: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                v = {n: b.column(n)[r].as_py() for n in b.schema.names}
                ids, other = np.frombuffer(v["ids"], "<i8"), np.frombuffer(v["other_ids"], "<i8")
                roots, root = np.unique(np.frombuffer(v["component"], "<i8"), return_inverse=True)
                other_roots, other_root = np.unique(np.frombuffer(v["other_component"], "<i8"), return_inverse=True)
                size = max(len(roots), len(other_roots))
                x, y = Tile(ids, unpacked(v["vectors"], len(ids)), seed), Tile(other, unpacked(v["other_vectors"], len(other)), seed)
                n, m, edges = np.zeros(len(ids), np.int64), np.zeros(len(other), np.int64), []
                for i, j in linked(x, y, least, block):
                    n += np.bincount(i, minlength=len(ids))
                    m += np.bincount(j, minlength=len(other))
                    edges.append(_different(root[i], other_root[j], size))
                if not n.any():
                    continue
                edge = _different(*np.concatenate(edges, axis=1), size)
                edge = roots[edge[0]], other_roots[edge[1]]
                a = np.concatenate([ids[n > 0], other[m > 0], edge[0]])
                c = np.concatenate([n[n > 0], m[m > 0], np.zeros(len(edge[0]), np.int64)])
                to = np.concatenate([ids[n > 0], other[m > 0], edge[1]])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), pa.array(to)], ["a", "n", "b"])

    return run


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in range(b.num_rows):
            ids, root, n = (np.frombuffer(b.column(c)[r].as_py(), "<i8") for c in ("ids", "component", "links"))
            some = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(n[some]), pa.array(root[some])], ["a", "n", "b"])


def tiles_of(
    vectors: DataFrame, scratch: Scratch, least: float, block: int, tile_floats: int, sample: int, seed: int
) -> DataFrame:
    """The tiles of all usable vectors: near ones together, about ``tile_floats`` components each."""
    good = usable(vectors)
    count, dims = good.agg(F.count("*"), F.max(F.size("embedding"))).first()
    tile = max(16, tile_floats // (dims or 1))
    trees = sampled_splits(good, count, sample, unit)
    dealt = grouped(good, scratch, trees, unit, count, tile)
    return scratch.table(dealt.mapInArrow(_tiled(tile, least, block, seed), TILE), "tiles")


def tile_pairs(tiles: DataFrame, least: float, block: int) -> DataFrame:
    """``tile, other``: the pairs of tiles whose boxes come within the budget of at least one block."""
    share = (2 - 2 * least) * (1 + ROOM) + 1e-6
    budget = F.lit(share) * F.least(F.lit(block), F.col("dims") - F.col("start")) / F.col("dims")
    cells = (
        tiles.select("tile", "dims", "low", "high")
        .withColumn("start", F.explode(F.sequence(F.lit(0), F.col("dims") - 1, F.lit(block))))
        .withColumn("width", F.sqrt(budget))  # along one coordinate a pair within the budget is within its radius
        .select(
            "tile", "dims", "low", "high", "start",
            F.explode(
                F.sequence(
                    F.floor(F.col("low")[F.col("start")] / F.col("width")) - 1,
                    F.floor(F.col("high")[F.col("start")] / F.col("width")) + 1,
                )
            ).alias("cell"),
        )
    )
    x, y = cells.alias("x"), cells.select(*[F.col(c).alias(f"o_{c}") for c in cells.columns]).alias("y")
    same = [F.col(c) == F.col(f"o_{c}") for c in ("dims", "start", "cell")]
    met = x.join(y, same[0] & same[1] & same[2] & (F.col("tile") < F.col("o_tile")))
    part = lambda c: F.slice(c, F.col("start") + 1, block)
    gap = F.zip_with(
        F.zip_with(part("low"), part("o_high"), lambda p, q: p - q),
        F.zip_with(part("o_low"), part("high"), lambda p, q: p - q),
        lambda p, q: F.greatest(p, q, F.lit(0.0)),
    )
    apart = F.aggregate(gap, F.lit(0.0), lambda acc, g: acc + g * g)
    return met.filter(apart <= budget).select("tile", F.col("o_tile").alias("other")).distinct()


def near_duplicates(
    vectors: DataFrame,
    scratch: Scratch,
    least: float = 0.9,
    block: int = 16,
    tile_floats: int = 1 << 19,
    sample: int = 2048,
    seed: int = 29,
) -> DataFrame:
    """``vec_id, n_links, component_id`` for every row of ``vectors(vec_id, embedding)`` with an id."""
    tiles = tiles_of(vectors, scratch, least, block, tile_floats, sample, seed)
    close = scratch.table(tile_pairs(tiles, least, block), "tile-pairs")
    body = tiles.select("tile", "ids", "vectors", "component")
    facing = tiles.select(F.col("tile").alias("other"), *[F.col(c).alias(f"other_{c}") for c in ("ids", "vectors", "component")])
    pairs = close.join(body.hint("merge"), "tile").join(facing.hint("merge"), "other")
    schema = "a long, n long, b long"
    found = scratch.table(
        pairs.mapInArrow(_pairs(least, block, seed), schema).unionByName(tiles.select("ids", "component", "links").mapInArrow(_own, schema)),
        "links",
    )
    counts = found.filter("n > 0").groupBy("a").agg(F.sum("n").alias("n_links"))
    labels = connected_components(found.filter("a <> b").select("a", "b"), scratch)
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).filter("vec_id is not null").distinct()
    return (
        ids.join(counts.withColumnRenamed("a", "vec_id"), "vec_id", "left")
        .join(labels.withColumnRenamed("node", "vec_id"), "vec_id", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    )
