"""Approximate nearest neighbours with a vantage-point tree per shard.

Vectors are ordered by a tree of half-spaces (fitted on a bounded sample, applied to all) and cut into
shards of about ``shard_rows`` neighbours, or of more where the table of their centres would outgrow ``MOST_CENTRES``. A shard is
described by its centre and radius. Blocks of queries, in the same order, are sent to the shards that can hold a neighbour: by the
triangle inequality one whose centre is further away than its radius and the k-th best can be holds
none, and the k-th best is no further than the centre of any shard of more than k rows and that shard's
radius. Each shard's tree is built where it is searched, and queries stream past it. A
subtree is skipped when the distance to its vantage point differs from the split
radius by more than ``1 / relax`` times the distance of the k-th best so far. ``relax`` 1 restores exact search;
larger values skip more shards and subtrees. The best of all shards are merged by a ranked window that Spark
limits to k per query before shuffling.

Defined results: rows that are no usable vector (see ``vectors.usable``) neither ask
nor answer; a query meets vectors of its own length; equal distances go to the smaller id; with fewer
than k candidates all are returned; rows that share an id are candidates each, but not of a query of
that id; other columns take no part; empty tables give no rows. Distances are Euclidean, in doubles, on the
original vectors; they are scaled where squares would overflow or vanish.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbside.llm.scratch import Scratch
from kerbside.llm.vectors import grouped, packed, pieces, sampled_splits, unpacked, usable

LEAF = 64
#: Most bytes of centres, which all tasks get, but for one centre more of each length of vectors; shards grow with the table to keep to it.
MOST_CENTRES = 32 << 20


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between rows, summed in order as one would by hand; rows whose squares would overflow or vanish are scaled."""
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        diff = a - b
        d = np.sqrt(np.cumsum(diff * diff, axis=1)[:, -1])
        most = np.abs(diff).max(axis=1)
        odd = np.flatnonzero((most > 0) & ~((most > 1e-140) & (most < 1e140)))
        if len(odd):
            half = np.isinf(most[odd])
            some = np.where(half[:, None], a[odd] / 2 - b[odd] / 2, diff[odd])
            power = np.frexp(np.abs(some).max(axis=1))[1]
            some = np.ldexp(some, -power[:, None])
            d[odd] = np.ldexp(np.sqrt(np.cumsum(some * some, axis=1)[:, -1]), power + half)
    return d


def _power(x: np.ndarray) -> int:
    """The power of two that brings the largest component below 1."""
    return int(np.frexp(np.abs(x).max())[1]) if x.size else 0


class VPTree:
    """Nodes are (vantage row, radius, inside, outside), leaves are row arrays; radii in the scale of ``power``."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 11):
        self.ids, self.vectors, self.power = ids, vectors, _power(vectors)
        self.rng = np.random.default_rng(seed)
        self.root = self._build(np.ldexp(vectors, -self.power), np.arange(len(ids)))

    def _build(self, x: np.ndarray, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        pick = int(self.rng.integers(len(rows)))
        vantage, rest = rows[pick], np.delete(rows, pick)
        d = np.linalg.norm(x[rest] - x[vantage], axis=1)
        radius = float(np.median(d))
        inside = d <= radius
        if inside.all():  # all as far: no split helps
            return rows
        return vantage, radius, self._build(x, rest[inside]), self._build(x, rest[~inside])

    def search(
        self, ids: np.ndarray, queries: np.ndarray, k: int, relax: float, most: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: none) and distances of the k nearest of each query, its own id left out.

        ``most``: a distance of each query that its k-th best is known not to exceed; infinite where nothing is known.
        """
        best_d = np.full((len(ids), k), np.inf)
        best_i = np.full((len(ids), k), -1, np.int64)
        most = np.full(len(ids), np.inf) if most is None else most
        power = max(self.power, _power(queries))
        x, y = np.ldexp(self.vectors, -power), np.ldexp(queries, -power)
        turned = math.ldexp(1.0, max(self.power - power, -1074))
        of_x, of_y = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)

        def limit(q: np.ndarray) -> np.ndarray:
            return np.ldexp(np.minimum(best_d[q, -1], most[q]), -power)

        def offer(q: np.ndarray, rows: np.ndarray) -> None:
            both = of_y[q][:, None] + of_x[rows][None, :]
            near = both - 2 * (y[q] @ x[rows].T)
            with np.errstate(over="ignore"):
                least = limit(q) ** 2
            at, of = np.nonzero((near <= least[:, None] + 1e-9 * both) & (self.ids[rows][None, :] != ids[q][:, None]))
            if not len(at):
                return
            exact = np.full((len(q), len(rows)), np.inf)
            found = np.full((len(q), len(rows)), -1, np.int64)
            for lo in range(0, len(at), 1 << 14):
                a, o = at[lo : lo + (1 << 14)], of[lo : lo + (1 << 14)]
                exact[a, o] = distances(queries[q[a]], self.vectors[rows[o]])
                found[a, o] = self.ids[rows[o]]
            hit = np.unique(at)
            d = np.concatenate([best_d[q[hit]], exact[hit]], axis=1)
            i = np.concatenate([best_i[q[hit]], found[hit]], axis=1)
            order = np.lexsort((i, i < 0, d), axis=-1)[:, :k]
            best_d[q[hit]] = np.take_along_axis(d, order, axis=1)
            best_i[q[hit]] = np.take_along_axis(i, order, axis=1)

        def visit(node, q: np.ndarray) -> None:
            if not len(q):
                return
            if isinstance(node, np.ndarray):
                for lo in range(0, len(node), 2048):
                    offer(q, node[lo : lo + 2048])
                return
            vantage, radius, inside, outside = node
            radius *= turned
            offer(q, np.array([vantage]))
            d = np.linalg.norm(y[q] - x[vantage], axis=1)
            within = d <= radius
            for near, far, own in ((inside, outside, within), (outside, inside, ~within)):
                some, gap = q[own], np.abs(d[own] - radius)
                visit(near, some)
                visit(far, some[(gap - 1e-9) * relax <= limit(some)])

        visit(self.root, np.arange(len(ids)))
        return best_i, best_d


SHARD = "shard long, dims int, others long, ids binary, vectors binary, centre binary, radius double"


def _shards(most: int):
    """Sorted rows to shards, each with its mean and the distance of the vector furthest from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, x in pieces(batches, most):
            power = _power(x)
            centre = np.ldexp(np.ldexp(x, -power).mean(axis=0), power)
            radius = float(distances(x, np.broadcast_to(centre, x.shape)).max())
            others = len(ids) - int(np.unique(ids, return_counts=True)[1].max())  # rows of other ids than any one
            values = [number, x.shape[1], others, ids.tobytes(), packed(x), packed(centre), radius]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64()]
            names = [f.split()[0] for f in SHARD.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names)

    return run


QUERIES = "block long, dims int, ids binary, vectors binary"
ASKED = "shard long, ids binary, vectors binary, most binary"


def _query_blocks(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, x in pieces(batches, most):
            values = [pa.array([number]), pa.array([x.shape[1]], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([packed(x)], pa.binary())]
            yield pa.RecordBatch.from_arrays(values, ["block", "dims", "ids", "vectors"])

    return run


def reachable(x: np.ndarray, centres: np.ndarray, radii: np.ndarray, others: np.ndarray, k: int, relax: float) -> tuple[np.ndarray, np.ndarray]:
    """Which shards each query has to ask, and what its k-th best cannot exceed."""
    d = np.stack([distances(x, np.broadcast_to(c, x.shape)) for c in centres], axis=1)
    room = 1 + 1e-9  # rounding of distances and radii
    with np.errstate(over="ignore", invalid="ignore"):
        far = np.where(others >= k, (d + radii) * room, np.inf)
        most = far.min(axis=1)
        least = np.nan_to_num(d / room - radii * room, nan=0.0)
        return least * relax <= most[:, None], most


def _ask(centres: dict[int, tuple[np.ndarray, ...]], k: int, relax: float):
    """Query blocks to the shards that can hold a neighbour of one of their queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ids = np.frombuffer(b.column("ids")[r].as_py(), "<i8")
                x = unpacked(b.column("vectors")[r].as_py(), len(ids))
                if x.shape[1] not in centres:
                    continue
                shards, *stats = centres[x.shape[1]]
                ask, most = reachable(x, *stats, k, relax)
                for j in np.flatnonzero(ask.any(axis=0)).tolist():
                    q = ask[:, j]
                    values = [pa.array([shards[j]]), *(pa.array([v], pa.binary()) for v in (ids[q].tobytes(), packed(x[q]), packed(most[q])))]
                    yield pa.RecordBatch.from_arrays(values, ["shard", "ids", "vectors", "most"])

    return run


def _search(k: int, relax: float):
    """Over rows sorted by (shard, later): a shard's tree, then the queries that ask it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for b in batches:
            for r in range(b.num_rows):
                ids = np.frombuffer(b.column("ids")[r].as_py(), "<i8")
                x = unpacked(b.column("vectors")[r].as_py(), len(ids))
                if b.column("later")[r].as_py() == 0:
                    tree = VPTree(ids, x)
                    continue
                most = b.column("most")[r].as_py()
                found, d = tree.search(ids, x, k, relax, None if most is None else np.frombuffer(most, "<f8"))
                ok = found >= 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, ok.sum(axis=1))), pa.array(found[ok]), pa.array(d[ok])],
                    ["query_id", "vec_id", "score"],
                )

    return run


def shard_size(total: int, dims: int, least: int) -> int:
    """Rows of a shard: ``least``, or as many as keep the centres (at most two for as many rows) within ``MOST_CENTRES``."""
    return max(least, -(-2 * total * dims * 8 // MOST_CENTRES))


def _centres(shards: DataFrame) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: shards, centres, radii and numbers of other rows."""
    table = shards.select("shard", "dims", "others", "centre", "radius").toArrow().to_pylist()
    out = {}
    for d in {r["dims"] for r in table}:
        own = [r for r in table if r["dims"] == d]
        centres = np.stack([np.frombuffer(r["centre"], "<f8") for r in own])
        out[d] = (*(np.array([r[c] for r in own]) for c in ("shard",)), centres, *(np.array([r[c] for r in own]) for c in ("radius", "others")))
    return out


def nearest(
    queries: DataFrame,
    vectors: DataFrame,
    scratch: Scratch,
    k: int = 10,
    relax: float = 1.0,
    shard_rows: int = 4096,
    block: int = 1024,
    sample: int = 2048,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest of ``vectors`` for each of ``queries`` (both ``vec_id, embedding``)."""
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    same = lambda x: x
    rows, asked = usable(vectors), usable(queries)
    total, dims = rows.agg(F.count("*"), F.max(F.size("embedding"))).first()
    shard_rows = shard_size(total, dims or 0, shard_rows)
    trees = sampled_splits(rows, total, sample, same)
    shards = scratch.table(
        grouped(rows, scratch, trees, same, total, shard_rows).mapInArrow(_shards(2 * shard_rows), SHARD), "shards"
    )
    blocks = scratch.table(
        grouped(asked, scratch, trees, same, asked.count(), block).mapInArrow(_query_blocks(block), QUERIES), "queries"
    )
    count = shards.count()
    sent = blocks.repartition(max(1, min(count, parts)), "block").mapInArrow(_ask(_centres(shards), k, relax), ASKED)
    trees_of = shards.select("shard", "ids", "vectors", F.lit(None).cast("binary").alias("most"), F.lit(0).alias("later"))
    found = (
        trees_of.unionByName(sent.withColumn("later", F.lit(1)))
        .repartition(max(1, min(count, 4 * parts)), "shard")
        .sortWithinPartitions("shard", "later")
        .mapInArrow(_search(k, relax), "query_id long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
