"""Vector tables as packed blocks, and an order that keeps near vectors together."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbside.llm.scratch import Scratch


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` (doubles) of the vectors that can be compared.

    Left out: null and zero vectors, vectors with null or non-finite components, and rows
    without an id. Vectors of different lengths all stay; they are compared with their like.
    """
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding"))
        .filter("vec_id is not null and embedding is not null")
        .filter(finite & F.exists(e, lambda x: x != 0))
    )


def runs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """``first, end, matrix`` of each run of rows with one length, of a list column of doubles."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if not len(lengths):
        return
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    cuts = np.flatnonzero(np.diff(lengths)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(lengths)], strict=True):
        yield int(lo), int(hi), flat[ends[lo] : ends[hi]].reshape(hi - lo, -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, "<f8").tobytes()


def unpacked(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(rows, -1)


@dataclass(frozen=True)
class Splits:
    """A tree of half-spaces; rows that fall into one leaf, or into neighbouring ones, tend to be near."""

    directions: np.ndarray
    edges: np.ndarray
    sides: np.ndarray  # of each node: its two children, or -1 - leaf

    @classmethod
    def fit(cls, x: np.ndarray, leaf: int = 8, seed: int = 29) -> Splits:
        """Over a bounded sample: each node parts its rows between two that lie far apart, where the two halves'
        squares are least."""
        rng = np.random.default_rng(seed)
        directions, edges, sides, leaves = [], [], [], 0

        def grow(rows: np.ndarray, depth: int) -> int:
            nonlocal leaves
            found = cls._cut(x[rows], rng) if len(rows) > leaf and depth < 40 else None
            if found is None:
                leaves += 1
                return -leaves
            direction, edge = found
            node = len(edges)
            directions.append(direction)
            edges.append(edge)
            sides.append([0, 0])
            high = x[rows] @ direction > edge
            for side, part in enumerate((rows[~high], rows[high])):
                sides[node][side] = grow(part, depth + 1)
            return node

        grow(np.arange(len(x)), 0)
        dims = x.shape[1]
        return cls(np.array(directions).reshape(-1, dims), np.array(edges), np.array(sides, np.int64).reshape(-1, 2))

    @staticmethod
    def _cut(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float] | None:
        far = x[int(rng.integers(len(x)))]
        ends = []
        for _ in range(2):
            far = x[int(((x - far) ** 2).sum(axis=1).argmax())]
            ends.append(far)
        direction = ends[0] - ends[1]
        at = np.sort(x @ direction)
        n, sums = np.arange(1, len(at)), np.cumsum(at)
        between = (sums[:-1] - n * at.mean()) ** 2 / (n * (len(at) - n))  # larger: smaller squares within
        k = int(between.argmax())
        edge = (at[k] + at[k + 1]) / 2
        return (direction, float(edge)) if at[k] < edge < at[k + 1] else None

    def code(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row; leaves are numbered from left to right."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))] if len(self.edges) else []
        while todo:
            node, rows = todo.pop()
            high = x[rows] @ self.directions[node] > self.edges[node]
            for side, part in enumerate((rows[~high], rows[high])):
                to = int(self.sides[node, side])
                if to < 0:
                    out[part] = -1 - to
                elif len(part):
                    todo.append((to, part))
        return out


def sampled_splits(good: DataFrame, rows: int, most: int, shape) -> dict[int, Splits]:
    """By vector length, a tree over at most ``most`` of the ``rows`` vectors, those with the smallest hash of their id.

    It only orders vectors; every vector is used. ``shape`` is applied to the sampled matrix first.
    """
    h = F.xxhash64("vec_id")
    near = good.filter(F.pmod(h, F.lit(1 << 30)) <= int(min(1.0, 2.0 * most / max(1, rows)) * (1 << 30)))
    table = near.orderBy(h, "vec_id").limit(most).select("embedding").toArrow()
    by_length: dict[int, list[np.ndarray]] = {}
    for chunk in table.column("embedding").chunks:
        for _, _, x in runs(chunk):
            by_length.setdefault(x.shape[1], []).append(x)
    return {d: Splits.fit(shape(np.concatenate(parts))) for d, parts in by_length.items()}


def _coded(trees: dict[int, Splits], shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, x in runs(b.column("embedding")):
                tree, n = trees.get(x.shape[1]), hi - lo
                code = tree.code(shape(x)) if tree else np.zeros(n, np.int64)
                dims = np.full(n, x.shape[1], np.int32)
                some = b.slice(lo, n)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(dims), pa.array(code)], ["vec_id", "embedding", "dims", "code"])

    return run


def grouped(good: DataFrame, scratch: Scratch, trees: dict[int, Splits], shape, total: int, size: int) -> DataFrame:
    """``group, vec_id, embedding`` of all ``total`` vectors in the trees' order: about ``size`` neighbours have one group.

    Partitions are sorted and hold whole groups. Vectors are ranged over partitions, and neighbouring partitions
    make up the groups, so a leaf of any size, or many equal vectors, are cut.
    """
    parts, order = int(good.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["dims", "code", "vec_id"]
    groups = max(1, -(-total // size))
    coded = scratch.table(good.mapInArrow(_coded(trees, shape), "vec_id long, embedding array<double>, dims int, code long"), "coded")
    ranged = scratch.table(coded.repartitionByRange(max(4 * groups, parts), *order).withColumn("part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")  # one row a partition
    group = scratch.table(sizes.select("part", F.floor(before / size).alias("group")), "groups")
    return (
        ranged.join(group, "part")  # one row a partition: sent to all tasks while Spark finds it small enough
        .repartition(max(1, min(groups, 4 * parts)), "group")
        .sortWithinPartitions("group", *order)
        .select("group", "vec_id", "embedding")
    )


def pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``number, ids, matrix`` of the rows of each group and length, at most ``most`` at a time; numbers are unique."""
    number = TaskContext.get().partitionId() << 32
    parts, n, own = [], 0, None
    for b in batches:
        keys, ids = b.column("group").to_numpy(), b.column("vec_id").to_numpy()
        for lo, hi, x in runs(b.column("embedding")):
            at = lo
            while at < hi:
                key = (int(keys[at]), x.shape[1])
                if parts and (key != own or n >= most):
                    yield number, *(np.concatenate(p) for p in zip(*parts, strict=True))
                    number, parts, n = number + 1, [], 0
                own = key
                end = min(lo + int(np.searchsorted(keys[lo:hi], keys[at], side="right")), at + most - n)
                parts.append((ids[at:end].copy(), x[at - lo : end - lo].copy()))
                n, at = n + end - at, end
    if parts:
        yield number, *(np.concatenate(p) for p in zip(*parts, strict=True))
