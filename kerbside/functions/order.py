"""Exact order statistics and running sums over all rows, without a task that sees them all."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbside.scratch import Scratch

#: Values that may reach the driver, or be held by one aggregate, at a time.
HELD = 100_000
#: Relative rank error of the sketch that narrows a search.
ERROR = 1e-4


def _pick(rows: Sequence[tuple[Any, int]], rank: int) -> Any:
    for value, n in sorted(rows):
        if rank < n:
            return value
        rank -= n
    raise IndexError("no such rank")


def nth_values(df: DataFrame, ranks: Mapping[str, Sequence[int]]) -> dict[str, list[Any]]:
    """Of each column, its values at 0-based ranks in ascending order; missing values don't count.

    Exact: a mergeable sketch brackets every rank, one aggregate counts what lies below and within the brackets, and
    what lies within is searched in turn until it is few enough to be looked at. Each step is one pass for all columns.
    """
    wanted = [(c, r) for c, own in ranks.items() for r in own]
    if not wanted:
        return {c: [] for c in ranks}
    counts = df.agg(*[F.count(c).alias(c) for c in ranks]).first()
    large = sorted({(c, r) for c, r in wanted if counts[c] > HELD})
    brackets = _brackets(df, large, counts) if large else {}
    found: dict[tuple[str, int], Any] = {}
    near: dict[str, list[tuple[str, int, Column, int]]] = {}
    for c, r in sorted(set(wanted)):
        low, high, below, within = brackets.get((c, r), (None, None, 0, counts[c]))
        if (c, r) in brackets and low == high:
            found[c, r] = low
        elif within <= HELD:
            inside = F.col(c).isNotNull() if low is None else F.col(c).between(F.lit(low), F.lit(high))
            near.setdefault(df.schema[c].dataType.simpleString(), []).append((c, r, inside, r - below))
        else:
            found[c, r] = _narrowed(df.select(c).filter(F.col(c).between(F.lit(low), F.lit(high))), c, r - below)
    for targets in near.values():  # one pass for each type of column
        cells = F.array(*[F.when(inside, F.struct(F.lit(i).alias("i"), F.col(c).alias("v"))) for i, (c, _, inside, _) in enumerate(targets)])
        rows = df.select(F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("x")).groupBy("x.i", "x.v").agg(F.count("*").alias("n")).collect()
        of: dict[int, list[tuple[Any, int]]] = {}
        for r in rows:
            of.setdefault(r["i"], []).append((r["v"], r["n"]))
        for i, (c, r, _, rank) in enumerate(targets):
            found[c, r] = _pick(of[i], rank)
    return {c: [found[c, r] for r in own] for c, own in ranks.items()}


def _brackets(df: DataFrame, wanted: Sequence[tuple[str, int]], counts: Mapping[str, int]) -> dict[tuple[str, int], tuple]:
    """Of each (column, rank): two values around it, how many rows lie below the first and how many between them."""
    ends = lambda c, r: (max(0.0, r / counts[c] - 3 * ERROR), min(1.0, r / counts[c] + 3 * ERROR))
    cuts = [F.percentile_approx(c, F.array(*map(F.lit, ends(c, r))), F.lit(int(1 / ERROR))).alias(str(i)) for i, (c, r) in enumerate(wanted)]
    row = df.agg(*cuts).first()
    tests = []
    for i, (c, _) in enumerate(wanted):
        tests += [F.count(F.when(F.col(c) < F.lit(row[i][0]), 1)), F.count(F.when(F.col(c) <= F.lit(row[i][1]), 1))]
    n = df.agg(*tests).first()
    out = {}
    for i, (c, r) in enumerate(wanted):
        if not n[2 * i] <= r < n[2 * i + 1]:
            raise ArithmeticError(f"{c}: rank {r} is outside its bracket")
        out[c, r] = (row[i][0], row[i][1], n[2 * i], n[2 * i + 1] - n[2 * i])
    return out


def _narrowed(df: DataFrame, c: str, rank: int) -> Any:
    """The value at a rank of one column with many rows: few distinct values are looked at, else searched again."""
    rows = df.groupBy(c).agg(F.count("*").alias("n")).limit(HELD + 1).collect()
    return _pick([tuple(r) for r in rows], rank) if len(rows) <= HELD else nth_values(df, {c: [rank]})[c][0]


def quantiles(df: DataFrame, wanted: Mapping[str, Sequence[float]]) -> dict[str, list[float | None]]:
    """Exact linearly interpolated quantiles of each column; None without values."""
    counts = df.agg(*[F.count(c).alias(c) for c in wanted]).first()
    out: dict[str, list[float | None]] = {c: [None] * len(q) for c, q in wanted.items()}
    few = [c for c in wanted if 0 < counts[c] <= HELD]
    if few:
        row = df.agg(*[F.percentile(c, F.array(*[F.lit(float(q)) for q in wanted[c]])).alias(c) for c in few]).first()
        out |= {c: list(row[c]) for c in few}
    many = [c for c in wanted if counts[c] > HELD]
    places = {c: [q * (counts[c] - 1) for q in wanted[c]] for c in many}
    got = nth_values(df, {c: sorted({f(p) for p in places[c] for f in (math.floor, math.ceil)}) for c in many})
    for c in many:
        at = dict(zip(sorted({f(p) for p in places[c] for f in (math.floor, math.ceil)}), map(float, got[c]), strict=True))
        out[c] = [at[math.floor(p)] + (p - math.floor(p)) * (at[math.ceil(p)] - at[math.floor(p)]) for p in places[c]]
    return out


def running(df: DataFrame, order: Sequence[str], weight: str, out: str, scratch: Scratch) -> DataFrame:
    """``df`` with the sum of ``weight`` over all rows before each in ascending order (rows must differ in ``order``).

    Rows are range-partitioned and written; a partition's base is the sum of the partitions before it, one row each.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = scratch.table(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("_part").agg(F.sum(weight).alias("_n"))
    base = sums.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))  # one row a partition
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(weight).over(inside), F.lit(0))
    return ranged.withColumn("_before", before).join(base, "_part").withColumn(out, F.col("_base") + F.col("_before")).select(*df.columns, out)
