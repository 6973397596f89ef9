"""Natural breaks: the exact optimal split of one column into k classes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions.scaling import right_closed


def optimal_breaks(values: np.ndarray, counts: np.ndarray, k: int) -> list[float]:
    """Minimum and the k class maxima that minimise within-class squares.

    ``values`` are distinct and ascending. Dynamic programming over class ends with
    divide and conquer: best starts ascend with the end, so a level costs n log n.
    """
    n = len(values)
    k = min(k, n)
    if n == 0:
        return []
    x = values - values.mean()  # centred, against cancellation
    w, s, q = (np.concatenate([[0.0], np.cumsum(v)]) for v in (counts.astype(float), counts * x, counts * x * x))

    def cost(i: np.ndarray, j: int) -> np.ndarray:
        """Of the class of values i..j - 1, for every i."""
        m = w[j] - w[i]
        return q[j] - q[i] - (s[j] - s[i]) ** 2 / m

    best = np.array([0.0] + [float(cost(np.array([0]), j)[0]) for j in range(1, n + 1)])
    back = np.zeros((k + 1, n + 1), int)
    for level in range(2, k + 1):
        new = np.full(n + 1, np.inf)
        todo = [(level, n, level - 1, n - 1)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(first, min(last, j - 1) + 1)
            total = best[i] + cost(i, j)
            at = int(total.argmin())
            new[j], back[level, j] = total[at], i[at]
            todo += [(lo, j - 1, first, int(i[at])), (j + 1, hi, int(i[at]), last)]
        best = new
    ends, j = [], n
    for level in range(k, 0, -1):
        ends.append(float(values[j - 1]))
        j = back[level, j]
    return [float(values[0]), *ends[::-1]]


def natural_breaks(df: DataFrame, column: str, k: int = 5, most_distinct: int = 200_000, cells: int = 4096) -> list[float]:
    """Breaks of a column, exact for any number of values: its minimum and the maxima of ``k`` classes.

    Up to ``most_distinct`` distinct values (by Spark's estimate) all are looked at by the driver, counted by Spark;
    beyond that the search goes from coarse to fine (``refined_breaks``) and the driver sees cells. Both give the same.
    """
    full = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    row = full.agg(F.approx_count_distinct("v", 0.02).alias("n")).first()
    if not row["n"]:
        return []
    if row["n"] > most_distinct:
        return refined_breaks(full, k, cells)
    got = full.groupBy("v").agg(F.count("*").alias("n")).toPandas().sort_values("v")
    return optimal_breaks(got["v"].to_numpy(), got["n"].to_numpy(), k)


# ---- from coarse to fine ----

#: Relative slack of bounds, against rounding.
_SLACK = 1e-9


def _moments(values: DataFrame, lows: np.ndarray, highs: np.ndarray, edges: np.ndarray, centre: float) -> pd.DataFrame:
    """``cell, n, s, q, lo, hi`` of the values (``v``) within spans, by the part between ``edges`` they fall in.

    A task sums its values over cells before anything moves; moments are about ``centre``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(edges)
        n, s, q = np.zeros(m, np.int64), np.zeros(m), np.zeros(m)
        lo, hi = np.full(m, np.inf), np.full(m, -np.inf)
        for b in batches:
            v = b.column(0).to_numpy()
            span = np.searchsorted(lows, v, side="right") - 1
            v = v[(span >= 0) & (v <= highs[np.maximum(span, 0)])]
            at = np.searchsorted(edges, v, side="right") - 1
            x = v - centre
            n += np.bincount(at, minlength=m)
            s += np.bincount(at, x, m)
            q += np.bincount(at, x * x, m)
            np.minimum.at(lo, at, v)
            np.maximum.at(hi, at, v)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in (some, n[some], s[some], q[some], lo[some], hi[some])], ["cell", "n", "s", "q", "lo", "hi"])

    parts = values.mapInArrow(run, "cell long, n long, s double, q double, lo double, hi double")
    sums = [F.sum(c).alias(c) for c in ("n", "s", "q")]
    return parts.groupBy("cell").agg(*sums, F.min("lo").alias("lo"), F.max("hi").alias("hi")).toPandas().sort_values("cell")


def _least(cost, before: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each j < n the least ``before[i] + cost(i, j)`` over i <= j, and that i, where best starts ascend with j."""
    out, back = np.full(n, np.inf), np.zeros(n, int)
    todo = [(0, n - 1, 0, n - 1)]
    while todo:
        lo, hi, first, last = todo.pop()
        if lo > hi:
            continue
        j = (lo + hi) // 2
        i = np.arange(first, min(last, j) + 1)
        total = before[i] + cost(i, j)
        at = int(total.argmin())
        out[j], back[j] = total[at], i[at]
        todo += [(lo, j - 1, first, int(i[at])), (j + 1, hi, int(i[at]), last)]
    return out, back


def _prefix(n: np.ndarray, s: np.ndarray, q: np.ndarray):
    """Squares about the mean of cells i..j - 1 (0 without any), for arrays of i or j."""
    w, a, b = (np.concatenate([[0.0], np.cumsum(v.astype(float))]) for v in (n, s, q))

    def cost(i, j):
        m = w[j] - w[i]
        return np.where(m > 0, np.maximum(b[j] - b[i] - (a[j] - a[i]) ** 2 / np.where(m > 0, m, 1.0), 0.0), 0.0)

    return cost


def _whole(n, s, q, k: int) -> tuple[float, list[int]]:
    """The least loss over classes that end at cells' ends, and those ends (the last cell of each class)."""
    cost, m = _prefix(n, s, q), len(n)
    best, backs = cost(0, np.arange(1, m + 1)), []  # of the first j + 1 cells as one class
    for _ in range(1, min(k, m)):
        # classes up to cell i - 1, then one of cells i..j
        best, back = _least(lambda i, j: cost(i, j + 1), np.concatenate([[np.inf], best[:-1]]), m)
        backs.append(back)
    ends, j = [], m - 1
    for back in reversed(backs):
        ends.append(j)
        j = int(back[j]) - 1
    return float(best[-1]), [*ends, j][::-1]


def _may_break(n, s, q, k: int, most: float) -> np.ndarray:
    """Which cells may have a break inside, if no better loss than ``most`` is known.

    A class costs at least what its whole cells cost, so a solution with a break inside a cell costs at least the
    cheapest chain of whole cells on both sides of it.
    """
    cost, m = _prefix(n, s, q), len(n)

    def chains(cost) -> list[np.ndarray]:
        """By classes: least cost of what lies before a break inside each cell."""
        out = [cost(-1, np.arange(m))]
        for _ in range(2, k):
            out.append(_least(cost, out[-1], m)[0])
        return out

    left = chains(lambda i, j: cost(np.minimum(i + 1, j), j))
    mirrored = _prefix(n[::-1], s[::-1], q[::-1])
    right = [v[::-1] for v in chains(lambda i, j: mirrored(np.minimum(i + 1, j), j))]
    least = np.min([left[i] + right[k - 2 - i] for i in range(k - 1)], axis=0)
    return least <= most + _SLACK * (most + q.sum() / max(n.sum(), 1))


def refined_breaks(values: DataFrame, k: int, cells: int = 4096) -> list[float]:
    """Exact breaks of the values (``v``, none missing) through cells of them.

    The best breaks between cells bound the loss from above, whole cells within classes bound it from below; only cells
    that may hold a break of a better or equal solution are cut into finer ones, until such cells are single values. Bounds
    are apart by what a cell weighs, losses grow with the square of a break's distance from the best: so the driver holds
    ``cells`` cells, and some times the square root of the number of distinct values, and a few passes are enough.
    """
    ends = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean")).first()
    if ends["lo"] is None:
        return []
    lows, highs, centre = np.array([ends["lo"]]), np.array([ends["hi"]]), ends["mean"]
    have = pd.DataFrame({"n": [], "s": [], "q": [], "lo": [], "hi": []}, dtype=float)
    while True:
        each = max(16, cells // len(lows))
        steps = np.arange(each) / each
        edges = np.unique((lows[:, None] + steps * (highs - lows)[:, None]).ravel())
        fine = _moments(values, lows, highs, edges, centre)
        have = pd.concat([have, fine[["n", "s", "q", "lo", "hi"]]]).sort_values("lo", ignore_index=True)
        n, s, q = (have[c].to_numpy(float) for c in ("n", "s", "q"))
        loss, last = _whole(n, s, q, k)
        if k < 2:
            break
        several = have["lo"].to_numpy() < have["hi"].to_numpy()
        if len(have) < k:  # fewer cells than classes: any may hold a break
            open_ = several
        else:
            open_ = several & _may_break(n, s, q, k, loss)
        if not open_.any():
            break
        lows, highs = have["lo"].to_numpy()[open_], have["hi"].to_numpy()[open_]
        have = have[~open_]
    return [float(have["lo"].iloc[0]), *(float(have["hi"].iloc[i]) for i in last)]


def classify(x: Column, breaks: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed classes, the lowest value included; NULL without breaks or outside."""
    if len(breaks) < 2:
        return F.lit(None).cast("string")
    inner = right_closed(x, [float("-inf"), *breaks[1:]], labels[: len(breaks) - 1])
    return F.when(x >= breaks[0], inner)
