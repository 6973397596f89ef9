"""Ranks over all rows that need no task to see all rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions.order import nth_values, running
from kerbside.scratch import Scratch

#: The five-step labels.
LEVELS = ("çok düşük", "düşük", "orta", "yüksek", "çok yüksek")
DISTANCES = ("çok yakın", "yakın", "orta", "uzak", "çok uzak")
DENSITIES = ("çok seyrek", "seyrek", "orta", "yoğun", "çok yoğun")


def rank_pct(df: DataFrame, column: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with the percentile rank (ties averaged) of ``column`` among its non-missing values, within ``by`` if given.

    Values are counted (with map-side combine, so a value that many rows have is one row), a running sum in
    sorted order gives the rows below each, and ranks are joined back by value. No task sees all rows of
    the table, of a group or of a value.
    """
    keys = [*by, column]
    counts = df.filter(F.col(column).isNotNull()).groupBy(*keys).agg(F.count("*").alias("_n"))
    below = running(counts, keys, "_n", "_below", Scratch(df.sparkSession, "ranks"))
    if by:
        groups = below.groupBy(*by).agg(F.sum("_n").alias("_all"), F.min("_below").alias("_first"))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by]
        below = below.join(groups.withColumnsRenamed({k: f"_{k}" for k in by}), same).drop(*[f"_{k}" for k in by])
    else:
        total = below.agg(F.sum("_n").alias("_all"), F.lit(0).alias("_first"))
        below = below.crossJoin(F.broadcast(total))  # one row
    place = F.col("_below") - F.col("_first") + (F.col("_n") + 1) / 2
    ranks = below.select(*[F.col(k).alias(f"_of_{k}") for k in keys], (place / F.col("_all")).alias(out))
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in by] + [F.col(column) == F.col(f"_of_{column}")]
    return df.join(ranks, same, "left").drop(*[f"_of_{k}" for k in keys])


def rank_pcts(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """``rank_pct`` of several columns (name to result)."""
    for column, out in columns.items():
        df = rank_pct(df, column, out)
    return df


def bucket5(pct: Column, labels: Sequence[str] = LEVELS) -> Column:
    """The five-step label of a percentile rank; edges .2 .4 .6 .8, right-closed."""
    out = F.when(pct.isNull(), None)
    for top, label in zip((0.2, 0.4, 0.6, 0.8), labels[:4], strict=True):
        out = out.when(pct <= top, F.lit(label))
    return out.otherwise(F.lit(labels[4]))


def top_share(df: DataFrame, column: str, key: str, share: float, out: str) -> DataFrame:
    """``df`` with a flag for the ``ceil(n * share)`` largest values; ties to the smaller key.

    The value at the cut, and among the rows that tie with it the key at the cut, are found by counting
    (``order.nth_values``), so no task sees the rows kept.
    """
    n = df.filter(F.col(column).isNotNull()).count()
    k = min(n, -(-int(round(n * share * 1e9)) // 10**9))
    if k <= 0:
        return df.withColumn(out, F.lit(False))
    v = F.lit(nth_values(df, {column: [n - k]})[column][0])
    ties = df.filter(F.col(column) == v)
    above, tied = df.agg(F.count(F.when(F.col(column) > v, 1)), F.count(F.when(F.col(column) == v, 1))).first()
    flag = F.col(column) >= v
    if above + tied > k:
        last = F.lit(nth_values(ties, {key: [k - above - 1]})[key][0])
        flag = (F.col(column) > v) | ((F.col(column) == v) & (F.col(key) <= last))
    return df.withColumn(out, F.coalesce(flag, F.lit(False)))
