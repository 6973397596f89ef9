"""Correlations and overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions.ranking import rank_pcts


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: Pearson of values and of average ranks, over rows that have both, and their number."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = rank_pcts(both, {x: "_rx", y: "_ry"})
    return ranked.agg(F.count("*").alias("n"), F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman"))


def top_overlap(base_pct: Column, run_pct: Column, share: float) -> Column:
    """Aggregate: the part of the base's top share that is in the run's."""
    top = base_pct > 1 - share
    both = top & (run_pct > 1 - share)
    return F.count(F.when(both, 1)) / F.greatest(F.count(F.when(top, 1)), F.lit(1))


def first_order(df: DataFrame, factor: str, outputs: list[str], bins: int | None = None) -> DataFrame:
    """``factor, output, s``: Var(E[Y|X]) / Var(Y) with population variance.

    ``bins``: a continuous factor is cut at its linear quantiles, right-closed, equal edges once.
    """
    if bins:
        edges = df.agg(
            F.array_sort(F.array_distinct(F.percentile(factor, F.array(*[F.lit(i / bins) for i in range(bins + 1)])))).alias("_e")
        )
        df = df.crossJoin(F.broadcast(edges))  # one row
        inner = F.slice("_e", 2, F.size("_e") - 2)
        df = df.withColumn("_key", F.size(F.filter(inner, lambda e: e < F.col(factor))).cast("string"))
    else:
        df = df.withColumn("_key", F.col(factor).cast("string"))
    stack = F.explode(F.array(*[F.struct(F.lit(o).alias("output"), F.col(o).alias("y")) for o in outputs])).alias("s")
    long = df.select("_key", stack).select("_key", "s.output", "s.y")
    cells = long.groupBy("output", "_key").agg(F.count("*").alias("n"), F.sum("y").alias("t"), F.sum(F.col("y") * F.col("y")).alias("q"))
    total = cells.groupBy("output").agg(
        F.sum("n").alias("n"), F.sum("t").alias("t"), F.sum("q").alias("q"), F.sum(F.col("t") * F.col("t") / F.col("n")).alias("between")
    )
    mean2 = F.col("t") * F.col("t") / F.col("n")
    var = F.col("q") - mean2
    s = F.when(F.abs(var) <= 1e-12 * F.abs(F.col("q")), F.lit(0.0)).otherwise((F.col("between") - mean2) / var)
    return total.select(F.lit(factor).alias("factor"), "output", s.alias("s"))
