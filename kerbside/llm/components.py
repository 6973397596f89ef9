"""Connected components of an edge table by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges(a, b)`` of longs to ``(node, component)``: the smallest node reachable.

    In each round every node points at the smallest node next to it, pointers
    are doubled once, and the edges are rewritten between what they point at;
    edges within one pointer's set vanish, so the edge table at least halves in
    nodes. Only minima are aggregated (with map-side combine) and every join is
    of two written tables, so the adaptive planner can split a hub's rows.
    Self-edges make isolated nodes; an empty table gives an empty result.
    """
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = scratch.table(pairs, "edges")
    labels: DataFrame | None = None
    while True:
        ends = pairs.select(F.col("a").alias("node"), F.col("a").alias("next")).unionByName(
            pairs.select(F.col("b").alias("node"), F.col("a").alias("next"))
        )
        both = ends.unionByName(pairs.select(F.col("a").alias("node"), F.col("b").alias("next")))
        point = scratch.table(both.groupBy("node").agg(F.least(F.min("next"), F.col("node")).alias("next")), "point")
        jump = point.select(F.col("node").alias("next"), F.col("next").alias("far"))
        point = scratch.table(
            point.join(jump.hint("merge"), "next").select("node", F.col("far").alias("next")), "jumped"
        )
        if labels is None:
            labels = scratch.table(point.select("node", F.col("next").alias("label")), "labels")
        else:
            to = point.select(F.col("node").alias("label"), "next")
            labels = scratch.table(
                labels.join(to.hint("merge"), "label", "left").select("node", F.coalesce("next", "label").alias("label")),
                "labels",
            )
        pa, pb = point.toDF("a", "pa"), point.toDF("b", "pb")
        half = scratch.table(pairs.filter("a <> b").join(pa.hint("merge"), "a").select("pa", "b"), "half")
        moved = half.join(pb.hint("merge"), "b").select("pa", "pb").filter("pa <> pb")
        pairs = scratch.table(
            moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges"
        )
        if pairs.isEmpty():
            return labels.select("node", F.col("label").alias("component"))
