"""Monte Carlo over the index's design decisions.

Draws are made once on the driver (a seeded numpy generator, a few hundred rows). The panel is packed into blocks of
some thousand rows with the components under each of the three scalings; a run's scores are a small matrix
product over a block, so blocks meet all runs where they are, and what moves is one small array for each block and run.
Scores of a run are rescaled by the run's own pooled bounds, which are exact (see ``packed``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbside.functions.scaling import FLOOR, ROBUST_QUANTILES
from kerbside.operators.index import GROUPS, RAW
from kerbside.operators.packed import Block, array, blocks_of, pack, series_quantiles, with_ranks
from kerbside.scratch import Scratch

NORMALIZATIONS = ("robust", "minmax", "rank")
AGGREGATIONS = ("geometric", "arithmetic")
COMPONENTS = tuple(c for g in GROUPS.values() for c in g)
_MEMBERS = {g: [COMPONENTS.index(c) for c in m] for g, m in GROUPS.items()}
#: Most runs that are sent to all tasks.
MOST_RUNS = 100_000


def draws(runs: int = 500, seed: int = 42, group_concentration: float = 8.0, component_concentration: float = 4.0, floor=(0.01, 0.10), exclusion: float = 0.25) -> list[dict]:
    """Decisions of each run; run 0 is the published index.

    Fixed values: the order of the generator's calls, so that a seed names the same decisions everywhere. Of each run: group
    weights, each group's component weights, whether and which component is left out, scaling, aggregation, floor.
    """
    if runs > MOST_RUNS:
        raise ValueError(f"{runs} runs; at most {MOST_RUNS} are sent to all tasks")
    rng = np.random.default_rng(seed)
    n = len(GROUPS)
    out = [
        {"run": 0, "normalization": "robust", "aggregation": "geometric", "floor": FLOOR, "excluded": None}
        | {f"g_{g}": 1 / n for g in GROUPS}
        | {f"w_{c}": 1.0 for c in COMPONENTS}
    ]
    removable = [c for m in GROUPS.values() if len(m) > 1 for c in m]
    for run in range(1, runs):
        row: dict = {"run": run}
        row |= {f"g_{g}": float(w) for g, w in zip(GROUPS, rng.dirichlet([group_concentration] * n), strict=True)}
        for members in GROUPS.values():
            w = rng.dirichlet([component_concentration] * len(members)) * len(members) if len(members) > 1 else [1.0]
            row |= {f"w_{c}": float(x) for c, x in zip(members, w, strict=True)}
        row["excluded"] = str(rng.choice(removable)) if rng.random() < exclusion else None
        row["normalization"] = str(rng.choice(NORMALIZATIONS))
        row["aggregation"] = str(rng.choice(AGGREGATIONS))
        row["floor"] = float(rng.uniform(*floor))
        out.append(row)
    return out


def factor_table(rows: Sequence[dict]) -> list[dict]:
    """The decisions of each run as factors, without those that are the same in all runs."""
    whole = [r | {"excluded": r["excluded"] or "none"} for r in rows]
    return [{k: v for k, v in r.items() if k == "run" or len({x[k] for x in whole}) > 1} for r in whole]


def draw_schema() -> str:
    """Groups ``hazard`` and ``exposure`` share names with components, so group weights are ``g_``."""
    groups = ", ".join(f"g_{g} double" for g in GROUPS)
    parts = ", ".join(f"w_{c} double" for c in COMPONENTS)
    return f"run int, normalization string, aggregation string, floor double, excluded string, {groups}, {parts}"


def draw_table(spark: SparkSession, rows: Sequence[dict]) -> DataFrame:
    names = [f.split()[0] for f in draw_schema().split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], draw_schema())


BLOCK = "block long, n int, ids binary, years binary, x binary"


def cube(panel: DataFrame, scratch: Scratch) -> DataFrame:
    """Blocks of the panel with the components under each of the three scalings, pooled over years.

    The robust scaling is the panel's own (component columns); the others start from raw columns, turned where less
    is more risk. ``x`` has the components under robust, minmax and rank scaling side by side.
    """
    raw = [(-F.col(RAW[c][0]) if RAW[c][1] else F.col(RAW[c][0])).cast("double").alias(f"raw_{c}") for c in COMPONENTS]
    kept = panel.select("road_id", "year", *COMPONENTS, *raw)
    m = len(COMPONENTS)
    ends = kept.agg(*[f(f"raw_{c}") for f in (F.min, F.max) for c in COMPONENTS]).first()
    low, high = (np.array([np.nan if v is None else v for v in x]) for x in (ends[:m], ends[m:]))
    packed = scratch.table(pack(kept, "road_id", [*COMPONENTS, *(f"raw_{c}" for c in COMPONENTS)]), "packed")

    def finish(block: Block, ranks: np.ndarray) -> list[pa.Array]:
        x = array(block, "x", columns=2 * m)
        with np.errstate(invalid="ignore", divide="ignore"):
            # on turned raw columns a share runs the same way as the index
            share = np.where(low == high, 0.0, (x[:, m:] - low) / (high - low))
        whole = np.ascontiguousarray(np.concatenate([x[:, :m], share, ranks], axis=1))
        values = [block["block"], block["n"], block["ids"], block["years"], whole.tobytes()]
        return [pa.array([v], k) for v, k in zip(values, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)]

    return scratch.table(with_ranks(packed, lambda b: array(b, "x", columns=2 * m)[:, m:], finish, BLOCK, scratch), "cube")


def group_scores(block: Block, draws_: Sequence[dict]) -> np.ndarray:
    """Weighted means of each group's components: a row for each row of the block, groups of run 0, of run 1, and so on."""
    x = array(block, "x", columns=len(NORMALIZATIONS) * len(COMPONENTS)).reshape(-1, len(NORMALIZATIONS), len(COMPONENTS))
    out = np.empty((len(x), len(draws_), len(GROUPS)))
    for n, name in enumerate(NORMALIZATIONS):
        runs = [i for i, d in enumerate(draws_) if d["normalization"] == name]
        w = np.array([[0.0 if d["excluded"] == c else d[f"w_{c}"] for c in COMPONENTS] for d in (draws_[i] for i in runs)]).reshape(-1, len(COMPONENTS))
        for g, members in enumerate(_MEMBERS.values()):
            total = x[:, n, members[0], None] * w[None, :, members[0]]
            for k in members[1:]:
                total = total + x[:, n, k, None] * w[None, :, k]
            out[:, runs, g] = total / w[:, members].sum(axis=1)[None, :]
    return out.reshape(len(x), -1)


def run_scores(block: Block, draws_: Sequence[dict], bounds: np.ndarray) -> np.ndarray:
    """The score of each row of a block in each run; ``bounds``: low and high of each run's groups."""
    raw = group_scores(block, draws_).reshape(-1, len(draws_), len(GROUPS))
    low, high = bounds[:, 0].reshape(len(draws_), -1), bounds[:, 1].reshape(len(draws_), -1)
    with np.errstate(invalid="ignore", divide="ignore"):
        scaled = np.where(np.isnan(raw), np.nan, np.where(low == high, 0.0, np.clip((raw - low) / (high - low), 0.0, 1.0)))
    weight = np.array([[d[f"g_{g}"] for g in GROUPS] for d in draws_])
    floor = np.array([d["floor"] for d in draws_])[None, :]
    total, logs, plain = weight[:, 0], 0.0, 0.0
    for g in range(1, len(GROUPS)):
        total = total + weight[:, g]
    for g in range(len(GROUPS)):
        logs = logs + weight[:, g] * np.log(floor + (1 - floor) * scaled[:, :, g])
        plain = plain + weight[:, g] * scaled[:, :, g]
    geometric = np.array([d["aggregation"] == "geometric" for d in draws_])
    return np.where(geometric, np.exp(logs / total) * 100, plain / total * 100)


@dataclass(frozen=True)
class Runs:
    """All runs over a panel: the packed panel, the decisions, and each run's bounds (two numbers a run and group)."""

    blocks: DataFrame
    draws: list[dict]
    bounds: np.ndarray
    scratch: Scratch

    def scores_of(self, year: int | None = None):
        """The function that turns a block into its scores; rows of other years have none."""
        draws_, bounds = self.draws, self.bounds

        def matrix(block: Block) -> np.ndarray:
            s = run_scores(block, draws_, bounds)
            if year is not None:
                s[array(block, "years", "<i4") != year] = np.nan
            return s

        return matrix


def simulate(panel: DataFrame, draws_: Sequence[dict], scratch: Scratch) -> Runs:
    """Every run over ``panel`` (``road_id, year``, component and raw columns)."""
    draws_ = list(draws_)
    blocks, series = cube(panel, scratch), len(draws_) * len(GROUPS)
    q = series_quantiles(blocks, partial(group_scores, draws_=draws_), series, (0.0, *ROBUST_QUANTILES, 1.0))
    bounds = np.where((q[:, 1] == q[:, 2])[:, None], q[:, [0, 3]], q[:, 1:3])
    return Runs(blocks, draws_, bounds, scratch)


def _numbers(runs: Runs) -> np.ndarray:
    return np.array([d["run"] for d in runs.draws], np.int32)


def scores(runs: Runs, year: int | None = None) -> DataFrame:
    """``run, road_id, year, score`` of every road and run, in one year or all."""
    matrix, numbers = runs.scores_of(), _numbers(runs)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in blocks_of(b):
                s, ids, years = matrix(block), array(block, "ids", "<i8"), array(block, "years", "<i4")
                keep = np.ones(len(ids), bool) if year is None else years == year
                s, n = s[keep], int(keep.sum())
                flat = s.ravel()
                cols = [
                    pa.array(np.tile(numbers, n)), pa.array(np.repeat(ids[keep], len(numbers))), pa.array(np.repeat(years[keep], len(numbers))),
                    pa.array(flat, mask=np.isnan(flat)),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["run", "road_id", "year", "score"])

    return runs.blocks.mapInArrow(out, "run int, road_id long, year int, score double")


def run_ranks(runs: Runs, year: int) -> DataFrame:
    """``n int, ids binary, pct binary``: blocks of the roads of one year with their percentile rank in each run (a
    matrix of roads by runs). Scores are rounded to 8 digits first, so that rounding doesn't break ties."""
    matrix = runs.scores_of(year)

    def finish(block: Block, ranks: np.ndarray) -> list[pa.Array]:
        own = array(block, "years", "<i4") == year
        values = [int(own.sum()), array(block, "ids", "<i8")[own].tobytes(), np.ascontiguousarray(ranks[own]).tobytes()]
        return [pa.array([v], k) for v, k in zip(values, (pa.int32(), pa.binary(), pa.binary()), strict=True)]

    return runs.scratch.table(
        with_ranks(runs.blocks, lambda b: np.round(matrix(b), 8), finish, "n int, ids binary, pct binary", runs.scratch), "ranks"
    )


def road_uncertainty(ranks: DataFrame, runs: Runs) -> DataFrame:
    """Rank quantiles over runs, how often a road is in the top 10% and 20%, and its rank in run 0."""
    m, first = len(runs.draws), int(np.flatnonzero(_numbers(runs) == 0)[0])

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in blocks_of(b):
                p = array(block, "pct", columns=m)
                if not len(p):
                    continue
                some = ~np.isnan(p).all(axis=1)
                p, ids = p[some], array(block, "ids", "<i8")[some]
                n = (~np.isnan(p)).sum(axis=1)
                q = np.nanquantile(p, (0.05, 0.5, 0.95), axis=1)
                base = p[:, first]
                cols = [pa.array(ids), *map(pa.array, q), pa.array((p > 0.9).sum(axis=1) / n), pa.array((p > 0.8).sum(axis=1) / n)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(base, mask=np.isnan(base))], ["road_id", "q05", "q50", "q95", "top10", "top20", "base"])

    return ranks.mapInArrow(out, "road_id long, q05 double, q50 double, q95 double, top10 double, top20 double, base double")


def area_uncertainty(scored: DataFrame, areas: DataFrame, least: int = 20) -> DataFrame:
    """Distribution of each area's rank by mean score over runs, and how often it is in the first 5 and 20.

    ``scored``: one year of ``scores``; ``areas``: ``road_id, area``; areas of fewer than ``least`` roads are left out.
    """
    big = areas.groupBy("area").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("area")
    named = areas.join(big, "area", "left_semi")
    means = scored.join(named, "road_id").groupBy("run", "area").agg(F.round(F.avg("score"), 8).alias("mean"))
    ranked = means.withColumn("place", F.rank().over(Window.partitionBy("run").orderBy(F.desc("mean"))))
    return ranked.groupBy("area").agg(
        F.median("place").alias("median_rank"),
        F.avg((F.col("place") <= 5).cast("double")).alias("p_first5"),
        F.avg((F.col("place") <= 20).cast("double")).alias("p_first20"),
    )


def run_outputs(ranks: DataFrame, runs: Runs, share: float = 0.1) -> DataFrame:
    """Each run against run 0: Spearman of ranks and overlap of the top share. A block sends one row of sums a run."""
    m, numbers = len(runs.draws), _numbers(runs)
    first = int(np.flatnonzero(numbers == 0)[0])
    names = ("n", "b", "p", "bb", "pp", "bp", "top", "hit")

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks_of(batch):
                p = array(block, "pct", columns=m)
                b = p[:, first, None]
                both = ~np.isnan(p) & ~np.isnan(b)
                x, y = np.where(both, b - 0.5, 0.0), np.where(both, p - 0.5, 0.0)  # about the mean rank, against cancellation
                top = both & (b > 1 - share)
                sums = (both, x, y, x * x, y * y, x * y, top, top & (p > 1 - share))
                cols = [pa.array(s.sum(axis=0).astype(np.float64)) for s in sums]
                yield pa.RecordBatch.from_arrays([pa.array(numbers), *cols], ["run", *names])

    sent = ranks.filter("n > 0").mapInArrow(out, "run int, " + ", ".join(f"{n} double" for n in names))
    t = sent.filter("run > 0").groupBy("run").agg(*[F.sum(n).alias(n) for n in names])
    n, b, p, bb, pp, bp = (F.col(c) for c in names[:6])
    spearman = (bp - b * p / n) / F.sqrt((bb - b * b / n) * (pp - p * p / n))
    return t.select("run", spearman.alias("spearman"), (F.col("hit") / F.greatest(F.col("top"), F.lit(1.0))).alias("overlap"))


def stable_top(uncertainty: DataFrame, share: float = 0.1, least: float = 0.9) -> DataFrame:
    """Of run 0's top share, how many stay there in at least ``least`` of the runs."""
    stays = F.count(F.when(F.col("top10") >= least, 1))
    return uncertainty.filter(F.col("base") > 1 - share).agg(
        F.count("*").alias("top"), stays.alias("stable"), (stays / F.greatest(F.count("*"), F.lit(1))).alias("share")
    )
