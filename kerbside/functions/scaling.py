"""Scaling of components to 0..1 on bounds that all years share.

A missing value is NULL throughout: sources turn NaN into NULL, and every function
here keeps a missing input missing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions.order import quantiles

#: The quantiles of the robust bounds, and the floor of a group's score.
ROBUST_QUANTILES = (0.02, 0.98)
FLOOR = 0.05


def clean(x: Column) -> Column:
    """NaN and infinities become NULL."""
    d = x.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def round_even(x: Column, digits: int) -> Column:
    """Doubles rounded half-even as arrays and SQL round them: the value times a power of ten, in double, decides what is a half.

    ``bround`` looks at the decimal text instead, where 924.0500000000001 is above the half. What is not finite, or too large to be scaled, stays.
    """
    power = F.lit(10.0 ** abs(digits))
    scaled = x * power if digits >= 0 else x / power
    whole = F.rint(scaled)
    return F.when(F.abs(scaled) < float("inf"), whole / power if digits >= 0 else whole * power).otherwise(x)


def scale_between(x: Column, low: Column, high: Column) -> Column:
    """``(x - low) / (high - low)`` clipped to 0..1; 0 on missing or equal bounds; missing stays missing."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / F.nullif(high - low, F.lit(0.0))))
    return F.when(x.isNull(), None).when(low.isNull() | high.isNull() | (low == high), F.lit(0.0)).otherwise(share)


def robust_bounds(df: DataFrame, columns: Sequence[str], quantiles_: Sequence[float] = ROBUST_QUANTILES) -> dict[str, tuple[float | None, float | None]]:
    """The two bounds of each column over all rows: exact quantiles, or the ends if those are equal.

    Eager: two numbers a column reach the driver (see ``order.quantiles``), so plans that use them need no join.
    """
    q = {c: (0.0, *quantiles_, 1.0) for c in columns}
    return {c: (v[0], v[3]) if v[1] == v[2] else (v[1], v[2]) for c, v in quantiles(df, q).items()}


def with_bounds(df: DataFrame, columns: Sequence[str], robust: bool = True) -> DataFrame:
    """``df`` with ``<column>_lo`` and ``<column>_hi``, over all rows."""
    ends = (("lo", 0), ("hi", 1))
    if robust:
        bounds = robust_bounds(df, columns)
        return df.withColumns({f"{c}_{n}": F.lit(bounds[c][i]).cast("double") for c in columns for n, i in ends})
    made = [f(c).cast("double").alias(f"{c}_{n}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]
    return df.crossJoin(F.broadcast(df.agg(*made)))  # one row


def scaled(df: DataFrame, columns: Sequence[str], suffix: str = "_norm", robust: bool = True, invert: Sequence[str] = ()) -> DataFrame:
    """``df`` with each column scaled by bounds over all its rows; those in ``invert`` as ``1 - scaled``."""
    both = with_bounds(df, columns, robust)
    out = {}
    for c in columns:
        s = scale_between(F.col(c), F.col(f"{c}_lo"), F.col(f"{c}_hi"))
        out[f"{c}{suffix}"] = 1 - s if c in invert else s
    return both.withColumns(out).drop(*[f"{c}_{n}" for c in columns for n in ("lo", "hi")])


def group_score(members: Sequence[Column], weights: Sequence[float] | None = None) -> Column:
    """Weighted mean of a group's members; missing if one is."""
    weights = weights or [1.0] * len(members)
    total = sum(m * F.lit(float(w)) for m, w in zip(members, weights, strict=True))
    return total / F.lit(float(sum(weights)))


def combine(groups: Sequence[Column], weights: Sequence[float] | None = None, floor: float = FLOOR) -> Column:
    """Weighted geometric mean of floored group scores, times 100."""
    weights = weights or [1.0] * len(groups)
    logs = sum(F.lit(float(w)) * F.log(F.lit(floor) + F.lit(1 - floor) * g) for g, w in zip(groups, weights, strict=True))
    return F.exp(logs / F.lit(float(sum(weights)))) * 100


def informative(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns with more than one distinct value: one eager aggregate that decides the plan."""
    row = df.agg(*[(F.min(c) != F.max(c)).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def right_closed(x: Column, edges: Sequence[Column | float], labels: Sequence[str]) -> Column:
    """The label of the interval ``(edge[i], edge[i + 1]]`` that holds x; NULL outside."""
    col = [e if isinstance(e, Column) else F.lit(float(e)) for e in edges]
    out = F.when(x.isNull() | (x <= col[0]), None)
    for top, label in zip(col[1:], labels, strict=True):
        out = out.when(x <= top, F.lit(label))
    return out


def coerced_scale(df: DataFrame, column: str, out: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Min-max scaling of what can be read as a number, clipped to 0..1, on given ends or the column's own.

    Without ends, or with equal ones, every row is 0, those without a number too; else those stay missing.
    """
    x = clean(F.col(column).try_cast("double") if df.schema[column].dataType.typeName() == "string" else F.col(column))
    ends = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    lo, hi = (F.col(c) if v is None else F.lit(float(v)) for c, v in (("_lo", low), ("_hi", high)))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - lo) / F.nullif(hi - lo, F.lit(0.0))))
    value = F.when(lo.isNull() | hi.isNull() | (lo == hi), F.lit(0.0)).when(x.isNotNull(), share)
    return df.crossJoin(F.broadcast(ends)).withColumn(out, value).drop("_lo", "_hi")  # one row


def without_constants(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``df`` without the columns that have one distinct value at most (missing doesn't count), but for ``keep``."""
    tested = [c for c in df.columns if c not in keep]
    row = df.agg(*[(F.coalesce(F.min(c) != F.max(c), F.lit(False))).alias(c) for c in tested]).first()
    return df.select(*[c for c in df.columns if c in keep or row[c]])
