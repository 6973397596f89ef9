"""Raster operators over pixel tables: one row a pixel, with integer ``row`` and ``col``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.operators.geometry import segments
from kerbside.operators.spatial import edge_join, within

#: Thermal scale and offset, Kelvin; night scale; reflectance scale and offset; the QA bits that reject.
THERMAL = (0.00341802, 149.0)
KELVIN = 273.15
NIGHT = 0.02
REFLECTANCE = (2.75e-5, -0.2)
QA_MASK = 63


def usable(qa: Column) -> Column:
    """No rejecting bit is set."""
    return qa.bitwiseAND(F.lit(QA_MASK)) == 0


def thermal_celsius(dn: Column) -> Column:
    """Day surface temperature; raw 0 is no data."""
    return F.when(dn > 0, dn * THERMAL[0] + THERMAL[1] - KELVIN)


def night_celsius(dn: Column) -> Column:
    return F.when(dn > 0, dn * NIGHT - KELVIN)


def reflectance(dn: Column) -> Column:
    """Negative reflectance is no data."""
    r = dn * REFLECTANCE[0] + REFLECTANCE[1]
    return F.when(r >= 0, r)


def ndvi(red: Column, nir: Column) -> Column:
    """From raw bands, clipped to -1..1; missing where the bands' sum is 0."""
    r, n = reflectance(red), reflectance(nir)
    x = (n - r) / F.nullif(n + r, F.lit(0.0))
    return F.when(x.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))


def composite_median(pixels: DataFrame, value: str) -> DataFrame:
    """Median of a pixel's scenes; all-missing stays missing."""
    return pixels.groupBy("row", "col").agg(F.median(value).alias(value))


def composite_mean(pixels: DataFrame, value: str) -> DataFrame:
    return pixels.groupBy("row", "col").agg(F.avg(value).alias(value))


def mosaic(pixels: DataFrame, value: str, order: str) -> DataFrame:
    """The valid value of the last scene of each pixel."""
    return pixels.groupBy("row", "col").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias(value))


def window_median(pixels: DataFrame, value: str, least: int = 5) -> DataFrame:
    """Median of the 3 by 3 neighbourhood where ``least`` pixels are valid; missing at the grid's edge.

    Each pixel is sent to its nine neighbourhoods and one aggregate gathers them, so no
    partition needs its neighbours' rows.
    """
    ends = pixels.agg(
        F.min("row").alias("_r0"), F.max("row").alias("_r1"), F.min("col").alias("_c0"), F.max("col").alias("_c1")
    )
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    sent = pixels.select(F.col("row"), F.col("col"), F.col(value).alias("_v"), steps.alias("s")).select(
        (F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col"), "_v"
    )
    gathered = sent.groupBy("row", "col").agg(F.median("_v").alias("_m"), F.count("_v").alias("_n"))
    inside = (
        (F.col("row") > F.col("_r0")) & (F.col("row") < F.col("_r1")) & (F.col("col") > F.col("_c0")) & (F.col("col") < F.col("_c1"))
    )
    return (
        pixels.select("row", "col")
        .join(gathered, ["row", "col"])
        .crossJoin(F.broadcast(ends))  # one row
        .select("row", "col", F.when(inside & (F.col("_n") >= least), F.col("_m")).alias(value))
    )


def snapped(low: Column, high: Column, origin: float, size: float) -> tuple[Column, Column]:
    """First cell and number of cells of a span on a lattice: floor of the low end, ceiling of the size."""
    first = F.floor((low - origin) / size)
    return first, F.ceil((high - origin) / size) - first


def cells_of_box(low_row: Column, high_row: Column, low_col: Column, high_col: Column) -> Column:
    """The cells of an inclusive integer box, as an array of (row, col)."""
    return F.flatten(
        F.transform(
            F.sequence(low_row, high_row),
            lambda r: F.transform(F.sequence(low_col, high_col), lambda c: F.struct(r.alias("row"), c.alias("col"))),
        )
    )


def zonal(boxes: DataFrame, pixels: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, sum and count of the valid pixels whose centre lies in each box (``r0, r1, c0, c1``); count 0 is missing.

    Boxes become their cells and meet pixels by an equal join.
    """
    cells = boxes.select(key, F.explode(cells_of_box(F.col("r0"), F.col("r1"), F.col("c0"), F.col("c1"))).alias("p")).select(key, "p.*")
    got = cells.join(pixels.select("row", "col", value), ["row", "col"]).groupBy(key).agg(
        F.avg(value).alias("mean"), F.sum(value).alias("total"), F.count(value).alias("cells")
    )
    return boxes.select(key).join(got, key, "left").withColumn("cells", F.coalesce("cells", F.lit(0)))


def zonal_shapes(shapes: DataFrame, pixels: DataFrame, key: str, value: str, size: float) -> DataFrame:
    """Mean, sum and count of the valid pixels whose centre (``x, y``) lies in each polygon (``rings``); count 0 is missing.

    ``size``: side of the cells that polygons and pixels meet by.
    """
    held = within(pixels.select("x", "y", value).filter(F.col(value).isNotNull()), shapes.select(key, "rings"), [key], size)
    return _statistics(shapes, held, key, value)


def zonal_buffers(lines: DataFrame, pixels: DataFrame, key: str, value: str, radius: float, path: str = "path") -> DataFrame:
    """The same for the pixels whose centre lies within ``radius`` of each path."""
    edges = lines.select(key, F.explode(segments(F.array(path), closed=False)).alias("e"))
    edges = edges.select(key, *[F.col(f"e.{end}.{c}").alias(f"{end}{c}") for end in "pq" for c in "xy"])
    cells = pixels.select("x", "y", value).filter(F.col(value).isNotNull()).withColumn("_id", F.struct("x", "y"))
    held = edge_join(cells, edges, radius, [key]).dropDuplicates([key, "_id"])
    return _statistics(lines, held, key, value)


def _statistics(zones: DataFrame, held: DataFrame, key: str, value: str) -> DataFrame:
    got = held.groupBy(key).agg(F.avg(value).alias("mean"), F.sum(value).alias("total"), F.count(value).alias("cells"))
    return zones.select(key).join(got, key, "left").withColumn("cells", F.coalesce("cells", F.lit(0)))


def rasterized(units: DataFrame, pixels: DataFrame, unit: str, order: str, size: float) -> DataFrame:
    """``pixels`` (``row, col, x, y``) with the ``unit`` of the polygon that holds their centre; of several the last by ``order``."""
    held = within(pixels.select("row", "col", "x", "y"), units, [unit, order], size)
    marked = held.groupBy("row", "col").agg(F.max_by(unit, order).alias(unit))
    return pixels.join(marked, ["row", "col"], "left")


def resampled(pixels: DataFrame, places: DataFrame, value: str, bilinear: bool = False) -> DataFrame:
    """``places`` (with fractional ``r, c`` on the pixels' lattice, whole numbers at centres) with the value there.

    The nearest pixel's value, or the mean of the valid ones of the four around by closeness; missing without any.
    """
    source = pixels.select("row", "col", F.col(value).alias("_v"))
    if not bilinear:
        at = places.withColumns({"row": F.floor(F.col("r") + 0.5).cast("int"), "col": F.floor(F.col("c") + 0.5).cast("int")})
        return at.join(source, ["row", "col"], "left").withColumn(value, F.col("_v")).drop("row", "col", "_v")
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    own = places.select("*", step.alias("_s"))
    fr, fc = F.col("r") - F.floor("r"), F.col("c") - F.floor("c")
    weight = lambda f, s: F.when(F.col(s) == 1, f).otherwise(1 - f)
    near = own.withColumns(
        {"row": (F.floor("r") + F.col("_s.i")).cast("int"), "col": (F.floor("c") + F.col("_s.j")).cast("int"), "_w": weight(fr, "_s.i") * weight(fc, "_s.j")}
    )
    seen = near.join(source, ["row", "col"], "left").withColumn("_w", F.when(F.col("_v").isNotNull(), F.col("_w")))
    mean = F.sum(F.col("_v") * F.col("_w")) / F.nullif(F.sum("_w"), F.lit(0.0))
    return seen.groupBy(*places.columns).agg(mean.alias(value))


def masked_by(value: Column, other: Column, digits: int = 1) -> Column:
    """``value`` rounded half-even, only where ``other`` is there."""
    return F.when(other.isNotNull(), F.bround(value, digits))


def calibrate(cells: DataFrame, units: DataFrame, unit: str, value: str, official: str) -> DataFrame:
    """Cells scaled so that each unit's sum is its official total; 0 if the unit's sum is 0; missing outside units."""
    sums = cells.filter(F.col(unit).isNotNull()).groupBy(unit).agg(F.sum(value).alias("_sum"))
    factor = units.join(sums, unit, "left").select(
        unit, F.when(F.col("_sum") > 0, F.col(official) / F.col("_sum")).otherwise(F.lit(0.0)).alias("factor")
    )
    return cells.join(factor, unit, "left").withColumn("calibrated", F.col(value) * F.col("factor"))
