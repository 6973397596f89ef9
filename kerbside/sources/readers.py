"""Sources: every reader has an explicit schema or reads names from the file, and turns NaN into NULL."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.functions.scaling import clean
from kerbside.functions.text import normalise_name
from kerbside.ship import ship

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
#: Satellites whose scenes are used.
PLATFORMS = ("LANDSAT_8", "LANDSAT_9")


def without_nan(df: DataFrame) -> DataFrame:
    """NaN and infinities of every floating column become NULL."""
    return df.withColumns({f.name: clean(F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def districts(spark: SparkSession, path: str) -> DataFrame:
    """``;``-separated district table: ``key, population, elderly_share, child_share``."""
    raw = spark.read.schema("ILCE string, NUFUS bigint, YASLI_ORAN double, COCUK_ORAN double").csv(path, sep=";", header=True)
    return without_nan(
        raw.select(
            normalise_name(F.col("ILCE")).alias("key"),
            F.col("NUFUS").alias("population"),
            F.col("YASLI_ORAN").alias("elderly_share"),
            F.col("COCUK_ORAN").alias("child_share"),
        )
    )


def development_scores(spark: SparkSession, path: str) -> DataFrame:
    """``;``-separated socio-economic table: ``key, development_score``."""
    raw = spark.read.csv(path, sep=";", header=True)
    return without_nan(raw.select(normalise_name(F.col("ILCE")).alias("key"), F.expr("try_cast(SKOR AS double)").alias("development_score")))


def observations(spark: SparkSession, path: str) -> DataFrame:
    """``|``-separated hourly observations: ``ts, temperature``; codes that start with a letter are rejected values."""
    raw = spark.read.csv(path, sep="|", header=True).select("DATE", "temperature", "temperature_Quality_Code")
    good = raw.filter(F.col("temperature_Quality_Code").isNull() | ~F.col("temperature_Quality_Code").rlike("^[A-Za-z]"))
    return good.select(
        F.expr("try_cast(DATE AS timestamp_ntz)").alias("ts"), clean(F.expr("try_cast(temperature AS double)")).alias("temperature")
    ).dropna()


def stations(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """A list of stations whose columns are named by position; rows without coordinates are dropped."""
    raw = spark.read.csv(path, header=True)
    raw = raw.toDF(*names, *raw.columns[len(names) :])
    return raw.withColumns({c: clean(F.expr(f"try_cast({c} AS double)")) for c in ("lat", "lon")}).dropna(subset=["lat", "lon"])


def in_box(lon: Column, lat: Column, box: Sequence[float]) -> Column:
    """Inclusive containment in ``(west, south, east, north)``."""
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])


_SCENES = (
    "features array<struct<id: string, bbox: array<double>, properties: struct<datetime: string, platform: string, `eo:cloud_cover`: double>>>"
)


def scenes(spark: SparkSession, path: str, box: Sequence[float], first: str, last: str, most_cloud: float) -> DataFrame:
    """Catalogue features in season, of the used satellites, below the cloud limit, whose box meets ``box``."""
    raw = spark.read.schema(_SCENES).json(path, multiLine=True)
    f = raw.select(F.explode("features").alias("f")).select(
        F.col("f.id").alias("scene_id"),
        F.substring("f.properties.datetime", 1, 10).alias("day"),
        F.upper(F.regexp_replace("f.properties.platform", "-", "_")).alias("platform"),
        F.col("f.properties.`eo:cloud_cover`").alias("cloud"),
        F.col("f.bbox").alias("box"),
    )
    meets = (F.col("box")[0] <= box[2]) & (F.col("box")[2] >= box[0]) & (F.col("box")[1] <= box[3]) & (F.col("box")[3] >= box[1])
    return f.filter(F.col("day").between(first, last) & F.col("platform").isin(*PLATFORMS) & (F.col("cloud") < most_cloud) & meets)


def daily_weather(spark: SparkSession, path: str) -> DataFrame:
    """Weather files of parallel arrays, one a grid point: ``file, grid_id, day, temperature``."""
    schema = "latitude double, longitude double, daily struct<time: array<string>, temperature_2m_mean: array<double>>"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    pairs = F.inline_outer(F.arrays_zip(F.col("daily.time").alias("time"), F.col("daily.temperature_2m_mean").alias("temperature")))
    rows = raw.select("latitude", "longitude", F.input_file_name().alias("file"), pairs)
    named = rows.toDF("latitude", "longitude", "file", "day", "temperature")
    return named.select("file", "latitude", "longitude", F.to_date("day").alias("day"), clean(F.col("temperature")).alias("temperature")).dropna(subset=["temperature"])


def area_tables(spark: SparkSession, pattern: str) -> DataFrame:
    """Every city's area table, with ``city`` from its path; columns that a city lacks are missing for it.

    Columns are matched by name: files are grouped by their header, each group is one scan, and the groups are united.
    """
    files = spark.read.format("binaryFile").load(pattern).select("path")
    lines = spark.read.text(pattern).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), "value")
    heads = lines.filter("at = 0").groupBy("path").agg(F.first("value").alias("head")).collect()  # one row a file, the line it starts with
    known = {r["path"]: r["head"] for r in heads}
    by_head: dict[str, list[str]] = {}
    for r in files.collect():
        if r["path"] in known:
            by_head.setdefault(known[r["path"]], []).append(r["path"])
    out = None
    for paths in by_head.values():
        one = spark.read.csv(sorted(paths), header=True, inferSchema=True)
        one = one.withColumn("city", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)_[^/_]+\.csv$", 1))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(pattern)
    return out


_GEOMETRY = "struct<type: string, coordinates: string>"


def features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """GeoJSON lines or collections as rows: ``properties`` (a schema), and the geometry's type and rings.

    Points and lines are one ring; polygons have their rings, several polygons all of them. Files of one feature a
    line are split over tasks; a collection is one JSON document and so one task a file.
    """
    schema = T._parse_datatype_string(properties)
    texts = ", ".join(f"`{f.name}`: string" for f in schema.fields)
    feature = f"struct<type: string, properties: struct<{texts}>, geometry: {_GEOMETRY}>"
    head = spark.read.text(path).filter(F.length(F.trim("value")) > 0).first()
    kind = head and spark.createDataFrame([(head[0],)], "v string").select(F.get_json_object("v", "$.type")).first()[0]
    if kind == "Feature":
        f = spark.read.text(path).filter(F.length(F.trim("value")) > 0).select(F.from_json("value", feature).alias("f"))
    else:
        raw = spark.read.text(path, wholetext=True)
        f = raw.select(F.explode(F.from_json("value", f"struct<features: array<{feature}>>")["features"]).alias("f"))
    text = F.col("f.geometry.coordinates")
    place = lambda c: F.struct(c[0].alias("x"), c[1].alias("y"))
    paths = lambda depth: F.from_json(text, "array<" * depth + "double" + ">" * depth)
    path_of = lambda ring: F.transform(ring, place)
    at = F.col("f.geometry.type")
    rings = (
        F.when(at == "Point", F.array(F.array(place(paths(1)))))
        .when(at.isin("LineString", "MultiPoint"), F.array(path_of(paths(2))))
        .when(at.isin("Polygon", "MultiLineString"), F.transform(paths(3), path_of))
        .when(at == "MultiPolygon", F.transform(F.flatten(paths(4)), path_of))
    )
    cast = [F.expr(f"try_cast(f.properties.`{x.name}` AS {x.dataType.simpleString()})").alias(x.name) for x in schema.fields]
    return without_nan(f.select(*cast, at.alias("kind"), rings.alias("rings")))


def layer(spark: SparkSession, path: str, box: Sequence[float] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """A map layer written by ``sinks.write_layer``: shapes whose box meets ``box`` (west, south, east, north).

    Box and columns reach the Parquet scan: files and row groups whose statistics rule the box out aren't read.
    """
    df = spark.read.parquet(path)
    if box is not None:
        df = df.filter((F.col("x0") <= box[2]) & (F.col("x1") >= box[0]) & (F.col("y0") <= box[3]) & (F.col("y1") >= box[1]))
    return df if columns is None else df.select(*columns, "kind", "rings")


#: Tags of green areas.
GREEN_LEISURE = ("park", "garden", "nature_reserve")
GREEN_LANDUSE = ("forest", "grass", "meadow", "recreation_ground")


def of_types(df: DataFrame, column: str, types: Sequence[str]) -> DataFrame:
    """Rows of the named road types; those without one are left out."""
    return df.filter(F.col(column).isNotNull() & F.col(column).isin(*types))


def is_green(leisure: Column, landuse: Column, rings: Column | None = None) -> Column:
    """Either tag names a green area, and the shape isn't empty."""
    tagged = F.coalesce(leisure.isin(*GREEN_LEISURE), F.lit(False)) | F.coalesce(landuse.isin(*GREEN_LANDUSE), F.lit(False))
    return tagged if rings is None else tagged & rings.isNotNull() & (F.size(F.flatten(rings)) > 0)


def administrative(df: DataFrame, level: str) -> DataFrame:
    """Shapes of one administrative level."""
    return df.filter((F.col("admin_level") == level) & (F.col("boundary") == "administrative"))


def ascii_grids(spark: SparkSession, path: str) -> DataFrame:
    """Text grids (``ncols, nrows, xllcorner, yllcorner, cellsize, NODATA_value``, then rows from the top) as pixels.

    ``raster, row, col, x, y, value``: centres, and missing where there is no data.
    """
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                words = data.split()
                head = {words[i].decode().lower(): float(words[i + 1]) for i in range(0, 12, 2)}
                n, m = int(head["nrows"]), int(head["ncols"])
                v = np.array(words[12:], np.float64).reshape(n, m)
                row, col = np.divmod(np.arange(n * m), m)
                x = head["xllcorner"] + (col + 0.5) * head["cellsize"]
                y = head["yllcorner"] + (n - row - 0.5) * head["cellsize"]
                flat = v.ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * len(flat)),
                        pa.array(row.astype(np.int32)),
                        pa.array(col.astype(np.int32)),
                        pa.array(x),
                        pa.array(y),
                        pa.array(flat, mask=(flat == head["nodata_value"]) | ~np.isfinite(flat)),
                    ],
                    ["raster", "row", "col", "x", "y", "value"],
                )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(
        run, "raster string, row int, col int, x double, y double, value double"
    )


def geopackage(spark: SparkSession, path: str, layer_: str, properties: str) -> DataFrame:
    """A layer of GeoPackage files: ``properties`` (a schema) and ``rings`` (a polygon's rings, or a line's path).

    The format is one database a file, so a file is one task.
    """
    ship(spark)
    schema = T._parse_datatype_string(properties)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sqlite3

        point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
        for b in batches:
            for data in b.column("content").to_pylist():
                con = sqlite3.connect(":memory:")
                con.deserialize(data)
                quoted = ", ".join(f'"{n}"' for n in names)
                rows = con.execute(f'SELECT geom{", " if names else ""}{quoted} FROM "{layer_}" ORDER BY fid')
                while some := rows.fetchmany(1000):
                    cols = [pa.array([None if r[i + 1] is None else str(r[i + 1]) for r in some], pa.string()) for i in range(len(names))]
                    shapes = pa.array([None if r[0] is None else _wkb_rings(r[0]) for r in some], pa.list_(pa.list_(point)))
                    yield pa.RecordBatch.from_arrays([*cols, shapes], [*names, "rings"])
                con.close()

    text = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField("rings", T.ArrayType(T.ArrayType(POINT)))])
    raw = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, text)
    return raw.select(*[F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name) for f in schema.fields], "rings")


#: Bytes of a GeoPackage geometry's envelope by its kind.
_ENVELOPES = (0, 32, 48, 48, 64)


def _wkb_rings(blob: bytes) -> list[list[dict[str, float]]]:
    """Rings, paths or points (a path of one) of a GeoPackage geometry, those of all its parts. What isn't known is refused."""
    if blob[:2] != b"GP" or len(blob) < 8:
        raise ValueError("no GeoPackage geometry")
    flags = blob[3]
    kind = flags >> 1 & 7
    if kind >= len(_ENVELOPES) or flags >> 5 & 1:
        raise ValueError(f"a GeoPackage geometry with flags {flags}")
    rings: list[list[dict[str, float]]] = []

    def part(at: int) -> int:
        order = {0: ">", 1: "<"}[blob[at]]
        (code,) = struct.unpack_from(f"{order}I", blob, at + 1)
        at += 5
        shape, dims = code % 1000, {0: 2, 1: 3, 2: 3, 3: 4}.get(code // 1000)
        if dims is None or shape not in (1, 2, 3, 4, 5, 6, 7):
            raise ValueError(f"a geometry of type {code}")
        if shape == 1:
            x, y = struct.unpack_from(f"{order}2d", blob, at)
            if x == x:  # an empty point has none
                rings.append([{"x": x, "y": y}])
            return at + 8 * dims
        (n,) = struct.unpack_from(f"{order}I", blob, at)
        at += 4
        if shape > 3:
            for _ in range(n):
                at = part(at)
            return at
        for _ in range(n if shape == 3 else 1):
            if shape == 3:
                (n,) = struct.unpack_from(f"{order}I", blob, at)
                at += 4
            xy = np.frombuffer(blob, f"{order}f8", dims * n, at).reshape(-1, dims)[:, :2]
            if n:
                rings.append([{"x": float(x), "y": float(y)} for x, y in xy])
            at += 8 * dims * n
        return at

    if not flags >> 4 & 1:
        part(8 + _ENVELOPES[kind])
    return rings
