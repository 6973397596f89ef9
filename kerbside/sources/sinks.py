"""Sinks: published folders, stage cache, packages."""

from __future__ import annotations

import contextlib
import hashlib
import html
import io
import json
import sqlite3
import struct
import tempfile
import zipfile
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.functions.order import quantiles
from kerbside.functions.scaling import round_even
from kerbside.functions.text import escape_html, or_unknown, percent_text
from kerbside.operators.geometry import bounds
from kerbside.operators.quality import content_digest


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(df: DataFrame, path: str, format: str = "parquet", **options) -> None:
    """Write beside ``path``, then swap by two renames: what was published is never deleted before the new is in place.

    A fault between the renames leaves the old folder at ``<path>.old``; ``recover`` (which each publish calls first) puts it back.
    """
    spark = df.sparkSession
    recover(spark, path)
    df.write.format(format).options(**options).mode("overwrite").save(f"{path}.new")
    (new, store), (here, _), (old, _) = _fs(spark, f"{path}.new"), _fs(spark, path), _fs(spark, f"{path}.old")
    had = store.exists(here)
    if had and not store.rename(here, old):
        raise OSError(f"{path} can't be renamed to {path}.old")
    if not store.rename(new, here):
        if had:
            store.rename(old, here)
        raise OSError(f"{path}.new can't be renamed to {path}")
    store.delete(old, True)


def recover(spark: SparkSession, path: str) -> bool:
    """Put back what a publish cut short had moved aside, or clear it away if the new is in place; whether there was any."""
    (here, store), (old, _) = _fs(spark, path), _fs(spark, f"{path}.old")
    if not store.exists(old):
        return False
    if store.exists(here):
        store.delete(old, True)
    elif not store.rename(old, here):
        raise OSError(f"{path}.old can't be renamed to {path}")
    return True


def write_layer(df: DataFrame, path: str, size: float = 0.05) -> None:
    """A map layer (``kind, rings`` and columns) as Parquet with each shape's box, near shapes together, so that
    ``readers.layer`` can skip files and row groups."""
    boxed = df.withColumns(bounds(F.col("rings")))
    cells = [F.floor((F.col(f"{c}0") + F.col(f"{c}1")) / 2 / size) for c in "yx"]
    boxed.repartitionByRange(*cells).sortWithinPartitions(*cells).write.mode("overwrite").parquet(path)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A driver-side file in any store."""
    p, store = _fs(spark, path)
    out = store.create(p, True)
    try:
        for at in range(0, len(data), 1 << 20):
            out.write(bytearray(data[at : at + (1 << 20)]))
    finally:
        out.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small driver-side text file in any store."""
    write_bytes(spark, path, text.encode("utf-8"))


def read_text(spark: SparkSession, path: str) -> str | None:
    p, store = _fs(spark, path)
    if not store.exists(p):
        return None
    return "\n".join(r[0] for r in spark.read.text(path).collect())


def fingerprint(version: int, parts: Mapping[str, object]) -> str:
    """SHA-256 over sorted JSON."""
    return hashlib.sha256(json.dumps({"version": version, **parts}, sort_keys=True, default=str).encode()).hexdigest()


def table_digest(df: DataFrame) -> dict[str, int]:
    """Order-free digest of a table's rows."""
    r = content_digest(df).first()
    return {k: int(v or 0) for k, v in r.asDict().items()}


def cached_stage(spark: SparkSession, path: str, version: int, parts: Mapping[str, object], build, force: bool = False) -> DataFrame:
    """The stage's table: read if its manifest has this fingerprint, else built and published."""
    want = fingerprint(version, parts)
    held = read_text(spark, f"{path}.meta.json")
    if force or held is None or json.loads(held).get("fingerprint") != want:
        publish(build(), path)
        write_text(spark, f"{path}.meta.json", json.dumps({"version": version, "fingerprint": want}))
    return spark.read.parquet(path)


def tidy(df: DataFrame, names: Mapping[str, str], digits: Mapping[str, int]) -> DataFrame:
    """The columns of a dictionary, renamed; floats rounded half-even by the longest matching name prefix, else to 1."""
    out: list[Column] = []
    for old, new in names.items():
        if old not in df.columns:
            continue
        c = F.col(old)
        kind = df.schema[old].dataType.typeName()
        if kind in ("double", "float"):
            match = max((p for p in digits if new.startswith(p)), key=len, default=None)
            c = round_even(c.cast("double"), digits[match] if match is not None else 1).cast(kind)
        out.append(c.alias(new))
    return df.select(*out)


def column_dictionary(spark: SparkSession, columns: Sequence[str], known: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``column, description, unit`` of the columns whose name without its year is known."""
    return described(spark.createDataFrame([(i, c) for i, c in enumerate(columns)], "i int, column string"), known)


def described(columns: DataFrame, known: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``column, description, unit`` of the known ones of ``columns`` (``i, column``), each once, by its smallest ``i``."""
    rows = columns.groupBy("column").agg(F.min("i").alias("i"))
    base = columns.sparkSession.createDataFrame([(k, *v) for k, v in known.items()], "base string, description string, unit string")
    named = rows.withColumn("base", F.regexp_replace("column", r"_(\d{4})$", "_{year}"))
    return named.join(F.broadcast(base), "base").orderBy("i").select("column", "description", "unit")  # a fixed dictionary


def tooltips(panel: DataFrame) -> DataFrame:
    """``panel`` with the texts of a map's tooltips: percent, escaped name and area; what is missing says so."""
    return panel.withColumns(
        {"percent_text": percent_text(F.col("percent")), "name_text": escape_html(F.col("name")), "area_text": escape_html(or_unknown(F.col("neighbourhood")))}
    )


def map_layers(panel: DataFrame, path: str) -> None:
    """One folder for each year and category, with tooltip columns where the panel has what they need."""
    if {"percent", "name", "neighbourhood"} <= set(panel.columns):
        panel = tooltips(panel)
    panel.write.mode("overwrite").partitionBy("year", "category").json(path)


def geojson_lines(df: DataFrame, rings: str, kind: str, properties: Sequence[str], digits: int = 5) -> DataFrame:
    """One feature a row as text, coordinates rounded."""
    place = lambda p: F.array(F.bround(p["x"], digits), F.bround(p["y"], digits))
    points = F.transform(rings, lambda r: F.transform(r, place))
    shape = {"LineString": points[0], "Polygon": points}
    geometry = F.struct(F.lit(kind).alias("type"), shape[kind].alias("coordinates"))
    props = F.struct(*properties)
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), geometry.alias("geometry"))).alias("value"))


def city_stats(panel: DataFrame, year: int, area: str = "neighbourhood") -> DataFrame:
    """One row of JSON: roads, means and the area with the largest mean."""
    p = panel.filter(F.col("year") == year)
    areas = p.groupBy(area).agg(F.avg("percent").alias("mean"))
    best = areas.agg(F.max_by(area, F.struct("mean", area)).alias("riskiest"))
    row = p.agg(F.count("*").alias("roads"), F.round(F.avg("percent"), 1).alias("percent_mean"), F.round(F.avg("lst"), 1).alias("lst_mean"))
    return row.crossJoin(F.broadcast(best)).select(F.to_json(F.struct("*")).alias("value"))  # one row each


def with_uncertainty(areas: DataFrame, uncertainty: DataFrame, keys: Sequence[str] = ("neighbourhood", "district")) -> DataFrame:
    """``areas`` with the uncertainty columns of the same area; missing where there are none."""
    return areas.join(uncertainty, list(keys), "left")


def with_probabilities(roads: DataFrame, uncertainty: DataFrame, key: str = "road_id") -> DataFrame:
    """``roads`` with each road's rank quantiles and top-share frequencies."""
    return roads.join(uncertainty, key, "left")


def package(tables: Mapping[str, DataFrame], folder: str) -> None:
    """The CSV export set; each table is small enough for one file (areas, the top roads, a dictionary) but ``roads``."""
    for name, df in tables.items():
        writer = (df if name == "roads" else df.coalesce(1)).write.mode("overwrite").option("header", True)
        writer.csv(f"{folder}/{name}")


def uncertainty_outputs(roads: DataFrame, areas: DataFrame, runs: DataFrame, indices: DataFrame, folder: str) -> None:
    """The output set of a Monte Carlo analysis: roads as Parquet, areas, runs and indices as CSV, a summary as JSON."""
    publish(roads, f"{folder}/roads")
    for name, df in (("areas", areas), ("runs", runs), ("indices", indices)):
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")  # a row an area, run or decision
    spread = five_quantiles(roads.withColumn("band", F.col("q95") - F.col("q05")), "band")
    both = {c: five_quantiles(runs, c) for c in ("spearman", "overlap")} | {"rank_band": spread}
    rows = [df.select(F.lit(n).alias("measure"), "*").first().asDict() for n, df in both.items()]
    write_text(roads.sparkSession, f"{folder}/summary.json", json.dumps(rows, ensure_ascii=False, indent=2, sort_keys=True))


def five_quantiles(df: DataFrame, column: str) -> DataFrame:
    """One row ``p05, p25, p50, p75, p95`` of a column, rounded to 4 digits."""
    q = (0.05, 0.25, 0.5, 0.75, 0.95)
    values = quantiles(df, {column: q})[column]
    row = tuple(None if v is None else round(v, 4) for v in values)
    return df.sparkSession.createDataFrame([row], ", ".join(f"p{int(x * 100):02d} double" for x in q))


def manifest(spark: SparkSession, path: str, city: str, years: Sequence[int], default_year: int, layers: Mapping[str, DataFrame]) -> dict:
    """What a map offers: years, the one shown first, and each layer's rows and digest; written as JSON and returned."""
    found = {n: table_digest(df) for n, df in sorted(layers.items())}
    out = {"city": city, "years": sorted(years), "default_year": default_year, "layers": found}
    write_text(spark, path, json.dumps(out, ensure_ascii=False, indent=2, sort_keys=True))
    return out


def _cells(row: Sequence[object], number: int) -> str:
    out = []
    for i, v in enumerate(row):
        name, i = "", i + 1
        while i:
            i, r = divmod(i - 1, 26)
            name = chr(65 + r) + name
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            out.append(f'<c r="{name}{number}"><v>{v!r}</v></c>')
        elif v is not None:
            out.append(f'<c r="{name}{number}" t="inlineStr"><is><t xml:space="preserve">{html.escape(str(v), quote=False)}</t></is></c>')
    return f'<row r="{number}">{"".join(out)}</row>'


def workbook(spark: SparkSession, path: str, sheets: Mapping[str, DataFrame], most_rows: int = 100_000) -> None:
    """A spreadsheet file with one sheet a table. Tables of a report are small; one beyond ``most_rows`` is refused."""
    kind = "http://schemas.openxmlformats.org"
    parts, names = {}, list(sheets)
    for k, (name, df) in enumerate(sheets.items(), 1):
        rows = df.limit(most_rows + 1).collect()
        if len(rows) > most_rows:
            raise ValueError(f"{name} has more than {most_rows} rows; write it as a table")
        body = "".join(_cells(r, i) for i, r in enumerate([df.columns, *rows], 1))
        parts[f"xl/worksheets/sheet{k}.xml"] = f'<worksheet xmlns="{kind}/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>'
    listed = "".join(f'<sheet name="{html.escape(n[:31])}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(names, 1))
    parts["xl/workbook.xml"] = f'<workbook xmlns="{kind}/spreadsheetml/2006/main" xmlns:r="{kind}/officeDocument/2006/relationships"><sheets>{listed}</sheets></workbook>'
    links = "".join(f'<Relationship Id="rId{k}" Type="{kind}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1))
    parts["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="{kind}/package/2006/relationships">{links}</Relationships>'
    parts["_rels/.rels"] = f'<Relationships xmlns="{kind}/package/2006/relationships"><Relationship Id="rId1" Type="{kind}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>'
    main = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    types = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{main}.worksheet+xml"/>' for k in range(1, len(names) + 1))
    parts["[Content_Types].xml"] = (
        f'<Types xmlns="{kind}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{main}.sheet.main+xml"/>{types}</Types>'
    )
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>{text}')
    write_bytes(spark, path, held.getvalue())


def html_report(spark: SparkSession, path: str, title: str, tables: Mapping[str, DataFrame], most_rows: int = 1000) -> None:
    """A page with one table a section; each is the first ``most_rows`` rows of a report's table."""
    cell = lambda v: html.escape("" if v is None else str(v))
    out = [f"<!doctype html><meta charset='utf-8'><title>{cell(title)}</title><h1>{cell(title)}</h1>"]
    for name, df in tables.items():
        head = "".join(f"<th>{cell(c)}</th>" for c in df.columns)
        body = "".join(f"<tr>{''.join(f'<td>{cell(v)}</td>' for v in r)}</tr>" for r in df.limit(most_rows).collect())
        out.append(f"<h2>{cell(name)}</h2><table><tr>{head}</tr>{body}</table>")
    write_text(spark, path, "\n".join(out))


def _parts(rings: Sequence[Sequence[Mapping[str, float]]]) -> list[list[Sequence[Mapping[str, float]]]]:
    """Rings by part: an outer ring, and the holes right inside it."""

    def holds(ring, x: float, y: float) -> bool:
        odd = False
        for p, q in zip(ring, [*ring[1:], ring[0]], strict=True):
            if (p["y"] > y) != (q["y"] > y) and x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]:
                odd = not odd
        return odd

    middle = [((r[0]["x"] + r[1]["x"]) / 2, (r[0]["y"] + r[1]["y"]) / 2) if len(r) > 1 else (r[0]["x"], r[0]["y"]) for r in rings]
    around = [[j for j in range(len(rings)) if j != i and holds(rings[j], *middle[i])] for i in range(len(rings))]
    out = {i: [rings[i]] for i in range(len(rings)) if len(around[i]) % 2 == 0}
    for i, outer in enumerate(around):
        if len(outer) % 2:  # a hole is in the ring around it that most others are around
            out[max((j for j in outer if j in out), key=lambda j: len(around[j]))].append(rings[i])
    return list(out.values())


def _wkb(rings: Sequence[Sequence[Mapping[str, float]]], polygon: bool) -> bytes:
    """Well-known binary of a polygon or of a line, or of several, little-endian."""
    line = lambda r: struct.pack("<I", len(r)) + b"".join(struct.pack("<dd", p["x"], p["y"]) for p in r)
    closed = lambda r: [*r, r[0]] if (r[0]["x"], r[0]["y"]) != (r[-1]["x"], r[-1]["y"]) else r
    if polygon:
        parts = [b"\x01" + struct.pack("<II", 3, len(part)) + b"".join(line(closed(r)) for r in part) for part in _parts(rings)]
    else:
        parts = [b"\x01" + struct.pack("<I", 2) + line(r) for r in rings]
    return parts[0] if len(parts) == 1 else b"\x01" + struct.pack("<II", 6 if polygon else 5, len(parts)) + b"".join(parts)


def geopackage(spark: SparkSession, path: str, layers: Mapping[str, DataFrame], srs: int = 4326, most_rows: int = 1_000_000) -> None:
    """A GeoPackage with one layer a table (``kind, rings`` and columns). Rows stream through the driver into one file,
    which is what the format is; a layer beyond ``most_rows`` is refused and belongs into ``write_layer``."""
    types = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "float": "REAL", "boolean": "INTEGER"}
    with tempfile.TemporaryDirectory() as folder:
        with contextlib.closing(sqlite3.connect(f"{folder}/out.gpkg")) as con:
            con.execute("PRAGMA application_id = 1196444487")
            con.execute("CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER PRIMARY KEY, organization TEXT, organization_coordsys_id INTEGER, definition TEXT)")
            con.executemany("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, ?)", [("undefined", -1, "NONE", -1, "undefined"), (f"EPSG:{srs}", srs, "EPSG", srs, "undefined")])
            con.execute("CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT, srs_id INTEGER)")
            con.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z TINYINT, m TINYINT)")
            for name, df in layers.items():
                own = [(c, types.get(t, "TEXT")) for c, t in df.dtypes if c not in ("kind", "rings")]
                quoted = ", ".join(f'"{c}" {t}' for c, t in own)
                con.execute(f'CREATE TABLE "{name}" (fid INTEGER PRIMARY KEY, geom BLOB{", " if own else ""}{quoted})')
                con.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, ?)", (name, name, srs))
                con.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'GEOMETRY', ?, 0, 0)", (name, srs))
                for n, r in enumerate(df.toLocalIterator(), 1):
                    if n > most_rows:
                        raise ValueError(f"{name} has more than {most_rows} rows; use write_layer")
                    shape = b"GP\x00\x01" + struct.pack("<i", srs) + _wkb(r["rings"], "Polygon" in (r["kind"] or "")) if r["rings"] else None
                    con.execute(f'INSERT INTO "{name}" VALUES (NULL, ?{", ?" * len(own)})', (shape, *(r[c] for c, _ in own)))
            con.commit()
        with open(f"{folder}/out.gpkg", "rb") as f:
            write_bytes(spark, path, f.read())
