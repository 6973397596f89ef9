"""OpenStreetMap extracts (``.osm.pbf``) as tables: elements, and the layers of points, lines and polygons.

An extract is a row of compressed blocks. One task a file walks over the block heads, which is a few bytes a
block; the blocks are then rows that any task unpacks from its range of the file. Shapes are
put together by joins: ways' node numbers with nodes, relations' members with ways.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.operators.geometry import bounds
from kerbside.operators.spatial import _stitched
from kerbside.scratch import Scratch
from kerbside.ship import ship

ELEMENTS = "kind string, id long, lon double, lat double, tags map<string, string>, refs array<long>, roles array<string>, members array<string>"
#: The format's member kinds, and the unit of coordinates.
_MEMBERS = ("node", "way", "relation")
NANO = 1e9


def _varints(data: bytes) -> np.ndarray:
    """Packed variable-length numbers, as unsigned 64-bit."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.empty(0, np.uint64)
    ends = np.flatnonzero(b < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.bitwise_or.reduceat((b & 127).astype(np.uint64) << (7 * place).astype(np.uint64), starts)


def _signed(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(1)).astype(np.int64) ^ -(x & np.uint64(1)).astype(np.int64)


def _fields(data: memoryview) -> Iterator[tuple[int, object]]:
    """Numbered fields of a message: a number, or the bytes of what has a length."""
    at, end = 0, len(data)

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < end:
        key = number()
        field, kind = key >> 3, key & 7
        if kind == 0:
            yield field, number()
        elif kind == 2:
            n = number()
            yield field, data[at : at + n]
            at += n
        else:
            at += {1: 8, 5: 4}[kind]


def _message(data) -> dict[int, list]:
    out: dict[int, list] = {}
    for field, value in _fields(memoryview(data)):
        out.setdefault(field, []).append(value)
    return out


def _first(m: dict[int, list], field: int, other):
    return m[field][0] if field in m else other


def _deltas(m: dict[int, list], field: int) -> np.ndarray:
    return np.cumsum(_signed(_varints(bytes(_first(m, field, b"")))))


def elements_of(block: bytes) -> list[tuple]:
    """The elements of one unpacked block, as rows of ``ELEMENTS``."""
    m = _message(block)
    strings = [bytes(s).decode("utf-8", "replace") for s in _message(_first(m, 1, b"")).get(1, [])]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    unit, lat0, lon0 = _first(m, 17, 100), signed(_first(m, 19, 0)), signed(_first(m, 20, 0))
    degrees = lambda start, v: (start + unit * v) / NANO
    text = lambda places: [strings[i] for i in places]
    rows: list[tuple] = []

    def tags(e: dict[int, list]) -> list[tuple[str, str]]:
        keys, values = (_varints(bytes(_first(e, f, b""))).tolist() for f in (2, 3))
        return list(zip(text(keys), text(values), strict=True))

    for group in m.get(2, []):
        g = _message(group)
        for raw in g.get(1, []):
            e = _message(raw)
            number = lambda f: int(_signed(np.array([e[f][0]], np.uint64))[0])  # noqa: B023, E731
            rows.append(("node", number(1), degrees(lon0, number(9)), degrees(lat0, number(8)), tags(e), None, None, None))
        for raw in g.get(2, []):
            e = _message(raw)
            ids, lat, lon = _deltas(e, 1), degrees(lat0, _deltas(e, 8)), degrees(lon0, _deltas(e, 9))
            own: list[list] = [[] for _ in ids]
            at, pairs = 0, _varints(bytes(_first(e, 10, b""))).tolist()
            k = 0
            while k < len(pairs):
                if pairs[k] == 0:
                    at, k = at + 1, k + 1
                else:
                    own[at].append((strings[pairs[k]], strings[pairs[k + 1]]))
                    k += 2
            rows += [("node", i, x, y, t, None, None, None) for i, x, y, t in zip(ids.tolist(), lon.tolist(), lat.tolist(), own, strict=True)]
        for raw in g.get(3, []):
            e = _message(raw)
            rows.append(("way", e[1][0], None, None, tags(e), _deltas(e, 8).tolist(), None, None))
        for raw in g.get(4, []):
            e = _message(raw)
            kinds = [_MEMBERS[i] for i in _varints(bytes(_first(e, 10, b""))).tolist()]
            roles = text(_varints(bytes(_first(e, 8, b""))).tolist())
            rows.append(("relation", e[1][0], None, None, tags(e), _deltas(e, 9).tolist(), roles, kinds))
    return rows


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each file's blocks of elements lie."""
    for b in batches:
        for path in b.column("path").to_pylist():
            store, base = fs.FileSystem.from_uri(path)
            found = []
            with store.open_input_file(base) as f:
                at, size = 0, f.size()
                while at < size:
                    (n,) = struct.unpack(">I", f.read_at(4, at))
                    head = _message(f.read_at(n, at + 4))
                    if bytes(head[1][0]) == b"OSMData":
                        found.append((path, at + 4 + n, head[3][0]))
                    at += 4 + n + head[3][0]
            cols = list(zip(*found, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["path", "at", "size"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["kind", "id", "lon", "lat", "tags", "refs", "roles", "members"]
    kinds = [pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.map_(pa.string(), pa.string()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string())]
    for b in batches:
        for path, at, size in zip(*(b.column(c).to_pylist() for c in ("path", "at", "size")), strict=True):
            store, base = fs.FileSystem.from_uri(path)
            with store.open_input_file(base) as f:
                blob = _message(f.read_at(size, at))
            if 1 not in blob and 3 not in blob:
                raise ValueError(f"{path}, byte {at}: a block that is neither plain nor deflated")
            rows = elements_of(bytes(blob[1][0]) if 1 in blob else zlib.decompress(bytes(blob[3][0])))
            for lo in range(0, len(rows), 2000):
                cols = zip(*rows[lo : lo + 2000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names)


def elements(spark: SparkSession, path: str) -> DataFrame:
    """Every node, way and relation: coordinates of nodes, node numbers of ways, members of relations, tags of all."""
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = spark.read.format("binaryFile").load(path).select("path")
    where = Scratch(spark, "blocks").table(files.mapInArrow(_blocks, "path string, at long, size long"), "blocks")
    return where.repartition(max(1, min(where.count(), 16 * parts)), "at").mapInArrow(_unpacked, ELEMENTS)


def _kept(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Elements that have one of the tags, which become columns (all of them text)."""
    have = F.lit(False)
    for k in keys:
        have = have | F.col("tags")[k].isNotNull()
    return df.filter(have).withColumns({f"tag_{k}": F.col("tags")[k] for k in keys})


def _meets(df: DataFrame, box: Sequence[float] | None) -> DataFrame:
    if box is None:
        return df
    b = bounds(F.col("rings"))
    return df.filter((b["x0"] <= box[2]) & (b["x1"] >= box[0]) & (b["y0"] <= box[3]) & (b["y1"] >= box[1]))


def points(all_: DataFrame, keys: Sequence[str], box: Sequence[float] | None = None) -> DataFrame:
    """``id, x, y`` and the tags of nodes that have one of ``keys``."""
    n = _kept(all_.filter("kind = 'node'"), keys).select("id", F.col("lon").alias("x"), F.col("lat").alias("y"), *[F.col(f"tag_{k}").alias(k) for k in keys])
    return n if box is None else n.filter(F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3]))


def _paths(all_: DataFrame, ways: DataFrame) -> DataFrame:
    """``id, path``: the places of each way's nodes in order; nodes that the extract lacks are left out."""
    steps = ways.select("id", F.posexplode("refs").alias("place", "node"))
    nodes = all_.filter("kind = 'node'").select(F.col("id").alias("node"), "lon", "lat")
    met = steps.join(nodes, "node").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "lon", "lat"))).alias("p"))
    return met.select("id", F.transform("p", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y"))).alias("path"))


def lines(all_: DataFrame, keys: Sequence[str], box: Sequence[float] | None = None, where: Column | None = None) -> DataFrame:
    """``id, kind, rings`` (one path) and the tags of ways that have one of ``keys`` (and pass ``where``, over ``tags``)."""
    ways = all_.filter("kind = 'way'")
    ways = _kept(ways if where is None else ways.filter(where), keys)
    shaped = _paths(all_, ways).filter(F.size("path") >= 2).select("id", F.lit("LineString").alias("kind"), F.array("path").alias("rings"))
    return _meets(shaped.join(ways.select("id", *[F.col(f"tag_{k}").alias(k) for k in keys]), "id"), box)


def polygons(all_: DataFrame, keys: Sequence[str], box: Sequence[float] | None = None) -> DataFrame:
    """``id, kind, rings`` and the tags of areas that have one of ``keys``: closed ways, and relations whose ways close.

    A relation's ways meet in one task, to be joined to rings; relations' numbers are negative, ways' positive.
    """
    ways = all_.filter("kind = 'way'")
    closed = _kept(ways.filter((F.size("refs") >= 4) & (F.element_at("refs", 1) == F.element_at("refs", -1))), keys)
    names = [F.col(f"tag_{k}").alias(k) for k in keys]
    own = _paths(all_, closed).select("id", F.array("path").alias("rings")).join(closed.select("id", *names), "id")
    relations = _kept(all_.filter("kind = 'relation'").filter(F.col("tags")["type"].isin("multipolygon", "boundary")), keys)
    members = relations.select("id", F.explode(F.arrays_zip("refs", "members")).alias("m")).filter("m.members = 'way'").select("id", F.col("m.refs").alias("way"))
    needed = ways.join(members.select(F.col("way").alias("id")).distinct(), "id", "left_semi")
    pieces = members.join(_paths(all_, needed).withColumnRenamed("id", "way"), "way")
    steps = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("a"), F.element_at("path", i + 1).alias("b")))
    edges = pieces.filter(F.size("path") >= 2).select("id", F.explode(steps).alias("e"))
    edges = edges.select("id", *[F.col(f"e.{c[0]}.{c[1]}").alias(c) for c in ("ax", "ay", "bx", "by")]).filter("ax <> bx or ay <> by")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": [pdf["id"].iloc[0]], "rings": [[r for r in _stitched(pdf) if len(r) >= 3]]})

    made = edges.groupBy("id").applyInPandas(join, "id long, rings array<array<struct<x: double, y: double>>>")
    made = made.filter(F.size("rings") > 0).join(relations.select("id", *names), "id").withColumn("id", -F.col("id"))
    return _meets(own.unionByName(made).withColumn("kind", F.lit("Polygon")), box)


# ---- writing ----


def _number(v: int) -> bytes:
    out = bytearray()
    v &= (1 << 64) - 1
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    return bytes([*out, v])


def _part(field: int, data: bytes | int) -> bytes:
    return _number(field << 3) + _number(data) if isinstance(data, int) else _number(field << 3 | 2) + _number(len(data)) + data


def _zigzag(v: int) -> int:
    return v << 1 ^ v >> 63


def encode(rows: Sequence[tuple]) -> bytes:
    """A small extract of ``(kind, id, lon, lat, tags, refs, roles, members)`` rows, one block: fixtures, and cut-outs for others."""
    strings: dict[str, int] = {"": 0}
    place = lambda s: strings.setdefault(s, len(strings))
    packed = lambda vs: b"".join(map(_number, vs))
    deltas = lambda vs: packed(_zigzag(b - a) for a, b in zip([0, *vs[:-1]], vs, strict=True))
    nodes = [r for r in rows if r[0] == "node"]
    body = b""
    if nodes:
        tags = [v for r in nodes for v in [*[place(x) for pair in dict(r[4]).items() for x in pair], 0]]
        unit = lambda v: round(v * NANO / 100)
        dense = _part(1, deltas([r[1] for r in nodes])) + _part(8, deltas([unit(r[3]) for r in nodes])) + _part(9, deltas([unit(r[2]) for r in nodes]))
        body += _part(2, dense + _part(10, packed(tags)))
    for kind, number, _, _, tags, refs, roles, members in rows:
        own = _part(1, number) + _part(2, packed(place(k) for k in dict(tags))) + _part(3, packed(place(v) for v in dict(tags).values()))
        if kind == "way":
            body += _part(3, own + _part(8, deltas(list(refs))))
        elif kind == "relation":
            body += _part(4, own + _part(8, packed(map(place, roles))) + _part(9, deltas(list(refs))) + _part(10, packed(map(_MEMBERS.index, members))))
    table = b"".join(_part(1, s.encode()) for s in strings)
    out = b""
    for name, block in (("OSMHeader", _part(4, b"OsmSchema-V0.6")), ("OSMData", _part(1, table) + _part(2, body))):
        blob = _part(2, len(block)) + _part(3, zlib.compress(block))
        head = _part(1, name.encode()) + _part(3, len(blob))
        out += struct.pack(">I", len(head)) + head + blob
    return out


def write_extracts(rows: DataFrame, folder: str) -> DataFrame:
    """Elements (``kind, id, lon, lat, tags, refs, roles, members``) as extracts below ``folder``, one for each task; ``path, elements``.

    A task's file is one block, so partitions should hold some thousand elements. It is renamed when whole, and a repeated
    task leaves the same file.
    """
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [tuple(r.values()) for b in batches for r in b.to_pylist()]
        if not some:
            return
        some = [(*r[:4], dict(r[4] or ()), *r[5:]) for r in some]
        name = f"{TaskContext.get().partitionId():05d}.osm.pbf"
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        own = f"{base}/.{name}-{uuid.uuid4().hex}"
        with store.open_output_stream(own) as out:
            out.write(encode(some))
        store.move(own, f"{base}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(some)])], ["path", "elements"])

    named = rows.select("kind", "id", "lon", "lat", "tags", "refs", "roles", "members")
    written = named.mapInArrow(run, "path string, elements long").collect()  # a row for each file
    return rows.sparkSession.createDataFrame(sorted(tuple(r) for r in written), "path string, elements long")
