"""GeoTIFF bands as blocks and pixels, read by ranges; and tiles of a lattice written side by side.

``blocks`` is a scan with pushdown: the files' headers are read when the scan is planned, blocks outside the box (or
outside comparisons of their edges, rows and columns) are dropped there, and a task reads the ranges of its blocks only.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from kerbside.scratch import Scratch
from kerbside.ship import ship

PIXELS = "raster string, row int, col int, x double, y double, value double"
#: A block of a band: its first pixel, its edges, the pixel's size, the projection's code (null if unknown), and its values, row by
#: row, as little-endian doubles, missing as NaN (null if they were not asked for).
BLOCKS = (
    "raster string, row int, col int, height int, width int, left double, bottom double, right double, top double, "
    "dx double, dy double, epsg int, values binary"
)
_NAMES = [x.split()[0] for x in BLOCKS.split(", ")]
#: The format's tags, field types, codes and geographic keys.
_TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 273: "strips", 277: "bands", 278: "rows", 279: "strip_sizes", 284: "planes",
         317: "predictor", 322: "tile_width", 323: "tile_height", 324: "tiles", 325: "tile_sizes", 339: "sample", 33550: "scale", 33922: "tie",
         34264: "matrix", 34735: "keys", 42113: "nodata"}
_FIELDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
_PLAIN, _LZW, _DEFLATE, _OLD_DEFLATE = 1, 5, 8, 32946
_KINDS = {1: "u", 2: "i", 3: "f"}
_MODEL, _AREA_OR_POINT, _GEOGRAPHIC, _PROJECTED = 1024, 1025, 2048, 3072
_CLEAR, _END, _FULL = 256, 257, 4094

Read = Callable[[int, int], bytes]


@dataclass(frozen=True)
class Header:
    """What a file says of its first image; ``offsets`` and ``sizes`` of its blocks, row by row, band by band if ``planes`` is 2."""

    width: int
    height: int
    kind: str
    bands: int
    planes: int
    packing: int
    predictor: int
    x0: float
    y0: float
    dx: float
    dy: float
    nodata: float | None
    epsg: int | None
    block: tuple[int, int]
    offsets: tuple[int, ...] = ()
    sizes: tuple[int, ...] = ()

    def place(self, i: int) -> tuple[int, int, int, int]:
        """First row and column, height and width of a block; blocks at the edge are cut there."""
        across = -(-self.width // self.block[1])
        r, c = i // across * self.block[0], i % across * self.block[1]
        return r, c, min(self.block[0], self.height - r), min(self.block[1], self.width - c)

    def edges(self, i: int) -> dict[str, float]:
        r, c, h, w = self.place(i)
        left, top = self.x0 + c * self.dx, self.y0 - r * self.dy
        return {"row": r, "col": c, "height": h, "width": w, "left": left, "right": left + w * self.dx, "top": top, "bottom": top - h * self.dy}

    @property
    def count(self) -> int:
        """Blocks of one band."""
        return -(-self.width // self.block[1]) * -(-self.height // self.block[0])


def _fields(read: Read) -> tuple[str, dict[str, tuple]]:
    """Byte order and the named fields of the first image, with offsets of 32 or 64 bits."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(f"{order}H", head[2:4])[0] if order and len(head) > 3 else 0
    if version not in (42, 43):
        raise ValueError("no TIFF file")
    long_, n_form, entry_form, n_size, entry_size = ("Q", "Q", "HHQ", 8, 20) if version == 43 else ("I", "H", "HHI", 2, 12)
    (at,) = struct.unpack(f"{order}{long_}", head[8:16] if version == 43 else head[4:8])
    (n,) = struct.unpack(f"{order}{n_form}", read(at, n_size))
    table = read(at + n_size, n * entry_size)
    fixed = struct.calcsize(f"{order}{entry_form}")
    out: dict[str, tuple] = {}
    for i in range(n):
        entry = table[i * entry_size : (i + 1) * entry_size]
        tag, kind, count = struct.unpack(f"{order}{entry_form}", entry[:fixed])
        if tag not in _TAGS or kind not in _FIELDS:
            continue
        form = f"{order}{count}s" if kind == 2 else f"{order}{count * len(_FIELDS[kind])}{_FIELDS[kind][0]}"
        size = struct.calcsize(form)
        raw = entry[fixed:][:size] if size <= entry_size - fixed else read(struct.unpack(f"{order}{long_}", entry[fixed:])[0], size)
        out[_TAGS[tag]] = struct.unpack(form, raw)
    return order, out


def header(read: Read) -> Header:
    """The header of a file of which ``read(at, size)`` gives ranges. What isn't known is refused."""
    order, f = _fields(read)
    width, height, bands = f["width"][0], f["height"][0], f.get("bands", (1,))[0]
    packing, predictor = f.get("compression", (_PLAIN,))[0], f.get("predictor", (1,))[0]
    if packing not in (_PLAIN, _LZW, _DEFLATE, _OLD_DEFLATE) or predictor not in (1, 2, 3):
        raise ValueError(f"compression {packing} with predictor {predictor}")
    if len(set(f["bits"])) != 1 or f["bits"][0] not in (8, 16, 32, 64) or len(set(f.get("sample", (1,)))) != 1:
        raise ValueError(f"samples of {f['bits']} bits")
    keys = f.get("keys", ())
    of = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    if "matrix" in f:
        m = f["matrix"]
        if m[1] or m[4]:
            raise ValueError("a rotated raster")
        x0, y0, dx, dy = m[3], m[7], m[0], -m[5]
    else:
        tie, (dx, dy, *_) = f.get("tie", (0, 0, 0, 0, float(height), 0)), f.get("scale", (1.0, 1.0))
        x0, y0 = tie[3] - tie[0] * dx, tie[4] + tie[1] * dy
    if of.get(_AREA_OR_POINT) == 2:  # places are those of centres
        x0, y0 = x0 - dx / 2, y0 + dy / 2
    tiled = "tiles" in f
    block = (f["tile_height"][0], f["tile_width"][0]) if tiled else (min(f.get("rows", (height,))[0], height), width)
    return Header(
        width, height, np.dtype(f"{order}{_KINDS[f.get('sample', (1,))[0]]}{f['bits'][0] // 8}").str, bands, f.get("planes", (1,))[0], packing, predictor,
        x0, y0, dx, dy, float(f["nodata"][0].split(b"\0")[0]) if "nodata" in f else None, of.get(_PROJECTED, of.get(_GEOGRAPHIC)),
        block, f["tiles" if tiled else "strips"], f["tile_sizes" if tiled else "strip_sizes"],
    )


def unlzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first; a code is one bit longer as soon as the next number but one needs it."""
    out, table, bits, acc, held, last = bytearray(), [], 9, 0, 0, b""
    for byte in data:
        acc, held = (acc << 8) | byte, held + 8
        if held < bits:
            continue
        held -= bits
        code = acc >> held
        acc &= (1 << held) - 1
        if code == _CLEAR:
            table, bits, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code == _END:
            break
        if not last:
            word = table[code]
        else:
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
            if len(table) > (1 << bits) - 2 and bits < 12:
                bits += 1
        out += word
        last = word
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """The same, written."""
    out, acc, held, bits = bytearray(), 0, 0, 9
    table: dict[bytes, int] = {}

    def put(code: int) -> None:
        nonlocal acc, held
        acc, held = (acc << bits) | code, held + bits
        while held >= 8:
            held -= 8
            out.append(acc >> held)
            acc &= (1 << held) - 1

    single = {bytes([i]): i for i in range(256)}
    put(_CLEAR)
    table, free, word = dict(single), _END + 1, b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer], free, word = free, free + 1, data[i : i + 1]
        if free > (1 << bits) - 1 and bits < 12:
            bits += 1
        if free == _FULL:
            put(_CLEAR)
            table, free, bits = dict(single), _END + 1, 9
    if word:
        put(table[word])
        free += 1
        if free > (1 << bits) - 1 and bits < 12:
            bits += 1
    put(_END)
    if held:
        out.append((acc << (8 - held)) & 255)
    return bytes(out)


def unpacked(h: Header, i: int, raw: bytes, band: int = 1) -> np.ndarray:
    """The values of a block as doubles, missing as NaN; a block without bytes is missing throughout."""
    _, _, rows, cols = h.place(i)
    if not raw:
        return np.full((rows, cols), np.nan)
    raw = {_PLAIN: bytes, _LZW: unlzw}.get(h.packing, zlib.decompress)(raw)
    kind, per = np.dtype(h.kind), h.bands if h.planes == 1 else 1
    line = h.block[1] * per * kind.itemsize
    data = np.frombuffer(raw, np.uint8)
    data = data[: len(data) // line * line].reshape(-1, line)
    if h.predictor == 3:  # differences of bytes, the high bytes of a line first
        data = np.cumsum(data.reshape(len(data), -1, per), axis=1, dtype=np.uint8).reshape(len(data), kind.itemsize, -1)
        block = np.ascontiguousarray(data.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(len(data), h.block[1], per)
    else:
        block = np.ascontiguousarray(data).view(kind).reshape(len(data), h.block[1], per)
        if h.predictor == 2:
            block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
    out = block[:rows, :cols, band - 1 if per > 1 else 0].astype(np.float64)
    if h.nodata is not None:
        out[out == h.nodata] = np.nan
    out[~np.isfinite(out)] = np.nan
    return out


def window(h: Header, box: Sequence[float] | None) -> tuple[int, int, int, int]:
    """Rows and columns (half-open) of the pixels that a box (x0, y0, x1, y1) touches."""
    if box is None:
        return 0, h.height, 0, h.width
    lo_c, hi_c = max(0, int(np.floor((box[0] - h.x0) / h.dx))), min(h.width, int(np.ceil((box[2] - h.x0) / h.dx)))
    lo_r, hi_r = max(0, int(np.floor((h.y0 - box[3]) / h.dy))), min(h.height, int(np.ceil((h.y0 - box[1]) / h.dy)))
    return lo_r, max(lo_r, hi_r), lo_c, max(lo_c, hi_c)


def decode(data: bytes, box: Sequence[float] | None = None, band: int = 1) -> tuple[np.ndarray, tuple[int, int], tuple[float, float, float, float]]:
    """``(values, (row, col), (x0, y0, dx, dy))`` of a band held in memory, or of the window of it that covers ``box``.

    Missing values are NaN; row and column are those of the first value in the file; pixel (r, c) has its
    centre at ``x0 + (c + .5) * dx, y0 - (r + .5) * dy``. Only blocks that meet the window are unpacked.
    """
    h = header(lambda at, size: data[at : at + size])
    r0, r1, c0, c1 = window(h, box)
    out = np.full((r1 - r0, c1 - c0), np.nan)
    first = h.count * (band - 1) if h.planes == 2 else 0
    for i in range(h.count):
        r, c, rows, cols = h.place(i)
        lo_r, hi_r, lo_c, hi_c = max(r, r0), min(r + rows, r1), max(c, c0), min(c + cols, c1)
        if lo_r < hi_r and lo_c < hi_c:
            at, size = h.offsets[first + i], h.sizes[first + i]
            block = unpacked(h, i, data[at : at + size] if size else b"", band)
            out[lo_r - r0 : hi_r - r0, lo_c - c0 : hi_c - c0] = block[lo_r - r : hi_r - r, lo_c - c : hi_c - c]
    return out, (r0, c0), (h.x0, h.y0, h.dx, h.dy)


def encode(
    values: np.ndarray, x0: float, y0: float, dx: float, dy: float, nodata: float | None = None, rows: int = 64, packing: str = "deflate",
    tile: int | None = None, predictor: int = 1, epsg: int | None = None,
) -> bytes:
    """A GeoTIFF of one band, in strips of ``rows`` or square tiles; NaN is written as ``nodata``, blocks without a value not at all."""
    floats = values.dtype.kind == "f"
    v = np.where(np.isnan(values), nodata, values).astype(values.dtype) if nodata is not None and floats else values
    v = np.ascontiguousarray(v, v.dtype.newbyteorder("<"))
    bh, bw = (tile, tile) if tile else (rows, v.shape[1])
    pack = {"deflate": zlib.compress, "lzw": lzw, "none": bytes}[packing]
    parts = []
    for r in range(0, len(v), bh):
        for c in range(0, v.shape[1], bw):
            part = v[r : r + bh, c : c + bw]
            if nodata is not None and (part == nodata).all():
                parts.append(b"")
                continue
            if tile:
                full = np.full((bh, bw), nodata or 0, v.dtype)
                full[: part.shape[0], : part.shape[1]] = part
                part = full
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.zeros((len(part), 1), v.dtype)).astype(v.dtype)
            parts.append(pack(np.ascontiguousarray(part).tobytes()))
    code = {"deflate": _DEFLATE, "lzw": _LZW, "none": _PLAIN}[packing]
    sample = {"u": 1, "i": 2, "f": 3}[v.dtype.kind]
    where, sizes = (324, 325) if tile else (273, 279)
    shape = [(322, 4, (bw,)), (323, 4, (bh,))] if tile else [(278, 4, (bh,))]
    fields = [
        (256, 4, (v.shape[1],)), (257, 4, (v.shape[0],)), (258, 3, (8 * v.dtype.itemsize,)), (259, 3, (code,)), (262, 3, (1,)), (277, 3, (1,)),
        (317, 3, (predictor,)), (339, 3, (sample,)), *shape, (where, 4, None), (sizes, 4, tuple(map(len, parts))),
        (33550, 12, (dx, dy, 0.0)), (33922, 12, (0.0, 0.0, 0.0, x0, y0, 0.0)),
    ]
    if epsg is not None:
        planar = epsg != 4326
        keys = ((_MODEL, 0, 1, 1 if planar else 2), (_AREA_OR_POINT, 0, 1, 1), (_PROJECTED if planar else _GEOGRAPHIC, 0, 1, epsg))
        fields.append((34735, 3, (1, 1, 0, len(keys), *(x for k in keys for x in k))))
    if nodata is not None:
        fields.append((42113, 2, (f"{nodata}".encode() + b"\0",)))
    fields.sort(key=lambda x: x[0])
    head = 8 + 2 + 12 * len(fields) + 4
    packed = []
    for tag, kind, value in fields:
        n = len(parts) if value is None else len(value[0]) if kind == 2 else len(value)
        packed.append((tag, kind, n, None if value is None else value[0] if kind == 2 else struct.pack(f"<{n}{_FIELDS[kind]}", *value)))
    start = head + sum(s for s in (len(x[3]) if x[3] is not None else 4 * x[2] for x in packed) if s > 4)
    starts = [at if p else 0 for at, p in zip(np.cumsum([start, *map(len, parts)])[:-1].tolist(), parts, strict=True)]
    extra, entries = b"", []
    for tag, kind, n, raw in packed:
        raw = struct.pack(f"<{n}I", *starts) if raw is None else raw
        if len(raw) > 4:
            entries.append(struct.pack("<HHII", tag, kind, n, head + len(extra)))
            extra += raw
        else:
            entries.append(struct.pack("<HHI", tag, kind, n) + raw.ljust(4, b"\0"))
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(fields)) + b"".join(entries) + b"\0" * 4 + extra + b"".join(parts)


# ---- the scan ----


@dataclass
class _Part(InputPartition):
    path: str
    header: Header
    blocks: list[tuple[int, int, int]]


def _open(path: str) -> pa.NativeFile:
    store, base = fs.FileSystem.from_uri(path)
    return store.open_input_file(base)


def _header_of(path: str) -> Header:
    with _open(path) as f:
        first = f.read_at(1 << 16, 0)
        return header(lambda at, n: first[at : at + n] if at + n <= len(first) else f.read_at(n, at))


_TESTS = {
    EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b,
}
_PLACED = {"row", "col", "height", "width", "left", "bottom", "right", "top"}


class _Scan(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = json.loads(options["paths"])
        self.box = json.loads(options.get("box", "null"))
        self.band = int(options.get("band", "1"))
        self.values = options.get("values", "true") == "true"
        self.most = int(options.get("partitionbytes", str(16 << 20)))
        self.tests: list[tuple[type, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of a block's place and edges, and of the raster's name, are done when the scan is planned."""
        for f in filters:
            name = f.attribute[0] if type(f) in _TESTS and len(f.attribute) == 1 else None
            if name in _PLACED or (name == "raster" and type(f) is EqualTo):
                self.tests.append((type(f), name, f.value))
            else:
                yield f

    def _wanted(self, h: Header) -> list[tuple[int, int, int]]:
        r0, r1, c0, c1 = window(h, self.box)
        first, out = h.count * (self.band - 1) if h.planes == 2 else 0, []
        for i in range(h.count):
            e = h.edges(i)
            if e["row"] < r1 and e["row"] + e["height"] > r0 and e["col"] < c1 and e["col"] + e["width"] > c0:
                if all(_TESTS[t](e[n], v) for t, n, v in self.tests if n in _PLACED):
                    out.append((i, h.offsets[first + i], h.sizes[first + i]))
        return out

    def partitions(self) -> list[_Part]:
        named = [v for t, n, v in self.tests if n == "raster"]
        paths = [p for p in self.paths if all(p == v for v in named)]
        out = []
        with ThreadPoolExecutor(16) as pool:
            for path, h in zip(paths, pool.map(_header_of, paths), strict=True):
                if self.band > h.bands:
                    raise ValueError(f"{path} has {h.bands} bands")
                part, size = [], 0
                small = replace(h, offsets=(), sizes=())
                for block in self._wanted(h):
                    part.append(block)
                    size += block[2] if self.values else 64
                    if size >= self.most:
                        out.append(_Part(path, small, part))
                        part, size = [], 0
                if part:
                    out.append(_Part(path, small, part))
        return out

    def read(self, part: _Part | None) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        schema = pa.schema([pa.field(n, t) for n, t in zip(_NAMES, [pa.string(), *[pa.int32()] * 4, *[pa.float64()] * 6, pa.int32(), pa.binary()], strict=True)])
        h = part.header
        with _open(part.path) as f:
            for i, at, size in part.blocks:
                e = h.edges(i)
                values = unpacked(h, i, f.read_at(size, at) if size else b"", self.band).astype("<f8").tobytes() if self.values else None
                row = [part.path, *(e[n] for n in _NAMES[1:9]), h.dx, h.dy, h.epsg, values]
                yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(row, schema, strict=True)], schema=schema)


class GeoTiffBlocks(DataSource):
    """``spark.read.format("geotiff_blocks")``: blocks of bands; see ``blocks``."""

    @classmethod
    def name(cls) -> str:
        return "geotiff_blocks"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema) -> _Scan:
        return _Scan({k.lower(): v for k, v in self.options.items()})


def _files(spark: SparkSession, path: str) -> list[str]:
    """Files at a path, which may be a folder or have wildcards, in order."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for x in store.globStatus(p) or []:
        for y in store.listStatus(x.getPath()) if x.isDirectory() else [x]:
            name = y.getPath().getName()
            if not y.isDirectory() and not name.startswith(("_", ".")):
                uri = y.getPath().toString()
                out.append(f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    return sorted(out)


def blocks(spark: SparkSession, path: str, box: Sequence[float] | None = None, band: int = 1, values: bool = True, partition_bytes: int = 16 << 20) -> DataFrame:
    """``BLOCKS`` of the bands at ``path``, those that ``box`` (x0, y0, x1, y1) touches.

    Filters on ``raster`` and on a block's edges, rows and columns are pushed into planning. Without ``values`` no block is
    read. The store must be one that ``pyarrow.fs`` opens by URI.
    """
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoTiffBlocks)
    scan = spark.read.format("geotiff_blocks").option("paths", json.dumps(_files(spark, path))).option("box", json.dumps(list(map(float, box)) if box is not None else None))
    return scan.option("band", band).option("values", str(values).lower()).option("partitionbytes", partition_bytes).load()


def exploded(some: DataFrame, box: Sequence[float] | None = None) -> DataFrame:
    """``raster, row, col, x, y, value`` of the pixels of blocks, or of those that ``box`` touches; missing is NULL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.to_pylist():
                v = np.frombuffer(x["values"], "<f8").reshape(x["height"], x["width"])
                x0, y0 = x["left"] - x["col"] * x["dx"], x["top"] + x["row"] * x["dy"]
                step = max(1, 100_000 // max(1, v.shape[1]))
                for lo in range(0, len(v), step):
                    part = v[lo : lo + step]
                    row, col = np.divmod(np.arange(part.size), v.shape[1])
                    row, col, flat = row + x["row"] + lo, col + x["col"], part.ravel()
                    if box is not None:
                        keep = (x0 + col * x["dx"] < box[2]) & (x0 + (col + 1) * x["dx"] > box[0]) & (y0 - row * x["dy"] > box[1]) & (y0 - (row + 1) * x["dy"] < box[3])
                        row, col, flat = row[keep], col[keep], flat[keep]
                    cols = [pa.array(row.astype(np.int32)), pa.array(col.astype(np.int32)), pa.array(x0 + (col + 0.5) * x["dx"]), pa.array(y0 - (row + 0.5) * x["dy"])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x["raster"]] * len(flat), pa.string()), *cols, pa.array(flat, mask=np.isnan(flat))], ["raster", "row", "col", "x", "y", "value"]
                    )

    return some.select("raster", "row", "col", "height", "width", "left", "top", "dx", "dy", "values").mapInArrow(run, PIXELS)


def pixels(spark: SparkSession, path: str, box: Sequence[float] | None = None) -> DataFrame:
    """``raster, row, col, x, y, value`` of the bands at ``path``, or of the windows of them that cover ``box``; missing is NULL."""
    return exploded(blocks(spark, path, box), box)


def write_tiles(some: DataFrame, folder: str, scratch: Scratch, tile: int = 1024, kind: str = "f4", nodata: float = -9999.0, packing: str = "lzw", inner: int = 64) -> DataFrame:
    """Blocks as GeoTIFF files of ``tile`` by ``tile`` pixels of their raster's lattice; the manifest ``path, raster, values``.

    Each file is put together by one task from the blocks it holds (cut where they reach over it), and renamed when
    whole. Names say raster, row and column.
    """
    spread = some.withColumn("tr", F.explode(F.sequence(F.floor(F.col("row") / tile), F.floor((F.col("row") + F.col("height") - 1) / tile))))
    spread = spread.withColumn("tc", F.explode(F.sequence(F.floor(F.col("col") / tile), F.floor((F.col("col") + F.col("width") - 1) / tile))))

    def write(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        name, tr, tc = key
        r0, c0 = int(tr) * tile, int(tc) * tile
        top = int(max(pdf["row"].min(), r0)), int(max(pdf["col"].min(), c0))
        shape = int(min((pdf["row"] + pdf["height"]).max(), r0 + tile)) - top[0], int(min((pdf["col"] + pdf["width"]).max(), c0 + tile)) - top[1]
        full, first = np.full(shape, np.nan), pdf.iloc[0]
        for x in pdf.itertuples():
            v = np.frombuffer(x.values, "<f8").reshape(x.height, x.width)
            lo_r, lo_c = max(x.row, top[0]), max(x.col, top[1])
            hi_r, hi_c = min(x.row + x.height, top[0] + shape[0]), min(x.col + x.width, top[1] + shape[1])
            full[lo_r - top[0] : hi_r - top[0], lo_c - top[1] : hi_c - top[1]] = v[lo_r - x.row : hi_r - x.row, lo_c - x.col : hi_c - x.col]
        x0, y0 = first["left"] + (top[1] - first["col"]) * first["dx"], first["top"] - (top[0] - first["row"]) * first["dy"]
        epsg = None if pd.isna(first["epsg"]) else int(first["epsg"])
        whole = np.where(np.isnan(full), nodata, full).astype(kind)
        data = encode(whole, x0, y0, first["dx"], first["dy"], nodata, packing=packing, tile=inner, epsg=epsg)
        path = f"{folder}/{name}-{int(tr):06d}-{int(tc):06d}.tif"
        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(base.rsplit("/", 1)[0], recursive=True)
        own = f"{base.rsplit('/', 1)[0]}/.{zlib.crc32(data):08x}-{base.rsplit('/', 1)[1]}"  # another attempt writes the same
        with store.open_output_stream(own) as out:
            out.write(data)
        store.move(own, base)
        return pd.DataFrame({"path": [path], "raster": [name], "values": [int((~np.isnan(full)).sum())]})

    return scratch.table(spread.groupBy("raster", "tr", "tc").applyInPandas(write, "path string, raster string, values long"), "tiles")


def population_grid(spark: SparkSession, path: str, box: Sequence[float], margin: float = 0.01) -> DataFrame:
    """The cells of a population grid around the units' box (west, south, east, north), with a margin in degrees."""
    return pixels(spark, path, (box[0] - margin, box[1] - margin, box[2] + margin, box[3] + margin))


def night_composite(spark: SparkSession, path: str, box: Sequence[float] | None = None) -> DataFrame:
    """``raster, row, col, x, y, value``: the mean night temperature in Celsius of a season's composites; raw 0 is no data.

    Composites meet on the lattice of the first, whatever their frames and tiles.
    """
    from kerbside.operators import blocks as lattice
    from kerbside.operators.raster import KELVIN, NIGHT

    raw = blocks(spark, path, box)
    grid = lattice.common_grid(blocks(spark, path, box, values=False))
    if grid is None:
        return exploded(raw)
    warm = lattice.mapped(raw, lambda v: np.where(v > 0, v * NIGHT - KELVIN, np.nan))
    return exploded(lattice.composite(lattice.aligned(warm, grid), grid, how="mean", name="night"), box)
