"""Bands as blocks: formats, pushdown, common grids, reprojection and neighbourhoods against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside.operators import blocks
from kerbside.scratch import Scratch
from kerbside.sources import geotiff


def test_lzw_of_the_specification():
    """The specification's own example, code by code: clear, 7, 258, 8, 8, 258, 6, 6, end."""
    data = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    want = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert geotiff.lzw(data) == want and geotiff.unlzw(want) == data


@pytest.mark.parametrize("n", [0, 1, 2, 253, 255, 256, 257, 3000, 70_000])
def test_lzw_round_trips(n):
    rng = np.random.default_rng(n)
    for data in (bytes(n), rng.integers(0, 256, n, np.uint8).tobytes(), rng.integers(0, 3, n, np.uint8).tobytes(), bytes(i // 7 % 256 for i in range(n))):
        assert geotiff.unlzw(geotiff.lzw(data)) == data


@pytest.mark.parametrize("packing", ["lzw", "deflate", "none"])
@pytest.mark.parametrize("tile", [None, 16])
@pytest.mark.parametrize("kind,predictor", [("f4", 1), ("f8", 1), ("u2", 2), ("i4", 2), ("u1", 1)])
def test_formats(packing, tile, kind, predictor):
    v = (np.arange(50 * 37).reshape(50, 37) * 7 % 200).astype(kind)
    v[3, 4] = 9
    data = geotiff.encode(v, 10.0, 90.0, 2.0, 1.0, 9, rows=13, packing=packing, tile=tile, predictor=predictor, epsg=32635)
    got, _, place = geotiff.decode(data)
    want = np.where(v == 9, np.nan, v.astype(float))
    assert np.array_equal(got, want, equal_nan=True) and place == (10.0, 90.0, 2.0, 1.0)
    assert geotiff.header(lambda at, n: data[at : at + n]).epsg == 32635
    some, (r, c), _ = geotiff.decode(data, (15.5, 60.2, 40.0, 80.0))
    assert (r, c) == (10, 2) and np.array_equal(some, want[10:30, 2:15], equal_nan=True)


def test_blocks_that_are_not_there_are_missing():
    v = np.full((64, 64), np.nan, "f4")
    v[20, 40] = 5
    data = geotiff.encode(v, 0, 0, 1, 1, -1.0, tile=16, packing="lzw")
    h = geotiff.header(lambda at, n: data[at : at + n])
    assert sum(s > 0 for s in h.sizes) == 1 and sum(o > 0 for o in h.offsets) == 1
    assert np.array_equal(geotiff.decode(data)[0], v.astype(float), equal_nan=True)
    with pytest.raises(ValueError):
        geotiff.decode(b"GIF89a" + bytes(20))


def test_floating_point_predictor():
    v = np.linspace(-3, 9, 24, dtype=">f4").reshape(4, 6)
    lines = []
    for row in v:  # bytes by significance, then differences
        planes = np.frombuffer(row.tobytes(), np.uint8).reshape(6, 4).T.ravel()
        lines.append(np.diff(planes, prepend=np.uint8(0)).astype(np.uint8).tobytes())
    h = geotiff.Header(6, 4, "<f4", 1, 1, 1, 3, 0, 0, 1, 1, None, None, (4, 6))
    assert np.array_equal(geotiff.unpacked(h, 0, b"".join(lines)), v.astype(float))


def big_tiff(values):
    """A file with 64-bit offsets, one strip, two interleaved bands."""
    import struct

    raw = np.ascontiguousarray(values, "<u2").tobytes()
    fields = [(256, 4, values.shape[1]), (257, 4, values.shape[0]), (258, 3, (16, 16)), (259, 3, 1), (273, 16, 16), (277, 3, 2), (278, 4, values.shape[0]), (279, 16, len(raw))]
    out = struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16 + len(raw)) + raw + struct.pack("<Q", len(fields))
    for tag, kind, value in fields:
        many = value if isinstance(value, tuple) else (value,)
        out += struct.pack("<HHQ", tag, kind, len(many)) + struct.pack(f"<{len(many)}{ {3: 'H', 4: 'I', 16: 'Q'}[kind]}", *many).ljust(8, b"\0")
    return out + struct.pack("<Q", 0)


def test_bands_and_large_files(spark, tmp_path):
    v = np.arange(2 * 30 * 20).reshape(30, 20, 2)
    (tmp_path / "b.tif").write_bytes(big_tiff(v))
    for band in (1, 2):
        x = geotiff.blocks(spark, f"file://{tmp_path}/b.tif", band=band).first()
        assert np.array_equal(np.frombuffer(x["values"], "<f8").reshape(30, 20), v[:, :, band - 1])
    with pytest.raises(Exception, match="has 2 bands"):
        geotiff.blocks(spark, f"file://{tmp_path}/b.tif", band=3).collect()


def test_pushdown_reaches_planning(spark, tmp_path):
    v = np.arange(64 * 64, dtype="f4").reshape(64, 64)
    for i in range(3):
        (tmp_path / f"t{i}.tif").write_bytes(geotiff.encode(v + i, 64.0 * i, 64.0, 1.0, 1.0, -1.0, tile=16, packing="lzw"))
    path = f"file://{tmp_path}/t*.tif"
    all_ = geotiff.blocks(spark, path, partition_bytes=1)
    assert all_.rdd.getNumPartitions() == 48  # a block each
    some = geotiff.blocks(spark, path, partition_bytes=1).filter("left >= 64 and right <= 128 and top > 40")
    assert some.rdd.getNumPartitions() == 8 and {r["raster"][-6:] for r in some.select("raster").collect()} == {"t1.tif"}
    assert geotiff.blocks(spark, path, (70.0, 1.0, 71.0, 2.0), partition_bytes=1).rdd.getNumPartitions() == 1
    odd = some.filter(F.col("row") + F.col("col") == 0)  # what can't be pushed is still done
    assert [(r["row"], r["col"]) for r in odd.collect()] == [(0, 0)]
    got = geotiff.pixels(spark, path, (100.5, 3.0, 130.0, 5.5)).collect()
    want = {(x + 0.5, y + 0.5): float(v[63 - y, x % 64] + x // 64) for x in range(100, 130) for y in range(3, 6)}
    assert {(r["x"], r["y"]): r["value"] for r in got} == want
    assert geotiff.blocks(spark, f"file://{tmp_path}/none*.tif").count() == 0


def made(spark, name, v, x0, y0, size, epsg=32635, d=30.0):
    """Blocks of an array."""
    rows = [(r, c, None if math.isnan(v[r, c]) else float(v[r, c])) for r in range(v.shape[0]) for c in range(v.shape[1])]
    grid = blocks.Grid(x0, y0, d, d, v.shape[1], v.shape[0], epsg)
    return blocks.packed(spark.createDataFrame(rows, "row int, col int, value double"), grid, raster=F.lit(name), size=size)


def array(some, grid):
    out = np.full((grid.height, grid.width), np.nan)
    for r in geotiff.exploded(some).collect():
        out[r["row"], r["col"]] = np.nan if r["value"] is None else r["value"]
    return out


def field(h, w, seed=1, missing=0.15):
    rng = np.random.default_rng(seed)
    v = rng.normal(20, 5, (h, w))
    v[rng.random((h, w)) < missing] = np.nan
    return v


def test_tiles_are_written_whole(spark):
    v = field(70, 90)
    scratch = Scratch(spark, "t")
    folder = scratch.path("tiles")
    out = geotiff.write_tiles(made(spark, "a", v, 500_000.0, 4_400_000.0, 20), folder, scratch, tile=32, kind="f8", inner=16)
    assert out.count() == 9 and out.agg(F.sum("values")).first()[0] == (~np.isnan(v)).sum()
    back = blocks.joined(geotiff.blocks(spark, folder), F.lit("a"), 25)
    assert np.array_equal(array(back, blocks.Grid(0, 0, 1, 1, 90, 70)), v, equal_nan=True)


def test_shifted_scenes_meet_on_the_first_ones_lattice(spark):
    """Frames shifted by two pixels east see the same ground: columns must be those of the ground."""
    ground = 100.0 + np.arange(10)
    a, b = np.tile(ground[:8], (8, 1)), np.tile(ground[2:], (6, 1))
    both = made(spark, "a", a, 400_000.0, 4_300_000.0, 5).unionByName(made(spark, "b", b, 400_060.0, 4_300_000.0, 5))
    grid = blocks.common_grid(both)
    assert (grid.x0, grid.y0, grid.width, grid.height) == (400_000.0, 4_300_000.0, 10, 8)
    got = array(blocks.composite(blocks.aligned(both, grid, 4), grid, 4), grid)
    assert np.array_equal(got[:6], np.tile(ground, (6, 1))) and np.isnan(got[6:, 8:]).all() and np.array_equal(got[6:, :8], np.tile(ground[:8], (2, 1)))


@pytest.mark.parametrize("how", ["median", "mean", "last"])
def test_composites_by_hand(spark, how):
    scenes = [(field(23 + i, 31 - i, i, 0.4), 30.0 * (i * 3) + 7 * i, 30.0 * i - 4 * i) for i in range(4)]
    df = None
    for i, (v, x, y) in enumerate(scenes):
        one = made(spark, f"s{i}", v, 500_000.0 + x, 4_400_000.0 - y, 8)
        df = one if df is None else df.unionByName(one)
    grid = blocks.common_grid(df)
    got = array(blocks.composite(blocks.aligned(df, grid, 9), grid, 9, how), grid)
    for r in range(grid.height):
        for c in range(grid.width):
            seen = []
            for v, x, y in scenes:
                rr = math.floor(((4_400_000.0 - y) - (grid.y0 - (r + 0.5) * 30)) / 30)
                cc = math.floor((grid.x0 + (c + 0.5) * 30 - 500_000.0 - x) / 30)
                if 0 <= rr < v.shape[0] and 0 <= cc < v.shape[1] and not math.isnan(v[rr, cc]):
                    seen.append(v[rr, cc])
            want = (float(np.median(seen)) if how == "median" else float(np.mean(seen)) if how == "mean" else seen[-1]) if seen else math.nan
            assert got[r, c] == pytest.approx(want, nan_ok=True)


def test_a_grid_covers_only_the_box(spark):
    """A scene far wider than the city: the grid is the city's and the margin's, on the scene's lattice."""
    wide = made(spark, "a", np.full((4, 5), 1.0), 440_000.0, 4_250_000.0, 4, d=30.0 * 480)
    box = (26.95, 38.05, 27.05, 38.12)
    grid = blocks.common_grid(wide.withColumns({"dx": F.lit(30.0), "dy": F.lit(30.0)}), box, margin=300.0)
    assert grid.width < 500 and grid.height < 500 and (grid.x0 - 440_000.0) % 30 == 0 and (4_250_000.0 - grid.y0) % 30 == 0
    left, bottom, right, top = blocks._bounds((grid.x0, grid.y0 - 30 * grid.height, grid.x0 + 30 * grid.width, grid.y0), 32635, 4326)
    assert left < box[0] and bottom < box[1] and right > box[2] and top > box[3]
    assert blocks.common_grid(wide, (10.0, 10.0, 10.1, 10.1)) is None
    assert blocks.common_grid(wide.limit(0)) is None


def snyder(lon, lat, zone):
    """Transverse Mercator by powers of the longitude's difference, not by the library's series."""
    a, e2, k0 = 6378137.0, 0.00669437999014, 0.9996
    ep = e2 / (1 - e2)
    phi, dl = math.radians(lat), math.radians(lon - (zone * 6 - 183))
    n = a / math.sqrt(1 - e2 * math.sin(phi) ** 2)
    t, c, x = math.tan(phi) ** 2, ep * math.cos(phi) ** 2, dl * math.cos(phi)
    m = a * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * math.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * math.sin(4 * phi)
        - 35 * e2**3 / 3072 * math.sin(6 * phi)
    )
    east = k0 * n * (x + (1 - t + c) * x**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * x**5 / 120)
    north = k0 * (m + n * math.tan(phi) * (x * x / 2 + (5 - t + 9 * c + 4 * c * c) * x**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * x**6 / 720))
    return 500_000.0 + east, north


def test_projection_against_another_formula():
    for lon, lat in [(29.9, 40.1), (30.0, 38.0), (27.3, 36.2), (33.0, 41.9), (31.5, 0.0)]:
        for zone in (35, 36):
            got = blocks.project(np.array([lon]), np.array([lat]), 4326, 32600 + zone)
            want = snyder(lon, lat, zone)
            assert got[0][0] == pytest.approx(want[0], abs=0.05) and got[1][0] == pytest.approx(want[1], abs=0.05)
            back = blocks.project(*got, 32600 + zone, 4326)
            assert back[0][0] == pytest.approx(lon, abs=1e-8) and back[1][0] == pytest.approx(lat, abs=1e-8)
    south = blocks.project(np.array([30.0]), np.array([-10.0]), 4326, 32735)
    assert south[1][0] == pytest.approx(10_000_000 - snyder(30.0, 10.0, 35)[1], abs=0.05)
    with pytest.raises(ValueError):
        blocks.project(np.array([1.0]), np.array([1.0]), 4326, 3857)


@pytest.mark.parametrize("size", [7, 16, 100])
def test_warp_against_a_plain_loop(spark, size):
    """From zone 36 to zone 35 pixel by pixel: the same pixels whatever the blocks, the pixel's size kept."""
    v = field(33, 29, 3)
    x0, y0 = 244_000.0, 4_430_000.0
    df = made(spark, "b", v, x0, y0, size, epsg=32636)
    grid = blocks.common_grid(df, epsg=32635)
    assert (grid.dx, grid.dy) == (30.0, 30.0) and grid.x0 % 30 == 0
    got = array(blocks.composite(blocks.warped(df, grid, 11), grid, 11, "last"), grid)
    seen = 0
    for r in range(grid.height):
        for c in range(grid.width):
            lon, lat = blocks.project(np.array([grid.x0 + (c + 0.5) * 30]), np.array([grid.y0 - (r + 0.5) * 30]), 32635, 4326)
            e, n = snyder(lon[0], lat[0], 36)
            fr, fc = (y0 - n) / 30, (e - x0) / 30
            if min(fr % 1, 1 - fr % 1, fc % 1, 1 - fc % 1) < 0.01:
                continue  # the other formula is good to some centimetres
            want = math.nan
            if 0 <= fr < v.shape[0] and 0 <= fc < v.shape[1]:
                t = w = 0.0
                for i in (math.floor(fr - 0.5), math.floor(fr - 0.5) + 1):
                    for j in (math.floor(fc - 0.5), math.floor(fc - 0.5) + 1):
                        if 0 <= i < v.shape[0] and 0 <= j < v.shape[1] and not math.isnan(v[i, j]):
                            k = (1 - abs(fr - 0.5 - i)) * (1 - abs(fc - 0.5 - j))
                            t, w = t + k * v[i, j], w + k
                want = t / w if w > 0.02 else None
            if want is not None:
                assert got[r, c] == pytest.approx(want, abs=0.3, nan_ok=True)
                seen += 1
    assert seen > 500


def test_a_constant_stays_constant_and_a_hole_stays_small(spark):
    v = np.full((40, 40), 25.5)
    v[10:14, 10:14] = np.nan
    df = made(spark, "b", v, 244_000.0, 4_430_000.0, 13, epsg=32636)
    grid = blocks.common_grid(df, epsg=32635)
    got = array(blocks.composite(blocks.warped(df, grid), grid, how="last"), grid)
    inside = got[~np.isnan(got)]
    assert np.allclose(inside, 25.5) and 1500 < len(inside) < 1600
    same = blocks.common_grid(df)
    assert np.array_equal(np.isnan(array(blocks.composite(blocks.warped(df, same), same, how="last"), same)), np.isnan(v))


@pytest.mark.parametrize("size", [4, 9, 64])
def test_window_median_across_blocks(spark, size):
    v = field(21, 26, 5, 0.45)
    got = array(blocks.window_median(made(spark, "m", v, 0.0, 0.0, size)), blocks.Grid(0, 0, 1, 1, 26, 21))
    for r in range(21):
        for c in range(26):
            around = v[max(0, r - 1) : r + 2, max(0, c - 1) : c + 2].ravel()
            around = around[~np.isnan(around)]
            ok = 0 < r < 20 and 0 < c < 25 and len(around) >= 5
            assert got[r, c] == pytest.approx(np.median(around) if ok else math.nan, nan_ok=True)


def test_empty_rasters(spark):
    none = made(spark, "a", np.full((2, 2), 1.0), 0.0, 0.0, 2).limit(0)
    grid = blocks.Grid(0.0, 0.0, 30.0, 30.0, 2, 2, 32635)
    for out in (blocks.composite(blocks.aligned(none, grid), grid), blocks.composite(blocks.warped(none, grid), grid), blocks.window_median(none), blocks.joined(none, F.lit("a"))):
        assert out.count() == 0
