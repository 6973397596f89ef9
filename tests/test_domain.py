"""Hand-computed cases of the domain's operators."""

import itertools
import json
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside import config
from kerbside.functions import ranking, scaling, text
from kerbside.operators import areas, index, jenks, montecarlo, quality, spatial, temporal
from kerbside.sources import readers, sinks
from kerbside.streaming.windows import windowed_summary


def column(df, name="r"):
    return [r[name] for r in df.collect()]


def test_scale_keeps_missing_and_clips(spark):
    df = spark.createDataFrame([(1, -5.0), (2, None), (3, 0.5), (4, 9.0)], "i int, x double")
    out = df.select("i", scaling.scale_between(F.col("x"), F.lit(0.0), F.lit(1.0)).alias("r")).orderBy("i")
    assert column(out) == [0.0, None, 0.5, 1.0]
    same = df.select("i", scaling.scale_between(F.col("x"), F.lit(3.0), F.lit(3.0)).alias("r")).orderBy("i")
    assert column(same) == [0.0, None, 0.0, 0.0]


def test_robust_bounds_ignore_an_outlier_and_fall_back(spark):
    long = spark.createDataFrame([(float(i),) for i in range(99)] + [(100000.0,)], "x double")
    lo, hi = scaling.robust_bounds(long, ["x"])["x"]
    assert (lo, hi) == pytest.approx(tuple(np.quantile([*range(99), 100000], [0.02, 0.98])))
    flat = spark.createDataFrame([(0.1,)] * 99 + [(0.3,)], "x double")
    assert scaling.robust_bounds(flat, ["x"])["x"] == (0.1, 0.3)


def test_combine_punishes_one_weak_group(spark):
    row = spark.range(1).select(scaling.combine([F.lit(1.0), F.lit(1.0), F.lit(0.0)]).alias("a"), scaling.combine([F.lit(1.0)] * 3).alias("b")).first()
    assert row["a"] == pytest.approx(100 * 0.05 ** (1 / 3)) and row["b"] == pytest.approx(100)


def test_right_closed_edges(spark):
    df = spark.createDataFrame([(-1.0,), (-0.5,), (1.0,), (3.0,), (3.1,), (-100.0,), (None,)], "x double")
    out = df.select(scaling.right_closed(F.col("x"), index.CHANGE_EDGES, index.CHANGES).alias("r"))
    a, b, c, d = index.CHANGES
    assert column(out) == [a, b, b, c, d, None, None]


def test_rank_pct_averages_ties(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 1.0), (4, None), (5, 9.0)], "i int, x double")
    assert column(ranking.rank_pct(df, "x", "r").orderBy("i")) == [0.625, 0.625, 0.25, None, 1.0]
    assert ranking.rank_pct(df.limit(0), "x", "r").count() == 0


def test_bucket5_uses_all_labels(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([*range(1, 19), 1000, 2000])], "i int, x double")
    got = column(ranking.rank_pct(df, "x", "p").select("i", ranking.bucket5(F.col("p")).alias("r")).orderBy("i"))
    assert got == [label for label in ranking.LEVELS for _ in range(4)]


@pytest.mark.parametrize("seed", range(4))
def test_jenks_is_optimal(seed):
    v = np.unique(np.random.default_rng(seed).integers(0, 60, 14)).astype(float)
    n = np.random.default_rng(seed + 9).integers(1, 4, len(v))

    def cost(cuts):
        total = 0.0
        for lo, hi in itertools.pairwise([0, *cuts, len(v)]):
            m = np.average(v[lo:hi], weights=n[lo:hi])
            total += (n[lo:hi] * (v[lo:hi] - m) ** 2).sum()
        return total

    best = min(cost(c) for c in itertools.combinations(range(1, len(v)), 4))
    breaks = jenks.optimal_breaks(v, n, 5)
    assert breaks[0] == v[0] and breaks[-1] == v[-1]
    assert cost([int(np.searchsorted(v, x, side="right")) for x in breaks[1:-1]]) == pytest.approx(best)


def test_jenks_without_values(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert jenks.natural_breaks(df, "x") == []
    assert column(df.select(jenks.classify(F.col("x"), [], index.CATEGORIES).alias("r"))) == [None]


def test_crosstab_is_full(spark):
    rows = [(1, 1996, "Orta"), (1, 2000, "Kritik"), (2, 1996, "Orta"), (2, 2000, "Orta")]
    got = {r["before"]: r.asDict() for r in areas.crosstab(spark.createDataFrame(rows, "road_id int, year int, category string"), (1996, 2000)).collect()}
    assert len(got) == 5 and got["Orta"]["Kritik"] == 1 and got["Orta"]["Orta"] == 1 and got["Düşük"]["Düşük"] == 0


def test_asof_tolerance_is_inclusive_and_first_wins(spark):
    want = spark.createDataFrame([("a", "2020-07-01 08:40:00"), ("b", "2020-07-01 08:40:00"), ("c", "2020-07-01 08:40:00")], "s string, at string")
    seen = [("a", "2020-07-01 09:25:00", 1.0), ("b", "2020-07-01 09:25:01", 2.0), ("c", "2020-07-01 08:10:00", 3.0), ("c", "2020-07-01 09:10:00", 4.0)]
    seen = spark.createDataFrame(seen, "s string, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    out = temporal.nearest_observation(want.withColumn("at", F.col("at").cast("timestamp_ntz")), seen, "s", "at", "ts", "v")
    assert {r["s"]: r["v"] for r in out.collect()} == {"a": 1.0, "b": None, "c": 3.0}


def test_nearest_rings_match_brute_force(spark):
    rng = np.random.default_rng(3)
    a, b = rng.uniform(0, 1000, (40, 2)), rng.uniform(0, 1000, (30, 2))
    left = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(a)], "k int, x double, y double")
    right = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(b)], "t int, x double, y double")
    got = {r["k"]: (r["t"], r["d"]) for r in spatial.nearest(left, right, "k", "t", 5.0).collect()}
    d = np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])
    assert {k: t for k, (t, _) in got.items()} == dict(enumerate(d.argmin(1).tolist()))
    assert spatial.nearest(left, right.limit(0), "k", "t", 5.0).count() == 0
    holes = left.unionByName(spark.createDataFrame([(99, None, 1.0), (98, 5.0, None)], left.schema))
    blank = right.unionByName(spark.createDataFrame([(97, None, None)], right.schema))
    assert {r["k"]: r["t"] for r in spatial.nearest(holes, blank, "k", "t").collect()} == {k: t for k, (t, _) in got.items()}


def test_polygon_with_hole_and_smallest(spark):
    ring = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    polys = [(1, [ring(0.0, 0.0, 10.0, 10.0), ring(4.0, 4.0, 6.0, 6.0)]), (2, [ring(1.0, 1.0, 3.0, 3.0)])]
    polys = spark.createDataFrame(polys, "poly int, rings array<array<struct<x: double, y: double>>>")
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, 2.0, 2.0), (3, 8.0, 8.0), (4, 20.0, 2.0)], "k int, x double, y double")
    got = {r["k"]: r["poly"] for r in spatial.smallest_polygon(points, polys, "k", "poly", 4.0).collect()}
    assert got == {1: None, 2: 2, 3: 1, 4: None}
    frame = [(1, [ring(0.0, 0.0, 10.0, 10.0), ring(0.5, 0.5, 9.5, 9.5)]), (2, [ring(-1.0, -1.0, 5.0, 5.0)])]  # 19 of 100, and 36
    frame = spark.createDataFrame(frame, "poly int, rings array<array<struct<x: double, y: double>>>")
    edge = spark.createDataFrame([(1, 0.25, 0.25)], "k int, x double, y double")
    assert spatial.smallest_polygon(edge, frame, "k", "poly", 4.0).first()["poly"] == 1
    assert spatial.coverage(points, polys, "k", 4.0).first()[0] == 0.5


def test_utm_of_a_known_point(spark):
    e, n = spatial.to_utm(F.lit(27.0), F.lit(0.0), 35)
    row = spark.range(1).select(e.alias("e"), n.alias("n")).first()
    assert row["e"] == pytest.approx(500000.0) and row["n"] == pytest.approx(0.0, abs=1e-6)
    e, n = spatial.to_utm(F.lit(28.0), F.lit(38.0), 35)
    row = spark.range(1).select(e.alias("e"), n.alias("n")).first()
    assert 587000 < row["e"] < 588500 and 4206000 < row["n"] < 4207500


def test_text_functions(spark):
    row = spark.range(1).select(
        text.normalise_name(F.lit(" çiğli  mahallesi")).alias("a"),
        text.slugify(F.lit("Aşırı Kritik!")).alias("b"),
        text.escape_html(F.lit("<a & 'b'>")).alias("c"),
        text.hstore_value(F.lit('"k"=>"1","k"=>"2"'), "k").alias("d"),
        text.starting_age(F.lit("65-69")).alias("e"),
        text.normalise_name(F.lit(None).cast("string")).alias("f"),
    ).first()
    assert row.asDict() == {"a": "CIGLI", "b": "asiri-kritik", "c": "&lt;a &amp; &#x27;b&#x27;&gt;", "d": "1", "e": 65, "f": "NAN"}


def test_draws_repeat_and_start_with_the_published_index():
    a, b = montecarlo.draws(20, 1), montecarlo.draws(20, 1)
    assert a == b and a[0]["aggregation"] == "geometric" and a[0]["excluded"] is None
    assert all(abs(sum(r[f"g_{g}"] for g in index.GROUPS) - 1) < 1e-12 for r in a)


def test_digest_ignores_order(spark):
    df = spark.range(50).withColumn("x", F.col("id") * 2)
    assert sinks.table_digest(df) == sinks.table_digest(df.orderBy(F.desc("id")))
    assert sinks.table_digest(df) != sinks.table_digest(df.withColumn("x", F.col("x") + 1))


def test_stage_cache(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    path = f"file://{tmp_path}/stage"
    for parts, n in (({"a": 1}, 1), ({"a": 1}, 1), ({"a": 2}, 2)):
        assert sinks.cached_stage(spark, path, 1, parts, build).count() == 3 and len(calls) == n


def test_readers(spark, tmp_path):
    (tmp_path / "d.csv").write_text("ILCE;NUFUS;YASLI_ORAN;COCUK_ORAN\nÇeşme;10;0.1;NaN\n", encoding="utf-8")
    assert readers.districts(spark, str(tmp_path / "d.csv")).first().asDict() == {"key": "CESME", "population": 10, "elderly_share": 0.1, "child_share": None}
    (tmp_path / "o.psv").write_text("DATE|temperature|temperature_Quality_Code\n2020-07-01T08:00:00|30.5|1\n2020-07-01T09:00:00|99|L\n2020-07-01T10:00:00||1\n")
    assert [r["temperature"] for r in readers.observations(spark, str(tmp_path / "o.psv")).collect()] == [30.5]
    scene = lambda i, cloud: {"id": i, "bbox": [26, 38, 27, 39], "properties": {"datetime": "2020-07-05T08:00:00Z", "platform": "LANDSAT_8", "eo:cloud_cover": cloud}}
    (tmp_path / "s.json").write_text(json.dumps({"features": [scene("a", 5.0), scene("b", 20.0)]}))
    got = readers.scenes(spark, str(tmp_path / "s.json"), (26.5, 38.5, 28, 40), "2020-06-01", "2020-08-31", 20.0)
    assert [r["scene_id"] for r in got.collect()] == ["a"]
    (tmp_path / "g.asc").write_text("ncols 2\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 10\nNODATA_value -9999\n1 2\n-9999 4\n")
    px = {(r["row"], r["col"]): (r["x"], r["y"], r["value"]) for r in readers.ascii_grids(spark, str(tmp_path / "g.asc")).collect()}
    assert px[0, 0] == (5.0, 15.0, 1.0) and px[1, 0] == (5.0, 5.0, None)


def test_geojson_round_trip(spark, tmp_path):
    rings = [[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}]]
    df = spark.createDataFrame([(1, "a", rings)], "k int, name string, rings array<array<struct<x: double, y: double>>>")
    sinks.geojson_lines(df, "rings", "Polygon", ["k", "name"]).write.text(str(tmp_path / "g"))
    back = readers.features(spark, f"{tmp_path}/g/*.txt", "k int, name string").first()
    assert (back["k"], back["name"], back["kind"]) == (1, "a", "Polygon") and [tuple(p) for p in back["rings"][0]] == [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]


def test_compression_is_lossless_with_nulls(spark):
    df = spark.createDataFrame([(1, "a<br>b<br>a"), (2, ""), (3, None)], "k int, t string")
    back = {r["k"]: r["t"] for r in quality.expanded(*quality.compressed(df, "k", "t"), "k", "t").collect()}
    assert back == {1: "a<br>b<br>a", 2: ""}


def test_config_and_adapter():
    assert config.city({"city_id": "izmir", "name": "İzmir", "bbox": [26, 38, 28, 39]}).utm_zone == 35
    assert len(config.faults({"city_id": "İ", "bbox": [2, 1, 1, 0], "season": ["13-01", "08-31"]})) == 4
    good = types.SimpleNamespace(fetch_population_data=lambda c: 1, build_neighbourhood_layer=lambda a, b, c: 1)
    assert config.adapter_faults(good) == [] and len(config.adapter_faults(types.SimpleNamespace(fetch_population_data=lambda: 1))) == 2


def test_stream_matches_batch(spark, tmp_path):
    rows = [(f"2020-07-01 0{h}:30:00", s, float(h)) for h in range(1, 6) for s in ("a", "b")]
    df = spark.createDataFrame(rows, "ts string, s string, v double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windowed_summary(stream, "ts", "s", "v").writeStream.format("memory").queryName("w").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w").count() == 10
