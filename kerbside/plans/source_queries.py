"""Queries of sources and sinks: each writes a fixture made of the test tables, reads it back, and returns what it read."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside import config
from kerbside.functions import scaling, text
from kerbside.operators import areas, blocks, geometry
from kerbside.plans import bindings as b
from kerbside.plans.geometry_queries import _diamonds
from kerbside.plans.index_queries import rounded
from kerbside.plans.raster_queries import _PIXELS, _pixels
from kerbside.scratch import Scratch
from kerbside.sources import geotiff, osm, readers, sinks


def _folder(spark: SparkSession, name: str) -> str:
    return Scratch(spark, name).root


def src_districts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    raw = b.table(spark, d, "nation").select(
        F.concat(F.lit(" "), F.lower("n_name"), F.lit(" ")).alias("ILCE"), (k * 1000 + 7).alias("NUFUS"), (k / 100).alias("YASLI_ORAN"),
        F.when(k % 4 == 0, F.lit("NaN")).otherwise((k / 50).cast("string")).alias("COCUK_ORAN"),
    )
    path = f"{_folder(spark, 'districts')}/t"
    raw.write.option("sep", ";").option("header", True).csv(path)
    return rounded(readers.districts(spark, path), "elderly_share", "child_share")


def src_development(spark: SparkSession, d: str) -> DataFrame:
    score = F.when(F.col("s_suppkey") % 5 == 0, F.lit("yok")).otherwise(F.round("s_acctbal", 2).cast("string"))
    path = f"{_folder(spark, 'development')}/t"
    b.table(spark, d, "supplier").select(F.col("s_name").alias("ILCE"), score.alias("SKOR")).write.option("sep", ";").option("header", True).csv(path)
    return rounded(readers.development_scores(spark, path), "development_score", digits=2)


def src_observations(spark: SparkSession, d: str) -> DataFrame:
    e = b.table(spark, d, "events")
    code = F.when(F.col("event_id") % 5 == 0, "A1").when(F.col("event_id") % 7 == 0, None).otherwise("1")
    temperature = F.when(F.col("event_id") % 11 == 0, "x").otherwise(F.round("value", 3).cast("string"))
    path = f"{_folder(spark, 'observations')}/t"
    rows = e.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("DATE"), temperature.alias("temperature"), code.alias("temperature_Quality_Code"))
    rows.write.option("sep", "|").option("header", True).csv(path)
    return rounded(readers.observations(spark, path), "temperature", digits=3)


def src_stations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    path = f"{_folder(spark, 'stations')}/t"
    lat = F.when(k % 6 != 0, (k % 90 / 2).cast("string"))
    b.table(spark, d, "supplier").select("s_suppkey", "s_name", lat.alias("a"), (k % 180 / 4).alias("o"), "s_nationkey").write.option("header", True).csv(path)
    out = readers.stations(spark, path, ["id", "name", "lat", "lon"])
    inside = readers.in_box(F.col("lon"), F.col("lat"), (5.0, 2.0, 30.0, 40.0))
    return out.filter(inside).select(F.col("id").cast("long").alias("id"), "name", "lat", "lon")


def src_weather(spark: SparkSession, d: str) -> DataFrame:
    o = b.table(spark, d, "orders").filter(F.year("o_orderdate") == 1996)
    day = o.groupBy("o_orderpriority", F.to_date("o_orderdate").alias("day")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("v"))
    rows = F.array_sort(F.collect_list(F.struct(F.date_format("day", "yyyy-MM-dd").alias("d"), "v")))
    per = day.groupBy("o_orderpriority").agg(rows.alias("r"))
    grid = F.substring("o_orderpriority", 1, 1).cast("double")
    daily = F.struct(F.col("r.d").alias("time"), F.transform("r", lambda x: F.when(F.dayofmonth(F.to_date(x["d"])) != 13, x["v"])).alias("temperature_2m_mean"))
    path = f"{_folder(spark, 'weather')}/t"
    per.select(grid.alias("latitude"), (grid * 2).alias("longitude"), daily.alias("daily")).write.option("maxRecordsPerFile", 1).json(path)
    return readers.daily_weather(spark, path).select("latitude", "longitude", "day", "temperature")


def src_scenes(spark: SparkSession, d: str) -> DataFrame:
    rows = b.table(spark, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()  # 25 rows of a fixture
    platforms = ["LANDSAT-8", "LANDSAT_9", "LANDSAT_7"]
    found = [
        {
            "id": r["n_name"], "bbox": [r["n_nationkey"], 30 + r["n_nationkey"], r["n_nationkey"] + 4, 33 + r["n_nationkey"]],
            "properties": {"datetime": f"2020-{5 + r['n_nationkey'] % 5:02d}-11T08:40:00Z", "platform": platforms[r["n_nationkey"] % 3], "eo:cloud_cover": float(r["n_nationkey"])},
        }
        for r in rows
    ]
    path = f"{_folder(spark, 'scenes')}/items.json"
    sinks.write_text(spark, path, json.dumps({"features": found}))
    out = readers.scenes(spark, path, (6.0, 30.0, 20.0, 50.0), "2020-06-01", "2020-08-31", 18.0)
    return out.filter(config.in_season(F.to_date("day"), "06-01", "08-31")).select("scene_id", "day", "platform", "cloud")


def src_area_tables(spark: SparkSession, d: str) -> DataFrame:
    """Two cities whose tables have different columns in different order."""
    n = b.table(spark, d, "nation").select("n_nationkey", "n_regionkey").orderBy("n_nationkey").collect()  # 25 rows of a fixture
    root = _folder(spark, "areas")
    for city, names in (("one", ("Y", "KEY")), ("two", ("KEY", "X", "Y")), ("three", ("KEY", "X"))):
        rows = [r for r in n if r["n_nationkey"] % 3 == ("one", "two", "three").index(city)]
        cell = {"KEY": lambda r: r["n_nationkey"], "X": lambda r: r["n_nationkey"] * 10, "Y": lambda r: r["n_regionkey"] * 100}
        lines = [",".join(names), *[",".join(str(cell[c](r)) for c in names) for r in rows]]
        sinks.write_text(spark, f"{root}/{city}_areas.csv", "\n".join(lines) + "\n")
    out = readers.area_tables(spark, f"{root}/*.csv")
    return out.select("city", *[F.col(c).cast("long").alias(c.lower()) for c in ("KEY", "X", "Y")])


def _shapes(spark: SparkSession, d: str) -> DataFrame:
    n = b.table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    return _diamonds(spark, d).join(n, "n_nationkey").withColumn("kind", F.lit("Polygon"))


def _measured(df: DataFrame) -> DataFrame:
    return rounded(df.select("n_nationkey", "name", "kind", geometry.polygon_area(F.col("rings")).alias("area")), "area", digits=4)


def src_feature_lines(spark: SparkSession, d: str) -> DataFrame:
    path = f"{_folder(spark, 'lines')}/t"
    sinks.geojson_lines(_shapes(spark, d), "rings", "Polygon", ["n_nationkey", "name"]).write.text(path)
    return _measured(readers.features(spark, path, "n_nationkey bigint, name string"))


def src_feature_collection(spark: SparkSession, d: str) -> DataFrame:
    lines = sinks.geojson_lines(_shapes(spark, d), "rings", "Polygon", ["n_nationkey", "name"])
    whole = lines.agg(F.concat(F.lit('{"type": "FeatureCollection",\n "features": ['), F.array_join(F.collect_list("value"), ",\n"), F.lit("]}")))
    path = f"{_folder(spark, 'collection')}/all.geojson"
    sinks.write_text(spark, path, whole.first()[0])  # 25 shapes of a fixture
    return _measured(readers.features(spark, path, "n_nationkey bigint, name string"))


def src_layer(spark: SparkSession, d: str) -> DataFrame:
    path = f"{_folder(spark, 'layer')}/t"
    sinks.write_layer(_shapes(spark, d), path, 100.0)
    return _measured(readers.layer(spark, path, (100.0, 100.0, 500.0, 400.0), ["n_nationkey", "name"]))


def src_geopackage(spark: SparkSession, d: str) -> DataFrame:
    path = f"{_folder(spark, 'gpkg')}/all.gpkg"
    sinks.geopackage(spark, path, {"areas": _shapes(spark, d)})
    out = readers.geopackage(spark, path, "areas", "n_nationkey bigint, name string")
    return _measured(out.withColumn("kind", F.lit("Polygon")))


def _written_band(spark: SparkSession, d: str, column: Column, kind: str, nodata: float, name: str = "band", into: str | None = None, packing: str = "lzw") -> str:
    """The pixel table as tiles of one band of 50 columns, written by Spark's tasks: (0, 1000) at the left top, pixels 2 wide and 1 high."""
    rows = _pixels(spark, d).select("row", "col", column.cast("double").alias("value"))
    grid = blocks.Grid(0.0, 1000.0, 2.0, 1.0, 50, rows.agg(F.max("row")).first()[0] + 1)
    scratch = Scratch(spark, "band")
    folder = into or scratch.path("tiles")
    geotiff.write_tiles(blocks.packed(rows, grid, raster=F.lit(name), size=32), folder, scratch, tile=128, kind=kind, nodata=nodata, packing=packing, inner=16)
    return folder


def _place(x: str = "x", y: str = "y") -> list[Column]:
    """Row and column on the whole band of a place on it."""
    return [F.floor((1000.0 - F.col(y)) / 1.0).cast("int").alias("row"), F.floor(F.col(x) / 2.0).cast("int").alias("col")]


def src_geotiff_window(spark: SparkSession, d: str) -> DataFrame:
    path = _written_band(spark, d, F.col("value"), "f8", -9999.0)
    return geotiff.pixels(spark, path, (11.0, 900.0, 60.5, 997.0)).filter("value is not null").select(*_place(), "x", "y", "value")


def src_population_grid(spark: SparkSession, d: str) -> DataFrame:
    path = _written_band(spark, d, F.col("value"), "f4", -1.0, packing="deflate")
    out = geotiff.population_grid(spark, path, (20.0, 990.0, 40.0, 995.0), margin=2.0)
    return rounded(out.agg(F.count("value").alias("cells"), F.sum(F.round("value", 2)).alias("people")), "people", digits=2)


def src_night_composite(spark: SparkSession, d: str) -> DataFrame:
    root = f"{_folder(spark, 'night')}/tiles"
    for i in (1, 2):
        raw = F.when((F.col("row") + F.col("col")) % (i + 2) != 0, F.floor(F.col("nir") / i)).otherwise(0)
        _written_band(spark, d, raw, "u2", 0, name=f"c{i}", into=root, packing="none" if i == 1 else "lzw")
    out = geotiff.night_composite(spark, root)
    return rounded(out.filter("value is not null").select(*_place(), "value"), "value", digits=4)


def src_band_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of a band by their edges, from the headers alone: the comparisons are made when the scan is planned."""
    path = _written_band(spark, d, F.col("value"), "f4", -1.0)
    some = geotiff.blocks(spark, path, values=False).filter("right > 20 and left < 70 and bottom < 980 and top > 700")
    return some.select(*_place("left", "top"), "height", "width", "dx", "dy")


def src_ascii_grid(spark: SparkSession, d: str) -> DataFrame:
    rows = _pixels(spark, d).select("row", "col", "red").toPandas()  # one fixture file
    v = np.full((int(rows["row"].max()) + 1, 50), -1)
    v[rows["row"], rows["col"]] = rows["red"]
    head = f"ncols 50\nnrows {len(v)}\nxllcorner 0\nyllcorner 0\ncellsize 1\nNODATA_value -1\n"
    path = f"{_folder(spark, 'ascii')}/g.asc"
    sinks.write_text(spark, path, head + "\n".join(" ".join(map(str, r)) for r in v) + "\n")
    return readers.ascii_grids(spark, path).filter("value is not null").select("row", "col", F.col("value").cast("long").alias("value"))


def src_osm_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of nations in a map extract: three nodes and a way each; those that meet a box."""
    rows = b.table(spark, d, "nation").select("n_nationkey", "n_name").collect()  # 25 lines of a fixture
    found = []
    for k, name in sorted(tuple(r) for r in rows):
        places = [(k * 1.5, k * 2.0), (k * 1.5 + 3, k * 2.0), (k * 1.5 + 3, k * 2.0 + 4)]
        found += [("node", 10 * k + i + 1, x, y, {}, None, None, None) for i, (x, y) in enumerate(places)]
        found.append(("way", k + 1, None, None, {"highway": "primary" if k % 3 else "track", "name": name}, [10 * k + 1, 10 * k + 2, 10 * k + 3], None, None))
    path = f"{_folder(spark, 'osm')}/a.osm.pbf"
    sinks.write_bytes(spark, path, osm.encode(found))
    out = readers.of_types(osm.lines(osm.elements(spark, path), ["highway", "name"], (5.0, 5.0, 30.0, 40.0)), "highway", ["primary"])
    return rounded(out.select("id", "highway", "name", geometry.line_length(F.col("rings")[0]).alias("length")), "length")


def _extract(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as a map extract that Spark's tasks write: a tagged node each, and a rectangle of four nodes and a closed way."""
    k = F.col("s_suppkey")
    x, y = (k * 7 % 170).cast("double"), (k * 13 % 80).cast("double")
    wide, high = 1 + (k % 5).cast("double"), 1 + (k % 3).cast("double")
    tags = lambda *pairs: F.create_map(*[F.lit(v) if isinstance(v, str) else v for v in pairs])
    kinds = F.element_at(F.array(*map(F.lit, ("clinic", "bank", "hospital", "school"))), (k % 4 + 1).cast("int"))
    none = F.lit(None).cast("map<string,string>")
    no_refs, no_names = F.lit(None).cast("array<bigint>"), F.lit(None).cast("array<string>")
    element = lambda kind, number, lon, lat, own, refs: F.struct(
        F.lit(kind).alias("kind"), number.cast("long").alias("id"), lon.alias("lon"), lat.alias("lat"), own.alias("tags"), refs.alias("refs"), no_names.alias("roles"), no_names.alias("members")
    )
    corners = [(x, y), (x + wide, y), (x + wide, y + high), (x, y + high)]
    nodes = [element("node", 10 * k + i, a, c, F.coalesce(none, F.create_map().cast("map<string,string>")), no_refs) for i, (a, c) in enumerate(corners, 1)]
    ring = F.array(*[(10 * k + i).cast("long") for i in (1, 2, 3, 4, 1)])
    way = element("way", k, F.lit(None).cast("double"), F.lit(None).cast("double"), tags(F.when(k % 3 == 0, "landuse").otherwise("leisure"), "park", "name", F.col("s_name")), ring)
    tagged = element("node", 10 * k, x + 0.5, y + 0.25, tags("amenity", kinds, "name", F.col("s_name")), no_refs)
    rows = b.table(spark, d, "supplier").select(F.explode(F.array(tagged, *nodes, way)).alias("e")).select("e.*")
    folder = f"{_folder(spark, 'extracts')}/files"
    osm.write_extracts(rows.repartition(4, "id"), folder)
    return osm.elements(spark, folder)


def src_osm_points(spark: SparkSession, d: str) -> DataFrame:
    """Tagged nodes of some kinds in a box."""
    found = osm.points(_extract(spark, d), ["amenity", "name"], (20.0, 10.0, 120.0, 60.0))
    return rounded(found.filter(F.col("amenity").isin("clinic", "hospital")).select("id", "amenity", "name", "x", "y"), "x", "y")


def src_osm_polygons(spark: SparkSession, d: str) -> DataFrame:
    """Closed ways with one of two tags that meet a box, by their areas."""
    found = osm.polygons(_extract(spark, d), ["landuse", "leisure"], (20.0, 10.0, 120.0, 60.0))
    return rounded(found.select("id", "landuse", "leisure", geometry.polygon_area(F.col("rings")).alias("area")), "area")


def snk_publish(spark: SparkSession, d: str) -> DataFrame:
    """Published twice; the second is what is read, after a fault between the renames as well."""
    path = f"{_folder(spark, 'publish')}/t"
    n = b.table(spark, d, "nation").select("n_nationkey", "n_name")
    sinks.publish(n.filter("n_nationkey < 5"), path)
    sinks.publish(n.filter("n_nationkey >= 5"), path)
    p, store = sinks._fs(spark, path)
    store.rename(p, sinks._fs(spark, f"{path}.old")[0])
    sinks.recover(spark, path)
    return spark.read.parquet(path)


def snk_cached_stage(spark: SparkSession, d: str) -> DataFrame:
    """Built once, read the second time, built again for another fingerprint: how many times, and the rows."""
    path, built = f"{_folder(spark, 'cache')}/t", []

    def build() -> DataFrame:
        built.append(1)
        return b.table(spark, d, "nation").select("n_nationkey")

    for version in (1, 1, 2):
        out = sinks.cached_stage(spark, path, version, {"source": "nation"}, build)
    return out.agg(F.count("*").alias("n"), F.lit(len(built)).alias("built"))


def snk_map_layers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    c = b.table(spark, d, "customer").select(
        k.alias("road_id"), F.col("c_name").alias("name"), F.when(k % 5 != 0, F.lit("<a & b>")).alias("neighbourhood"), F.when(k % 7 != 0, k % 100 + 0.25).alias("percent"),
        (F.col("c_nationkey") % 2 + 2020).alias("year"), F.col("c_mktsegment").alias("category"),
    )
    path = f"{_folder(spark, 'map')}/t"
    sinks.map_layers(c, path)
    out = spark.read.json(path)
    return out.select("road_id", F.col("year").cast("int").alias("year"), "category", "percent_text", "area_text")


def snk_city_stats(spark: SparkSession, d: str) -> DataFrame:
    panel = b.yearly(spark, d).join(b.roads(spark, d).select("road_id", "neighbourhood"), "road_id").withColumn("percent", F.col("ndvi") * 1000)
    text_ = sinks.city_stats(panel, b.YEARS[0])
    return text_.select(F.from_json("value", "roads bigint, percent_mean double, lst_mean double, riskiest string").alias("v")).select("v.*")


def snk_package(spark: SparkSession, d: str) -> DataFrame:
    root = _folder(spark, "package")
    n = b.table(spark, d, "nation").select("n_nationkey", "n_name")
    u = n.filter("n_nationkey % 2 = 0").select("n_name", (F.col("n_nationkey") * 2).alias("median_rank"))
    sinks.package({"areas": sinks.with_uncertainty(n, u, ["n_name"]), "roads": sinks.with_probabilities(n, u, "n_name")}, root)
    out = spark.read.csv(f"{root}/areas", header=True, schema="n_name string, n_nationkey bigint, median_rank bigint")
    return out.select("n_nationkey", "n_name", "median_rank")


def tidy_columns(spark: SparkSession, d: str) -> DataFrame:
    s = b.table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("lst_mean_2020"), (F.col("s_acctbal") / 7).alias("percent"), (F.col("s_acctbal") / 3).alias("ndvi_mean"))
    names = {"s_suppkey": "key", "lst_mean_2020": "surface_2020", "ndvi_mean": "ndvi", "percent": "share", "absent": "absent"}
    return sinks.tidy(s, names, {"surface": 1, "ndvi": 3})


def column_descriptions(spark: SparkSession, d: str) -> DataFrame:
    known = {"surface_{year}": ("Mean surface temperature", "C"), "key": ("Number", "")}
    return sinks.column_dictionary(spark, ["key", "surface_2020", "surface_2026", "other", "key"], known)


def snk_manifest(spark: SparkSession, d: str) -> DataFrame:
    path = f"{_folder(spark, 'manifest')}/m.json"
    n = b.table(spark, d, "nation")
    sinks.manifest(spark, path, "sample", [2026, 2020], 2026, {"nation": n, "region": b.table(spark, d, "region")})
    schema = "city string, default_year int, years array<int>, layers struct<nation: struct<rows: bigint>, region: struct<rows: bigint>>"
    m = spark.read.schema(schema).json(path, multiLine=True)
    return m.select("city", "default_year", F.array_join(F.col("years").cast("array<string>"), ",").alias("years"), F.col("layers.nation.rows").alias("nations"), F.col("layers.region.rows").alias("regions"))


def five_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return sinks.five_quantiles(b.table(spark, d, "orders"), "o_totalprice")


def composite_name_join(spark: SparkSession, d: str) -> DataFrame:
    n = b.table(spark, d, "nation").join(b.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    ours = n.select("n_nationkey", F.lower("n_name").alias("name"), F.concat(F.lit(" "), "r_name").alias("district"))
    theirs = n.filter("n_nationkey % 3 <> 0").select(F.concat("n_name", F.lit(" mahallesi")).alias("a"), F.lower("r_name").alias("b"), (F.col("n_nationkey") * 11).alias("people"))
    return areas.joined_by_names(ours, theirs, [("name", "a"), ("district", "b")], ["people"]).select("n_nationkey", "people")


def coerced_scale(spark: SparkSession, d: str) -> DataFrame:
    s = b.table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 6 == 0, "yok").otherwise(F.round("s_acctbal", 2).cast("string")).alias("v"), F.when(F.col("s_suppkey") % 2 == 0, 4.0).alias("same"))
    out = scaling.coerced_scale(scaling.coerced_scale(scaling.coerced_scale(s, "v", "own"), "v", "given", 0.0, 5000.0), "same", "flat")
    return rounded(out.select("s_suppkey", "own", "given", "flat"), "own", "given", "flat")


def without_constants(spark: SparkSession, d: str) -> DataFrame:
    n = b.table(spark, d, "nation").select("n_nationkey", "n_regionkey", F.lit(1).alias("one"), F.when(F.col("n_nationkey") == 3, 5).alias("rare"))
    left = scaling.without_constants(n, keep=["n_nationkey"])
    return spark.createDataFrame([(c,) for c in left.columns], "column string")


def tag_filters(spark: SparkSession, d: str) -> DataFrame:
    """Road types, green areas and administrative levels, counted."""
    k = F.col("p_partkey")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % len(v) + 1).cast("int"))
    p = b.table(spark, d, "part").select(
        "p_partkey", F.when(k % 13 != 0, pick("primary", "residential", "footway")).alias("highway"), F.when(k % 3 == 0, pick("park", "pitch", "garden")).alias("leisure"),
        pick("forest", "industrial", "meadow", "retail", "farm").alias("landuse"), pick("4", "6", "8").alias("admin_level"), F.when(k % 4 != 0, "administrative").alias("boundary"),
    )
    roads = readers.of_types(p, "highway", ["primary", "residential"]).agg(F.lit("roads").alias("what"), F.count("*").alias("n"))
    green = p.filter(readers.is_green(F.col("leisure"), F.col("landuse"))).agg(F.lit("green").alias("what"), F.count("*").alias("n"))
    return roads.unionByName(green).unionByName(readers.administrative(p, "6").agg(F.lit("districts").alias("what"), F.count("*").alias("n")))


def formatted_texts(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("s_suppkey") % 4 != 0, F.col("s_suppkey") % 97 + 0.25)
    url = F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("https://example.org/europe/turkey/"), F.lower("s_name"), F.lit("-latest.osm.pbf"))).otherwise(F.lit("https://example.org/none"))
    return b.table(spark, d, "supplier").select(
        "s_suppkey", text.percent_text(v).alias("percent"), text.degrees_text(v).alias("degrees"), text.metres_text(v * 1000).alias("metres"),
        text.or_unknown(F.when(F.col("s_suppkey") % 5 != 0, F.col("s_name"))).alias("label"), text.region_of(url).alias("region"),
    )


def dense_core(spark: SparkSession, d: str) -> DataFrame:
    n = b.table(spark, d, "nation").select(F.col("n_nationkey").alias("area"), (F.col("n_nationkey") * 7 % 11).cast("double").alias("size"))
    few = areas.dense_core(n, "size", 0.5).withColumn("rule", F.lit("fallback"))
    return areas.dense_core(n, "size", 5.0).withColumn("rule", F.lit("dense")).unionByName(few)


def registry_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = b.table(spark, d, "nation").select("n_nationkey", "n_name").collect()  # 25 settings of a fixture
    cities = {r["n_name"]: {"city_id": r["n_name"].lower().replace(" ", "_") if r["n_nationkey"] % 4 else "Bad Id", "name": r["n_name"], "bbox": [26.0, 38.0, 27.0, 39.0]} for r in rows}
    found = config.registry(cities, {r["n_name"]: 1 for r in rows if r["n_nationkey"] % 2 == 0})
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{k} bigint" for k in found))


QUERIES = {
    f.__name__: f
    for f in (
        src_districts, src_development, src_observations, src_stations, src_weather, src_scenes, src_area_tables, src_feature_lines, src_feature_collection,
        src_layer, src_geopackage, src_geotiff_window, src_population_grid, src_night_composite, src_band_blocks, src_ascii_grid, src_osm_lines, src_osm_points, src_osm_polygons, snk_publish, snk_cached_stage, snk_map_layers,
        snk_city_stats, snk_package, tidy_columns, column_descriptions, snk_manifest, five_quantiles, composite_name_join, coerced_scale, without_constants,
        tag_filters, formatted_texts, dense_core, registry_counts,
    )
}

_AREA_SQL = "round(2.0::DOUBLE * (40.25 + n_nationkey * 3) * (40.25 + n_nationkey * 3), 4)"
_MEASURED = f"SELECT n_nationkey, n_name AS name, 'Polygon' AS kind, {_AREA_SQL} AS area FROM nation"

SQL = {
    "src_districts": """SELECT upper(n_name) AS key, CAST(n_nationkey * 1000 + 7 AS BIGINT) AS population, round(n_nationkey / 100, 6) AS elderly_share,
  CASE WHEN n_nationkey % 4 <> 0 THEN round(n_nationkey / 50, 6) END AS child_share FROM nation""",
    "src_development": "SELECT upper(s_name) AS key, CASE WHEN s_suppkey % 5 <> 0 THEN round(s_acctbal, 2) END AS development_score FROM supplier",
    "src_observations": """SELECT CAST(date_trunc('second', ts) AS TIMESTAMP) AS ts, round(value, 3) AS temperature FROM events
  WHERE event_id % 5 <> 0 AND event_id % 11 <> 0 AND value IS NOT NULL AND ts IS NOT NULL""",
    "src_stations": """SELECT s_suppkey AS id, s_name AS name, CAST(s_suppkey % 90 / 2 AS DOUBLE) AS lat, CAST(s_suppkey % 180 / 4 AS DOUBLE) AS lon FROM supplier
  WHERE s_suppkey % 6 <> 0 AND s_suppkey % 90 / 2 BETWEEN 2 AND 40 AND s_suppkey % 180 / 4 BETWEEN 5 AND 30""",
    "src_weather": """SELECT CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS latitude, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) * 2 AS longitude, CAST(o_orderdate AS DATE) AS day,
  CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS temperature FROM orders WHERE year(o_orderdate) = 1996 AND day(o_orderdate) <> 13 GROUP BY o_orderpriority, 3""",
    "src_scenes": """SELECT n_name AS scene_id, '2020-' || lpad(CAST(5 + n_nationkey % 5 AS VARCHAR), 2, '0') || '-11' AS day, CASE n_nationkey % 3 WHEN 0 THEN 'LANDSAT_8' ELSE 'LANDSAT_9' END AS platform,
  CAST(n_nationkey AS DOUBLE) AS cloud FROM nation WHERE n_nationkey % 3 < 2 AND n_nationkey % 5 BETWEEN 1 AND 3 AND n_nationkey < 18 AND n_nationkey <= 20 AND n_nationkey + 4 >= 6 AND 30 + n_nationkey <= 50""",
    "src_area_tables": """SELECT CASE n_nationkey % 3 WHEN 0 THEN 'one' WHEN 1 THEN 'two' ELSE 'three' END AS city, CAST(n_nationkey AS BIGINT) AS key,
  CASE WHEN n_nationkey % 3 > 0 THEN CAST(n_nationkey * 10 AS BIGINT) END AS x, CASE WHEN n_nationkey % 3 < 2 THEN CAST(n_regionkey * 100 AS BIGINT) END AS y FROM nation""",
    "src_feature_lines": _MEASURED,
    "src_feature_collection": _MEASURED,
    "src_geopackage": _MEASURED,
    "src_layer": f"""SELECT n_nationkey, n_name AS name, 'Polygon' AS kind, {_AREA_SQL} AS area FROM (SELECT *, n_nationkey * 67 % 900 AS cx, n_nationkey * 113 % 900 AS cy, 40.25 + n_nationkey * 3 AS r FROM nation)
  WHERE cx - r <= 500 AND cx + r >= 100 AND cy - r <= 400 AND cy + r >= 100""",
    "src_geotiff_window": f"""WITH {_PIXELS} SELECT row, col, col * 2.0::DOUBLE + 1 AS x, 1000.0::DOUBLE - row - 0.5::DOUBLE AS y, value FROM px WHERE col BETWEEN 5 AND 30 AND row BETWEEN 3 AND 99""",
    "src_population_grid": f"WITH {_PIXELS} SELECT count(*) AS cells, round(sum(round(CAST(CAST(value AS FLOAT) AS DOUBLE), 2)), 2) AS people FROM px WHERE col BETWEEN 9 AND 20 AND row BETWEEN 3 AND 11",
    "src_night_composite": f"""WITH {_PIXELS}, v AS (SELECT row, col, CASE WHEN (row + col) % (i + 2) <> 0 THEN nir // i * 0.02::DOUBLE - 273.15::DOUBLE END AS v FROM px, range(1, 3) t(i))
SELECT row, col, round(avg(v), 4) AS value FROM v GROUP BY 1, 2 HAVING count(v) > 0""",
    "src_band_blocks": f"""WITH {_PIXELS}, n AS (SELECT max(row) + 1 AS h FROM px), b AS (SELECT CAST(i * 16 AS INT) AS row, CAST(j * 16 AS INT) AS col, h FROM n, range(0, 4) c(j), range(0, 100000) r(i) WHERE i * 16 < h)
SELECT row, col, CAST(least(16, h - row) AS INT) AS height, CAST(least(16, 50 - col) AS INT) AS width, 2.0::DOUBLE AS dx, 1.0::DOUBLE AS dy FROM b
WHERE 2 * least(col + 16, 50) > 20 AND 2 * col < 70 AND 1000 - least(row + 16, h) < 980 AND 1000 - row > 700""",
    "src_ascii_grid": f"WITH {_PIXELS} SELECT row, col, CAST(red AS BIGINT) AS value FROM px",
    "src_osm_lines": """SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, 'primary' AS highway, n_name AS name, CAST(7.0 AS DOUBLE) AS length FROM nation
  WHERE n_nationkey % 3 <> 0 AND n_nationkey * 1.5 <= 30 AND n_nationkey * 1.5 + 3 >= 5 AND n_nationkey * 2 <= 40 AND n_nationkey * 2 + 4 >= 5""",
    "src_osm_points": """WITH s AS (SELECT s_suppkey AS k, s_name, ['clinic', 'bank', 'hospital', 'school'][s_suppkey % 4 + 1] AS amenity, s_suppkey * 7 % 170 + 0.5::DOUBLE AS x, s_suppkey * 13 % 80 + 0.25::DOUBLE AS y FROM supplier)
SELECT CAST(10 * k AS BIGINT) AS id, amenity, s_name AS name, x, y FROM s WHERE amenity IN ('clinic', 'hospital') AND x BETWEEN 20 AND 120 AND y BETWEEN 10 AND 60""",
    "src_osm_polygons": """WITH s AS (SELECT s_suppkey AS k, s_suppkey * 7 % 170 AS x, s_suppkey * 13 % 80 AS y, 1 + s_suppkey % 5 AS w, 1 + s_suppkey % 3 AS h FROM supplier)
SELECT CAST(k AS BIGINT) AS id, CASE WHEN k % 3 = 0 THEN 'park' END AS landuse, CASE WHEN k % 3 <> 0 THEN 'park' END AS leisure, CAST(w * h AS DOUBLE) AS area FROM s WHERE x <= 120 AND x + w >= 20 AND y <= 60 AND y + h >= 10""",
    "snk_publish": "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey >= 5",
    "snk_cached_stage": "SELECT count(*) AS n, 2 AS built FROM nation",
    "snk_map_layers": """SELECT c_custkey AS road_id, CAST(c_nationkey % 2 + 2020 AS INT) AS year, c_mktsegment AS category,
  CASE WHEN c_custkey % 7 <> 0 THEN '%' || CAST(c_custkey % 100 AS VARCHAR) ELSE 'Veri yok' END AS percent_text, CASE WHEN c_custkey % 5 <> 0 THEN '&lt;a &amp; b&gt;' ELSE 'Bilinmiyor' END AS area_text FROM customer""",
    "snk_city_stats": f"""WITH {b.YEARLY_SQL.strip()},{b.ROADS_SQL}, p AS (SELECT road_id, neighbourhood, ndvi * 1000 AS percent, lst FROM yearly JOIN roads USING (road_id) WHERE year = {b.YEARS[0]}),
m AS (SELECT neighbourhood, avg(percent) AS mean FROM p GROUP BY 1)
SELECT count(*) AS roads, round(avg(percent), 1) AS percent_mean, round(avg(lst), 1) AS lst_mean, (SELECT arg_max(neighbourhood, (mean, neighbourhood)) FROM m) AS riskiest FROM p""",
    "snk_package": "SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey * 2 AS BIGINT) END AS median_rank FROM nation",
    "tidy_columns": "SELECT s_suppkey AS key, round_even(s_acctbal, 1) AS surface_2020, round_even(s_acctbal / 3, 3) AS ndvi, round_even(s_acctbal / 7, 1) AS share FROM supplier",
    "column_descriptions": """SELECT * FROM (VALUES ('key', 'Number', ''), ('surface_2020', 'Mean surface temperature', 'C'), ('surface_2026', 'Mean surface temperature', 'C')) t("column", description, unit)""",
    "snk_manifest": "SELECT 'sample' AS city, 2026 AS default_year, '2020,2026' AS years, (SELECT count(*) FROM nation) AS nations, (SELECT count(*) FROM region) AS regions",
    "five_quantiles": "SELECT " + ", ".join(f"round(quantile_cont(o_totalprice, {q}), 4) AS p{int(q * 100):02d}" for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM orders",
    "composite_name_join": "SELECT n_nationkey, CASE WHEN n_nationkey % 3 <> 0 THEN CAST(n_nationkey * 11 AS BIGINT) END AS people FROM nation",
    "coerced_scale": """WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 6 <> 0 THEN round(s_acctbal, 2) END AS v FROM supplier), e AS (SELECT min(v) AS lo, max(v) AS hi FROM s)
SELECT s_suppkey, CASE WHEN lo = hi THEN 0.0 ELSE round((v - lo) / (hi - lo), 6) END AS own, CASE WHEN v IS NOT NULL THEN round(greatest(0.0, least(1.0, v / 5000.0)), 6) END AS given, CAST(0.0 AS DOUBLE) AS flat FROM s, e""",
    "without_constants": """SELECT * FROM (VALUES ('n_nationkey'), ('n_regionkey')) t("column")""",
    "tag_filters": """WITH p AS (SELECT p_partkey AS k FROM part)
SELECT 'roads' AS what, count(*) AS n FROM p WHERE k % 13 <> 0 AND k % 3 < 2 UNION ALL
SELECT 'green', count(*) FROM p WHERE k % 3 = 0 OR k % 5 IN (0, 2) UNION ALL
SELECT 'districts', count(*) FROM p WHERE k % 3 = 1 AND k % 4 <> 0""",
    "formatted_texts": """WITH s AS (SELECT *, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 97 + 0.25 END AS v FROM supplier)
SELECT s_suppkey, coalesce('%' || CAST(CAST(s_suppkey % 97 AS INT) + CAST(v * 0 AS INT) AS VARCHAR), 'Veri yok') AS percent,
  CASE WHEN v IS NULL THEN 'Veri yok' ELSE CAST(s_suppkey % 97 AS VARCHAR) || '.2°C' END AS degrees,
  CASE WHEN v IS NULL THEN 'OSM verisi yok' ELSE format('{:,}', CAST(s_suppkey % 97 * 1000 + 250 AS BIGINT)) || ' m' END AS metres,
  CASE WHEN s_suppkey % 5 <> 0 THEN s_name ELSE 'Bilinmiyor' END AS label, CASE WHEN s_suppkey % 3 <> 0 THEN lower(s_name) ELSE '' END AS region FROM s""",
    "dense_core": """WITH n AS (SELECT n_nationkey AS area, CAST(n_nationkey * 7 % 11 AS DOUBLE) AS size FROM nation)
SELECT area, size, 'dense' AS rule FROM n WHERE size < 5 UNION ALL (SELECT area, size, 'fallback' AS rule FROM n ORDER BY size, area LIMIT 8)""",
    "registry_counts": "SELECT count(*) AS cities, count(*) FILTER (n_nationkey % 4 <> 0) AS valid, count(*) FILTER (n_nationkey % 4 = 0) AS faulty, count(*) FILTER (n_nationkey % 2 = 0) AS published FROM nation",
}
