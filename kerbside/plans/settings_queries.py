"""Queries over tables of settings, descriptions and written outputs that are read back."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside import config
from kerbside.plans import bindings as b
from kerbside.plans.index_queries import rounded
from kerbside.scratch import Scratch
from kerbside.sources import sinks


def _settings(spark: SparkSession, d: str) -> DataFrame:
    """Settings of one city for each customer, with every kind of fault."""
    k = F.col("c_custkey")
    city = F.when(k % 4 == 0, F.concat(F.lit("Bad "), k)).when(k % 10 == 9, "twin").otherwise(F.concat(F.lit("city_"), k))
    return b.table(spark, d, "customer").select(
        "c_custkey", city.alias("city_id"), F.when(k % 5 == 0, "  ").otherwise(F.col("c_name")).alias("name"),
        F.when(k % 7 == 0, 200.0).otherwise(26.0).alias("west"), F.lit(38.0).alias("south"), F.when(k % 11 != 0, 27.0).alias("east"), F.lit(39.0).alias("north"),
        F.when(k % 6 == 0, "13-01").alias("season_first"), F.lit(None).cast("string").alias("season_last"),
        F.when(k % 13 == 0, 101.0).alias("most_cloud"), F.when(k % 17 == 0, 0.0).otherwise(10.0).alias("buffer_m"),
    )


def city_settings(spark: SparkSession, d: str) -> DataFrame:
    return config.settings_faults(_settings(spark, d)).select("c_custkey", F.array_join("faults", "; ").alias("faults"))


def city_registry(spark: SparkSession, d: str) -> DataFrame:
    out = _settings(spark, d).filter("c_custkey % 3 = 0").select("city_id")
    return config.registry_table(_settings(spark, d), out)


def csv_resources(spark: SparkSession, d: str) -> DataFrame:
    """Package descriptions of suppliers: some no success, some without a CSV file."""
    k = F.col("s_suppkey")
    file = lambda kind, name: F.struct(kind.alias("format"), name.alias("url"))
    files = F.array(
        file(F.lit("JSON"), F.concat(F.lit("a/"), k)), file(F.when(k % 3 == 0, " csv ").otherwise("XLSX"), F.when(k % 9 != 0, F.concat(F.lit("b/"), k))),
        file(F.when(k % 2 == 0, "CSV").otherwise("ZIP"), F.concat(F.lit("c/"), k)),
    )
    text = F.when(k % 7 != 0, F.to_json(F.struct((k % 5 != 0).alias("success"), F.struct(files.alias("resources")).alias("result")))).otherwise("{no json")
    return config.csv_resources(b.table(spark, d, "supplier").select("s_suppkey", text.alias("package")), "package").drop("package")


def adapter_layer(spark: SparkSession, d: str) -> DataFrame:
    """The layer of an adapter that counts customers as people."""

    def build(people: DataFrame, districts: DataFrame, boundaries: DataFrame) -> DataFrame:
        named = boundaries.join(districts, F.col("n_regionkey") == F.col("r_regionkey"))
        return named.join(people, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_name", "r_name", "people")

    people = b.table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("people"))
    adapter = SimpleNamespace(fetch_population_data=lambda city: people, build_neighbourhood_layer=build)
    city = config.city({"city_id": "sample", "name": "Sample", "bbox": [26, 38, 27, 39]})
    return config.layer_of(adapter, city, b.table(spark, d, "region"), b.table(spark, d, "nation"))


def columns_described(spark: SparkSession, d: str) -> DataFrame:
    """Names of columns made of parts' kinds and sizes."""
    base = F.element_at(F.array(*map(F.lit, ("surface_", "ndvi_", "other_"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    names = b.table(spark, d, "part").select(F.col("p_partkey").alias("i"), F.concat(base, F.col("p_size") % 40 + 1990).alias("column"))
    return sinks.described(names, {"surface_{year}": ("Mean surface temperature", "C"), "ndvi_{year}": ("Greenness", "")})


def _roads(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return b.table(spark, d, "customer").select(k.alias("road_id"), (k % 50).cast("double").alias("q05"), (k % 50 + k % 7).cast("double").alias("q95"))


def snk_roads(spark: SparkSession, d: str) -> DataFrame:
    """Roads of the export set with their probabilities, read back."""
    root = Scratch(spark, "package").root
    roads = b.table(spark, d, "customer").select(F.col("c_custkey").alias("road_id"), F.col("c_name").alias("name"))
    sinks.package({"roads": sinks.with_probabilities(roads, _roads(spark, d).filter("road_id % 3 <> 0"))}, root)
    return spark.read.csv(f"{root}/roads", header=True, schema="road_id bigint, name string, q05 double, q95 double")


def snk_uncertainty(spark: SparkSession, d: str) -> DataFrame:
    """The output set of a Monte Carlo analysis, read back: rows and a sum of each table, and the summary."""
    root = Scratch(spark, "uncertainty").root
    k = F.col("s_suppkey")
    runs = b.table(spark, d, "supplier").select(k.alias("run"), (k % 100 / 100).alias("spearman"), (k % 10 / 10).alias("overlap"))
    areas = b.table(spark, d, "nation").select("n_name", (F.col("n_nationkey") * 1.5).alias("median_rank"))
    indices = b.table(spark, d, "region").select("r_name", (F.col("r_regionkey") / 8).alias("first_order"))
    sinks.uncertainty_outputs(_roads(spark, d), areas, runs, indices, root)
    held = {
        "roads": spark.read.parquet(f"{root}/roads").select(F.col("q95").alias("v")),
        "areas": spark.read.csv(f"{root}/areas", header=True, schema="n string, v double").select("v"),
        "runs": spark.read.csv(f"{root}/runs", header=True, schema="run bigint, v double, overlap double").select("v"),
        "indices": spark.read.csv(f"{root}/indices", header=True, schema="n string, v double").select("v"),
    }
    out = spark.read.schema("measure string, p50 double").json(f"{root}/summary.json", multiLine=True)
    out = out.select(F.col("measure").alias("part"), F.lit(5).cast("long").alias("n"), F.col("p50").alias("v"))
    for name, df in held.items():
        out = out.unionByName(df.agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.sum("v").alias("v")))
    return rounded(out, "v", digits=4)


def snk_digests(spark: SparkSession, d: str) -> DataFrame:
    """Digests in manifests of the same tables dealt otherwise, and with one value changed."""
    scratch, names = Scratch(spark, "digests"), ("customer", "nation", "part", "supplier")
    schema = ", ".join(f"{n}: struct<rows: bigint, mix: bigint, total: bigint>" for n in names)
    held = []
    for deal in (lambda df: df, lambda df: df.repartition(5), lambda df: df.withColumn(df.columns[1], F.when(F.col(df.columns[0]) != 1, F.col(df.columns[1])))):
        path = scratch.path("manifest.json")
        sinks.manifest(spark, path, "sample", [2020], 2020, {n: deal(b.table(spark, d, n)) for n in names})
        held.append(spark.read.schema(f"layers struct<{schema}>").json(path, multiLine=True).select("layers"))
    row = held[0].withColumnRenamed("layers", "one")
    for name, df in zip(("two", "three"), held[1:], strict=True):
        row = row.crossJoin(F.broadcast(df.withColumnRenamed("layers", name)))  # one row each
    out = F.array(*[F.struct(F.lit(n).alias("name"), *[F.col(f"{x}.{n}").alias(x) for x in ("one", "two", "three")]) for n in names])
    return row.select(F.explode(out).alias("t")).select("t.name", "t.one.rows", (F.col("t.one") == F.col("t.two")).alias("same"), (F.col("t.one") == F.col("t.three")).alias("edited_same"))


QUERIES = {f.__name__: f for f in (city_settings, city_registry, csv_resources, adapter_layer, columns_described, snk_roads, snk_uncertainty, snk_digests)}

_SETTINGS = """s AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'Bad ' || c_custkey WHEN c_custkey % 10 = 9 THEN 'twin' ELSE 'city_' || c_custkey END AS id FROM customer),
f AS (SELECT k, id, concat_ws('; ', CASE WHEN k % 4 = 0 THEN 'city_id: lower-case letters, digits and underscores' END,
  CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'city_id: repeated' END, CASE WHEN k % 5 = 0 THEN 'name: missing' END, CASE WHEN k % 11 = 0 THEN 'bbox: four numbers' END,
  CASE WHEN k % 11 <> 0 AND k % 7 = 0 THEN 'bbox: west < east and south < north' END, CASE WHEN k % 6 = 0 THEN 'season: 13-01 is no MM-DD' END,
  CASE WHEN k % 13 = 0 THEN 'most_cloud: 0 to 100' END, CASE WHEN k % 17 = 0 THEN 'buffer_m: above 0' END) AS faults FROM s)"""
_MIDDLE = "'{0}' AS part, CAST(5 AS BIGINT) AS n, round(round(quantile_cont({1}, 0.5), 4), 4) AS v"

SQL = {
    "city_settings": f"WITH {_SETTINGS} SELECT k AS c_custkey, faults FROM f",
    "city_registry": f"""WITH {_SETTINGS} SELECT count(*) AS cities, count(*) FILTER (faults = '') AS valid, count(*) FILTER (faults <> '') AS faulty,
  count(*) FILTER (id IN (SELECT id FROM f WHERE k % 3 = 0)) AS published FROM f""",
    "csv_resources": """WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0 THEN
  CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 9 <> 0 THEN 'b/' || s_suppkey WHEN s_suppkey % 2 = 0 THEN 'c/' || s_suppkey END END AS url FROM supplier)
SELECT k AS s_suppkey, url, CASE WHEN k % 7 = 0 OR k % 5 = 0 THEN 'the package description is no success' WHEN url IS NULL THEN 'the package has no CSV resource' END AS fault FROM s""",
    "adapter_layer": """SELECT n_name, r_name, people FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT c_nationkey, count(*) AS people FROM customer GROUP BY 1) ON n_nationkey = c_nationkey""",
    "columns_described": """SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN 'surface_' ELSE 'ndvi_' END || (p_size % 40 + 1990) AS "column",
  CASE p_partkey % 3 WHEN 0 THEN 'Mean surface temperature' ELSE 'Greenness' END AS description, CASE p_partkey % 3 WHEN 0 THEN 'C' ELSE '' END AS unit FROM part WHERE p_partkey % 3 < 2""",
    "snk_roads": """SELECT c_custkey AS road_id, c_name AS name, CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey % 50 AS DOUBLE) END AS q05,
  CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey % 50 + c_custkey % 7 AS DOUBLE) END AS q95 FROM customer""",
    "snk_uncertainty": f"""SELECT {_MIDDLE.format("spearman", "s_suppkey % 100 / 100")} FROM supplier UNION ALL SELECT {_MIDDLE.format("overlap", "s_suppkey % 10 / 10")} FROM supplier
UNION ALL SELECT {_MIDDLE.format("rank_band", "CAST(c_custkey % 7 AS DOUBLE)")} FROM customer UNION ALL SELECT 'roads', count(*), CAST(sum(c_custkey % 50 + c_custkey % 7) AS DOUBLE) FROM customer
UNION ALL SELECT 'areas', count(*), round(sum(n_nationkey * 1.5::DOUBLE), 4) FROM nation UNION ALL SELECT 'runs', count(*), round(sum(s_suppkey % 100 / 100), 4) FROM supplier
UNION ALL SELECT 'indices', count(*), round(sum(r_regionkey / 8), 4) FROM region""",
    "snk_digests": " UNION ALL ".join(f"SELECT '{n}' AS name, (SELECT count(*) FROM {n}) AS rows, true AS same, false AS edited_same" for n in ("customer", "nation", "part", "supplier")),
}
