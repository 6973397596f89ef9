"""Queries of strings, JSON, names and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.functions import text
from kerbside.operators import areas, quality
from kerbside.plans import bindings as b
from kerbside.plans.index_queries import rounded


def normalised_name_join(spark: SparkSession, d: str) -> DataFrame:
    n = b.table(spark, d, "nation").withColumn("name", F.concat(F.lit("  "), F.lower("n_name"), F.lit("  mahallesi")))
    r = b.table(spark, d, "nation").select(text.normalise_name(F.col("n_name")).alias("key"), F.col("n_regionkey").alias("region"))
    left = n.select("n_nationkey", text.normalise_name(F.col("name")).alias("key"))
    return left.join(r, "key", "left").select("n_nationkey", "key", "region")


def missing_keys(spark: SparkSession, d: str) -> DataFrame:
    ours = b.table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return quality.missing_keys(ours, b.table(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k")


def shared_keys(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "customer").select(F.col("c_custkey").alias("k")).intersect(b.table(spark, d, "part").select(F.col("p_partkey").alias("k")))


def alias_single_centre(spark: SparkSession, d: str) -> DataFrame:
    n = b.table(spark, d, "nation")
    ours = n.select(F.when(F.col("n_nationkey") == 3, "MERKEZ").otherwise(F.upper("n_name")).alias("key"))
    theirs = n.select(F.when(F.col("n_nationkey") == 3, "IL MERKEZ").otherwise(F.upper("n_name")).alias("key"))
    return quality.centre_aliases(ours, theirs, "key")


def hstore_tags(spark: SparkSession, d: str) -> DataFrame:
    e = b.table(spark, d, "events")
    tags = F.concat(F.lit('"kind"=>"'), F.col("event_type"), F.lit('","user"=>"'), F.col("user_id").cast("string"), F.lit('"'))
    return e.select(
        "event_id", text.hstore_value(tags, "kind").alias("kind"), text.hstore_value(tags, "user").alias("who"), text.hstore_value(tags, "none").alias("none")
    )


def json_props(spark: SparkSession, d: str) -> DataFrame:
    p = F.from_json("props", "struct<k: bigint>")
    return b.table(spark, d, "events").select("event_id", p["k"].alias("k"))


def slug(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "part").select("p_partkey", text.slugify(F.concat(F.lit("Çok Özel: "), "p_name", F.lit(" / "), "p_type")).alias("slug"))


def html_escape(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("<a href=\"x\">'"), F.col("p_name"), F.lit("' & co</a>"))
    return b.table(spark, d, "part").select("p_partkey", text.escape_html(F.when(F.col("p_partkey") % 5 != 0, raw)).alias("escaped"))


def _explained(spark: SparkSession, d: str) -> DataFrame:
    size = F.when(F.col("p_size") <= 10, "çok yakın").when(F.col("p_size") <= 30, "orta").otherwise("uzak")
    metres = text.metres_text(F.when(F.col("p_partkey") % 7 != 0, F.floor("p_retailprice").cast("double")))
    out = text.explanation(("Tür", F.col("p_type")), ("Mesafe", size), ("Eczane", metres))
    return b.table(spark, d, "part").select("p_partkey", out.alias("explanation"))


def explanation_text(spark: SparkSession, d: str) -> DataFrame:
    return _explained(spark, d)


def dictionary_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of explanations with their numbers, in the order in which they are first seen."""
    return quality.compressed_in_order(_explained(spark, d), "p_partkey", "explanation")[1]


def dictionary_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Explanations that went through numbers in order of first appearance and back."""
    tokens, dictionary = quality.compressed_in_order(_explained(spark, d), "p_partkey", "explanation")
    return quality.expanded(tokens, dictionary, "p_partkey", "explanation")


def dictionary_compress(spark: SparkSession, d: str) -> DataFrame:
    tokens, dictionary = quality.compressed(_explained(spark, d), "p_partkey", "explanation")
    return quality.expanded(tokens, dictionary, "p_partkey", "explanation")


def label_extract(spark: SparkSession, d: str) -> DataFrame:
    label = text.long_label(F.col("n_name"), F.col("r_name"))
    j = b.table(spark, d, "nation").join(b.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    j = j.select("n_nationkey", label.alias("label"))
    name, district = text.split_label(F.col("label"))
    return j.select("n_nationkey", "label", name.alias("name"), district.alias("district"))


def amenity_classes(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("hospital", "cafe", "pharmacy", "none")])
    care = F.array(*[F.lit(x) for x in ("doctor", "clinic", "other")])
    k = F.col("p_partkey")
    a, h = F.element_at(kinds, (k % 4 + 1).cast("int")), F.element_at(care, (k % 3 + 1).cast("int"))
    return b.table(spark, d, "part").select("p_partkey", text.amenity_class(a, h).alias("class"))


def age_bands(spark: SparkSession, d: str) -> DataFrame:
    band = F.when(F.col("p_size") % 9 == 0, "toplam").otherwise(F.concat(F.col("p_size").cast("string"), F.lit("-"), (F.col("p_size") + 4).cast("string")))
    p = b.table(spark, d, "part").select("p_brand", text.starting_age(band).alias("age"), F.col("p_retailprice").cast("decimal(18,2)").alias("n"))
    return rounded(areas.age_shares(p, "p_brand", "age", "n", old=40, young=15), "old_share", "young_share")


def dedupe_keys(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicate_keys(b.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def quality_violations(spark: SparkSession, d: str) -> DataFrame:
    x = F.col
    rules = {
        "positive_price": x("o_totalprice") > 1000,
        "known_status": x("o_orderstatus").isin("O", "F"),
        "in_window": F.year("o_orderdate").between(1995, 2000),
        "has_priority": F.nullif(x("o_orderpriority"), F.lit("5-LOW")).isNotNull(),
    }
    return quality.violations(b.table(spark, d, "orders"), rules)


def zero_density_share(spark: SparkSession, d: str) -> DataFrame:
    o = b.table(spark, d, "lineitem").select((F.col("l_discount")).alias("v"))
    return quality.zero_share(o, "v").select(F.round("zero_share", 6).alias("zero_share"), "warn")


def union_missing_columns(spark: SparkSession, d: str) -> DataFrame:
    c = b.table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    s = b.table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nation"))
    return c.unionByName(s, allowMissingColumns=True).groupBy("kind", "nation").agg(F.count("*").alias("n"), F.count("segment").alias("segments"))


QUERIES = {
    f.__name__: f
    for f in (
        normalised_name_join, missing_keys, shared_keys, alias_single_centre, hstore_tags, json_props, slug, html_escape, explanation_text,
        dictionary_compress, dictionary_in_order, dictionary_first_seen, label_extract, amenity_classes, age_bands, dedupe_keys, quality_violations, zero_density_share, union_missing_columns,
    )
}

_NORM = "trim(regexp_replace(regexp_replace(translate(upper(trim({x})), 'İŞĞÜÖÇ', 'ISGUOC'), '\\s+MAHALLESI$', ''), '\\s+', ' ', 'g'))"
_EXPLAIN = """SELECT p_partkey, 'Tür: ' || p_type || '<br>Mesafe: ' || CASE WHEN p_size <= 10 THEN 'çok yakın' WHEN p_size <= 30 THEN 'orta' ELSE 'uzak' END
  || '<br>Eczane: ' || CASE WHEN p_partkey % 7 <> 0 THEN format('{:,}', CAST(floor(p_retailprice) AS BIGINT)) || ' m' ELSE 'OSM verisi yok' END AS explanation FROM part"""

SQL = {
    "normalised_name_join": f"""WITH l AS (SELECT n_nationkey, {_NORM.format(x="'  ' || lower(n_name) || '  mahallesi'")} AS key FROM nation),
r AS (SELECT {_NORM.format(x='n_name')} AS key, n_regionkey AS region FROM nation) SELECT n_nationkey, key, region FROM l LEFT JOIN r USING (key)""",
    "missing_keys": "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "shared_keys": "SELECT c_custkey AS k FROM customer INTERSECT SELECT p_partkey FROM part",
    "alias_single_centre": "SELECT 'MERKEZ' AS ours, 'IL MERKEZ' AS theirs",
    "hstore_tags": "SELECT event_id, event_type AS kind, CAST(user_id AS VARCHAR) AS who, CAST(NULL AS VARCHAR) AS none FROM events",
    "json_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "slug": """SELECT p_partkey, trim(regexp_replace(lower(translate('Çok Özel: ' || p_name || ' / ' || p_type, 'çğıöşüÇĞİÖŞÜ', 'cgiosuCGIOSU')), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part""",
    "html_escape": """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '&lt;a href=&quot;x&quot;&gt;&#x27;' || replace(p_name, '&', '&amp;') || '&#x27; &amp; co&lt;/a&gt;' END AS escaped FROM part""",
    "explanation_text": _EXPLAIN,
    "dictionary_compress": _EXPLAIN,
    "dictionary_first_seen": _EXPLAIN,
    "dictionary_in_order": f"""WITH x AS ({_EXPLAIN}), s AS (SELECT p_partkey, string_split(explanation, '<br>') AS ps FROM x WHERE explanation IS NOT NULL),
e AS (SELECT p_partkey, unnest(ps) AS piece, generate_subscripts(ps, 1) AS pos FROM s), f AS (SELECT piece, min((p_partkey, pos)) AS place FROM e GROUP BY 1)
SELECT piece, row_number() OVER (ORDER BY place, piece) - 1 AS token FROM f""",
    "label_extract": "SELECT n_nationkey, n_name || ' (' || r_name || ')' AS label, n_name AS name, r_name AS district FROM nation JOIN region ON n_regionkey = r_regionkey",
    "amenity_classes": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'hospital' WHEN 2 THEN 'pharmacy' ELSE CASE p_partkey % 3 WHEN 0 THEN 'doctors' WHEN 1 THEN 'clinic' END END AS class FROM part""",
    "age_bands": """WITH p AS (SELECT p_brand, CASE WHEN p_size % 9 <> 0 THEN p_size END AS age, CAST(p_retailprice AS DECIMAL(18,2)) AS n FROM part)
SELECT p_brand, round(CAST(sum(n) FILTER (age >= 40) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 6) AS old_share, round(CAST(sum(n) FILTER (age < 15) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 6) AS young_share FROM p GROUP BY 1""",
    "dedupe_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "quality_violations": """SELECT 'positive_price' AS rule, count(*) AS rows FROM orders WHERE NOT o_totalprice > 1000 UNION ALL
SELECT 'known_status', count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F') UNION ALL
SELECT 'in_window', count(*) FROM orders WHERE year(o_orderdate) NOT BETWEEN 1995 AND 2000 UNION ALL
SELECT 'has_priority', count(*) FROM orders WHERE o_orderpriority = '5-LOW'""",
    "zero_density_share": "SELECT round(avg(CASE WHEN l_discount = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share, avg(CASE WHEN l_discount = 0 THEN 1.0 ELSE 0.0 END) > 0.25 AS warn FROM lineitem",
    "union_missing_columns": """SELECT 'customer' AS kind, c_nationkey AS nation, count(*) AS n, count(c_mktsegment) AS segments FROM customer GROUP BY 2
UNION ALL SELECT 'supplier', s_nationkey, count(*), 0 FROM supplier GROUP BY 2""",
}
