"""Model tables derived from the provided tables by integer arithmetic.

The provided tables have no coordinates and few names, so places, points, polygons, addresses and
requests are computed from their keys; the same expressions stand in the queries' SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the provided tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lat(k: Column) -> Column:
    """Latitude of a key, in microdegrees."""
    return (F.lit(59000000) + (k * 7919) % 200003).cast("bigint")


def lon(k: Column) -> Column:
    """Longitude of a key, in microdegrees."""
    return (F.lit(18000000) + (k * 104729) % 400009).cast("bigint")


#: Place types by key, most of them settlements.
KINDS = ("city", "town", "village", "suburb", "hamlet", "island", "station", "lake", "park", "landmark", "unknown")


def kind(k: Column) -> Column:
    """Place type of a key."""
    return F.element_at(F.array(*map(F.lit, KINDS)), (k % len(KINDS)).cast("int") + 1)


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named places from parts: record_id, name, country, kind, population, notable, translations, lat_u, lon_u."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("record_id"), F.col("p_name").alias("name"), (k % 5).cast("int").alias("country"), kind(k).alias("kind"),
        ((k * 7907) % 1000003).alias("population"), (k % 7 == 0).alias("notable"), (k % 6).cast("int").alias("translations"), lat(k).alias("lat_u"), lon(k).alias("lon_u"),
    )


def scored_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places with an integer importance in place of the logarithmic one, so that ranks are exact."""
    return places(spark, sf_dir).withColumn("importance", ((F.col("record_id") * 48271) % 65521).cast("int"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places from customers: record_id, admin_id, kind, lat_u, lon_u."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("record_id"), F.col("c_nationkey").alias("admin_id"), kind(k).alias("kind"), lat(k).alias("lat_u"), lon(k).alias("lon_u"), F.col("c_mktsegment").alias("segment")
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query points from suppliers: point_id, lat_u, lon_u, zoom."""
    s = F.col("s_suppkey")
    k = s * 13 + 5
    return table(spark, sf_dir, "supplier").select(s.alias("point_id"), lat(k).alias("lat_u"), lon(k).alias("lon_u"), (F.lit(8) + s % 11).cast("int").alias("zoom"))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admin polygons from nations: admin_id, ord, ring of five corners."""
    n = F.col("n_nationkey")
    south = (F.lit(59020000) + (n % 5) * 40000).cast("bigint")
    west = (F.lit(18040000) + F.floor(n / 5) * 80000).cast("bigint")
    corner = lambda dy, dx: F.struct((south + dy).alias("lat"), (west + dx).alias("lon"))
    shape = ((-11000, -9000), (30000, -14000), (41000, 52000), (12000, 74000), (-11000, -9000))
    return table(spark, sf_dir, "nation").select(n.alias("admin_id"), n.alias("ord"), F.array(*[corner(*c) for c in shape]).alias("ring"))


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres of the admin polygons."""
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        n.alias("admin_id"), n.alias("ord"), (F.lit(59035000) + (n % 5) * 40000).cast("bigint").alias("lat_u"), (F.lit(18070000) + F.floor(n / 5) * 80000).cast("bigint").alias("lon_u")
    )


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses from orders: street, housenumber, number, suffix, muni, postcode, city, position."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    number = (k % 97 + 1).cast("int")
    suffix = (k % 4).cast("int")
    return table(spark, sf_dir, "orders").select(
        k.alias("osm_id"), F.concat(F.lit("street "), (k % 211).cast("string")).alias("street"), F.concat(F.lit("Street "), (k % 211).cast("string")).alias("display"),
        number.alias("number"), suffix.alias("suffix"), F.concat(number.cast("string"), F.when(suffix > 0, F.char(suffix + 64)).otherwise("")).alias("housenumber"),
        (c % 7).cast("int").alias("muni"), F.lpad((k % 503).cast("string"), 5, "1").alias("postcode"), F.concat(F.lit("city "), (c % 13).cast("string")).alias("city"),
        k.alias("ord"), lat(k).alias("lat_u"), lon(k).alias("lon_u"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API requests from events: key, event_id, ts, failed."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", "ts", (F.col("event_type") == "error").alias("failed"))


#: SQL of the same tables, as common table expressions.
SQL = {
    "places": "places AS (SELECT p_partkey AS record_id, p_name AS name, CAST(p_partkey % 5 AS INTEGER) AS country, ['city','town','village','suburb','hamlet','island','station','lake','park','landmark','unknown'][CAST(p_partkey % 11 AS INTEGER) + 1] AS kind, "
    "(p_partkey * 7907) % 1000003 AS population, p_partkey % 7 = 0 AS notable, CAST(p_partkey % 6 AS INTEGER) AS translations, CAST(59000000 + (p_partkey * 7919) % 200003 AS BIGINT) AS lat_u, CAST(18000000 + (p_partkey * 104729) % 400009 AS BIGINT) AS lon_u, "
    "CAST((p_partkey * 48271) % 65521 AS INTEGER) AS importance FROM part)",
    "customers": "customers AS (SELECT c_custkey AS record_id, c_nationkey AS admin_id, ['city','town','village','suburb','hamlet','island','station','lake','park','landmark','unknown'][CAST(c_custkey % 11 AS INTEGER) + 1] AS kind, "
    "CAST(59000000 + (c_custkey * 7919) % 200003 AS BIGINT) AS lat_u, CAST(18000000 + (c_custkey * 104729) % 400009 AS BIGINT) AS lon_u, c_mktsegment AS segment FROM customer)",
    "points": "points AS (SELECT s_suppkey AS point_id, CAST(59000000 + ((s_suppkey * 13 + 5) * 7919) % 200003 AS BIGINT) AS lat_u, CAST(18000000 + ((s_suppkey * 13 + 5) * 104729) % 400009 AS BIGINT) AS lon_u, CAST(8 + s_suppkey % 11 AS INTEGER) AS zoom FROM supplier)",
    "edges": "base AS (SELECT n_nationkey AS admin_id, CAST(59020000 + (n_nationkey % 5) * 40000 AS BIGINT) AS s, CAST(18040000 + (n_nationkey // 5) * 80000 AS BIGINT) AS w FROM nation), "
    "edges AS (SELECT admin_id, s + y1 AS y1, w + x1 AS x1, s + y2 AS y2, w + x2 AS x2 FROM base, (VALUES (-11000,-9000,30000,-14000),(30000,-14000,41000,52000),(41000,52000,12000,74000),(12000,74000,-11000,-9000)) e(y1,x1,y2,x2))",
    "centroids": "centroids AS (SELECT n_nationkey AS admin_id, CAST(59035000 + (n_nationkey % 5) * 40000 AS BIGINT) AS lat_u, CAST(18070000 + (n_nationkey // 5) * 80000 AS BIGINT) AS lon_u FROM nation)",
    "addresses": "addresses AS (SELECT o_orderkey AS osm_id, 'street ' || (o_orderkey % 211) AS street, 'Street ' || (o_orderkey % 211) AS display, CAST(o_orderkey % 97 + 1 AS INTEGER) AS number, CAST(o_orderkey % 4 AS INTEGER) AS suffix, "
    "(o_orderkey % 97 + 1) || CASE WHEN o_orderkey % 4 > 0 THEN chr(CAST(o_orderkey % 4 + 64 AS INTEGER)) ELSE '' END AS housenumber, CAST(o_custkey % 7 AS INTEGER) AS muni, lpad(CAST(o_orderkey % 503 AS VARCHAR), 5, '1') AS postcode, "
    "'city ' || (o_custkey % 13) AS city, CAST(59000000 + (o_orderkey * 7919) % 200003 AS BIGINT) AS lat_u, CAST(18000000 + (o_orderkey * 104729) % 400009 AS BIGINT) AS lon_u FROM orders)",
    "requests": "requests AS (SELECT user_id AS key, event_id, ts, event_type = 'error' AS failed FROM events)",
}


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """SQL of the great-circle distance in metres, to the millimetre."""
    a = (
        f"(sin(radians(({lat2} - {lat1}) / 1e6) / 2) * sin(radians(({lat2} - {lat1}) / 1e6) / 2) + cos(radians({lat1} / 1e6)) * cos(radians({lat2} / 1e6)) * "
        f"sin(radians(({lon2} - {lon1}) / 1e6) / 2) * sin(radians(({lon2} - {lon1}) / 1e6) / 2))"
    )
    return f"round(6371000 * 2 * atan2(sqrt({a}), sqrt(1 - {a})), 3)"


def with_tables(*names: str) -> str:
    """The WITH clause of some derived tables."""
    return "WITH " + ", ".join(SQL[n] for n in names)
