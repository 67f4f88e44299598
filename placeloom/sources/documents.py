"""Readers of JSON, XML and SQLite sources, and of extracted map elements."""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PHOTON = (
    "osm_id bigint, osm_type string, osm_key string, osm_value string, rank_address int, importance double, name map<string,string>, address map<string,string>, "
    "housenumber string, street string, postcode string, city string, state string, centroid struct<coordinates:array<double>>, extra map<string,string>"
)
#: Population that a rank stands for where none is known.
RANK_POPULATION = ((8, 500_000), (12, 300_000), (16, 100_000), (20, 10_000))


def photon(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(places, addresses) of a JSON-lines dump."""
    raw = spark.read.schema(PHOTON).json(path)
    lat, lon = F.col("centroid.coordinates")[1], F.col("centroid.coordinates")[0]
    is_house = F.col("housenumber").isNotNull() & (F.col("housenumber") != "")
    label = F.coalesce(F.try_element_at("name", F.lit("default")), F.try_element_at("name", F.lit("name")))
    population = F.lit(0)
    for rank, people in reversed(RANK_POPULATION):
        population = F.when(F.col("rank_address") <= rank, people).otherwise(population)
    places = raw.where(~is_house & label.isNotNull() & F.col("osm_key").isin("place", "boundary")).select(
        "osm_id", "osm_type", label.alias("name"), lat.alias("lat"), lon.alias("lon"), F.col("osm_value").alias("kind"), population.cast("bigint").alias("population"), F.col("name").alias("name_intl")
    )
    addresses = raw.where(is_house & F.col("street").isNotNull()).select("osm_id", "street", "housenumber", "postcode", "city", "state", lat.alias("lat"), lon.alias("lon"))
    return places, addresses


def change_feed(spark: SparkSession, path: str, sequence: int) -> DataFrame:
    """action, osm_id, lat, lon, tags, sequence of the nodes in a change file; gzipped ones too."""
    node = T.StructType.fromDDL("_id bigint, _lat double, _lon double, tag array<struct<_k:string,_v:string>>")
    schema = T.StructType([T.StructField("node", T.ArrayType(node))])
    out = None
    for action in ("create", "modify", "delete"):
        rows = spark.read.format("xml").option("rowTag", action).schema(schema).load(path)
        each = rows.select(F.lit(action).alias("action"), F.explode("node").alias("n")).select(
            "action", F.col("n._id").alias("osm_id"), F.col("n._lat").alias("lat"), F.col("n._lon").alias("lon"),
            F.map_from_entries(F.transform(F.coalesce("n.tag", F.array().cast("array<struct<_k:string,_v:string>>")), lambda t: F.struct(t["_k"], t["_v"]))).alias("tags"),
            F.lit(sequence).cast("bigint").alias("sequence"),
        )
        out = each if out is None else out.unionByName(each)
    return out


def sqlite_rows(spark: SparkSession, path: str, sql: str, schema: str) -> DataFrame:
    """Rows of a query over SQLite and GeoPackage files; each file is one task's work.

    The files are read as binaries, so they may lie in any store that Spark reaches.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    names = T.StructType.fromDDL(schema).fieldNames() if not isinstance(schema, T.StructType) else schema.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with sqlite3.connect(":memory:") as db:
                    db.deserialize(bytes(content))
                    cursor = db.execute(sql)
                    while rows := cursor.fetchmany(10_000):
                        yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(run, schema)


def _point_of(blob: bytes | None) -> tuple[float, float] | None:
    """x, y of a GeoPackage or WKB point."""
    if not blob:
        return None
    at = 0
    if blob[:2] == b"GP":
        at = 8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7]
    order = "<" if blob[at] == 1 else ">"
    kind = struct.unpack_from(order + "I", blob, at + 1)[0] % 1000
    return struct.unpack_from(order + "dd", blob, at + 5) if kind == 1 else None


def wkb_point(column: Column) -> Column:
    """struct<x, y> of a binary point, null for other shapes."""

    @F.pandas_udf("x double, y double")
    def run(blobs: pd.Series) -> pd.DataFrame:
        found = [_point_of(b) or (None, None) for b in blobs]
        return pd.DataFrame(found, columns=["x", "y"], dtype="float64")

    return run(column)


#: Tags that make an element a place of interest, by key; None allows every value but those excluded.
POI_TAGS = {
    "tourism": ("attraction", "museum", "gallery", "viewpoint", "theme_park", "zoo", "aquarium", "hotel"),
    "amenity": ("university", "college", "hospital", "townhall", "library", "theatre", "arts_centre", "restaurant", "cafe", "school", "place_of_worship"),
    "railway": ("station", "halt"),
    "aeroway": ("aerodrome",),
    "historic": None,
    "natural": ("water", "peak", "bay", "cape", "wood"),
    "leisure": ("park", "stadium", "nature_reserve"),
}
NEEDS_NOTABILITY = ("leisure", "man_made")


def qualifies(tags: Column) -> Column:
    """Whether an element's tags make it a place: named, and a place or a place of interest."""
    has = lambda k: F.try_element_at(tags, F.lit(k))
    notable = has("wikidata").isNotNull() | has("wikipedia").isNotNull()
    rule = has("place").isNotNull()
    for key, values in POI_TAGS.items():
        hit = has(key).isNotNull() if values is None else F.coalesce(has(key).isin(list(values)), F.lit(False))
        rule = rule | (hit & notable if key in NEEDS_NOTABILITY else hit)
    return has("name").isNotNull() & rule


def node_places(nodes: DataFrame, least_population: int = 0) -> DataFrame:
    """Places among extracted nodes (id, lat, lon, tags)."""
    t = lambda k: F.try_element_at("tags", F.lit(k))
    people = F.regexp_replace(t("population"), "[^0-9]", "").try_cast("bigint")
    named = nodes.where(qualifies(F.col("tags")) & (people.isNull() | (people >= least_population)))
    languages = F.map_filter("tags", lambda k, v: k.startswith("name:"))
    return named.select(
        F.col("id").alias("osm_id"), t("name").alias("name"), "lat", "lon", F.coalesce(t("place"), F.lit("landmark")).alias("kind"), people.alias("population"), t("wikidata").alias("wikidata"),
        F.concat_ws(";", t("alt_name"), t("short_name"), t("official_name")).alias("alt_names"), F.transform_keys(languages, lambda k, v: F.substring(k, F.lit(6), F.length(k))).alias("name_intl"),
    )


def node_addresses(nodes: DataFrame) -> DataFrame:
    """Addresses among extracted nodes."""
    t = lambda k: F.try_element_at("tags", F.lit(k))
    rows = nodes.select(F.col("id").alias("osm_id"), F.coalesce(t("addr:street"), t("addr:place")).alias("street"), t("addr:housenumber").alias("housenumber"), t("addr:postcode").alias("postcode"), t("addr:city").alias("city"), t("addr:state").alias("state"), "lat", "lon")
    return rows.where("street IS NOT NULL AND housenumber IS NOT NULL")


def way_refs(ways: DataFrame) -> DataFrame:
    """(way_id, pos, node_id) of ways, for the join with nodes."""
    return ways.select(F.col("id").alias("way_id"), F.posexplode("refs").alias("pos", "node_id"))
