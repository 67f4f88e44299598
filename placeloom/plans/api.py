"""Lookups as functions of DataFrames: every request is a row.

``search``, ``autocomplete``, ``reverse``, ``lookup``, ``details`` and ``status`` take the model
tables and return ranked rows or documents; ``register`` makes the name functions callable from
SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.functions import address, geo, scoring, text
from placeloom.operators import search as s
from placeloom.operators import spatial, streets
from placeloom.plans.model import Model

SEARCH_LIMIT, AUTOCOMPLETE_LIMIT = 50, 20


def register(spark: SparkSession, language: text.Language = text.SWEDISH) -> None:
    """normalize_name, query_forms, phonetic_key and ascii_name as SQL functions."""
    spark.udf.register("normalize_name", text.normalize_udf(language))
    spark.udf.register("query_forms", text.normalize_query_udf(language))
    spark.udf.register("phonetic_key", text.phonetic_udf(language))
    spark.udf.register("ascii_name", text.universal_ascii_udf())


def search(
    queries: DataFrame, model: Model, *, language: text.Language = text.SWEDISH, countries: list | None = None, viewbox: tuple | None = None, bounded: bool = False,
    feature: Column | None = None, excluded: list[int] | None = None, limit: int = 10,
) -> DataFrame:
    """Ranked hits of (query_id, q): query forms, the layers' cascade, filters, order.

    A query's forms are tried in their order; the first form that hits decides.
    """
    limit = min(limit, SEARCH_LIMIT)
    forms = queries.select("query_id", F.posexplode(text.normalize_query_udf(language)(F.col("q"))).alias("form", "key"))
    names = model.places.select("record_id", "importance", "country", F.col("name"), "kind", "lat_u", "lon_u", "place_id", "admin_name")
    posted = model.exact
    if countries:
        # lists are capped within each country, so none crowds out another
        names, posted = names.where(F.col("country").isin(countries)), posted.where(F.col("country").isin(countries))
    exact = forms.join(posted.select("key", "record_id", F.col("importance").alias("posted")), "key").select("query_id", "form", "record_id", "posted")
    first = exact.groupBy("query_id").agg(F.min("form").alias("form"))
    hits = exact.join(first, ["query_id", "form"]).select("query_id", "record_id", F.lit("exact").alias("layer"))
    missed = queries.join(first, "query_id", "left_anti")
    grams = None if countries else model.ngrams
    fuzzy = s.cascade(missed, names, text.phonetic_udf(language), grams).select("query_id", "record_id", "layer")
    found = hits.unionByName(fuzzy).join(names, "record_id").withColumn("confidence", scoring.confidence(F.col("layer")))
    found = found.withColumn("lat", F.col("lat_u")).withColumn("lon", F.col("lon_u")).withColumn("importance", F.col("importance").cast("double"))
    ids = F.array(*[F.lit(x).cast("bigint") for x in excluded]) if excluded else None
    kept = s.filtered(found, viewbox, bounded, ids, feature)
    same = s.first_wins(kept, ["query_id", "name", "kind", "admin_name"], [F.desc("confidence"), F.desc("importance"), F.col("record_id")])
    return s.top(same, [F.desc("confidence"), F.desc("importance"), F.col("record_id")], limit)


def autocomplete(queries: DataFrame, model: Model, limit: int = 10) -> DataFrame:
    """The best names that begin with a query."""
    return s.prefix(queries, model.places.select("record_id", "name", "importance"), min(limit, AUTOCOMPLETE_LIMIT))


def reverse(points: DataFrame, model: Model, limit: int = 1) -> DataFrame:
    """Places around points (point_id, lat_u, lon_u, zoom)."""
    return spatial.reverse(points, model.places.drop("gx", "gy"), limit)


def reverse_houses(points: DataFrame, addresses: DataFrame, metres: float = 200.0) -> DataFrame:
    """The nearest address of the points that ask for houses: zoom 17 and beyond."""
    return streets.nearest_house(points.where("zoom >= 17"), addresses, metres)


def lookup(ids: DataFrame, model: Model) -> DataFrame:
    """Places by place_id or by (osm_type, osm_id), whichever columns ``ids`` has."""
    on = [c for c in ("place_id", "osm_type", "osm_id") if c in ids.columns]
    return ids.join(model.places, on)


def details(places: DataFrame) -> DataFrame:
    """(place_id, document): a JSON document of each place."""
    lat, lon = geo.degrees(F.col("lat_u")), geo.degrees(F.col("lon_u"))
    label = address.display_name([F.col("name"), F.col("admin_name")])
    point = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    document = F.struct(
        "place_id", "osm_type", "osm_id", F.col("kind").alias("type"), scoring.by_type(F.col("kind"), scoring.PLACE_RANK, 30).alias("place_rank"), "importance", label.alias("display_name"), point.alias("centroid"),
        address.synthetic_box(lat, lon).alias("boundingbox"),
    )
    return places.select("place_id", F.to_json(document).alias("document"))


def feature_collections(hits: DataFrame) -> DataFrame:
    """(query_id, document): the hits of each query as one GeoJSON collection, in rank order."""
    point = F.struct(F.lit("Point").alias("type"), F.array(geo.degrees(F.col("lon_u")), geo.degrees(F.col("lat_u"))).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct("place_id", "name", "kind", "importance").alias("properties"))
    ranked = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", feature.alias("f")))).alias("fs"))
    document = F.struct(F.lit("FeatureCollection").alias("type"), F.transform("fs", lambda x: x["f"]).alias("features"))
    return ranked.select("query_id", F.to_json(document).alias("document"))


def status(model: Model) -> DataFrame:
    """Places by country and in all."""
    return model.places.rollup("country").agg(F.count("*").alias("n_places"), F.countDistinct("name").alias("n_names"))


def accept_languages(header: str) -> list[str]:
    """Primary subtags of an Accept-Language header, the most wanted first."""
    wanted = []
    for i, part in enumerate(header.split(",")):
        tag, _, q = part.strip().partition(";q=")
        try:
            weight = float(q) if q else 1.0
        except ValueError:
            weight = 0.0
        if tag and tag != "*" and weight > 0:
            wanted.append((-weight, i, tag.split("-")[0].lower()))
    return list(dict.fromkeys(t for _, _, t in sorted(wanted)))


def localised(names: Column, fallback: Column, languages: list[str]) -> Column:
    """A place's name in the first wanted language that it has."""
    return F.coalesce(*[F.try_element_at(names, F.lit(x)) for x in languages], fallback)


def viewbox(value: str) -> tuple[int, int, int, int] | None:
    """south, north, west, east in microdegrees of "x1,y1,x2,y2"; corners in any order."""
    try:
        x1, y1, x2, y2 = (float(v) for v in value.split(","))
    except ValueError:
        return None
    south, north, west, east = min(y1, y2), max(y1, y2), min(x1, x2), max(x1, x2)
    return tuple(round(v * 1e6) for v in (south, north, west, east))
