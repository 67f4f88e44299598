"""Building the model tables from sources: merge, assign admin areas, score, index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.functions import hashing, scoring
from placeloom.operators import merge, search, spatial, streets


@dataclass(frozen=True)
class Model:
    """The tables that lookups read."""

    places: DataFrame
    exact: DataFrame
    ngrams: DataFrame
    streets: DataFrame
    houses: DataFrame
    postcodes: DataFrame
    admin: DataFrame


def packable(places: DataFrame, longest: int = 255) -> DataFrame:
    """Places that may be indexed: named, not too long, and of a known type or notable."""
    name = F.trim("name")
    return places.where((name != "") & (F.octet_length(name) < longest) & ((F.col("kind") != "unknown") | F.col("notable")))


def build(places: DataFrame, addresses: DataFrame, admin: DataFrame, polygons: DataFrame, centroids: DataFrame) -> Model:
    """All model tables.

    ``places``: record_id, osm_type, osm_id, name, country, kind, population, notable, translations,
    lat_u, lon_u.  ``addresses``: street, number, suffix, muni, postcode, display, ord, lat_u,
    lon_u.  ``admin``: admin_id, name, population.
    """
    kept = packable(places)
    points = kept.select(F.col("record_id").alias("point_id"), "lat_u", "lon_u")
    assigned = spatial.assign_admin(points, polygons, centroids).select(F.col("point_id").alias("record_id"), "admin_id")
    owned = kept.join(assigned, "record_id", "left")
    filled = streets.backfill_population(admin, owned.where(F.col("kind").isin("city", "town", "village")).select("admin_id", "population"))
    parents = filled.select("admin_id", F.col("population").alias("parent_population"), F.col("name").alias("admin_name"))
    scored = owned.join(parents, "admin_id", "left")
    parent = F.coalesce("parent_population", F.lit(0))
    scored = scored.withColumn("importance", scoring.importance(F.col("kind"), F.coalesce("population", F.lit(0)), F.col("notable"), F.col("translations"), parent))
    number = scoring.by_type(F.col("kind"), scoring.PLACE_TYPES, 255)
    scored = scored.withColumn("place_id", hashing.place_id(F.col("osm_type"), F.col("osm_id"), number))
    grouped = streets.street_groups(addresses)
    return Model(
        places=spatial.with_cell(scored),
        exact=search.postings(search.exact_keys(scored, carried=("country",)), search.EXACT_CAP, ("country",)),
        ngrams=search.postings(search.ngram_keys(scored), search.NGRAM_CAP),
        streets=grouped.drop("houses"),
        houses=addresses.select("street", "muni", "number", "suffix", "lat_u", "lon_u"),
        postcodes=streets.postcode_centroids(addresses),
        admin=filled,
    )


def merged_sources(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Places of several sources: by id, then by name and neighbourhood, first sources first."""
    out = first
    for other in others:
        fresh = merge.by_name_nearby(out, other)
        out = merge.by_id(out, fresh)
    return out
