"""Ranks, scores and rules of place types, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers of the place types.
PLACE_TYPES = {
    "country": 0, "state": 1, "county": 2, "city": 3, "town": 4, "village": 5, "hamlet": 6, "farm": 7, "locality": 8, "postcode": 9,
    "suburb": 10, "quarter": 11, "neighbourhood": 12, "island": 13, "islet": 14, "square": 15, "street": 16,
    "lake": 20, "river": 21, "mountain": 22, "forest": 23, "bay": 24, "cape": 25,
    "airport": 30, "station": 31, "landmark": 32, "university": 33, "hospital": 34, "publicbuilding": 35, "park": 36, "unknown": 255,
}
#: Importance by type; all others 300.
TYPE_IMPORTANCE = {
    "city": 10000, "town": 6000, "village": 2000, "suburb": 1500, "quarter": 1500, "neighbourhood": 1400, "hamlet": 500, "farm": 500, "island": 3000,
    "airport": 1500, "station": 1500, "square": 1500, "street": 1500, "landmark": 2500, "university": 1000, "hospital": 1000, "publicbuilding": 1000,
    "park": 2500, "lake": 1000, "river": 1000, "mountain": 700, "forest": 700, "county": 4000, "state": 5000, "country": 8000,
}
#: Metres of head start in reverse lookups up to zoom 16.
TYPE_BONUS_M = {
    "country": 50000, "state": 20000, "county": 10000, "city": 5000, "town": 3000, "village": 1500, "suburb": 800, "quarter": 800, "neighbourhood": 800,
    "hamlet": 500, "farm": 500, "island": 2000, "airport": 1000, "station": 300, "lake": 500, "river": 500, "mountain": 500, "forest": 500,
}
#: Address ranks by type; all others 30.
PLACE_RANK = {
    "country": 4, "state": 8, "county": 12, "city": 16, "town": 19, "village": 21, "hamlet": 22, "farm": 22, "locality": 22, "suburb": 22, "quarter": 22,
    "neighbourhood": 22, "island": 17, "islet": 17, "square": 25, "street": 26, "lake": 22, "river": 22, "mountain": 22, "forest": 22, "bay": 22,
    "cape": 22, "airport": 22, "station": 26, "postcode": 21,
}
#: Types that a zoom level shows.
ZOOM_TYPES = (
    (3, ("country",)),
    (6, ("country", "state")),
    (9, ("state", "county", "city")),
    (11, ("city", "town", "lake", "island")),
    (13, ("city", "town", "village", "suburb", "lake", "island")),
)
#: Metres that part agreeing, close and diverging answers.
COMPARE_BANDS = (200, 2000, 20000)


def by_type(kind: Column, table: dict[str, int], other: int) -> Column:
    """A number of a type's name."""
    out = None
    groups: dict[int, list[str]] = {}
    for k, v in table.items():
        groups.setdefault(v, []).append(k)
    for v, kinds in groups.items():
        out = F.when(kind.isin(kinds), v) if out is None else out.when(kind.isin(kinds), v)
    return out.otherwise(other)


def importance(kind: Column, population: Column, notable: Column, translations: Column, parent_population: Column) -> Column:
    """Score of a place, 0 to 65535: population, type, notability, translations and parent."""
    people = F.when(kind.isin("city", "town") & (population > 100), F.floor(F.log10(population.cast("double")) * 4000)).otherwise(0)
    parent = F.when(parent_population > 10000, F.floor((F.log10(parent_population.cast("double")) - 4) * 1500)).otherwise(0)
    score = people + by_type(kind, TYPE_IMPORTANCE, 300) + F.when(notable, 8000).otherwise(0) + F.least(translations, F.lit(5)) * 1500 + parent
    return F.least(score, F.lit(65535)).cast("int")


def matches_zoom(kind: Column, zoom: Column) -> Column:
    """Whether a zoom level shows a type."""
    out = None
    for top, kinds in ZOOM_TYPES:
        rule = kind.isin(list(kinds))
        out = F.when(zoom <= top, rule) if out is None else out.when(zoom <= top, rule)
    return out.when(zoom <= 15, ~kind.isin("country", "state")).when(zoom <= 16, ~kind.isin("country", "state", "unknown")).otherwise(True)


def effective_distance(distance: Column, kind: Column, zoom: Column) -> Column:
    """Order of reverse results: distance less the type's head start, but for zoom 17 and beyond."""
    return F.when(zoom <= 16, distance - by_type(kind, TYPE_BONUS_M, 0)).otherwise(distance)


def confidence(layer: Column) -> Column:
    """Confidence of a match by the layer that found it."""
    return F.when(layer == "exact", 1.0).when(layer == "phonetic", 0.8).when(layer == "ngram", 0.7).when(layer == "edit1", 0.75).when(layer == "edit2", 0.55).otherwise(0.5)


def city_tier(same_country: Column, same_admin2: Column, same_admin1: Column, distance_m: Column) -> Column:
    """3: same municipality, 2: same region, 1: within 50 km, 0: elsewhere."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(same_country & same_admin2), 3).when(yes(same_country & same_admin1), 2).when(yes(distance_m <= 50000), 1).otherwise(0)


def compare_category(distance_m: Column, a_found: Column, b_found: Column) -> Column:
    """How two answers to one query relate."""
    near, close, far = COMPARE_BANDS
    return (
        F.when(~a_found & ~b_found, "BOTH_MISS")
        .when(~a_found, "MISS_A")
        .when(~b_found, "MISS_B")
        .when(distance_m < near, "AGREE")
        .when(distance_m < close, "CLOSE")
        .when(distance_m < far, "DIVERGE")
        .otherwise("CONFLICT")
    )
