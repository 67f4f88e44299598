"""What a place's type and tags say about it: classes, address types, flags, gates and older scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeloom.functions.scoring import by_type

#: Default class by place type; all others are places.
CLASSES = {
    "boundary": ("country", "state", "county"),
    "natural": ("lake", "mountain", "forest", "bay", "cape", "island", "islet"),
    "waterway": ("river",),
    "aeroway": ("airport",),
    "railway": ("station",),
    "highway": ("street",),
    "tourism": ("landmark",),
    "amenity": ("university", "hospital", "publicbuilding"),
    "leisure": ("park",),
}
#: The address field that a place's own name fills; the city's for all others.
SETTLEMENT_FIELDS = {
    "town": ("town",),
    "village": ("village", "hamlet", "farm", "locality"),
    "suburb": ("suburb", "quarter", "neighbourhood"),
}
#: Bits of a record's flags.
FLAGS = ("population", "alt_name", "old_name", "relation", "box", "way")
#: Tags that are kept beside a place.
EXTRA_TAGS = (
    "wikidata", "wikipedia", "population", "capital", "ele", "opening_hours", "phone", "website", "email", "wheelchair",
    "iata", "icao", "ref", "operator", "brand", "cuisine", "denomination", "religion",
)
#: Tags that make a named way a place, and those that show it to be notable.
WAY_TAGS = ("natural", "landuse", "leisure", "waterway", "place", "amenity", "tourism", "historic", "aeroway", "public_transport", "railway", "man_made", "shop", "office")
NOTABLE_TAGS = ("wikidata", "wikipedia", "loc_name", "short_name", "nat_name", "reg_name")
#: Weight of a type; all others 20.
TYPE_WEIGHT = {
    "country": 100, "state": 90, "county": 85, "city": 80, "town": 70, "airport": 65, "station": 65, "village": 60, "suburb": 55, "quarter": 55, "landmark": 55,
    "island": 50, "square": 50, "neighbourhood": 50, "university": 50, "hospital": 50, "publicbuilding": 50, "street": 48, "hamlet": 40, "farm": 40, "locality": 35, "park": 35, "postcode": 30,
}
#: The older score's part by type; all others 200.
OLDER_TYPE_SCORE = {
    "city": 2000, "town": 1500, "village": 1000, "suburb": 900, "quarter": 900, "neighbourhood": 850, "island": 800, "square": 750, "airport": 700, "station": 700, "landmark": 700,
    "university": 600, "hospital": 600, "publicbuilding": 600, "lake": 600, "river": 600, "hamlet": 500, "farm": 500, "mountain": 500, "forest": 500, "park": 400, "county": 300, "state": 200, "country": 100,
}


def default_class(kind: Column) -> Column:
    """The class of a place that states none."""
    out = F
    for label, kinds in CLASSES.items():
        out = out.when(kind.isin(list(kinds)), label)
    return out.otherwise("place")


def class_and_type(kind: Column, stated_class: Column, stated_type: Column) -> Column:
    """Stated class and type, else those of the place type."""
    stated = stated_class.isNotNull() & stated_type.isNotNull()
    return F.struct(F.when(stated, stated_class).otherwise(default_class(kind)).alias("class"), F.when(stated, stated_type).otherwise(F.lower(kind)).alias("type"))


def address_type(kind: Column) -> Column:
    """A place type as the name of an address level."""
    return F.when(kind == "street", "road").otherwise(kind)


def settlement_field(kind: Column) -> Column:
    """Which of city, town, village and suburb the place's name fills."""
    out = F
    for label, kinds in SETTLEMENT_FIELDS.items():
        out = out.when(kind.isin(list(kinds)), label)
    return out.otherwise("city")


def settlement_columns(kind: Column, name: Column) -> list[Column]:
    """The name under the one of city, town, village and suburb that it fills, null under the others."""
    field = settlement_field(kind)
    return [F.when(field == label, name).alias(label) for label in ("city", "town", "village", "suburb")]


def flags(population: Column, alt_name: Column, old_name: Column, is_relation: Column, has_box: Column, is_way: Column) -> Column:
    """Six bits: what a record has and what it was made of."""
    filled = lambda c: F.coalesce(c != "", F.lit(False))
    bits = (population.isNotNull(), filled(alt_name), filled(old_name), is_relation, has_box, is_way)
    total = F.lit(0)
    for i, bit in enumerate(bits):
        total = total + bit.cast("int") * (1 << i)
    return total


def has_flag(bits: Column, flag: str) -> Column:
    """Whether a record's flags have a bit."""
    return bits.bitwiseAND(1 << FLAGS.index(flag)) != 0


def extra_tags(tags: Column) -> Column:
    """The tags that are kept beside a place."""
    return F.map_filter(tags, lambda k, _: k.isin(list(EXTRA_TAGS)))


def way_qualifies(tags: Column) -> Column:
    """Whether a way is a place: named, and either notable or with a tag that is neither road nor building."""
    keys = F.map_keys(tags)
    has = lambda *names: F.arrays_overlap(keys, F.array(*map(F.lit, names)))
    translated = F.exists(keys, lambda k: k.startswith("name:") & (F.length(k) == 7))
    notable = has(*NOTABLE_TAGS) | translated
    return has("name") & F.when(has("highway"), notable).when(has("building"), notable | has(*WAY_TAGS)).otherwise(notable | has(*WAY_TAGS))


def type_weight(kind: Column) -> Column:
    """Weight of a place type in per cent."""
    return by_type(kind, TYPE_WEIGHT, 20)


def older_importance(kind: Column, population: Column, notable: Column, translations: Column) -> Column:
    """The older score of a place, 0 to 65535."""
    people = F.when(population > 0, F.floor(F.log10(population.cast("double")) * 3000)).otherwise(0)
    score = people + by_type(kind, OLDER_TYPE_SCORE, 200) + F.when(notable, 1500).otherwise(0) + F.least(translations, F.lit(5)) * 300
    return F.least(score, F.lit(65535)).cast("int")
