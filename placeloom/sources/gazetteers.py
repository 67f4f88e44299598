"""Readers of place gazetteers and paged or joined address sources that are no plain tables."""

from __future__ import annotations

import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.functions import hashing, text

#: Danish main and sub types, and the place types of those that are kept; * stands for any sub type.
DANISH_TYPES = {
    "Bebyggelse": {"bydel": "suburb", "by": "village", "sommerhusområde": "neighbourhood", "kolonihave": "neighbourhood"},
    "Bygning": {
        "slot": "landmark", "herregård": "landmark", "museumSamling": "landmark", "kirkeProtestantisk": "landmark", "kirkeKatolsk": "landmark", "kloster": "landmark", "domkirke": "landmark", "ruin": "landmark",
        "rådhus": "publicbuilding", "bibliotek": "publicbuilding", "teater": "publicbuilding", "operahus": "publicbuilding", "universitet": "university", "højskoleEtc": "university", "hospital": "hospital",
        "sygehus": "hospital", "togstation": "station", "lufthavn": "airport", "turistbureau": "landmark", "kirkeAndenKristen": "landmark", "vandrerhjem": "landmark", "gymnasium": "university",
        "folkehøjskole": "university", "uddannelsescenter": "university",
    },
    "Seværdighed": {"*": "landmark"},
    "Idraetsanlæg": {"stadion": "landmark"},
    "Standsningssted": {"*": "station"},
    "Andentopografi punkt": {"bro": "landmark", "udsigtspunkt": "landmark"},
    "Vej": {"vejbro": "landmark", "vejtunnel": "landmark"},
    "Jernbane": {"jernbanetunnel": "landmark", "veteranjernbane": "landmark"},
    "Navigationsanlaeg": {"fyrtårn": "landmark"},
    "Havnebassin": {"trafikhavn": "locality", "lystbådehavn": "locality"},
    "Landskabsform": {"næs": "cape", "odde": "cape"},
}
#: Norwegian kinds of names by place type; all others are localities.
NORWEGIAN_TYPES = {
    "city": ("by", "storby"),
    "town": ("tettsted", "tettbebyggelse"),
    "village": ("bygd", "grend"),
    "hamlet": ("navnegard", "bruk", "eneboligFritidsbolig", "boligfelt", "husmannsplass"),
    "suburb": ("bydel", "delbydel"),
    "lake": ("innsjø", "tjern", "vann", "dam", "sjø"),
    "river": ("elv", "bekk", "foss", "stryk"),
    "mountain": ("fjell", "topp", "ås", "fjellområde", "egg", "nut", "tind", "kamBre"),
    "forest": ("skog", "myr", "mo", "hei", "vidde", "dal"),
    "bay": ("bukt", "vik", "fjord", "sund", "poll"),
    "cape": ("nes", "odde"),
    "island": ("øy", "holme", "halvøy"),
    "station": ("stasjon", "holdeplass"),
    "airport": ("lufthavn", "flyplass"),
}
#: Population that a Norwegian importance code stands for; all others 50.
NORWEGIAN_POPULATION = {"viktighetA": 10_000, "viktighetB": 5_000, "viktighetC": 1_000, "viktighetD": 500, "viktighetE": 100}
#: South, north, west and east of the countries whose rows are tested.
FINLAND, NEW_ZEALAND = (59.0, 71.0, 19.0, 32.0), (-47.5, -34.0, 166.0, 179.0)


def _inside(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])


def _filled(*columns: Column) -> Column:
    """The first text that is not blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in columns])


def danish_type(main: Column, sub: Column) -> Column:
    """Place type of a Danish main and sub type, null if it is not kept."""
    out = F
    for m, subs in DANISH_TYPES.items():
        for s, kind in subs.items():
            out = out.when((main == m) if s == "*" else (main == m) & (sub == s), kind)
    return out.otherwise(None)


def norwegian_type(kind: Column) -> Column:
    """Place type of a Norwegian kind of name."""
    out = F
    for label, kinds in NORWEGIAN_TYPES.items():
        out = out.when(kind.isin(list(kinds)), label)
    return out.otherwise("locality")


def synthetic_id(source_id: Column) -> Column:
    """A negative id from a source's own, of 62 bits of its hash."""
    return -hashing.low_bits(hashing.fnv1a(hashing.utf8_bytes(source_id)), 62)


def danish_places(spark: SparkSession, path: str) -> DataFrame:
    """osm_id, name, alt_names, kind, lat, lon of a list of Danish place names."""
    schema = "id string, hovedtype string, undertype string, `primærtnavn` string, visueltcenter array<double>, `sekundærenavne` array<struct<navn:string>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    name, at = F.trim("primærtnavn"), F.col("visueltcenter")
    others = F.filter(F.transform("sekundærenavne", lambda x: x["navn"]), lambda n: (F.trim(n) != "") & (n != F.col("primærtnavn")))
    lat, lon = F.get(at, F.lit(1)), F.get(at, F.lit(0))
    kept = raw.withColumn("kind", danish_type(F.col("hovedtype"), F.col("undertype"))).where(F.col("kind").isNotNull() & (name != "") & lat.between(-90, 90) & lon.between(-180, 180))
    return kept.select(synthetic_id(F.col("id")).alias("osm_id"), name.alias("name"), F.coalesce(others, F.array().cast("array<string>")).alias("alt_names"), "kind", lat.alias("lat"), lon.alias("lon"))


def norwegian_places(spark: SparkSession, path: str) -> DataFrame:
    """osm_id, name, alt_names, kind, population, municipality, county, lat, lon of active Norwegian places with approved spellings; read as a stream of elements."""
    spelling = "struct<`app:Skrivemåte`:array<struct<`app:langnavn`:string,`app:prioritertSkrivemåte`:boolean,`app:skrivemåtestatus`:string>>>"
    schema = (
        "`app:stedsnummer` bigint, `app:stedstatus` string, `app:navneobjekttype` string, `app:sortering` struct<`app:Sortering`:struct<`app:sortering1Kode`:string>>, `app:posisjon` struct<`gml:Point`:struct<`gml:pos`:string>>, "
        f"`app:kommune` struct<`app:Kommune`:struct<`app:kommunenavn`:string,`app:fylkesnavn`:string>>, `app:stedsnavn` array<struct<`app:Stedsnavn`:struct<`app:skrivemåte`:array<{spelling}>>>>"
    )
    raw = spark.read.format("xml").option("rowTag", "app:Sted").schema(schema).load(path)
    each = F.flatten(F.flatten(F.transform("`app:stedsnavn`", lambda x: F.transform(x["app:Stedsnavn"]["app:skrivemåte"], lambda y: y["app:Skrivemåte"]))))
    approved = F.filter(each, lambda x: (x["app:skrivemåtestatus"] == "godkjent") & (F.trim(x["app:langnavn"]) != ""))
    at = F.split(F.trim(F.col("`app:posisjon`.`gml:Point`.`gml:pos`")), r"\s+")
    population = F
    for code, people in NORWEGIAN_POPULATION.items():
        population = population.when(F.col("code") == code, people)
    rows = raw.where("`app:stedstatus` = 'aktiv'").select(
        F.col("`app:stedsnummer`").alias("number"), F.col("`app:navneobjekttype`").alias("type"), approved.alias("names"), F.get(at, F.lit(0)).try_cast("double").alias("lat"), F.get(at, F.lit(1)).try_cast("double").alias("lon"),
        F.col("`app:kommune`.`app:Kommune`.`app:kommunenavn`").alias("municipality"), F.col("`app:kommune`.`app:Kommune`.`app:fylkesnavn`").alias("county"), F.col("`app:sortering`.`app:Sortering`.`app:sortering1Kode`").alias("code"),
    )
    preferred = F.filter("names", lambda x: x["app:prioritertSkrivemåte"])
    name = F.coalesce(F.get(preferred, F.lit(0)), F.get("names", F.lit(0)))["app:langnavn"]
    others = F.array_distinct(F.filter(F.transform("names", lambda x: x["app:langnavn"]), lambda n: n != F.col("name")))
    named = rows.withColumn("name", name).where("name IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
    return named.select((-F.col("number")).alias("osm_id"), "name", others.alias("alt_names"), norwegian_type(F.col("type")).alias("kind"), population.otherwise(50).alias("population"), "municipality", "county", "lat", "lon")


def finnish_addresses(spark: SparkSession, path: str) -> DataFrame:
    """street, housenumber, postcode, city, lat, lon of pages of features; Finnish names before Swedish ones."""
    names = "address_name_fin:string,address_name_swe:string,number_part_of_address_number:bigint,subdivision_letter_of_address_number:string,postal_code:string,postal_office_fin:string,postal_office_swe:string"
    raw = spark.read.schema(f"features array<struct<properties:struct<{names}>,geometry:struct<coordinates:array<double>>>>").option("multiLine", True).json(path)
    f = raw.select(F.explode("features").alias("f")).select("f.properties.*", F.get("f.geometry.coordinates", F.lit(1)).alias("lat"), F.get("f.geometry.coordinates", F.lit(0)).alias("lon"))
    number = F.when(F.col("number_part_of_address_number") > 0, F.concat(F.col("number_part_of_address_number").cast("string"), F.coalesce(_filled(F.col("subdivision_letter_of_address_number")), F.lit(""))))
    out = f.select(_filled(F.col("address_name_fin"), F.col("address_name_swe")).alias("street"), number.alias("housenumber"), _filled(F.col("postal_code")).alias("postcode"), _filled(F.col("postal_office_fin"), F.col("postal_office_swe")).alias("city"), "lat", "lon")
    return out.where(F.col("street").isNotNull() & F.col("housenumber").isNotNull() & _inside(F.col("lat"), F.col("lon"), FINLAND))


def canadian_addresses(addresses: DataFrame, locations: DataFrame) -> DataFrame:
    """Canadian addresses: joined with the table that holds their positions."""
    placed = locations.select("LOC_GUID", F.col("BG_LATITUDE").try_cast("double").alias("lat"), F.col("BG_LONGITUDE").try_cast("double").alias("lon"))
    street = F.concat_ws(" ", _filled(F.col("OFFICIAL_STREET_NAME")), _filled(F.col("OFFICIAL_STREET_TYPE")), _filled(F.col("OFFICIAL_STREET_DIR")))
    number = F.concat(_filled(F.col("CIVIC_NO")), F.coalesce(_filled(F.col("CIVIC_NO_SUFFIX")), F.lit("")))
    out = addresses.join(placed, "LOC_GUID").select(
        text.title_case(street).alias("street"), number.alias("housenumber"), _filled(F.col("MAIL_POSTAL_CODE")).alias("postcode"), text.title_case(_filled(F.col("CSD_ENG_NAME"))).alias("city"), F.col("MAIL_PROV_ABVN").alias("state"), "lat", "lon"
    )
    return out.where("street <> '' AND housenumber IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")


def new_zealand_addresses(rows: DataFrame) -> DataFrame:
    """New Zealand addresses of rows of its layer: units before the number, ranges and suffixes behind it."""
    part = lambda c: F.coalesce(_filled(F.col(c)), F.lit(""))
    number = F.concat(part("address_number"), F.when(part("address_number_high") != "", F.concat(F.lit("-"), part("address_number_high"))).otherwise(""), part("address_number_suffix"))
    number = F.when(part("unit_value") != "", F.concat(part("unit_value"), F.lit("/"), number)).otherwise(number)
    street = text.title_case(F.concat_ws(" ", _filled(F.col("road_name")), _filled(F.col("road_type_name"))))
    kept = rows.where((part("address_number") != "") & (part("road_name") != "") & _inside(F.col("lat"), F.col("lon"), NEW_ZEALAND))
    return kept.select(street.alias("street"), number.alias("housenumber"), _filled(F.col("suburb_locality"), F.col("town_city")).alias("city"), "lat", "lon")


def catalogue(document: str) -> list[dict]:
    """Sources of a catalogue's text: one row for each table below ``country``, with its code, its kind and its settings."""
    return [{"country": code, "kind": kind, **settings} for code, parts in tomllib.loads(document).get("country", {}).items() for kind, settings in [("", {k: v for k, v in parts.items() if not isinstance(v, dict)}), *((k, v) for k, v in parts.items() if isinstance(v, dict))]]


def first_text(value: Column) -> Column:
    """A JSON text, or the first text of a JSON list; null for anything else."""
    listed = F.get(F.from_json(value, "array<string>"), F.lit(0))
    return F.when(value.startswith("["), listed).when(value.startswith('"'), F.get(F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>"), F.lit(0)))
