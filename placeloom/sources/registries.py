"""Readers of national address and place registries, as one table of declarations.

Every registry maps its columns to the address schema; coordinates that are not degrees name
their grid.  Files are read by Spark, so any store that Spark reaches will do.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.functions import projections as pj

Grid = Callable[[Column, Column], tuple[Column, Column]]


@dataclass(frozen=True)
class Registry:
    """How a registry's file maps to addresses; a column given as several names takes the first that is filled."""

    x: str
    y: str
    number: tuple[str, ...]
    street: tuple[str, ...]
    postcode: tuple[str, ...] = ()
    city: tuple[str, ...] = ()
    state: tuple[str, ...] = ()
    suffix: tuple[str, ...] = ()
    sep: str = ","
    encoding: str = "UTF-8"
    decimal_comma: bool = False
    grid: Grid | None = None
    keep: str | None = None
    options: dict = field(default_factory=dict)


#: Column names of the registries' files.
REGISTRIES = {
    "dk_dawa": Registry("wgs84koordinat_længde", "wgs84koordinat_bredde", ("husnr",), ("vejnavn",), ("postnr",), ("postnrnavn",)),
    "no_kartverket": Registry("Øst", "Nord", ("nummer",), ("adressenavn",), ("postnummer",), ("poststed",), suffix=("bokstav",), sep=";", grid=pj.UTM33.inverse),
    "be_best": Registry("EPSG:4326_lon", "EPSG:4326_lat", ("house_number",), ("streetname_nl", "streetname_fr", "streetname_de"), ("postcode",), ("municipality_name_nl", "municipality_name_fr", "municipality_name_de")),
    "fr_ban": Registry("lon", "lat", ("numero",), ("nom_voie",), ("code_postal",), ("nom_commune",), suffix=("rep",), sep=";"),
    "nl_bag": Registry("lon", "lat", ("huisnummer",), ("openbareruimte",), ("postcode",), ("woonplaats",), suffix=("huisletter",), sep=";"),
    "cz_ruian": Registry("Souřadnice Y", "Souřadnice X", ("Číslo orientační", "Číslo domovní"), ("Název ulice", "Název části obce"), ("PSČ",), ("Název obce",), sep=";", encoding="windows-1250", grid=pj.krovak),
    "pl_prg": Registry("X", "Y", ("NUMER",), ("ULICA", "MIEJSCOWOSC"), ("KOD_POCZTOWY",), ("MIEJSCOWOSC",), sep=";", grid=pj.PUWG92.inverse),
    "ee_ads": Registry("VIITEPUNKT_X", "VIITEPUNKT_Y", ("AADRESS_NR",), ("LIIKLUSPIND", "VAIKEKOHT"), ("SIHTNUMBER",), ("ASUSTUSYKSUS",), ("MAAKOND",), sep=";", grid=pj.LEST97.inverse),
    "lv_vzd": Registry("DD_E", "DD_N", ("NOSAUKUMS",), ("IELA",), ("ATRIB",), ("PILSETA",), sep=";"),
    "br_cnefe": Registry("LONGITUDE", "LATITUDE", ("NUM_ENDERECO",), ("NOM_LOGRADOURO",), ("NUM_CEP",), ("NOM_LOCALIDADE",), sep=";", decimal_comma=True),
    "us_openaddresses": Registry("LON", "LAT", ("NUMBER",), ("STREET",), ("POSTCODE",), ("CITY",), ("REGION",)),
    "ca_nar": Registry("BG_LONGITUDE", "BG_LATITUDE", ("CIVIC_NO",), ("OFFICIAL_STREET_NAME",), ("MAIL_POSTAL_CODE",), ("CSD_ENG_NAME",), ("MAIL_PROV_ABVN",), suffix=("CIVIC_NO_SUFFIX",)),
}


def _filled(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of some columns that has a text; columns that the file lacks are passed over."""
    have = [F.col(f"`{n}`") for n in names if n in df.columns]
    texts = [F.when(F.trim(c.cast("string")) != "", F.trim(c.cast("string"))) for c in have]
    return F.coalesce(*texts) if texts else F.lit(None).cast("string")


def _number(c: Column, comma: bool) -> Column:
    text = F.trim(c.cast("string"))
    return (F.translate(text, ",", ".") if comma else text).try_cast("double")


def map_addresses(raw: DataFrame, r: Registry) -> DataFrame:
    """A registry's rows as addresses: street, housenumber, postcode, city, state, lat, lon.

    Rows without street, number or usable coordinates are dropped.
    """
    x, y = _number(F.col(f"`{r.x}`"), r.decimal_comma), _number(F.col(f"`{r.y}`"), r.decimal_comma)
    lat, lon = r.grid(x, y) if r.grid else (y, x)
    number = F.concat(_filled(raw, r.number), F.coalesce(_filled(raw, r.suffix), F.lit("")))
    rows = raw.where(r.keep) if r.keep else raw
    out = rows.select(
        _filled(raw, r.street).alias("street"), number.alias("housenumber"), _filled(raw, r.postcode).alias("postcode"), _filled(raw, r.city).alias("city"), _filled(raw, r.state).alias("state"), lat.alias("lat"), lon.alias("lon")
    )
    usable = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & ~((F.col("lat") == 0) & (F.col("lon") == 0))
    return out.where(F.col("street").isNotNull() & F.col("housenumber").isNotNull() & usable)


def _recoded(raw: DataFrame, code_page: str) -> DataFrame:
    """Texts that were read as Latin-1, in the code page that they were written in."""
    high = "".join(map(chr, range(128, 256)))
    real = "".join(bytes([b]).decode(code_page, "replace") for b in range(128, 256))
    names = {c: c.translate(str.maketrans(high, real)) for c in raw.columns}
    return raw.select(*[F.translate(F.col(f"`{c}`"), high, real).alias(n) for c, n in names.items()])


def read_addresses(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Addresses of a registry's files; gzipped ones too.

    Spark reads no code pages but Latin-1, so others are read as that and translated.
    """
    r = REGISTRIES[name]
    native = r.encoding == "UTF-8"
    reader = spark.read.option("header", True).option("sep", r.sep).option("encoding", "UTF-8" if native else "ISO-8859-1").options(**r.options)
    raw = reader.csv(path)
    return map_addresses(raw if native else _recoded(raw, r.encoding), r)


def swiss(addresses: DataFrame, streets: DataFrame, localities: DataFrame) -> DataFrame:
    """Swiss addresses: entrances joined with street names and postal places; LV95 coordinates."""
    lat, lon = pj.lv95(F.col("ADR_EASTING").cast("double"), F.col("ADR_NORTHING").cast("double"))
    joined = addresses.join(streets.select(F.col("STR_ESID"), F.col("STN_LABEL")), "STR_ESID", "left").join(localities.select("ZIP4", "PLZ_NAME").dropDuplicates(["ZIP4"]), "ZIP4", "left")
    return joined.select(F.col("STN_LABEL").alias("street"), F.col("ADR_NUMBER").alias("housenumber"), F.col("ZIP4").cast("string").alias("postcode"), F.col("PLZ_NAME").alias("city"), F.lit(None).cast("string").alias("state"), lat.alias("lat"), lon.alias("lon")).where("street IS NOT NULL AND housenumber IS NOT NULL")


def austrian(addresses: DataFrame, streets: DataFrame, municipalities: DataFrame) -> DataFrame:
    """Austrian addresses: joined with streets and municipalities; one of three grid zones by EPSG code."""
    east, north = F.translate("RW", ",", ".").cast("double"), F.translate("HW", ",", ".").cast("double")
    zones = {"31254": pj.MGI_M28, "31255": pj.MGI_M31, "31256": pj.MGI_M34}
    lat = lon = F.lit(None).cast("double")
    for code, grid in zones.items():
        a, o = pj.mgi(pj.TransverseMercator(grid.lon0, grid.k0, 0.0, -5000000.0, ellipsoid=grid.ellipsoid), east, north)
        lat, lon = F.when(F.col("EPSG").cast("string") == code, a).otherwise(lat), F.when(F.col("EPSG").cast("string") == code, o).otherwise(lon)
    number = F.concat_ws("", F.col("HAUSNRZAHL1"), F.col("HAUSNRBUCHSTABE1"))
    joined = addresses.join(streets.select("SKZ", "STRASSENNAME"), "SKZ", "left").join(municipalities.select("GKZ", "GEMEINDENAME"), "GKZ", "left")
    return joined.select(F.col("STRASSENNAME").alias("street"), number.alias("housenumber"), F.col("PLZ").cast("string").alias("postcode"), F.col("GEMEINDENAME").alias("city"), F.lit(None).cast("string").alias("state"), lat.alias("lat"), lon.alias("lon")).where("street IS NOT NULL AND housenumber <> '' AND lat IS NOT NULL")


def australian(details: DataFrame, geocodes: DataFrame, streets: DataFrame, localities: DataFrame, states: DataFrame) -> DataFrame:
    """Australian addresses: five tables; details are the large side, the dimensions are left to the planner."""
    street = F.initcap(F.lower(F.concat_ws(" ", "STREET_NAME", "STREET_TYPE_CODE", "STREET_SUFFIX_CODE")))
    number = F.concat_ws("", F.col("NUMBER_FIRST"), F.col("NUMBER_FIRST_SUFFIX"))
    joined = (
        details.select("ADDRESS_DETAIL_PID", "STREET_LOCALITY_PID", "LOCALITY_PID", "NUMBER_FIRST", "NUMBER_FIRST_SUFFIX", "POSTCODE")
        .join(geocodes.select("ADDRESS_DETAIL_PID", "LATITUDE", "LONGITUDE"), "ADDRESS_DETAIL_PID")
        .join(streets.select("STREET_LOCALITY_PID", "STREET_NAME", "STREET_TYPE_CODE", "STREET_SUFFIX_CODE"), "STREET_LOCALITY_PID")
        .join(localities.select("LOCALITY_PID", "LOCALITY_NAME", "STATE_PID"), "LOCALITY_PID")
        .join(states.select("STATE_PID", "STATE_ABBREVIATION"), "STATE_PID", "left")
    )
    return joined.select(street.alias("street"), number.alias("housenumber"), F.col("POSTCODE").cast("string").alias("postcode"), F.initcap(F.lower("LOCALITY_NAME")).alias("city"), F.col("STATE_ABBREVIATION").alias("state"), F.col("LATITUDE").cast("double").alias("lat"), F.col("LONGITUDE").cast("double").alias("lon")).where("housenumber <> ''")


def korean(roads: DataFrame, buildings: DataFrame) -> DataFrame:
    """Korean addresses: buildings (road_code, main, sub, zip, lat, lon) joined with road names."""
    number = F.concat(F.col("main").cast("string"), F.when(F.col("sub").cast("int") > 0, F.concat(F.lit("-"), F.col("sub").cast("string"))).otherwise(""))
    joined = buildings.join(roads, "road_code")
    return joined.select(F.col("road").alias("street"), number.alias("housenumber"), F.col("zip").cast("string").alias("postcode"), F.col("city"), F.col("state"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))


#: Feature classes of the US gazetteer and of the German one that are kept, as place types.
GNIS_TYPES = {"Populated Place": "locality", "Summit": "mountain", "Range": "mountain", "Stream": "river", "Lake": "lake", "Reservoir": "lake", "Island": "island", "Bay": "bay", "Cape": "cape", "Forest": "forest", "Airport": "airport", "Park": "park", "Hospital": "hospital", "Civil": "county"}
GN250_TYPES = {"AX_Ortslage": "locality", "AX_Gemeinde": "town", "AX_Insel": "island", "AX_StehendesGewaesser": "lake", "AX_Gewaesserachse": "river", "AX_Wald": "forest", "AX_Flugverkehr": "airport", "AX_Bahnverkehrsanlage": "station"}


def gnis_places(spark: SparkSession, path: str) -> DataFrame:
    """US gazetteer: name, kind, state, lat, lon of the classes that are kept."""
    raw = spark.read.option("header", True).option("sep", "|").csv(path)
    listed = F.create_map(*[F.lit(x) for kv in GNIS_TYPES.items() for x in kv])
    out = raw.select(F.col("feature_id").cast("bigint").alias("osm_id"), F.col("feature_name").alias("name"), F.try_element_at(listed, F.col("feature_class")).alias("kind"), F.col("state_name").alias("state"), F.col("prim_lat_dec").cast("double").alias("lat"), F.col("prim_long_dec").cast("double").alias("lon"))
    return out.where("kind IS NOT NULL AND NOT (lat = 0 AND lon = 0)")


def gn250_places(spark: SparkSession, path: str) -> DataFrame:
    """German gazetteer: name, kind, lat, lon; UTM zone 32 coordinates."""
    raw = spark.read.option("header", True).option("sep", ";").csv(path)
    lat, lon = pj.UTM32.inverse(F.col("RECHTS").cast("double"), F.col("HOCH").cast("double"))
    listed = F.create_map(*[F.lit(x) for kv in GN250_TYPES.items() for x in kv])
    return raw.select(F.col("NNID").alias("source_id"), F.col("NAME").alias("name"), F.try_element_at(listed, F.col("OBA")).alias("kind"), lat.alias("lat"), lon.alias("lon")).where("kind IS NOT NULL")


def zip_crosswalk(spark: SparkSession, path: str) -> DataFrame:
    """US ZIP rows: zip, city, state, county, lat, lon."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(F.lpad("zip", 5, "0").alias("zip"), "city", F.col("state_id").alias("state"), F.col("county_name").alias("county"), F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lon"))
