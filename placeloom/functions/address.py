"""Addresses: house numbers, postcodes, display names, structured queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes of the states.
US_STATES = dict(
    p.split(":")
    for p in (
        "AL:Alabama AK:Alaska AZ:Arizona AR:Arkansas CA:California CO:Colorado CT:Connecticut DE:Delaware FL:Florida GA:Georgia HI:Hawaii ID:Idaho "
        "IL:Illinois IN:Indiana IA:Iowa KS:Kansas KY:Kentucky LA:Louisiana ME:Maine MD:Maryland MA:Massachusetts MI:Michigan MN:Minnesota MS:Mississippi "
        "MO:Missouri MT:Montana NE:Nebraska NV:Nevada NH:New_Hampshire NJ:New_Jersey NM:New_Mexico NY:New_York NC:North_Carolina ND:North_Dakota OH:Ohio "
        "OK:Oklahoma OR:Oregon PA:Pennsylvania RI:Rhode_Island SC:South_Carolina SD:South_Dakota TN:Tennessee TX:Texas UT:Utah VT:Vermont VA:Virginia "
        "WA:Washington WV:West_Virginia WI:Wisconsin WY:Wyoming DC:District_of_Columbia PR:Puerto_Rico"
    ).split()
)
UK_POSTCODE = r"^[A-Za-z]{1,2}[0-9][A-Za-z0-9]? ?[0-9][A-Za-z]{2}$"
POSTCODE = r"^(?:[0-9]{4,7}|[0-9]{2,3} [0-9]{2,3})$"
COUNTRY_POSTCODE = r"^[A-Za-z]{2}[- ]([0-9]{4,6})(?: ?[A-Za-z]{2})?$"


def house_number(text: Column) -> Column:
    """Leading number (0 if none or over 16 bits) and the place of a letter right behind it."""
    digits = F.regexp_extract(text, r"^\s*([0-9]+)", 1)
    number = F.try_to_number(digits, F.lit("9" * 18)).cast("bigint")
    letter = F.upper(F.regexp_extract(text, r"^\s*[0-9]+([A-Za-z])", 1))
    return F.struct(
        F.when((F.length(digits) > 0) & (number <= 65535), number.cast("int")).otherwise(0).alias("number"),
        F.when(F.length(letter) > 0, F.ascii(letter) - 64).otherwise(0).alias("suffix"),
    )


def house_label(number: Column, suffix: Column) -> Column:
    """A house number as it is written."""
    return F.concat(number.cast("string"), F.when(suffix > 0, F.char(suffix + 64)).otherwise(""))


def normal_postcode(text: Column) -> Column:
    """Upper case without spaces and hyphens."""
    return F.regexp_replace(F.upper(text), "[ -]", "")


def postcode_of(text: Column) -> Column:
    """The postcode if the text has a postcode's shape, else null."""
    t = F.trim(text)
    prefixed = F.regexp_extract(t, COUNTRY_POSTCODE, 1)
    return F.when(t.rlike(POSTCODE) | t.rlike(UK_POSTCODE), normal_postcode(t)).when(prefixed != "", prefixed)


def us_zip(text: Column) -> Column:
    """Five digits of a ZIP or ZIP+4, else null."""
    five = F.regexp_extract(F.trim(text), r"^([0-9]{5})(?:-[0-9]{4})?$", 1)
    return F.when(five != "", five)


def state_name(code: Column) -> Column:
    """Name of a state's two letters, else null."""
    listed = F.create_map(*[F.lit(x) for kv in US_STATES.items() for x in (kv[0], kv[1].replace("_", " "))])
    return F.try_element_at(listed, F.upper(F.trim(code)))


def parse_address(text: Column) -> Column:
    """street, number, suffix, postcode, city of "street number[, postcode] [city]"; fields may be null."""
    pattern = r"^\s*([^0-9,][^,]*?)\s+([0-9]+)\s*([A-Za-z]?)(?:-[0-9]+[A-Za-z]?)?\s*(?:,\s*|\s+|$)(?:([0-9]{3} ?[0-9]{2,4}|[0-9]{4,6})\b\s*)?(.*?)\s*$"
    part = lambda i: F.when(F.regexp_extract(text, pattern, i) != "", F.regexp_extract(text, pattern, i))
    return F.struct(
        part(1).alias("street"), part(2).cast("int").alias("number"), F.upper(part(3)).alias("suffix"), F.regexp_replace(part(4), " ", "").alias("postcode"), part(5).alias("city")
    )


def display_name(parts: list[Column], postcode: Column | None = None) -> Column:
    """Parts that are neither empty nor repeated, joined by commas; a postcode is never taken for a repeat."""
    named = F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != ""))
    listed = F.array_distinct(named)
    if postcode is not None:
        listed = F.concat(listed, F.when(postcode.isNotNull() & (postcode != ""), F.array(postcode)).otherwise(F.array().cast("array<string>")))
    return F.array_join(listed, ", ")


def structured_query(*parts: Column) -> Column:
    """The parts that are not blank, joined by commas; null if none is."""
    named = F.filter(F.array(*[F.trim(p) for p in parts]), lambda p: p.isNotNull() & (p != ""))
    return F.when(F.size(named) > 0, F.array_join(named, ", "))


def qid(text: Column) -> Column:
    """Number of a Q identifier, null for other texts."""
    digits = F.regexp_extract(F.trim(text), r"^[Qq]([0-9]{1,18})$", 1)
    return F.when(digits != "", digits.cast("bigint"))


def synthetic_box(lat_deg: Column, lon_deg: Column) -> Column:
    """South, north, west, east of a small box around a point, seven decimals each."""
    half = 0.00045
    return F.array(*[F.format_string("%.7f", x) for x in (lat_deg - half, lat_deg + half, lon_deg - half, lon_deg + half)])


#: Words before a flat's number.
UNIT_WORDS = (" apt ", " apt. ", " ste ", " ste. ", " suite ", " unit ", " #")
#: Territories with codes of their own.
TERRITORIES = ("VI", "GU", "AS", "MP")
#: Words for thoroughfares, by which a number in front is taken for a house number.
STREET_WORDS = tuple(
    "rue avenue av av. boulevard bd bd. blvd allée allee all all. chemin ch ch. impasse imp imp. place pl pl. passage pass route rte voie quai qu qu. cours crs promenade prom prom. "
    "esplanade rond-point square sq sq. cité cite villa venelle sentier ruelle faubourg faub fbg parvis straße strasse str. str weg platz gasse ufer damm ring chaussee graben markt steig "
    "stieg brücke brucke street st st. road rd rd. lane ln drive dr dr. court ct way highway hwy parkway pkwy terrace ter circle cir trail tr tr. via viale piazza pza p.zza vicolo corso "
    "largo salita lungomare calle c. avenida avda carrer plaza plaça paseo rambla ronda travesía travesia praça straat laan plein kade gracht singel dijk lei".split()
)


def is_uk_postcode(text: Column) -> Column:
    """Whether a text has the shape of a British postcode, spaced or not."""
    clean = F.regexp_replace(F.upper(text), r"\s", "")
    outward, inward = F.substring(clean, F.lit(1), F.length(clean) - 3), F.substring(clean, -3, 3)
    shaped = inward.rlike("^[0-9][A-Z]{2}$") & outward.rlike("^[A-Z]{1,2}(?![A-Z])") & outward.rlike("[0-9]")
    return F.length(clean).between(5, 7) & clean.rlike(r"^[\x00-\x7F]*$") & shaped


def without_unit(text: Column) -> Column:
    """An address without its flat: what stands before the first unit word, tried in a fixed order."""
    lower = F.lower(text)
    out = F
    for word in UNIT_WORDS:
        at = F.instr(lower, F.lit(word))
        out = out.when(at > 0, F.trim(F.substring(text, F.lit(1), at - 1)))
    return out.otherwise(text)


def state_code(text: Column) -> Column:
    """Two letters of a state by its code or name, else null."""
    upper = F.upper(F.trim(text))
    by_name = F.create_map(*[F.lit(x) for code, name in US_STATES.items() for x in (name.replace("_", " ").upper(), code)])
    return F.when(upper.isin([*US_STATES, *TERRITORIES]), upper).otherwise(F.try_element_at(by_name, upper))


def without_state(text: Column) -> Column:
    """(rest, state) of a place name that ends in a state: behind a comma, as two letters, or as a name of up to three words, longest first."""
    trimmed = F.trim(text)
    head = F.trim(F.regexp_extract(trimmed, r"^(.*),[^,]*$", 1))
    tail = state_code(F.regexp_extract(trimmed, r",([^,]*)$", 1))
    words = F.split(F.regexp_replace(trimmed, r"\s+", " "), " ")
    out = F.when((head != "") & tail.isNotNull(), F.struct(head.alias("rest"), tail.alias("state")))
    last = F.element_at(words, -1)
    for take, rule in ((1, last.rlike("^[A-Za-z]{2}$")), (3, F.lit(True)), (2, F.lit(True)), (1, F.lit(True))):
        code = state_code(F.array_join(F.slice(words, -take, take), " "))
        rest = F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - take, F.lit(0))), " ")
        out = out.when((F.size(words) > take) & rule & code.isNotNull(), F.struct(rest.alias("rest"), code.alias("state")))
    return out.otherwise(F.struct(trimmed.alias("rest"), F.lit(None).cast("string").alias("state")))


def disambiguated(text: Column) -> Column:
    """(head, context) of "X, Y" at the last comma; null if either is empty or the context begins with a digit."""
    trimmed = F.trim(text)
    head, last = (F.trim(F.regexp_extract(trimmed, r"^(.*),([^,]*)$", i)) for i in (1, 2))
    return F.when((head != "") & (last != "") & ~last.rlike("^[0-9]"), F.struct(head.alias("head"), last.alias("context")))


def street_query(text: Column) -> Column:
    """(street, city) of "street, city": split at the first comma, the street in lower case, no number in front."""
    trimmed = F.trim(text)
    street, city = (F.trim(F.regexp_extract(trimmed, r"^([^,]*),(.*)$", i)) for i in (1, 2))
    return F.when((F.octet_length(street) >= 2) & (city != "") & ~street.rlike("^[0-9]"), F.struct(F.lower(street).alias("street"), city.alias("city")))


def without_postal_letter(city: Column) -> Column:
    """A city without the letter of its postal district."""
    words = F.filter(F.split(city, r"\s+"), lambda w: w != "")
    letters = F.length(F.regexp_replace(F.element_at(words, -1), r"[^\p{L}]", ""))
    return F.when((F.size(words) >= 2) & (letters == 1), F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ")).otherwise(city)


def city_postcode(text: Column) -> Column:
    """(city, postcode) of "114 56 City", "11456 City" or "City"; both null for an empty text."""
    t = F.trim(text)
    spaced, plain = r"^([0-9]{3,})\s+([0-9]{2})(?:\s+(.*))?$", r"^([0-9]{3,})(?:\s+(.*))?$"
    named = lambda c: F.when(c != "", without_postal_letter(F.regexp_replace(c, r"\s+", " ")))
    pair = lambda city, code: F.struct(city.alias("city"), code.alias("postcode"))
    none = F.lit(None).cast("string")
    return (
        F.when(t == "", pair(none, none))
        .when(t.rlike(spaced), pair(named(F.regexp_extract(t, spaced, 3)), F.concat(F.regexp_extract(t, spaced, 1), F.lit(" "), F.regexp_extract(t, spaced, 2))))
        .when(t.rlike(plain), pair(named(F.regexp_extract(t, plain, 2)), F.regexp_extract(t, plain, 1)))
        .otherwise(pair(without_postal_letter(t), none))
    )


def street_number(text: Column) -> Column:
    """(street, number) of "street 15B" or, where a thoroughfare word follows, "15 street"; null without a number."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    first, rest = F.get(words, F.lit(0)), F.slice(words, 2, 1 << 30)
    known = F.exists(rest, lambda w: F.regexp_replace(F.lower(w), r"^[^\p{L}\p{N}.]+|[^\p{L}\p{N}.]+$", "").isin(list(STREET_WORDS)))
    leads = first.rlike("^[0-9]{1,4}[A-Za-z]{0,6}$") & (F.size(words) >= 3) & known
    at = F.array_position(F.transform(rest, lambda w: w.rlike("^[0-9]")), True).cast("int")
    behind = F.struct(F.array_join(F.slice(words, F.lit(1), F.greatest(at, F.lit(1))), " ").alias("street"), F.get(words, at).alias("number"))
    return F.when(leads, F.struct(F.array_join(rest, " ").alias("street"), first.alias("number"))).when(at > 0, behind)


def parsed_address(text: Column) -> Column:
    """street (lower case), number, postcode, city of an address in words; null if there is no house number.

    The part before the first comma has street and number; a city may follow the number, or stand
    with its postcode behind the comma.
    """
    t = F.trim(text)
    head, tail = F.trim(F.regexp_extract(t, "^([^,]*)", 1)), F.trim(F.regexp_extract(t, "^[^,]*,(.*)$", 1))

    def whole(found: Column) -> Column:
        number = found["number"]
        after = F.trim(F.regexp_extract(F.substring(head, F.instr(head, number) + F.length(number), F.length(head)), r"^\S*\s+(.*)$", 1))
        place = F.when(tail != "", city_postcode(tail)).otherwise(
            F.struct(F.when(after.rlike(r"^\p{L}"), after).alias("city"), F.lit(None).cast("string").alias("postcode"))
        )
        plain = F.lower(F.trim(F.regexp_extract(number, "^([^-]*)", 1)))
        return F.when(
            found.isNotNull() & (F.length(found["street"]) > 0),
            F.struct(F.lower(found["street"]).alias("street"), plain.alias("number"), place["postcode"].alias("postcode"), place["city"].alias("city")),
        )

    return F.transform(F.array(street_number(head)), whole)[0]
