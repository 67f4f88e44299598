"""Resolving names and codes to administrative areas, countries and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placeloom.functions import address, geo
from placeloom.operators import spatial

#: Place types that a city's name may mean.
SETTLEMENTS = ("city", "town", "village", "hamlet", "suburb", "quarter", "neighbourhood")


def resolve_cities(queries: DataFrame, places: DataFrame, settlements_only: bool = False) -> DataFrame:
    """(query_id, admin1, admin2, lat_u, lon_u) of the most important place of every city name.

    A query may name the states (array of admin1 ids) that the place must lie in.
    """
    named = places.where(F.col("kind").isin(list(SETTLEMENTS))) if settlements_only else places
    named = named.select(F.lower("name").alias("key"), "record_id", "importance", "admin1", "admin2", "lat_u", "lon_u")
    met = queries.withColumn("key", F.lower("city")).join(named, "key")
    met = met.where(F.col("states").isNull() | (F.size("states") == 0) | F.array_contains("states", F.col("admin1")))
    order = F.struct((-F.col("importance")).alias("minus"), "record_id", "admin1", "admin2", "lat_u", "lon_u")
    return met.groupBy("query_id").agg(F.min(order).alias("b")).select("query_id", "b.admin1", "b.admin2", "b.lat_u", "b.lon_u")


def state_areas(codes: DataFrame, admin: DataFrame) -> DataFrame:
    """(code, ids): areas without a parent that are named like the state of a code, or so with a bracket behind."""
    asked = codes.withColumn("state", F.lower(address.state_name(F.col("code")))).where("state IS NOT NULL")
    top = admin.where("parent_id IS NULL").select("admin_id", F.trim(F.regexp_replace(F.lower("name"), r"\s*\(.*$", "")).alias("state"))
    return asked.join(top, "state").groupBy("code").agg(F.array_sort(F.collect_set("admin_id")).alias("ids"))


def postcode_countries(queries: DataFrame, postcodes: DataFrame, places: DataFrame, metres: float = 80000.0) -> DataFrame:
    """(query_id, country, metres): of the countries that know a postcode, the one whose place of the city's name, or of one of its words, is nearest."""
    held = queries.join(postcodes.select("postcode", "country", F.col("lat_u").alias("p_lat"), F.col("lon_u").alias("p_lon")), "postcode")
    words = F.filter(F.split("city", r"\s+"), lambda w: F.length(F.regexp_replace(w, r"[^\p{L}]", "")) >= 2)
    asked = held.withColumn("key", F.explode(F.array_distinct(F.transform(F.concat(F.array("city"), words), F.lower))))
    named = places.select(F.lower("name").alias("key"), "country", "lat_u", "lon_u")
    far = F.round(geo.haversine_m(F.col("p_lat"), F.col("p_lon"), F.col("lat_u"), F.col("lon_u")), 3)
    met = asked.join(named, ["key", "country"]).withColumn("metres", far)
    best = met.groupBy("query_id").agg(F.min(F.struct("metres", "country")).alias("b"))
    return best.where(F.col("b.metres") <= metres).select("query_id", "b.country", "b.metres")


def parent_counties(municipalities: DataFrame, polygons: DataFrame, centroids: DataFrame) -> DataFrame:
    """(admin_id, parent_id, how): the county whose polygon holds a municipality's centre, else the nearest one."""
    points = municipalities.select(F.col("admin_id").alias("point_id"), "lat_u", "lon_u")
    found = spatial.assign_admin(points, polygons, centroids)
    return found.select(F.col("point_id").alias("admin_id"), F.col("admin_id").alias("parent_id"), "how")


def own_polygons(regions: DataFrame, polygons: DataFrame) -> DataFrame:
    """(osm_id, n_rings, holds): the rings of every region by its id, and whether a single ring holds the region's own centre."""
    met = regions.join(polygons.select("osm_id", "ring"), "osm_id", "left")
    inside = F.coalesce(geo.in_ring(F.col("lat_u"), F.col("lon_u"), F.col("ring")), F.lit(False))
    return met.groupBy("osm_id").agg(F.count("ring").alias("n_rings"), F.max(inside).alias("holds"))


def parent_populations(places: DataFrame, admin: DataFrame) -> DataFrame:
    """``places`` with the larger population of their two areas, 0 without one."""
    people = admin.select("admin_id", "population")
    first, second = (people.select(F.col("admin_id").alias(c), F.col("population").alias(f"{c}_people")) for c in ("admin1", "admin2"))
    out = places.join(first, "admin1", "left").join(second, "admin2", "left")
    return out.withColumn("parent_population", F.greatest(F.coalesce("admin1_people", F.lit(0)), F.coalesce("admin2_people", F.lit(0)))).drop("admin1_people", "admin2_people")


def area_names(hits: DataFrame, by_polygon: DataFrame, admin: DataFrame) -> DataFrame:
    """``hits`` (record_id, admin_id) with an area's name: of the polygon that holds them (record_id, area_id), else of the stored area."""
    met = hits.join(by_polygon, "record_id", "left").withColumn("named_id", F.coalesce("area_id", "admin_id"))
    return met.join(admin.select(F.col("admin_id").alias("named_id"), F.col("name").alias("area")), "named_id", "left").drop("named_id", "area_id")


def hashed_anti(new: DataFrame, old: DataFrame) -> DataFrame:
    """New addresses without an old one of the same street and number in the nine cells of 1e-4 degrees around."""
    keyed = lambda df: df.withColumn("k", F.xxhash64(F.lower("street"), F.lower("housenumber")))
    cell = lambda c, shift: F.floor((F.col(c) + shift) / 100).cast("bigint")
    placed = keyed(old).select("k", F.lower("street").alias("o_street"), F.lower("housenumber").alias("o_number"), cell("lat_u", 90_000_000).alias("y"), cell("lon_u", 180_000_000).alias("x"))
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    around = placed.withColumn("s", F.explode(steps)).select("k", "o_street", "o_number", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    asked = keyed(new).withColumn("y", cell("lat_u", 90_000_000)).withColumn("x", cell("lon_u", 180_000_000))
    same = (asked["k"] == around["k"]) & (asked["y"] == around["y"]) & (asked["x"] == around["x"]) & (F.lower(asked["street"]) == around["o_street"]) & (F.lower(asked["housenumber"]) == around["o_number"])
    return asked.join(around, same, "left_anti").drop("k", "y", "x")


def changed_sources(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(source, why): sources that are new, or whose sequence, checksum or tag differs from the state kept; the first that tells."""
    kept = previous.select("source", F.col("sequence").alias("o_sequence"), F.col("md5").alias("o_md5"), F.col("etag").alias("o_etag"), F.lit(True).alias("known"))
    met = current.join(kept, "source", "left")
    differs = lambda c: F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"o_{c}"))
    why = F.when(F.col("known").isNull(), "new").when(differs("sequence"), "sequence").when(differs("md5"), "md5").when(F.col("sequence").isNull() & F.col("md5").isNull() & differs("etag"), "etag")
    return met.withColumn("why", why).where("why IS NOT NULL").select("source", "why")


def active_keys(keys: DataFrame, users: DataFrame, used: DataFrame, tiers: dict[str, int], month_first_day: int) -> DataFrame:
    """(key_id, quota, month_to_date) of keys in force: the key's own quota else its user's tier's, and what it has used this month."""
    met = keys.where("revoked_at IS NULL").join(users.where("active").select("user_id", "tier"), "user_id")
    listed = F.create_map(*[F.lit(x) for kv in tiers.items() for x in kv])
    spent = used.where(F.col("day") >= month_first_day).groupBy("key_id").agg(F.sum("requests").alias("month_to_date"))
    out = met.withColumn("quota", F.coalesce("quota", F.try_element_at(listed, F.col("tier")))).join(spent, "key_id", "left")
    return out.select("key_id", "quota", F.coalesce("month_to_date", F.lit(0)).alias("month_to_date"))


def weighted_sample(places: DataFrame, seed: int) -> DataFrame:
    """Places taken with a probability that grows with their importance: (importance + 100) / (most + 100), by a seeded hash of the id."""
    most = places.agg(F.coalesce(F.max("importance"), F.lit(0))).first()[0]
    drawn = F.pmod(F.xxhash64("record_id", F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return places.where(drawn <= (F.col("importance") + 100) / F.lit(float(most + 100)))


def address_tags(addresses: DataFrame) -> DataFrame:
    """(tag, filled, missing) of the columns of addresses."""
    tags = ("street", "housenumber", "postcode", "city")
    filled = lambda c: F.sum(F.when(F.coalesce(F.trim(F.col(c)) != "", F.lit(False)), 1).otherwise(0))
    one = addresses.agg(F.count("*").alias("n"), *[filled(c).alias(c) for c in tags])
    rows = F.array(*[F.struct(F.lit(c).alias("tag"), F.coalesce(F.col(c), F.lit(0)).alias("filled"), (F.col("n") - F.coalesce(F.col(c), F.lit(0))).alias("missing")) for c in tags])
    return one.select(F.explode(rows).alias("r")).select("r.tag", "r.filled", "r.missing")


def request_metrics(requests: DataFrame, bounds: tuple[float, ...]) -> DataFrame:
    """(endpoint, le, n): requests of every endpoint that took at most so long, by bucket bound, infinity last."""
    le = F.explode(F.array(*[F.lit(float(b)) for b in bounds], F.lit(float("inf")))).alias("le")
    counted = requests.groupBy("endpoint", F.element_at(F.filter(F.array(*[F.lit(float(b)) for b in bounds], F.lit(float("inf"))), lambda b: F.col("seconds") <= b), 1).alias("own")).agg(F.count("*").alias("n"))
    spread = counted.select("endpoint", "own", "n", le).where(F.col("own") <= F.col("le"))
    return spread.groupBy("endpoint", "le").agg(F.sum("n").alias("n"))


def arrival_ids(records: DataFrame, by: list[str], buckets: int = 64) -> DataFrame:
    """``records`` with ids from 1 in the order of ``by``; numbers are dealt in ranges of the first column, shifted by the sizes of those before."""
    cuts = records.agg(F.percentile_approx(by[0], [i / buckets for i in range(1, buckets)])).first()[0]
    borders = F.array(*[F.lit(c) for c in sorted(set(cuts or []))]) if cuts else None
    part = F.size(F.filter(borders, lambda b: b < F.col(by[0]))) if cuts else F.lit(0)
    dealt = records.withColumn("__part", part)
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("n"))
    # one row for each range
    before = sizes.select("__part", F.coalesce(F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    ranked = dealt.withColumn("__at", F.row_number().over(W.partitionBy("__part").orderBy(*by)))
    return ranked.join(F.broadcast(before), "__part").withColumn("arrival_id", F.col("__before") + F.col("__at")).drop("__part", "__before", "__at")
