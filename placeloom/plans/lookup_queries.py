"""More registered queries: addresses in words, names resolved to areas, labels, codes, projections and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.functions import address, codecs, labels, projections, text
from placeloom.operators import resolve, search, spatial, streets
from placeloom.plans import fixtures as fx
from placeloom.plans.fixtures import hav, with_tables
from placeloom.plans.queries import _CELLS, _TOKENS, query

_CHAR = "chr(CAST(97 + {} AS INTEGER))"


def _letter(k):
    return F.char(97 + k)


# --- addresses in words ----------------------------------------------------------------------


@query("fuzzy_lev2", f"WITH {_TOKENS} SELECT a.key AS query_id, a.key AS key, b.key AS hit, CAST(levenshtein(a.key, b.key) AS INTEGER) AS distance FROM w a JOIN w b ON abs(len(a.key) - len(b.key)) <= 2 AND levenshtein(a.key, b.key) <= 2")
def fuzzy_lev2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark within two edits of each other."""
    words = fx.table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("key")).distinct()
    return search.within_two_edits(words.select(F.col("key").alias("query_id"), "key"), words)


@query(
    "nearest_house",
    f"{with_tables('points', 'addresses')}, pc AS (SELECT *, least(floor((lon_u + 180000000) * 32768 / 360000000), 32767) AS gx, least(floor((lat_u + 90000000) * 32768 / 180000000), 32767) AS gy FROM points), "
    "ac AS (SELECT *, least(floor((lon_u + 180000000) * 32768 / 360000000), 32767) AS gx, least(floor((lat_u + 90000000) * 32768 / 180000000), 32767) AS gy FROM addresses), "
    f"m AS (SELECT point_id, {hav('pc.lat_u', 'pc.lon_u', 'ac.lat_u', 'ac.lon_u')} AS metres, osm_id, street, housenumber, postcode FROM pc JOIN ac ON abs(pc.gx - ac.gx) <= 1 AND abs(pc.gy - ac.gy) <= 1) "
    "SELECT * FROM m WHERE metres <= 200 QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY metres, osm_id) = 1",
)
def nearest_house(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest address within 200 m of every point."""
    return streets.nearest_house(fx.points(spark, sf_dir), fx.addresses(spark, sf_dir))


_GATA = "'Gata' || " + _CHAR.format("k % 23") + " || " + _CHAR.format("k // 23 % 23")


def _gata(k):
    return F.concat(F.lit("Gata"), _letter(k % 23), _letter(F.floor(k / 23) % 23))


_WORDED = (
    f"o AS (SELECT o_orderkey AS osm_id, o_orderkey AS k, {_GATA.replace('k ', 'o_orderkey ')} AS street, CAST(o_orderkey % 97 + 1 AS INTEGER) AS number, CAST(o_orderkey % 4 AS INTEGER) AS suffix, "
    f"'Stad' || {_CHAR.format('o_custkey % 13')} AS city, lpad(CAST(o_orderkey % 503 AS VARCHAR), 5, '1') AS postcode, CAST(59000000 + (o_orderkey * 7919) % 200003 AS BIGINT) AS lat_u, CAST(18000000 + (o_orderkey * 104729) % 400009 AS BIGINT) AS lon_u FROM orders)"
)


def _worded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses whose streets and cities are words."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return fx.table(spark, sf_dir, "orders").select(
        k.alias("osm_id"), _gata(k).alias("street"), (k % 97 + 1).cast("int").alias("number"), (k % 4).cast("int").alias("suffix"), F.concat(F.lit("Stad"), _letter(c % 13)).alias("city"),
        F.lpad((k % 503).cast("string"), 5, "1").alias("postcode"), fx.lat(k).alias("lat_u"), fx.lon(k).alias("lon_u"),
    )


_FORM = "osm_id % 4"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every address in one of four ways to write it."""
    a = _worded(spark, sf_dir)
    number = address.house_label(F.col("number"), F.col("suffix"))
    form = F.col("osm_id") % 4
    typed = (
        F.when(form == 0, F.concat("street", F.lit(" "), number, F.lit(", "), "postcode", F.lit(" "), "city", F.lit(" K")))
        .when(form == 1, F.concat(F.lit(" "), "street", F.lit(" "), number, F.lit("-9 "), "city"))
        .when(form == 2, F.concat(number, F.lit(" rue "), "street", F.lit(", "), "city"))
        .otherwise(F.concat("street", F.lit(" "), number))
    )
    return a.select("osm_id", typed.alias("q"), F.col("osm_id").alias("query_id"))


@query(
    "parse_addresses",
    f"WITH {_WORDED}, n AS (SELECT *, number || CASE WHEN suffix > 0 THEN chr(CAST(suffix + 64 AS INTEGER)) ELSE '' END AS label FROM o) SELECT osm_id, CASE {_FORM} WHEN 2 THEN 'rue ' || lower(street) ELSE lower(street) END AS street, lower(label) AS number, "
    f"CASE {_FORM} WHEN 0 THEN postcode END AS postcode, CASE {_FORM} WHEN 3 THEN NULL ELSE city END AS city FROM n",
)
def parse_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Street, number, postcode and city of addresses in words."""
    return _asked(spark, sf_dir).select("osm_id", address.parsed_address(F.col("q")).alias("p")).select("osm_id", "p.street", "p.number", "p.postcode", "p.city")


@query(
    "address_search",
    f"WITH {_WORDED}, q AS (SELECT osm_id AS query_id, lower(street) AS street, number, suffix, CASE {_FORM} WHEN 3 THEN NULL ELSE lower(city) END AS q_city, CASE {_FORM} WHEN 0 THEN postcode END AS q_postcode FROM o WHERE {_FORM} <> 2), "
    "m AS (SELECT query_id, CASE WHEN q_city = lower(o.city) THEN 0 WHEN q_postcode = o.postcode THEN 1 WHEN q_city IS NULL AND q_postcode IS NULL THEN 2 ELSE 3 END AS rank, o.osm_id, o.lat_u, o.lon_u FROM q JOIN o ON q.street = lower(o.street) AND q.number = o.number AND q.suffix = o.suffix) "
    "SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, osm_id) = 1",
)
def address_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in words, looked up."""
    return streets.search_addresses(_asked(spark, sf_dir), _worded(spark, sf_dir))


@query(
    "street_and_city",
    f"WITH p AS (SELECT DISTINCT p_name AS name FROM part), q AS (SELECT o_orderkey AS query_id, {_GATA.replace('k ', 'o_orderkey ')} AS street, p_name AS city FROM orders JOIN part ON p_partkey = o_custkey % 40 + 1), "
    "w AS (SELECT query_id, string_split(street || ' ' || city, ' ') AS w FROM q), c AS (SELECT query_id, w, unnest(range(1, least(len(w) - 1, 3) + 1)) AS n FROM w), "
    "s AS (SELECT query_id, n, lower(array_to_string(w[:len(w) - n], ' ')) AS street, array_to_string(w[len(w) - n + 1:], ' ') AS city FROM c) SELECT query_id, street, city FROM s WHERE lower(city) IN (SELECT lower(name) FROM p) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n) = 1",
)
def street_and_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streets and cities of texts without a comma."""
    parts = fx.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    orders = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), _gata(F.col("o_orderkey")).alias("street"), (F.col("o_custkey") % 40 + 1).alias("p_partkey"))
    asked = orders.join(parts, "p_partkey").select("query_id", F.concat_ws(" ", "street", "p_name").alias("q"))
    return streets.street_and_city(asked, parts.select(F.col("p_name").alias("name")))


_DJB2 = "(list_reduce(list_prepend(CAST(5381 AS BIGINT), list_transform(string_split(lower(city), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, b: (h * 33 + b) % 4294967296) % 65534 + 1)"


@query(
    "street_tiers",
    f"{with_tables('addresses')}, s0 AS (SELECT street, CAST(muni AS BIGINT) AS muni, arg_min(display, osm_id) AS display, CAST(sum(lat_u) // count(*) AS BIGINT) AS mean_lat, CAST(sum(lon_u) // count(*) AS BIGINT) AS mean_lon FROM addresses GROUP BY 1, 2), "
    f"h AS (SELECT city, {_DJB2} AS muni FROM (SELECT DISTINCT 'city ' || (c_custkey % 5) AS city FROM customer)), s AS (SELECT * FROM s0 UNION ALL SELECT street, h.muni, display || '!', mean_lat, mean_lon FROM s0 JOIN h ON s0.muni = 3), "
    "q AS (SELECT c_custkey AS query_id, 'street ' || (c_custkey % 211) AS street, c_custkey % 11 AS muni, 'city ' || (c_custkey % 9) AS city, CAST(59000000 + (c_custkey * 7919) % 200003 AS BIGINT) AS near_lat, CAST(18000000 + (c_custkey * 104729) % 400009 AS BIGINT) AS near_lon FROM customer), "
    f"k AS (SELECT *, {_DJB2} AS city_key FROM q), m AS (SELECT query_id, CASE WHEN k.muni = s.muni THEN 0 WHEN city_key = s.muni THEN 1 WHEN {hav('near_lat', 'near_lon', 'mean_lat', 'mean_lon')} < 15000 THEN 2 END AS tier, {hav('near_lat', 'near_lon', 'mean_lat', 'mean_lon')} AS far, s.muni, display FROM k JOIN s ON k.street = s.street) "
    "SELECT query_id, tier, muni, display FROM m WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY tier, CASE WHEN tier = 2 THEN far ELSE 0 END, muni, display) = 1",
)
def street_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streets by municipality, by the hash of the city, by distance."""
    grouped = streets.street_groups(fx.addresses(spark, sf_dir)).select("street", F.col("muni").cast("bigint").alias("muni"), "display", "mean_lat", "mean_lon")
    k = F.col("c_custkey")
    customers = fx.table(spark, sf_dir, "customer")
    cities = customers.select(F.concat(F.lit("city "), (k % 5).cast("string")).alias("city")).distinct()
    hashed = grouped.where("muni = 3").drop("muni").withColumn("display", F.concat("display", F.lit("!"))).join(F.broadcast(cities.select(streets.hashing.djb2_bucket(F.col("city")).alias("muni"), F.lit(3).alias("one"))), F.lit(3) == F.col("one")).drop("one")
    asked = customers.select(
        k.alias("query_id"), F.concat(F.lit("street "), (k % 211).cast("string")).alias("street"), (k % 11).alias("muni"), F.concat(F.lit("city "), (k % 9).cast("string")).alias("city"), fx.lat(k).alias("near_lat"), fx.lon(k).alias("near_lon")
    )
    return streets.street_tiers(asked, grouped.unionByName(hashed))


@query(
    "address_forms",
    "SELECT c_custkey AS id, [true, true, false, false][CAST(c_custkey % 4 AS INTEGER) + 1] AS uk, 'Main ' || c_custkey AS without_unit, 'Portland' AS rest, ['OR', 'NY', 'TX', NULL][CAST(c_custkey % 4 AS INTEGER) + 1] AS state, "
    "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'X' || c_custkey END AS head, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'Z' END AS context, CASE WHEN c_custkey % 3 = 1 THEN 'gata ' || c_custkey END AS street, CASE WHEN c_custkey % 3 = 1 THEN 'Åby, Ort' END AS city, "
    "CASE WHEN c_custkey % 2 = 0 THEN 'Aarhus' ELSE 'Aarhus Nord' END AS without_letter FROM customer",
)
def address_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes and parts of addresses: British postcodes, units, states, contexts, street and city, postal letters."""
    k = F.col("c_custkey")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (k % n).cast("int") + 1)
    one = fx.table(spark, sf_dir, "customer").select(
        k.alias("id"), pick(("sw1a 2AA", "M11AA", "SWA1 2AA", "12345"), 4).alias("uk"), F.concat(F.lit("Main "), k.cast("string"), pick((" Apt 5", " #2", " Suite 7b", ""), 4)).alias("unit"),
        pick(("Portland, or", "Portland  New York", "Portland Texas", "Portland"), 4).alias("place"),
        F.when(k % 3 == 0, "X, 12").otherwise(F.concat(F.lit("X"), k.cast("string"), F.lit(" , Z"))).alias("dis"),
        F.when(k % 3 == 1, F.concat(F.lit("Gata "), k.cast("string"), F.lit(", Åby, Ort"))).when(k % 3 == 2, "5 Gata, Ort").otherwise("Gata").alias("street"),
        F.when(k % 2 == 0, "Aarhus Ø").otherwise("Aarhus Nord").alias("city"),
    )
    state, dis, street = address.without_state(F.col("place")), address.disambiguated(F.col("dis")), address.street_query(F.col("street"))
    return one.select(
        "id", address.is_uk_postcode(F.col("uk")).alias("uk"), address.without_unit(F.col("unit")).alias("without_unit"), state["rest"].alias("rest"), state["state"].alias("state"), dis["head"].alias("head"), dis["context"].alias("context"),
        street["street"].alias("street"), street["city"].alias("city"), address.without_postal_letter(F.col("city")).alias("without_letter"),
    )


# --- names resolved to areas -----------------------------------------------------------------

_SETTLED = (
    "s AS (SELECT c_custkey AS record_id, 'Stad ' || (c_custkey % 97) AS name, ['city','town','village','suburb','hamlet','island','station','lake','park','landmark','unknown'][CAST(c_custkey % 11 AS INTEGER) + 1] AS kind, (c_custkey * 48271) % 65521 AS importance, n_regionkey AS admin1, c_nationkey AS admin2, "
    "CAST(59000000 + (c_custkey * 7919) % 200003 AS BIGINT) AS lat_u, CAST(18000000 + (c_custkey * 104729) % 400009 AS BIGINT) AS lon_u FROM customer JOIN nation ON n_nationkey = c_nationkey)"
)


def _settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as places with two areas."""
    k = F.col("c_custkey")
    regions = fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("admin2"), F.col("n_regionkey").alias("admin1"))
    made = fx.table(spark, sf_dir, "customer").select(k.alias("record_id"), F.concat(F.lit("Stad "), (k % 97).cast("string")).alias("name"), fx.kind(k).alias("kind"), ((k * 48271) % 65521).alias("importance"), F.col("c_nationkey").alias("admin2"), fx.lat(k).alias("lat_u"), fx.lon(k).alias("lon_u"))
    return made.join(regions, "admin2")


@query(
    "city_resolve",
    f"WITH {_SETTLED}, q AS (SELECT s_suppkey AS query_id, 'stad ' || (s_suppkey % 120) AS city, CASE WHEN s_suppkey % 3 = 0 THEN [s_suppkey % 5, 2] ELSE [] END AS states FROM supplier) "
    "SELECT query_id, admin1, admin2, lat_u, lon_u FROM q JOIN s ON lower(s.name) = city WHERE kind IN ('city','town','village','hamlet','suburb') AND (len(states) = 0 OR list_contains(states, admin1)) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY importance DESC, record_id) = 1",
)
def city_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cities resolved to their areas, some within given states."""
    k = F.col("s_suppkey")
    none = F.array().cast("array<int>")
    asked = fx.table(spark, sf_dir, "supplier").select(k.alias("query_id"), F.concat(F.lit("stad "), (k % 120).cast("string")).alias("city"), F.when(k % 3 == 0, F.array((k % 5).cast("int"), F.lit(2))).otherwise(none).alias("states"))
    return resolve.resolve_cities(asked, _settled(spark, sf_dir), settlements_only=True)


@query(
    "state_areas",
    "WITH a AS (SELECT c_custkey AS admin_id, CASE WHEN c_custkey % 7 = 0 THEN c_custkey END AS parent_id, ['Texas', 'Ohio (state)', 'New York', 'Texas (x)', 'Bavaria'][CAST(c_custkey % 5 AS INTEGER) + 1] AS name FROM customer), "
    "q AS (SELECT * FROM (VALUES ('TX', 'texas'), ('oh', 'ohio'), ('NY', 'new york'), ('ZZ', NULL), ('CA', 'california')) v(code, state)) "
    "SELECT code, list_sort(list(admin_id)) AS ids FROM (SELECT code, admin_id FROM q JOIN a ON parent_id IS NULL AND (lower(name) = state OR starts_with(lower(name), state || ' ('))) GROUP BY code",
)
def state_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All areas that are named like a state."""
    k = F.col("c_custkey")
    names = F.element_at(F.array(*map(F.lit, ("Texas", "Ohio (state)", "New York", "Texas (x)", "Bavaria"))), (k % 5).cast("int") + 1)
    admin = fx.table(spark, sf_dir, "customer").select(k.alias("admin_id"), F.when(k % 7 == 0, k).alias("parent_id"), names.alias("name"))
    return resolve.state_areas(spark.createDataFrame([("TX",), ("oh",), ("NY",), ("ZZ",), ("CA",)], "code string"), admin)


@query(
    "postcode_country",
    f"WITH {_SETTLED}, pc AS (SELECT lpad(CAST(o_orderkey % 503 AS VARCHAR), 5, '1') AS postcode, CAST(o_custkey % 5 AS INTEGER) AS country, CAST(59000000 + (o_orderkey * 7919) % 200003 AS BIGINT) AS p_lat, CAST(18000000 + (o_orderkey * 104729) % 400009 AS BIGINT) AS p_lon FROM orders QUALIFY row_number() OVER (PARTITION BY postcode, country ORDER BY o_orderkey) = 1), "
    "q AS (SELECT s_suppkey AS query_id, lpad(CAST(s_suppkey % 503 AS VARCHAR), 5, '1') AS postcode, 'stad ' || (s_suppkey % 97) AS key FROM supplier), "
    f"m AS (SELECT query_id, country, {hav('p_lat', 'p_lon', 's.lat_u', 's.lon_u')} AS metres FROM q JOIN pc USING (postcode) JOIN s ON lower(s.name) = q.key AND s.record_id % 5 = pc.country) SELECT query_id, country, metres FROM m WHERE metres <= 9000 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY metres, country) = 1",
)
def postcode_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postcode and city: the country where both lie nearest to each other."""
    o, s = F.col("o_orderkey"), F.col("s_suppkey")
    held = fx.table(spark, sf_dir, "orders").select(F.lpad((o % 503).cast("string"), 5, "1").alias("postcode"), (F.col("o_custkey") % 5).cast("int").alias("country"), o.alias("o"))
    held = held.groupBy("postcode", "country").agg(F.min("o").alias("o")).select("postcode", "country", fx.lat(F.col("o")).alias("lat_u"), fx.lon(F.col("o")).alias("lon_u"))
    places = _settled(spark, sf_dir).select("name", (F.col("record_id") % 5).cast("int").alias("country"), "lat_u", "lon_u")
    asked = fx.table(spark, sf_dir, "supplier").select(s.alias("query_id"), F.lpad((s % 503).cast("string"), 5, "1").alias("postcode"), F.concat(F.lit("Stad "), (s % 97).cast("string")).alias("city"))
    return resolve.postcode_countries(asked, held, places, 9000.0)


@query(
    "parent_populations",
    f"WITH {_SETTLED}, a AS (SELECT n_nationkey AS admin_id, (n_nationkey * 7907) % 1003 AS population FROM nation WHERE n_nationkey % 4 <> 3) "
    "SELECT record_id, greatest(coalesce(x.population, 0), coalesce(y.population, 0)) AS parent_population FROM s LEFT JOIN a x ON x.admin_id = admin1 LEFT JOIN a y ON y.admin_id = admin2",
)
def parent_populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The larger population of a place's two areas."""
    n = F.col("n_nationkey")
    admin = fx.table(spark, sf_dir, "nation").where(n % 4 != 3).select(n.alias("admin_id"), ((n * 7907) % 1003).cast("bigint").alias("population"))
    return resolve.parent_populations(_settled(spark, sf_dir), admin).select("record_id", F.col("parent_population").cast("bigint").alias("parent_population"))


@query(
    "last_word_importance",
    "WITH p AS (SELECT lower(p_name) AS key, max(CAST((p_partkey * 48271) % 65521 AS INTEGER)) AS importance FROM part GROUP BY 1), q AS (SELECT DISTINCT p_name AS query_id, lower(p_name) AS q FROM part UNION SELECT DISTINCT p_name || ' x', lower(p_name) || ' x' FROM part UNION SELECT DISTINCT 'y ' || p_name, 'y ' || lower(p_name) FROM part) "
    "SELECT query_id, coalesce(w.importance, 0) AS whole, coalesce(l.importance, 0) AS last FROM q LEFT JOIN p w ON w.key = q LEFT JOIN p l ON l.key = string_split(q, ' ')[-1]",
)
def last_word_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of a whole name and of its last word."""
    places = fx.scored_places(spark, sf_dir)
    names = places.select("name").distinct().select(F.explode(F.array("name", F.concat("name", F.lit(" x")), F.concat(F.lit("y "), "name"))).alias("q")).distinct()
    return search.best_importance(names.select(F.col("q").alias("query_id"), "q"), places)


@query(
    "area_names",
    f"{with_tables('customers', 'edges')}, hit AS (SELECT c.record_id, e.admin_id, count(*) AS k FROM customers c JOIN edges e ON (e.y1 > c.lat_u) <> (e.y2 > c.lat_u) AND CASE WHEN e.y2 > e.y1 THEN (c.lon_u - e.x1) * (e.y2 - e.y1) < (c.lat_u - e.y1) * (e.x2 - e.x1) ELSE (c.lon_u - e.x1) * (e.y2 - e.y1) > (c.lat_u - e.y1) * (e.x2 - e.x1) END GROUP BY 1, 2), "
    "inside AS (SELECT record_id, min(admin_id) AS area_id FROM hit WHERE k % 2 = 1 GROUP BY 1) SELECT c.record_id, n_name AS area FROM customers c LEFT JOIN inside i USING (record_id) LEFT JOIN nation ON n_nationkey = coalesce(area_id, c.admin_id)",
)
def area_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area names by polygon, else as stored."""
    hits = fx.customers(spark, sf_dir)
    inside = spatial.containing(hits.select(F.col("record_id").alias("point_id"), "lat_u", "lon_u"), fx.polygons(spark, sf_dir))
    admin = fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("admin_id"), F.col("n_name").alias("name"))
    named = resolve.area_names(hits.select("record_id", "admin_id"), inside.select(F.col("point_id").alias("record_id"), F.col("admin_id").alias("area_id")), admin)
    return named.select("record_id", "area")


@query(
    "hashed_addr_anti",
    f"{with_tables('addresses')}, n AS (SELECT osm_id, upper(street) AS street, housenumber, lat_u + CAST(osm_id % 5 AS BIGINT) * 70 AS lat_u, lon_u - CAST(osm_id % 3 AS BIGINT) * 90 AS lon_u FROM addresses) "
    "SELECT n.osm_id FROM n WHERE NOT EXISTS (SELECT 1 FROM addresses o WHERE lower(o.street) = lower(n.street) AND lower(o.housenumber) = lower(n.housenumber) AND abs((o.lat_u + 90000000) // 100 - (n.lat_u + 90000000) // 100) <= 1 AND abs((o.lon_u + 180000000) // 100 - (n.lon_u + 180000000) // 100) <= 1)",
)
def hashed_addr_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New addresses without an old one in the small cells around."""
    old = fx.addresses(spark, sf_dir)
    new = old.select("osm_id", F.upper("street").alias("street"), "housenumber", (F.col("lat_u") + F.col("osm_id") % 5 * 70).alias("lat_u"), (F.col("lon_u") - F.col("osm_id") % 3 * 90).alias("lon_u"))
    return resolve.hashed_anti(new, old).select("osm_id")


@query(
    "relation_shapes",
    "WITH n AS (SELECT p_partkey AS node_id, CAST(59000000 + (p_partkey * 7919) % 200003 AS BIGINT) AS lat_u, CAST(18000000 + (p_partkey * 104729) % 400009 AS BIGINT) AS lon_u FROM part), p AS (SELECT l_orderkey AS way_id, lat_u, lon_u FROM lineitem JOIN n ON l_partkey = node_id), "
    "w AS (SELECT way_id, CAST(sum(lat_u) // count(*) AS BIGINT) AS lat_u, CAST(sum(lon_u) // count(*) AS BIGINT) AS lon_u, min(lat_u) AS south, max(lat_u) AS north, min(lon_u) AS west, max(lon_u) AS east FROM p GROUP BY 1), "
    "m AS (SELECT o_custkey AS relation_id, lat_u, lon_u, south, north, west, east FROM orders JOIN w ON way_id = o_orderkey UNION ALL SELECT c_custkey, lat_u, lon_u, lat_u, lat_u, lon_u, lon_u FROM customer JOIN n ON node_id = c_custkey % 50) "
    "SELECT relation_id, CAST(sum(lat_u) // count(*) AS BIGINT) AS lat_u, CAST(sum(lon_u) // count(*) AS BIGINT) AS lon_u, min(south) AS south, max(north) AS north, min(west) AS west, max(east) AS east, count(*) AS n_members FROM m GROUP BY 1",
)
def relation_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres and boxes of relations of ways and nodes."""
    refs = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("way_id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("node_id"))
    nodes = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), fx.lat(F.col("p_partkey")).alias("lat_u"), fx.lon(F.col("p_partkey")).alias("lon_u"))
    ways = fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("relation_id"), F.lit("way").alias("kind"), F.col("o_orderkey").alias("ref"))
    others = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("relation_id"), F.lit("node").alias("kind"), (F.col("c_custkey") % 50).alias("ref"))
    return streets.relation_shapes(ways.unionByName(others), streets.way_shapes(refs, nodes), nodes)


# --- labels, codes, clocks -------------------------------------------------------------------


@query(
    "place_labels",
    f"{with_tables('places')} SELECT record_id, CASE WHEN kind IN ('lake', 'island') THEN 'natural' WHEN kind = 'station' THEN 'railway' WHEN kind = 'landmark' THEN 'tourism' WHEN kind = 'park' THEN 'leisure' ELSE 'place' END AS class, kind AS type, "
    "CASE WHEN kind = 'town' THEN 'town' WHEN kind IN ('village', 'hamlet') THEN 'village' WHEN kind = 'suburb' THEN 'suburb' ELSE 'city' END AS field, "
    "CASE kind WHEN 'city' THEN 80 WHEN 'town' THEN 70 WHEN 'village' THEN 60 WHEN 'suburb' THEN 55 WHEN 'hamlet' THEN 40 WHEN 'island' THEN 50 WHEN 'station' THEN 65 WHEN 'park' THEN 35 WHEN 'landmark' THEN 55 ELSE 20 END AS weight, "
    "CAST(least((CASE WHEN population > 0 THEN floor(log10(population) * 3000) ELSE 0 END) + CASE kind WHEN 'city' THEN 2000 WHEN 'town' THEN 1500 WHEN 'village' THEN 1000 WHEN 'suburb' THEN 900 WHEN 'hamlet' THEN 500 WHEN 'island' THEN 800 WHEN 'station' THEN 700 WHEN 'lake' THEN 600 WHEN 'park' THEN 400 WHEN 'landmark' THEN 700 ELSE 200 END "
    "+ CASE WHEN notable THEN 1500 ELSE 0 END + least(translations, 5) * 300, 65535) AS INTEGER) AS older, CAST(1 + CASE WHEN record_id % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN record_id % 3 = 0 THEN 4 ELSE 0 END + CASE WHEN record_id % 5 = 0 THEN 8 ELSE 0 END + CASE WHEN notable THEN 16 ELSE 0 END AS INTEGER) AS flags FROM places",
)
def place_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, type, address field, weight, older score and flags of places."""
    kind, k = F.col("kind"), F.col("record_id")
    none = F.lit(None).cast("string")
    both = labels.class_and_type(kind, none, none)
    text_if = lambda rule: F.when(rule, "x")
    bits = labels.flags(F.col("population"), text_if(k % 2 == 0), text_if(k % 3 == 0), k % 5 == 0, F.col("notable"), F.lit(False))
    return fx.places(spark, sf_dir).select(
        "record_id", both["class"].alias("class"), both["type"].alias("type"), labels.settlement_field(kind).alias("field"), labels.type_weight(kind).alias("weight"), labels.older_importance(kind, F.col("population"), F.col("notable"), F.col("translations")).alias("older"), bits.alias("flags")
    )


@query(
    "way_gate",
    "SELECT c_custkey AS way_id, c_custkey % 5 <> 0 AND CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 7 = 0 OR c_custkey % 11 = 0 ELSE c_custkey % 2 = 0 OR c_custkey % 7 = 0 OR c_custkey % 11 = 0 END AS qualifies, "
    "(CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END) + (CASE WHEN c_custkey % 13 = 0 THEN 1 ELSE 0 END) AS n_extra FROM customer",
)
def way_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which ways are places, and how many of their tags are kept."""
    k = F.col("c_custkey")
    rules = {"name": k % 5 != 0, "highway": k % 3 == 0, "natural": k % 2 == 0, "wikidata": k % 7 == 0, "name:sv": k % 11 == 0, "phone": k % 13 == 0, "source": k >= 0}
    entries = F.filter(F.array(*[F.struct(rule.alias("has"), F.lit(tag).alias("key"), F.lit("v").alias("value")) for tag, rule in rules.items()]), lambda e: e["has"])
    tags = F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], e["value"])))
    ways = fx.table(spark, sf_dir, "customer").select(k.alias("way_id"), tags.alias("tags"))
    return ways.select("way_id", labels.way_qualifies(F.col("tags")).alias("qualifies"), F.size(labels.extra_tags(F.col("tags"))).alias("n_extra"))


@query(
    "number_codes",
    "WITH v AS (SELECT o_orderkey AS k, o_orderkey * 7919 % 40009 - 20000 AS v FROM orders), z AS (SELECT k, v, CASE WHEN v >= 0 THEN v * 2 ELSE -v * 2 - 1 END AS z FROM v) "
    "SELECT k, z, lpad(printf('%x', (z % 128 + CASE WHEN z >= 128 THEN 128 ELSE 0 END)::BIGINT), 2, '0') || CASE WHEN z >= 128 THEN lpad(printf('%x', (z // 128 % 128 + CASE WHEN z >= 16384 THEN 128 ELSE 0 END)::BIGINT), 2, '0') ELSE '' END || CASE WHEN z >= 16384 THEN lpad(printf('%x', (z // 16384)::BIGINT), 2, '0') ELSE '' END AS bytes, "
    "v AS back, z AS decoded, [v, k - v, v - k] AS steps, [v, k, v] AS vals FROM z",
)
def number_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zigzag, varint and delta codes, both ways."""
    k = F.col("o_orderkey")
    v = fx.table(spark, sf_dir, "orders").select(k.alias("k"), (k * 7919 % 40009 - 20000).alias("v")).withColumn("z", codecs.zigzag(F.col("v")))
    steps = codecs.delta_encode(F.array("v", "k", "v"))
    code = codecs.varint(F.col("z"))
    return v.select("k", "z", F.lower(code).alias("bytes"), codecs.unzigzag(F.col("z")).alias("back"), codecs.unvarint(code).alias("decoded"), steps.alias("steps"), codecs.delta_decode(steps).alias("vals"))


@query(
    "clock_forms",
    "SELECT event_id, strftime(to_timestamp(event_id * 1000003 % 2000000000)::TIMESTAMPTZ AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS utc, 'https://x/replication/' || printf('%03d/%03d/%03d', event_id * 7 // 1000000, event_id * 7 // 1000 % 1000, event_id * 7 % 1000) || '.osc.gz' AS url FROM events",
)
def clock_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times in UTC and addresses of change files."""
    e = F.col("event_id")
    return fx.table(spark, sf_dir, "events").select("event_id", codecs.utc_text(e * 1000003 % 2000000000).alias("utc"), codecs.change_file(F.lit("https://x/replication/"), e * 7).alias("url"))


@query(
    "name_forms",
    "SELECT p_partkey AS id, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title, CASE WHEN p_partkey % 3 = 0 THEN [lower(p_name), 'b'] WHEN p_partkey % 3 = 1 THEN [lower(p_name), 'x/y', 'x', 'y'] ELSE [] END AS parts FROM part",
)
def name_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title case and parts of names in two languages."""
    k = F.col("p_partkey")
    named = F.when(k % 3 == 0, F.concat("p_name", F.lit(" - B"))).when(k % 3 == 1, F.concat("p_name", F.lit(" / X/y"))).otherwise(F.col("p_name"))
    return fx.table(spark, sf_dir, "part").select(k.alias("id"), text.title_case(F.upper("p_name")).alias("title"), text.bilingual_parts(named).alias("parts"))


@query("mistyped_names")
def mistyped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part name with one typing error."""
    return fx.table(spark, sf_dir, "part").select("p_partkey", "p_name", text.mistyped(F.col("p_name"), F.col("p_partkey")).alias("typed"))


@query("weighted_places")
def weighted_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places drawn with a probability that grows with their importance."""
    return resolve.weighted_sample(fx.scored_places(spark, sf_dir), 7).select("record_id", "importance")


# --- sources, keys, reports ------------------------------------------------------------------


@query(
    "changed_sources",
    "WITH c AS (SELECT c_custkey AS source, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS sequence, CASE WHEN c_custkey % 3 = 1 THEN 'm' || c_custkey END AS md5, 'e' || (c_custkey % 4) AS etag FROM customer), "
    "p AS (SELECT c_custkey AS source, c_custkey + CAST(c_custkey % 2 AS BIGINT) AS sequence, 'm' || (c_custkey - CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END) AS md5, 'e1' AS etag FROM customer WHERE c_custkey % 11 <> 0) "
    "SELECT * FROM (SELECT c.source, CASE WHEN p.source IS NULL THEN 'new' WHEN c.sequence IS NOT NULL AND c.sequence IS DISTINCT FROM p.sequence THEN 'sequence' WHEN c.md5 IS NOT NULL AND c.md5 IS DISTINCT FROM p.md5 THEN 'md5' WHEN c.sequence IS NULL AND c.md5 IS NULL AND c.etag IS DISTINCT FROM p.etag THEN 'etag' END AS why FROM c LEFT JOIN p USING (source)) WHERE why IS NOT NULL",
)
def changed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that changed since the state that was kept."""
    k = F.col("c_custkey")
    all_ = fx.table(spark, sf_dir, "customer")
    now = all_.select(k.alias("source"), F.when(k % 3 == 0, k).alias("sequence"), F.when(k % 3 == 1, F.concat(F.lit("m"), k.cast("string"))).alias("md5"), F.concat(F.lit("e"), (k % 4).cast("string")).alias("etag"))
    kept = all_.where(k % 11 != 0).select(k.alias("source"), (k + k % 2).alias("sequence"), F.concat(F.lit("m"), (k - F.when(k % 5 == 0, 1).otherwise(0)).cast("string")).alias("md5"), F.lit("e1").alias("etag"))
    return resolve.changed_sources(now, kept)


@query(
    "active_keys",
    "WITH k AS (SELECT c_custkey AS key_id, c_nationkey AS user_id, CASE WHEN c_custkey % 4 = 0 THEN c_custkey * 10 END AS quota FROM customer WHERE c_custkey % 9 <> 0), u AS (SELECT n_nationkey AS user_id, ['free', 'pro'][CAST(n_nationkey % 2 AS INTEGER) + 1] AS tier FROM nation WHERE n_nationkey % 6 <> 0), "
    "d AS (SELECT user_id AS key_id, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS day, count(*) AS requests FROM events GROUP BY 1, 2), m AS (SELECT key_id, sum(requests) AS n FROM d WHERE day >= 20240115 GROUP BY 1) "
    "SELECT key_id, CAST(coalesce(quota, CASE tier WHEN 'free' THEN 1000 ELSE 50000 END) AS BIGINT) AS quota, CAST(coalesce(n, 0) AS BIGINT) AS month_to_date FROM k JOIN u USING (user_id) LEFT JOIN m USING (key_id)",
)
def active_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in force, their quotas and what they have used."""
    k, n = F.col("c_custkey"), F.col("n_nationkey")
    keys = fx.table(spark, sf_dir, "customer").select(k.alias("key_id"), F.col("c_nationkey").alias("user_id"), F.when(k % 4 == 0, k * 10).alias("quota"), F.when(k % 9 == 0, 1).alias("revoked_at"))
    users = fx.table(spark, sf_dir, "nation").select(n.alias("user_id"), F.element_at(F.array(F.lit("free"), F.lit("pro")), (n % 2).cast("int") + 1).alias("tier"), (n % 6 != 0).alias("active"))
    used = fx.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key_id"), F.date_format("ts", "yyyyMMdd").cast("int").alias("day")).agg(F.count("*").alias("requests"))
    out = resolve.active_keys(keys, users, used, {"free": 1000, "pro": 50000}, 20240115)
    return out.select("key_id", F.col("quota").cast("bigint").alias("quota"), F.col("month_to_date").cast("bigint").alias("month_to_date"))


@query(
    "request_metrics",
    "WITH r AS (SELECT event_type AS endpoint, event_id % 97 / 100.0 AS seconds FROM events) SELECT endpoint, b AS le, count(*) AS n FROM r JOIN (VALUES (0.05::DOUBLE), (0.1), (0.5), ('inf'::DOUBLE)) v(b) ON seconds <= b GROUP BY 1, 2",
)
def request_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by endpoint and time bound."""
    made = fx.table(spark, sf_dir, "events").select(F.col("event_type").alias("endpoint"), (F.col("event_id") % 97 / 100.0).alias("seconds"))
    return resolve.request_metrics(made, (0.05, 0.1, 0.5))


@query(
    "address_tags",
    "WITH a AS (SELECT 's' AS street, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'n' END AS housenumber, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'p' END AS postcode, ' ' AS city FROM orders) "
    "SELECT 'street' AS tag, count(*) AS filled, 0 AS missing FROM a UNION ALL SELECT 'housenumber', count(*) FILTER (housenumber <> ''), count(*) FILTER (housenumber = '') FROM a UNION ALL SELECT 'postcode', count(postcode), count(*) - count(postcode) FROM a UNION ALL SELECT 'city', 0, count(*) FROM a",
)
def address_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many addresses have each tag."""
    k = F.col("o_orderkey")
    made = fx.table(spark, sf_dir, "orders").select(F.lit("s").alias("street"), F.when(k % 3 == 0, "").otherwise("n").alias("housenumber"), F.when(k % 4 != 0, "p").alias("postcode"), F.lit(" ").alias("city"))
    return resolve.address_tags(made)


@query("arrival_ids", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS arrival_id FROM orders")
def arrival_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in order of arrival."""
    orders = fx.table(spark, sf_dir, "orders").select("o_orderkey", F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")).alias("day"), "o_orderdate")
    return resolve.arrival_ids(orders, ["day", "o_orderdate", "o_orderkey"]).select("o_orderkey", F.col("arrival_id").cast("bigint").alias("arrival_id"))


# --- projections -----------------------------------------------------------------------------


def _mercator_sql(g: projections.TransverseMercator, x: str, y: str) -> tuple[str, str]:
    """The series of a transverse Mercator grid in SQL: latitude and longitude."""
    n = g.ellipsoid.f / (2 - g.ellipsoid.f)
    radius = g.ellipsoid.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    xi, eta = f"(({y} - {g.north0!r}) / {g.k0 * radius!r})", f"(({x} - {g.east0!r}) / {g.k0 * radius!r})"
    sinh, cosh = (lambda t: f"((exp({t}) - exp(-({t}))) / 2)"), (lambda t: f"((exp({t}) + exp(-({t}))) / 2)")
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
    xi1 = f"({xi}" + "".join(f" - {b!r} * sin({2 * j} * {xi}) * {cosh(f'{2 * j} * {eta}')}" for j, b in enumerate(beta, 1)) + ")"
    eta1 = f"({eta}" + "".join(f" - {b!r} * cos({2 * j} * {xi}) * {sinh(f'{2 * j} * {eta}')}" for j, b in enumerate(beta, 1)) + ")"
    chi = f"asin(sin({xi1}) / {cosh(eta1)})"
    lat = f"({chi}" + "".join(f" + {d!r} * sin({2 * j} * {chi})" for j, d in enumerate(delta, 1)) + ")"
    return f"degrees({lat})", f"degrees(atan2({sinh(eta1)}, cos({xi1}))) + {g.lon0!r}"


_GRIDS = {"utm33": projections.UTM33, "utm32": projections.UTM32, "puwg92": projections.PUWG92, "lks94": projections.LKS94, "lks92": projections.LKS92}
_GRID_SQL = ", ".join(f"round({e}, 6) AS {name}_{axis}" for name, g in _GRIDS.items() for axis, e in zip(("lat", "lon"), _mercator_sql(g, "x", "y")))


@query("grid_degrees", f"WITH p AS (SELECT c_custkey AS id, 300000 + (c_custkey * 7919) % 400009 AS x, 5500000 + (c_custkey * 104729) % 1200007 AS y FROM customer) SELECT id, {_GRID_SQL} FROM p")
def grid_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees of points in five national grids."""
    k = F.col("c_custkey")
    points = fx.table(spark, sf_dir, "customer").select(k.alias("id"), (F.lit(300000) + (k * 7919) % 400009).alias("x"), (F.lit(5500000) + (k * 104729) % 1200007).alias("y"))
    made = {name: g.inverse(F.col("x"), F.col("y")) for name, g in _GRIDS.items()}
    return points.select("id", *[F.round(c, 6).alias(f"{name}_{axis}") for name, pair in made.items() for axis, c in zip(("lat", "lon"), pair)])
