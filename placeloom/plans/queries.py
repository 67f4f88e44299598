"""The registered queries: every operator over the derived tables, with the SQL of its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placeloom.functions import address, geo, hashing, scoring, text
from placeloom.operators import merge, quality, rules, search, spatial, streets, usage
from placeloom.plans import fixtures as fx
from placeloom.plans.fixtures import hav, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL if SQL can express it."""

    def put(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return put


# --- forward search --------------------------------------------------------------------------


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part name as a query, in capitals."""
    return fx.table(spark, sf_dir, "part").select(F.col("p_name").alias("query_id"), F.upper("p_name").alias("q")).distinct()


_ASKED = "asked AS (SELECT DISTINCT p_name AS query_id, upper(p_name) AS q FROM part)"


@query(
    "exact_search",
    f"{with_tables('places')}, {_ASKED}, keyed AS (SELECT lower(name) AS key, record_id, importance FROM places UNION ALL SELECT unnest(list_filter(string_split(lower(name), ' '), lambda t: strlen(t) > 2)), record_id, CAST(greatest(importance // 128, 1) AS INTEGER) FROM places WHERE contains(name, ' ')), "
    "best AS (SELECT key, record_id, max(importance) AS importance FROM keyed GROUP BY 1, 2), posted AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY importance DESC, record_id) AS rank FROM best QUALIFY rank <= 16) "
    "SELECT query_id, record_id, importance, rank FROM asked JOIN posted ON lower(q) = key",
)
def exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact names through posting lists of at most 16 records."""
    posted = search.postings(search.exact_keys(fx.scored_places(spark, sf_dir)), search.EXACT_CAP)
    return search.exact(_queries(spark, sf_dir).withColumn("key", text.base(F.col("q"))), posted)


@query(
    "postings_topn",
    "WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[\\x09-\\x0D ]+'), lambda x: x <> '')) AS key FROM documents), c AS (SELECT key, doc_id AS record_id, count(*) AS importance FROM t GROUP BY 1, 2) "
    "SELECT *, row_number() OVER (PARTITION BY key ORDER BY importance DESC, record_id) AS rank FROM c QUALIFY rank <= 16",
)
def postings_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posting lists of all words of all documents."""
    words = F.filter(F.split(F.lower("text"), r"[\x09-\x0D ]+"), lambda t: t != "")
    counted = fx.table(spark, sf_dir, "documents").select("doc_id", F.explode(words).alias("key")).groupBy("key", F.col("doc_id").alias("record_id")).agg(F.count("*").alias("importance"))
    return search.postings(counted, search.EXACT_CAP)


@query(
    "prefix_search",
    f"{with_tables('places')}, q AS (SELECT DISTINCT substr(p_name, 1, 5) AS q FROM part) SELECT q AS query_id, record_id, name, importance, row_number() OVER (PARTITION BY q ORDER BY importance DESC, record_id) AS rank "
    "FROM q JOIN places ON starts_with(lower(name), lower(q)) QUALIFY rank <= 10",
)
def prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Autocomplete: the ten best names of every five-letter beginning."""
    asked = fx.table(spark, sf_dir, "part").select(F.substring("p_name", 1, 5).alias("q")).distinct().select(F.col("q").alias("query_id"), "q")
    return search.prefix(asked, fx.scored_places(spark, sf_dir))


_GRAMS = (
    "gram AS (SELECT DISTINCT id, g FROM (SELECT id, unnest(list_transform(range(1, greatest(len(t) - 2, 1) + 1), lambda i: substr(t, i, 3))) AS g FROM (SELECT id, '^' || unnest(string_split(name, ' ')) || '$' AS t FROM named)))"
)


@query(
    "trigram_candidates",
    f"{with_tables('places')}, named AS (SELECT DISTINCT name AS id, name FROM places), {_GRAMS}, q AS (SELECT id, g, count(*) OVER (PARTITION BY id) AS n FROM gram), "
    "m AS (SELECT q.id AS query_id, p.record_id, count(*) AS matches, max(q.n) AS n, max(p.importance) AS importance FROM q JOIN gram g ON q.g = g.g JOIN places p ON p.name = g.id GROUP BY 1, 2) "
    "SELECT query_id, record_id, matches, matches * 1000 + importance // 64 AS score FROM m WHERE matches >= greatest(ceil(n * 0.7 - 1e-9), 2) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY matches * 1000 + importance // 64 DESC, record_id) <= 64",
)
def trigram_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram layer: every name as a query."""
    places = fx.scored_places(spark, sf_dir)
    asked = places.select("name").distinct().select(F.col("name").alias("query_id"), F.col("name").alias("key"))
    return search.by_trigrams(asked, search.postings(search.ngram_keys(places), search.NGRAM_CAP))


_TOKENS = "w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS key FROM benchmark)"


@query("fuzzy_lev1", f"WITH {_TOKENS} SELECT a.key AS query_id, a.key AS key, b.key AS hit, CAST(levenshtein(a.key, b.key) AS INTEGER) AS distance FROM w a JOIN w b ON abs(len(a.key) - len(b.key)) <= 1 AND levenshtein(a.key, b.key) <= 1")
def fuzzy_lev1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark within one edit of each other."""
    words = fx.table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("key")).distinct()
    return search.within_one_edit(words.select(F.col("key").alias("query_id"), "key"), words)


@query(
    "cascade_search",
    f"{with_tables('places')}, asked AS (SELECT DISTINCT p_name || '/' || v AS query_id, CASE v WHEN 0 THEN p_name WHEN 1 THEN p_name || 's' ELSE substr(p_name, 2) END AS key FROM part, range(3) r(v)), "
    "named AS (SELECT DISTINCT 'p' || name AS id, name FROM places UNION ALL SELECT 'q' || query_id, key FROM asked), " + _GRAMS + ", "
    "exact AS (SELECT query_id, record_id, 1 AS n, 'exact' AS layer FROM asked JOIN places ON key = name), qg AS (SELECT query_id, g, count(*) OVER (PARTITION BY query_id) AS n FROM asked JOIN gram ON id = 'q' || query_id), "
    "m AS (SELECT query_id, record_id, count(*) AS matches, max(n) AS n, max(importance) AS importance FROM qg JOIN gram p ON p.g = qg.g JOIN places ON p.id = 'p' || name GROUP BY 1, 2), "
    "tri AS (SELECT query_id, record_id, 3, 'ngram' FROM m WHERE matches >= greatest(ceil(n * 0.7 - 1e-9), 2) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY matches * 1000 + importance // 64 DESC, record_id) <= 64), "
    "edit AS (SELECT query_id, record_id, 4, 'edit1' FROM asked JOIN places ON levenshtein(key, name) <= 1 WHERE len(key) >= 4), u AS (SELECT * FROM exact UNION ALL SELECT * FROM tri UNION ALL SELECT * FROM edit) "
    "SELECT DISTINCT u.query_id, u.record_id, u.layer, CAST(CASE layer WHEN 'exact' THEN 1.0 WHEN 'ngram' THEN 0.7 ELSE 0.75 END AS DOUBLE) AS confidence, p.importance FROM u JOIN places p ON p.record_id = u.record_id WHERE u.n = (SELECT min(n) FROM u v WHERE v.query_id = u.query_id)",
)
def cascade_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact, trigram and edit layers on names that are right, lengthened or cut."""
    names = fx.table(spark, sf_dir, "part").select("p_name").distinct().withColumn("v", F.explode(F.array(*map(F.lit, range(3)))))
    typed = F.when(F.col("v") == 0, F.col("p_name")).when(F.col("v") == 1, F.concat("p_name", F.lit("s"))).otherwise(F.expr("substring(p_name, 2)"))
    asked = names.select(F.concat("p_name", F.lit("/"), F.col("v").cast("string")).alias("query_id"), typed.alias("q"))
    return search.cascade(asked, fx.scored_places(spark, sf_dir))


@query("phonetic_search")
def phonetic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that sound alike by Cologne phonetics."""
    language = text.Language(engine="cologne")
    names = fx.scored_places(spark, sf_dir).select("name").distinct()
    keyed = names.withColumn("key", text.phonetic_udf(language)(F.col("name")))
    return keyed.join(keyed.withColumnRenamed("name", "alike"), "key").where("name <> alike").select("name", "alike", "key")


@query("normalize_candidates")
def normalize_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index forms of all part names and of all lines of the documents."""
    docs = fx.table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("name"))
    names = docs.union(fx.table(spark, sf_dir, "part").select("p_name")).distinct()
    return names.select("name", F.array_join(text.normalize_udf()(F.col("name")), "|").alias("forms"), text.phonetic_udf()(F.col("name")).alias("phonetic"))


@query(
    "ambiguous_names",
    f"{with_tables('places')} SELECT name, count(DISTINCT country) AS n_countries FROM places GROUP BY name HAVING count(DISTINCT country) >= 2",
)
def ambiguous_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that several countries have."""
    return search.ambiguous(fx.places(spark, sf_dir))


@query(
    "global_postings",
    f"{with_tables('places')}, b AS (SELECT name AS key, country, record_id, max(importance) AS importance FROM places GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY key ORDER BY importance DESC, country, record_id) AS rank FROM b",
)
def global_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posting lists over all countries, without a cap."""
    best = fx.scored_places(spark, sf_dir).groupBy(F.col("name").alias("key"), "country", "record_id").agg(F.max("importance").alias("importance"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy(F.desc("importance"), "country", "record_id")))


@query(
    "viewbox_bias",
    f"{with_tables('places')}, {_ASKED} SELECT query_id, record_id, CASE WHEN lat_u BETWEEN 59050000 AND 59150000 AND lon_u BETWEEN 18100000 AND 18300000 THEN importance * 1.5 ELSE importance * 1.0 END AS importance, "
    "row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN lat_u BETWEEN 59050000 AND 59150000 AND lon_u BETWEEN 18100000 AND 18300000 THEN importance * 1.5 ELSE importance * 1.0 END DESC, record_id) AS rank FROM asked JOIN places ON lower(q) = name QUALIFY rank <= 10",
)
def viewbox_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits inside a viewbox gain half their importance; the ten best of each query."""
    hits = _queries(spark, sf_dir).withColumn("name", F.lower("q")).join(fx.scored_places(spark, sf_dir), "name")
    hits = hits.withColumn("importance", F.col("importance").cast("double")).withColumnRenamed("lat_u", "lat").withColumnRenamed("lon_u", "lon")
    biased = search.filtered(hits, (59050000, 59150000, 18100000, 18300000))
    return search.top(biased, [F.desc("importance"), F.col("record_id")], 10).select("query_id", "record_id", F.col("importance").cast("double").alias("importance"), "rank")


@query(
    "dedupe_results",
    f"{with_tables('places')}, {_ASKED}, h AS (SELECT query_id, record_id, name, country, kind, importance FROM asked JOIN places ON lower(q) = name WHERE record_id NOT IN (7, 14, 21) AND kind <> 'unknown') "
    "SELECT query_id, record_id, name, country, kind FROM h QUALIFY row_number() OVER (PARTITION BY query_id, country, kind ORDER BY importance DESC, record_id) = 1",
)
def dedupe_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result filters: excluded ids, types, first of results that look the same."""
    hits = _queries(spark, sf_dir).withColumn("name", F.lower("q")).join(fx.scored_places(spark, sf_dir), "name")
    kept = search.filtered(hits, excluded=F.array(*[F.lit(x).cast("bigint") for x in (7, 14, 21)]), kinds=F.col("kind") != "unknown")
    return search.first_wins(kept, ["query_id", "country", "kind"], [F.desc("importance"), F.col("record_id")]).select("query_id", "record_id", "name", "country", "kind")


@query(
    "city_tier_rank",
    f"{with_tables('customers')}, ctx AS (SELECT n_nationkey AS query_id, n_regionkey AS region, CAST(59035000 + (n_nationkey % 5) * 40000 AS BIGINT) AS lat, CAST(18070000 + (n_nationkey // 5) * 80000 AS BIGINT) AS lon FROM nation), "
    "t AS (SELECT query_id, record_id, CASE WHEN c.admin_id = query_id THEN 3 WHEN n.n_regionkey = region THEN 2 WHEN " + hav("lat", "lon", "lat_u", "lon_u") + " <= 9000 THEN 1 ELSE 0 END AS tier, (record_id * 48271) % 65521 AS importance FROM ctx JOIN customers c ON c.record_id % 25 = query_id JOIN nation n ON n.n_nationkey = c.admin_id) "
    "SELECT query_id, record_id, tier, row_number() OVER (PARTITION BY query_id ORDER BY tier DESC, importance DESC, record_id) AS rank FROM t",
)
def city_tier_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates ranked by how near they are to the context's city: municipality, region, distance."""
    context = fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("admin_id"), "n_regionkey").join(fx.centroids(spark, sf_dir), "admin_id")
    context = context.select(F.col("admin_id").alias("query_id"), F.col("n_regionkey").alias("region"), F.col("lat_u").alias("lat"), F.col("lon_u").alias("lon"))
    regions = fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("admin_id"), "n_regionkey")
    places = fx.customers(spark, sf_dir).withColumn("query_id", (F.col("record_id") % 25).cast("int")).join(regions, "admin_id")
    met = places.join(context, "query_id")
    far = F.round(geo.haversine_m(F.col("lat"), F.col("lon"), F.col("lat_u"), F.col("lon_u")), 3)
    near = scoring.city_tier(F.lit(True), F.col("admin_id") == F.col("query_id"), F.col("n_regionkey") == F.col("region"), far + 41000)
    ranked = met.withColumn("tier", near).withColumn("importance", (F.col("record_id") * 48271) % 65521)
    order = W.partitionBy("query_id").orderBy(F.desc("tier"), F.desc("importance"), "record_id")
    return ranked.select("query_id", "record_id", "tier", F.row_number().over(order).alias("rank"))


# --- reverse ---------------------------------------------------------------------------------

_CELLS = (
    "pc AS (SELECT *, least(floor((lon_u + 180000000) * 32768 / 360000000), 32767) AS gx, least(floor((lat_u + 90000000) * 32768 / 180000000), 32767) AS gy FROM points), "
    "rc AS (SELECT *, least(floor((lon_u + 180000000) * 32768 / 360000000), 32767) AS gx, least(floor((lat_u + 90000000) * 32768 / 180000000), 32767) AS gy FROM customers), "
    f"met AS (SELECT pc.point_id, pc.zoom, rc.record_id, rc.kind, {hav('pc.lat_u', 'pc.lon_u', 'rc.lat_u', 'rc.lon_u')} AS metres FROM pc JOIN rc ON abs(pc.gx - rc.gx) <= 1 AND abs(pc.gy - rc.gy) <= 1)"
)


@query("knn_grid", f"{with_tables('points', 'customers')}, {_CELLS} SELECT point_id, record_id, metres, row_number() OVER (PARTITION BY point_id ORDER BY metres, record_id) AS rank FROM met QUALIFY rank <= 5")
def knn_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest places in the nine cells around."""
    return spatial.nearest(fx.points(spark, sf_dir), fx.customers(spark, sf_dir), 5)


_ZOOM = (
    "CASE WHEN zoom <= 3 THEN kind IN ('country') WHEN zoom <= 6 THEN kind IN ('country','state') WHEN zoom <= 9 THEN kind IN ('state','county','city') WHEN zoom <= 11 THEN kind IN ('city','town','lake','island') "
    "WHEN zoom <= 13 THEN kind IN ('city','town','village','suburb','lake','island') WHEN zoom <= 15 THEN kind NOT IN ('country','state') WHEN zoom <= 16 THEN kind NOT IN ('country','state','unknown') ELSE true END"
)
_BONUS = "CASE kind WHEN 'city' THEN 5000 WHEN 'town' THEN 3000 WHEN 'village' THEN 1500 WHEN 'suburb' THEN 800 WHEN 'hamlet' THEN 500 WHEN 'island' THEN 2000 WHEN 'station' THEN 300 WHEN 'lake' THEN 500 ELSE 0 END"


@query(
    "reverse_zoom",
    f"{with_tables('points', 'customers')}, {_CELLS} SELECT point_id, zoom, record_id, kind, metres, CASE WHEN zoom <= 16 THEN round(metres - {_BONUS}, 3) ELSE metres END AS effective, "
    f"row_number() OVER (PARTITION BY point_id ORDER BY CASE WHEN zoom <= 16 THEN round(metres - {_BONUS}, 3) ELSE metres END, record_id) AS rank FROM met WHERE {_ZOOM} QUALIFY rank <= 3",
)
def reverse_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reverse lookup with zoom rules and head starts."""
    return spatial.reverse(fx.points(spark, sf_dir), fx.customers(spark, sf_dir), 3)


_INSIDE = (
    "hit AS (SELECT c.record_id AS point_id, e.admin_id, count(*) AS k FROM customers c JOIN edges e ON (e.y1 > c.lat_u) <> (e.y2 > c.lat_u) AND "
    "CASE WHEN e.y2 > e.y1 THEN (c.lon_u - e.x1) * (e.y2 - e.y1) < (c.lat_u - e.y1) * (e.x2 - e.x1) ELSE (c.lon_u - e.x1) * (e.y2 - e.y1) > (c.lat_u - e.y1) * (e.x2 - e.x1) END GROUP BY 1, 2), "
    "inside AS (SELECT point_id, min(admin_id) AS admin_id FROM hit WHERE k % 2 = 1 GROUP BY 1)"
)


def _customer_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.customers(spark, sf_dir).select(F.col("record_id").alias("point_id"), "lat_u", "lon_u")


@query("pip_assign", f"{with_tables('customers', 'edges')}, {_INSIDE} SELECT point_id, admin_id FROM inside")
def pip_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first polygon that holds a place."""
    return spatial.containing(_customer_points(spark, sf_dir), fx.polygons(spark, sf_dir))


@query(
    "nearest_centroid_fallback",
    f"{with_tables('customers', 'edges', 'centroids')}, {_INSIDE}, missed AS (SELECT record_id AS point_id, lat_u, lon_u FROM customers WHERE record_id NOT IN (SELECT point_id FROM inside)), "
    "far AS (SELECT point_id, a.admin_id, round(pow((a.lon_u - m.lon_u) / 1e6 * cos(radians(m.lat_u / 1e6)), 2) + pow((a.lat_u - m.lat_u) / 1e6, 2), 9) AS d FROM missed m, centroids a) "
    "SELECT point_id, admin_id, 'polygon' AS how FROM inside UNION ALL (SELECT point_id, admin_id, 'nearest' FROM far QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY d, admin_id) = 1)",
)
def nearest_centroid_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admin area of every place: by polygon, else by the nearest centre."""
    return spatial.assign_admin(_customer_points(spark, sf_dir), fx.polygons(spark, sf_dir), fx.centroids(spark, sf_dir))


# --- addresses -------------------------------------------------------------------------------


@query("postcode_centroid", f"{with_tables('addresses')} SELECT postcode, CAST(sum(lat_u) // count(*) AS BIGINT) AS lat_u, CAST(sum(lon_u) // count(*) AS BIGINT) AS lon_u, count(*) AS n, CAST(3500 + floor(log10(count(*)) * 250) AS INTEGER) AS importance FROM addresses GROUP BY postcode")
def postcode_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres of postcodes."""
    return streets.postcode_centroids(fx.addresses(spark, sf_dir))


@query("dominant_city", f"{with_tables('addresses')} SELECT street, muni, city, count(*) AS n FROM addresses GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY street, muni ORDER BY count(*) DESC, city) = 1")
def dominant_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The city that most addresses of a street name."""
    return streets.dominant_city(fx.addresses(spark, sf_dir), ["street", "muni"])


@query(
    "street_group",
    f"{with_tables('addresses')} SELECT street, muni, arg_min(display, osm_id) AS display, count(*) AS n_houses, CAST(sum(lat_u) // count(*) AS BIGINT) AS mean_lat, CAST(sum(lon_u) // count(*) AS BIGINT) AS mean_lon, "
    "list_sort(list(lat_u))[count(*) // 2 + 1] AS base_lat, list_sort(list(lon_u))[count(*) // 2 + 1] AS base_lon, min(number * 10 + suffix) AS first_house FROM addresses GROUP BY 1, 2",
)
def street_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streets with their houses, mean and median positions."""
    grouped = streets.street_groups(fx.addresses(spark, sf_dir))
    return grouped.withColumn("first_house", F.col("houses")[0]["number"] * 10 + F.col("houses")[0]["suffix"]).drop("houses")


@query(
    "house_lookup",
    f"{with_tables('addresses')}, q AS (SELECT l_orderkey * 10 + l_linenumber AS query_id, 'street ' || (l_orderkey % 211) AS street, CAST(l_suppkey % 7 AS INTEGER) AS muni, CAST(l_partkey % 120 AS INTEGER) AS number, CAST(l_linenumber % 3 AS INTEGER) AS suffix FROM lineitem), "
    "m AS (SELECT q.query_id, CASE WHEN q.number = a.number AND (q.suffix = a.suffix OR q.suffix = 0) THEN 0 WHEN q.number = a.number THEN 1 ELSE 2 END AS tier, a.number, a.suffix, a.lat_u, a.lon_u, abs(q.number - a.number) AS apart FROM q JOIN addresses a ON q.street = a.street AND q.muni = a.muni) "
    "SELECT query_id, tier, number, suffix, lat_u, lon_u FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY tier, apart, number, suffix, lat_u, lon_u) = 1",
)
def house_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Houses by exact number, by number, by the nearest number."""
    asked = fx.table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("query_id"), F.concat(F.lit("street "), (F.col("l_orderkey") % 211).cast("string")).alias("street"),
        (F.col("l_suppkey") % 7).cast("int").alias("muni"), (F.col("l_partkey") % 120).cast("int").alias("number"), (F.col("l_linenumber") % 3).cast("int").alias("suffix"),
    )
    return streets.find_houses(asked, fx.addresses(spark, sf_dir))


@query(
    "street_cascade",
    f"{with_tables('addresses')}, s AS (SELECT street, muni, arg_min(display, osm_id) AS display, CAST(sum(lat_u) // count(*) AS BIGINT) AS mean_lat, CAST(sum(lon_u) // count(*) AS BIGINT) AS mean_lon FROM addresses GROUP BY 1, 2), "
    "q AS (SELECT c_custkey AS query_id, 'street ' || (c_custkey % 211) AS street, CAST(c_custkey % 11 AS INTEGER) AS muni, CAST(59000000 + (c_custkey * 7919) % 200003 AS BIGINT) AS near_lat, CAST(18000000 + (c_custkey * 104729) % 400009 AS BIGINT) AS near_lon FROM customer), "
    f"m AS (SELECT query_id, CASE WHEN q.muni = s.muni THEN 0 ELSE 1 END AS prio, {hav('near_lat', 'near_lon', 'mean_lat', 'mean_lon')} AS metres, s.muni, display FROM q JOIN s ON q.street = s.street) "
    "SELECT query_id, prio, metres, muni, display FROM m WHERE prio = 0 OR metres < 15000 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY prio, metres, muni, display) = 1",
)
def street_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streets in the municipality asked for, else the nearest within reach."""
    grouped = streets.street_groups(fx.addresses(spark, sf_dir)).select("street", "muni", "display", "mean_lat", "mean_lon")
    k = F.col("c_custkey")
    asked = fx.table(spark, sf_dir, "customer").select(
        k.alias("query_id"), F.concat(F.lit("street "), (k % 211).cast("string")).alias("street"), (k % 11).cast("int").alias("muni"), fx.lat(k).alias("near_lat"), fx.lon(k).alias("near_lon")
    )
    return streets.street_cascade(asked, grouped)


@query(
    "interp_addresses",
    "WITH w AS (SELECT o_orderkey AS way_id, o_orderkey % 50 * 2 + 1 AS first, o_orderkey % 50 * 2 + 1 + (o_custkey % 40) * 2 AS last, CAST(59000000 + (o_orderkey * 7919) % 200003 AS BIGINT) AS lat_a, CAST(18000000 + (o_orderkey * 104729) % 400009 AS BIGINT) AS lon_a, "
    "CAST(59000000 + (o_custkey * 7919) % 200003 AS BIGINT) AS lat_b, CAST(18000000 + (o_custkey * 104729) % 400009 AS BIGINT) AS lon_b FROM orders), "
    "n AS (SELECT *, unnest(range(first, last + 1, 2)) AS number FROM w WHERE last > first AND (last - first) / 2 < 200) SELECT way_id, number, CAST(lat_a + floor((lat_b - lat_a) * ((number - first) / (last - first))) AS BIGINT) AS lat_u, CAST(lon_a + floor((lon_b - lon_a) * ((number - first) / (last - first))) AS BIGINT) AS lon_u FROM n",
)
def interp_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """House numbers interpolated along ways."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    first = k % 50 * 2 + 1
    ways = fx.table(spark, sf_dir, "orders").select(
        k.alias("way_id"), first.alias("first"), (first + c % 40 * 2).alias("last"), F.lit(2).cast("bigint").alias("step"), fx.lat(k).alias("lat_a"), fx.lon(k).alias("lon_a"), fx.lat(c).alias("lat_b"), fx.lon(c).alias("lon_b")
    )
    return streets.interpolated(ways)


@query(
    "way_shapes",
    "WITH p AS (SELECT l_orderkey AS way_id, l_linenumber AS pos, CAST(59000000 + (l_partkey * 7919) % 200003 AS BIGINT) AS lat_u, CAST(18000000 + (l_partkey * 104729) % 400009 AS BIGINT) AS lon_u FROM lineitem JOIN part ON l_partkey = p_partkey) "
    "SELECT way_id, CAST(sum(lat_u) // count(*) AS BIGINT) AS lat_u, CAST(sum(lon_u) // count(*) AS BIGINT) AS lon_u, min(lat_u) AS south, max(lat_u) AS north, min(lon_u) AS west, max(lon_u) AS east, count(*) AS n_nodes FROM p GROUP BY way_id",
)
def way_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres and boxes of ways from their nodes."""
    refs = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("way_id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("node_id"))
    nodes = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), fx.lat(F.col("p_partkey")).alias("lat_u"), fx.lon(F.col("p_partkey")).alias("lon_u"))
    return streets.way_shapes(refs, nodes).drop("metres")


@query(
    "admin_dimension",
    "SELECT CAST(row_number() OVER (ORDER BY name, osm_id) AS INTEGER) AS admin_id, name, osm_id FROM (SELECT c_mktsegment || ' ' || (c_custkey % 40) AS name, c_custkey AS osm_id FROM customer)",
)
def admin_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense admin ids in order of name and id."""
    named = fx.table(spark, sf_dir, "customer").select(F.concat("c_mktsegment", F.lit(" "), (F.col("c_custkey") % 40).cast("string")).alias("name"), F.col("c_custkey").alias("osm_id"))
    return streets.admin_dimension(named).select("admin_id", "name", "osm_id")


@query(
    "admin_population_backfill",
    "SELECT n_nationkey AS admin_id, n_name AS name, CAST(CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey * 1000 + 7 ELSE coalesce((SELECT sum((c_custkey * 7907) % 1000003) FROM customer WHERE c_nationkey = n_nationkey), 0) END AS BIGINT) AS population FROM nation",
)
def admin_population_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Populations of admin areas that have none, from their settlements."""
    n = F.col("n_nationkey")
    admin = fx.table(spark, sf_dir, "nation").select(n.alias("admin_id"), F.col("n_name").alias("name"), F.when(n % 3 == 0, n * 1000 + 7).otherwise(0).cast("bigint").alias("population"))
    people = fx.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("admin_id"), ((F.col("c_custkey") * 7907) % 1000003).alias("population"))
    return streets.backfill_population(admin, people)


# --- merging ---------------------------------------------------------------------------------


def _old_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as an old source; suppliers, moved by a few metres, as a new one."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    old = fx.table(spark, sf_dir, "customer").select(c.alias("osm_id"), F.concat(F.lit("place "), (c % 50).cast("string")).alias("name"), fx.lat(c).alias("lat_u"), fx.lon(c).alias("lon_u"))
    new = fx.table(spark, sf_dir, "supplier").select((s * 3).alias("osm_id"), F.concat(F.lit("place "), (s % 60).cast("string")).alias("name"), (fx.lat(s) + 400).alias("lat_u"), (fx.lon(s) - 300).alias("lon_u"))
    return old, new


_OLD_NEW = (
    "old AS (SELECT c_custkey AS osm_id, 'place ' || (c_custkey % 50) AS name, CAST(59000000 + (c_custkey * 7919) % 200003 AS BIGINT) AS lat_u, CAST(18000000 + (c_custkey * 104729) % 400009 AS BIGINT) AS lon_u FROM customer), "
    "new AS (SELECT s_suppkey * 3 AS osm_id, 'place ' || (s_suppkey % 60) AS name, CAST(59000000 + (s_suppkey * 7919) % 200003 AS BIGINT) + 400 AS lat_u, CAST(18000000 + (s_suppkey * 104729) % 400009 AS BIGINT) - 300 AS lon_u FROM supplier)"
)


@query("merge_by_id", f"WITH {_OLD_NEW} SELECT * FROM old UNION ALL SELECT * FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.osm_id = new.osm_id AND old.osm_id <> 0)")
def merge_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second source's rows where the first lacks their id."""
    return merge.by_id(*_old_new(spark, sf_dir))


@query(
    "dedup_grid_anti",
    f"WITH {_OLD_NEW} SELECT * FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.name = n.name AND abs(o.lat_u // 1000 - n.lat_u // 1000) <= 1 AND abs(o.lon_u // 1000 - n.lon_u // 1000) <= 1)",
)
def dedup_grid_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New places without an old one of the same name nearby."""
    return merge.by_name_nearby(*_old_new(spark, sf_dir))


@query(
    "self_dedup",
    "WITH r AS (SELECT o_orderkey AS record_id, 'n' || (o_custkey % 3) AS name, CAST(59000000 + (o_orderkey * 7919) % 200003 AS BIGINT) AS lat_u, CAST(18000000 + (o_orderkey * 104729) % 400009 AS BIGINT) AS lon_u FROM orders), c AS (SELECT *, lat_u // 1000 AS y, lon_u // 1000 AS x FROM r) "
    "SELECT a.record_id, a.name, a.lat_u, a.lon_u FROM c a LEFT JOIN c b ON a.name = b.name AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND b.record_id < a.record_id GROUP BY ALL HAVING count(b.record_id) = 0",
)
def self_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places without an earlier one of the same name nearby."""
    k = F.col("o_orderkey")
    rows = fx.table(spark, sf_dir, "orders").select(k.alias("record_id"), F.concat(F.lit("n"), (F.col("o_custkey") % 3).cast("string")).alias("name"), fx.lat(k).alias("lat_u"), fx.lon(k).alias("lon_u"))
    return merge.self_dedup(rows).select("record_id", "name", "lat_u", "lon_u")


@query(
    "dedup_addr_10m",
    f"{with_tables('addresses')}, new AS (SELECT osm_id + 1 AS osm_id, upper(street) AS street, housenumber, lat_u + CAST(osm_id % 3 AS BIGINT) * 70 AS lat_u, lon_u FROM addresses) "
    f"SELECT n.osm_id, n.street, n.housenumber, n.lat_u, n.lon_u FROM new n WHERE NOT EXISTS (SELECT 1 FROM addresses o WHERE lower(o.street) = lower(n.street) AND lower(o.housenumber) = lower(n.housenumber) AND {hav('n.lat_u', 'n.lon_u', 'o.lat_u', 'o.lon_u')} < 10)",
)
def dedup_addr_10m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New addresses without the same address within ten metres."""
    old = fx.addresses(spark, sf_dir)
    new = old.select((F.col("osm_id") + 1).alias("osm_id"), F.upper("street").alias("street"), "housenumber", (F.col("lat_u") + (F.col("osm_id") % 3) * 70).alias("lat_u"), "lon_u")
    return merge.addresses_apart(old, new)


@query(
    "cdc_apply",
    "WITH base AS (SELECT DISTINCT user_id * 2 AS osm_id, 'old' AS state, 0.0::DOUBLE AS value FROM events), last AS (SELECT user_id AS osm_id, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'modify' END AS action, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) "
    "SELECT * FROM base WHERE osm_id NOT IN (SELECT osm_id FROM last) UNION ALL SELECT osm_id, action, value FROM last WHERE action <> 'delete'",
)
def cdc_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table after a change feed."""
    events = fx.table(spark, sf_dir, "events")
    base = events.select((F.col("user_id") * 2).alias("osm_id")).distinct().withColumn("state", F.lit("old")).withColumn("value", F.lit(0.0))
    action = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "delete").otherwise("modify")
    changes = events.select(F.col("user_id").alias("osm_id"), action.alias("action"), action.alias("state"), "value", "ts", "event_id")
    return merge.apply_changes(base, changes, "osm_id", ["ts", "event_id"])


@query("index_diff", "WITH a AS (SELECT o_orderkey, o_custkey % 3 AS v FROM orders), b AS (SELECT o_orderkey, o_custkey % 4 AS v FROM orders) (SELECT *, 'a' AS side FROM (FROM a EXCEPT ALL FROM b)) UNION ALL (SELECT *, 'b' FROM (FROM b EXCEPT ALL FROM a))")
def index_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that only one of two indices has."""
    rows = fx.table(spark, sf_dir, "orders")
    side = lambda n: rows.select("o_orderkey", (F.col("o_custkey") % n).alias("v"))
    return merge.symmetric_difference(side(3), side(4))


@query(
    "remap_fallback",
    "WITH d AS (SELECT n_name AS name, n_regionkey AS state, n_nationkey AS id FROM nation), l AS (SELECT name, min(id) AS id FROM d GROUP BY name) SELECT c_custkey AS record_id, coalesce(d.id, l.id) AS id FROM (SELECT c_custkey, 'NATION_' || (c_custkey % 30) AS name, CAST(c_custkey % 5 AS INTEGER) AS state FROM customer) c LEFT JOIN d ON d.name = c.name AND d.state = c.state LEFT JOIN l ON l.name = c.name",
)
def remap_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admin ids by name and state, else by name alone."""
    d = fx.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("state"), F.col("n_nationkey").alias("id"))
    rows = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record_id"), F.concat(F.lit("NATION_"), (F.col("c_custkey") % 30).cast("string")).alias("name"), (F.col("c_custkey") % 5).cast("int").alias("state"))
    return merge.with_fallback(rows, d, d.groupBy("name").agg(F.min("id").alias("id")), ["name", "state"], ["name"], "id").select("record_id", "id")


@query(
    "multi_table_join",
    "SELECT l_orderkey * 10 + l_linenumber AS address_id, o_orderstatus AS street_type, c_name AS locality, n_name AS state, r_name AS country, CAST(l_quantity AS INTEGER) AS number FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
def multi_table_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry's five tables joined into addresses."""
    t = lambda n: fx.table(spark, sf_dir, n)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("address_id"), F.col("o_orderstatus").alias("street_type"), F.col("c_name").alias("locality"), F.col("n_name").alias("state"), F.col("r_name").alias("country"), F.col("l_quantity").cast("int").alias("number")
    )


# --- scalars ---------------------------------------------------------------------------------


@query(
    "importance_score",
    f"{with_tables('places')} SELECT record_id, CAST(least(CASE WHEN kind IN ('city','town') AND population > 100 THEN floor(log10(CAST(population AS DOUBLE)) * 4000) ELSE 0 END + CASE kind WHEN 'city' THEN 10000 WHEN 'town' THEN 6000 WHEN 'village' THEN 2000 WHEN 'suburb' THEN 1500 WHEN 'hamlet' THEN 500 WHEN 'island' THEN 3000 WHEN 'station' THEN 1500 WHEN 'lake' THEN 1000 WHEN 'park' THEN 2500 WHEN 'landmark' THEN 2500 ELSE 300 END "
    "+ CASE WHEN notable THEN 8000 ELSE 0 END + least(translations, 5) * 1500 + CASE WHEN population * 3 > 10000 THEN floor((log10(CAST(population * 3 AS DOUBLE)) - 4) * 1500) ELSE 0 END, 65535) AS INTEGER) AS importance FROM places",
)
def importance_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of all places."""
    score = scoring.importance(F.col("kind"), F.col("population"), F.col("notable"), F.col("translations"), F.col("population") * 3)
    return fx.places(spark, sf_dir).select("record_id", score.alias("importance"))


@query(
    "bbox_codec",
    f"{with_tables('customers')}, e AS (SELECT record_id, lat_u, greatest(-32768, least(32767, CAST(trunc((record_id * 977 % 2000003 - 1000000) / 16) AS BIGINT))) AS delta FROM customers) SELECT record_id, delta, lat_u + delta * 16 AS edge FROM e",
)
def bbox_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box edges encoded as clamped distances and decoded."""
    edge = F.col("lat_u") + F.col("record_id") * 977 % 2000003 - 1000000
    coded = fx.customers(spark, sf_dir).select("record_id", "lat_u", geo.box_delta(F.col("lat_u"), edge).alias("delta"))
    return coded.select("record_id", "delta", geo.box_edge(F.col("lat_u"), F.col("delta")).alias("edge"))


@query(
    "muni_hash",
    "SELECT name, list_reduce(list_prepend(CAST(5381 AS BIGINT), list_transform(string_split(name, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, b: (h * 33 + b) % 4294967296) % 65534 + 1 AS bucket FROM (SELECT DISTINCT p_name AS name FROM part)",
)
def muni_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City names folded to 16-bit buckets."""
    return fx.table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct().withColumn("bucket", hashing.djb2_bucket(F.col("name")))


_TYPE_NUMBER = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in scoring.PLACE_TYPES.items() if k in fx.KINDS) + " ELSE 255 END"


@query(
    "place_id",
    f"{with_tables('places')} SELECT record_id, CASE WHEN record_id = 0 THEN 0 ELSE CAST(list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform([78::BIGINT] || list_transform(range(0, 8), lambda i: (record_id >> (8 * i)::INTEGER) & 255) || [({_TYPE_NUMBER})::BIGINT], lambda x: x::UHUGEINT)), "
    "lambda h, b: xor(h, b) * 1099511628211::UHUGEINT % 18446744073709551616::UHUGEINT) & 9007199254740991::UHUGEINT AS BIGINT) END AS place_id FROM places",
)
def place_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable ids of all places."""
    number = scoring.by_type(F.col("kind"), scoring.PLACE_TYPES, 255)
    return fx.places(spark, sf_dir).select("record_id", hashing.place_id(F.lit("N"), F.col("record_id"), number).alias("place_id"))


@query(
    "housenumber_parse",
    "SELECT raw, CASE WHEN CAST(regexp_extract(raw, '^([0-9]+)', 1) AS BIGINT) <= 65535 THEN CAST(regexp_extract(raw, '^([0-9]+)', 1) AS INTEGER) ELSE 0 END AS number, CASE WHEN regexp_extract(raw, '^[0-9]+([A-Za-z])', 1) <> '' THEN ascii(upper(regexp_extract(raw, '^[0-9]+([A-Za-z])', 1))) - 64 ELSE 0 END AS suffix "
    "FROM (SELECT DISTINCT (o_orderkey * 37 % 90001) || CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN chr(CAST(97 + o_orderkey % 26 AS INTEGER)) ELSE '-' || (o_orderkey % 9) END AS raw FROM orders)",
)
def housenumber_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and letters of house numbers."""
    k = F.col("o_orderkey")
    tail = F.when(k % 3 == 0, "").when(k % 3 == 1, F.char(97 + k % 26)).otherwise(F.concat(F.lit("-"), (k % 9).cast("string")))
    raw = fx.table(spark, sf_dir, "orders").select(F.concat((k * 37 % 90001).cast("string"), tail).alias("raw")).distinct()
    return raw.select("raw", address.house_number(F.col("raw")).alias("h")).select("raw", "h.number", "h.suffix")


@query(
    "display_name",
    "SELECT c_custkey AS record_id, array_to_string(list_filter([a, CASE WHEN b <> a THEN b END, CASE WHEN c <> a AND c <> b THEN c END, p], lambda x: x IS NOT NULL AND x <> ''), ', ') AS display_name FROM (SELECT c_custkey, 'N' || (c_custkey % 4) AS a, 'N' || (c_custkey % 3) AS b, 'N' || (c_custkey % 5) AS c, CASE WHEN c_custkey % 2 = 0 THEN 'N1' END AS p FROM customer)",
)
def display_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display names without repeated parts."""
    k = F.col("c_custkey")
    part = lambda n: F.concat(F.lit("N"), (k % n).cast("string"))
    return fx.table(spark, sf_dir, "customer").select(k.alias("record_id"), address.display_name([part(4), part(3), part(5)], F.when(k % 2 == 0, "N1")).alias("display_name"))


@query(
    "structured_query",
    "SELECT c_custkey AS query_id, array_to_string(list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'street ' || (c_custkey % 9) END, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'city ' || (c_custkey % 4) END, CASE WHEN c_custkey % 5 = 0 THEN 'land' END], lambda x: x IS NOT NULL AND x <> ''), ', ') AS q FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 <> 0 OR c_custkey % 5 = 0",
)
def structured_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured parameters as one query text."""
    k = F.col("c_custkey")
    street = F.when(k % 2 == 0, F.concat(F.lit("street "), (k % 9).cast("string")))
    city = F.when(k % 3 == 0, "  ").otherwise(F.concat(F.lit("city "), (k % 4).cast("string")))
    made = address.structured_query(street, city, F.when(k % 5 == 0, "land"))
    return fx.table(spark, sf_dir, "customer").select(k.alias("query_id"), made.alias("q")).where("q IS NOT NULL")


@query(
    "postcode_shapes",
    "SELECT raw, CASE WHEN regexp_matches(raw, '^([0-9]{4,7}|[0-9]{2,3} [0-9]{2,3})$') THEN replace(raw, ' ', '') WHEN regexp_matches(raw, '^[A-Za-z]{2}[- ][0-9]{4,6}$') THEN substr(raw, 4) END AS postcode FROM (SELECT DISTINCT CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey + 1000 AS VARCHAR) WHEN 1 THEN (100 + o_orderkey % 899) || ' ' || (10 + o_orderkey % 89) WHEN 2 THEN 'DK-' || (1000 + o_orderkey % 8999) ELSE 'x' || o_orderkey END AS raw FROM orders)",
)
def postcode_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that have a postcode's shape, in normal form."""
    k = F.col("o_orderkey")
    raw = F.when(k % 4 == 0, (k + 1000).cast("string")).when(k % 4 == 1, F.concat((100 + k % 899).cast("string"), F.lit(" "), (10 + k % 89).cast("string"))).when(k % 4 == 2, F.concat(F.lit("DK-"), (1000 + k % 8999).cast("string"))).otherwise(F.concat(F.lit("x"), k.cast("string")))
    return fx.table(spark, sf_dir, "orders").select(raw.alias("raw")).distinct().select("raw", address.postcode_of(F.col("raw")).alias("postcode"))


@query(
    "result_json",
    f"{with_tables('places')} SELECT record_id, '{{\"type\":\"Feature\",\"geometry\":{{\"type\":\"Point\",\"coordinates\":[' || lon_u || ',' || lat_u || ']}},\"properties\":{{\"name\":\"' || name || '\",\"category\":\"' || kind || '\"}}}}' AS feature FROM places",
)
def result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as GeoJSON features, coordinates in microdegrees."""
    point = F.struct(F.lit("Point").alias("type"), F.array("lon_u", "lat_u").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct("name", F.col("kind").alias("category")).alias("properties"))
    return fx.places(spark, sf_dir).select("record_id", F.to_json(feature).alias("feature"))


# --- lookups and totals ----------------------------------------------------------------------


@query("id_lookup", f"{with_tables('places')} SELECT s_suppkey AS query_id, record_id, name, kind FROM supplier JOIN places ON record_id = s_suppkey * 11")
def id_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places by id."""
    ids = fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), (F.col("s_suppkey") * 11).alias("record_id"))
    return ids.join(fx.places(spark, sf_dir), "record_id").select("query_id", "record_id", "name", "kind")


@query("qid_best", f"{with_tables('places')} SELECT record_id % 97 AS qid, arg_min(record_id, struct_pack(m := -importance, r := record_id)) AS record_id FROM places GROUP BY 1")
def qid_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most important record of every identifier, the smallest id of equals."""
    best = F.min(F.struct((-F.col("importance")).alias("m"), "record_id"))
    return fx.scored_places(spark, sf_dir).groupBy((F.col("record_id") % 97).alias("qid")).agg(best.alias("b")).select("qid", F.col("b.record_id").alias("record_id"))


@query("status_totals", f"{with_tables('places')} SELECT country, count(*) AS n_places, count(DISTINCT name) AS n_names FROM places GROUP BY ROLLUP (country)")
def status_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and names by country, and in all."""
    return fx.places(spark, sf_dir).rollup("country").agg(F.count("*").alias("n_places"), F.countDistinct("name").alias("n_names"))


@query("zip_keep_first", "SELECT o_custkey % 100 AS zip, min(o_orderkey) AS record_id, arg_min(o_orderpriority, o_orderkey) AS city FROM orders GROUP BY 1")
def zip_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ZIP rows: the first of every code."""
    first = F.min(F.struct("o_orderkey", "o_orderpriority"))
    return fx.table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 100).alias("zip")).agg(first.alias("f")).select("zip", F.col("f.o_orderkey").alias("record_id"), F.col("f.o_orderpriority").alias("city"))


@query(
    "zip_crosswalk",
    "SELECT c_custkey AS zip, CASE WHEN s.s_acctbal > 0 THEN s.s_name ELSE c_name END AS city, c_nationkey AS state FROM customer LEFT JOIN supplier s ON s_suppkey = c_custkey",
)
def zip_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ZIP rows overwritten by a crosswalk where it is valid."""
    rows = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("zip"), F.col("c_name").alias("city"), F.col("c_nationkey").alias("state"))
    updates = fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("zip"), F.col("s_name").alias("city"), "s_acctbal")
    return merge.overwrite_where(rows, updates, "zip", ["city"], F.col("s_acctbal") > 0)


@query("population_weights", f"{with_tables('places')}, c AS (SELECT country, sum(population) AS p FROM places GROUP BY 1) SELECT country, round(p / sum(p) OVER (), 9) AS weight FROM c")
def population_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries' shares of the population."""
    by = fx.places(spark, sf_dir).groupBy("country").agg(F.sum("population").alias("p"))
    total = by.agg(F.sum("p").alias("t"))
    return by.join(F.broadcast(total)).select("country", F.round(F.col("p") / F.col("t"), 9).alias("weight"))


@query(
    "stratified_sample",
    f"{with_tables('places')} SELECT record_id, kind FROM places QUALIFY row_number() OVER (PARTITION BY kind ORDER BY (record_id * 2654435761 + 40503) % 4294967296, record_id) <= 7",
)
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven places of every type, the same on every run."""
    return quality.sample_by_stratum(fx.places(spark, sf_dir), "kind", "record_id", 7).select("record_id", "kind")


# --- reports ---------------------------------------------------------------------------------

_RUNS = (
    "runs AS (SELECT o_orderkey AS id, o_orderstatus AS kind, CAST(o_custkey % 5 AS INTEGER) AS country, (o_orderkey * 7919 % 45000) AS distance_m, o_orderkey % 11 <> 0 AS a, o_orderkey % 7 <> 0 AS b FROM orders), "
    "cat AS (SELECT *, CASE WHEN NOT a AND NOT b THEN 'BOTH_MISS' WHEN NOT a THEN 'MISS_A' WHEN NOT b THEN 'MISS_B' WHEN distance_m < 200 THEN 'AGREE' WHEN distance_m < 2000 THEN 'CLOSE' WHEN distance_m < 20000 THEN 'DIVERGE' ELSE 'CONFLICT' END AS category FROM runs)"
)


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    runs = fx.table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_orderstatus").alias("kind"), (F.col("o_custkey") % 5).cast("int").alias("country"), (k * 7919 % 45000).alias("distance_m"), (k % 11 != 0).alias("a"), (k % 7 != 0).alias("b"))
    return runs.withColumn("category", scoring.compare_category(F.col("distance_m"), F.col("a"), F.col("b")))


@query(
    "compare_report",
    f"WITH {_RUNS}, g AS (SELECT kind, country, category, count(*) AS n, grouping(kind) AS gk, grouping(country) AS gc FROM cat GROUP BY GROUPING SETS ((category), (kind, category), (country, category))) SELECT kind, country, category, n, round(n * 100.0 / sum(n) OVER (PARTITION BY gk, gc, kind, country), 3) AS pct FROM g",
)
def compare_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two engines in all, by kind and by country."""
    return quality.category_report(_runs(spark, sf_dir), ["kind", "country"])


@query(
    "percentile_report",
    f"WITH {_RUNS}, r AS (SELECT distance_m, row_number() OVER (ORDER BY distance_m) - 1 AS i, count(*) OVER () AS n FROM cat WHERE a AND b) SELECT CAST(p AS DOUBLE) AS share, distance_m AS value FROM r, (VALUES (0.5), (0.9), (0.99)) s(p) WHERE i = floor(p * (n - 1) + 0.5)",
)
def percentile_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles of the distances."""
    return quality.nearest_rank(_runs(spark, sf_dir).where("a AND b"), "distance_m", [0.5, 0.9, 0.99])


@query("distance_histogram", f"WITH {_RUNS} SELECT CASE WHEN distance_m < 100 THEN '<100 m' WHEN distance_m < 1000 THEN '<1 km' WHEN distance_m < 10000 THEN '<10 km' ELSE '>=10 km' END AS bin, count(*) AS n FROM cat GROUP BY 1")
def distance_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances in four bins."""
    return quality.histogram(_runs(spark, sf_dir), "distance_m", [100, 1000, 10000], ["<100 m", "<1 km", "<10 km", ">=10 km"])


@query("attention_flags", f"WITH {_RUNS} SELECT country, count(*) AS n, count(*) FILTER (category = 'MISS_A') AS n_miss FROM cat GROUP BY 1 HAVING count(*) FILTER (category = 'MISS_A') * 100 > count(*) * 2")
def attention_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries where one engine misses more than two in a hundred."""
    counted = _runs(spark, sf_dir).groupBy("country").agg(F.count("*").alias("n"), F.count_if(F.col("category") == "MISS_A").alias("n_miss"))
    return counted.where(F.col("n_miss") * 100 > F.col("n") * 2)


@query(
    "trend_report",
    f"WITH {_RUNS}, o AS (SELECT round(avg(CASE WHEN category = 'AGREE' THEN 1.0 ELSE 0.0 END) * 100, 4) AS overall FROM cat), r AS (SELECT round(avg(CASE WHEN category = 'AGREE' THEN 1.0 ELSE 0.0 END) * 100, 4) AS recent FROM (SELECT * FROM cat ORDER BY id DESC LIMIT 1000)) SELECT overall, recent, CASE WHEN recent > overall + 0.5 THEN 'up' WHEN recent < overall - 0.5 THEN 'down' ELSE 'flat' END AS direction FROM o, r",
)
def trend_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last thousand runs against all."""
    return quality.trend(_runs(spark, sf_dir), F.col("category") == "AGREE")


@query(
    "audit_counts",
    f"{with_tables('customers')}, p AS (SELECT kind, CASE WHEN record_id % 17 = 0 THEN 0 ELSE lat_u END AS lat_u, CASE WHEN record_id % 17 = 0 THEN 0 ELSE lon_u END AS lon_u, CASE WHEN record_id % 19 <> 0 THEN segment END AS name FROM customers) "
    "SELECT kind, count(*) AS n, count(*) FILTER (lat_u = 0 AND lon_u = 0) AS n_zero, count(*) FILTER (NOT (lat_u BETWEEN 59010000 AND 59190000) AND NOT (lat_u = 0 AND lon_u = 0)) AS n_outside, count(*) FILTER (name IS NULL) AS n_unnamed FROM p GROUP BY kind",
)
def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places without position, outside their country, without name."""
    k = F.col("record_id")
    rows = fx.customers(spark, sf_dir).select("kind", F.when(k % 17 == 0, 0).otherwise(F.col("lat_u")).alias("lat_u"), F.when(k % 17 == 0, 0).otherwise(F.col("lon_u")).alias("lon_u"), F.when(k % 19 != 0, F.col("segment")).alias("name"))
    return quality.audit(rows, F.col("lat_u").between(59010000, 59190000))


# --- usage -----------------------------------------------------------------------------------

_DAILY = "daily AS (SELECT key, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS day, count(*) AS requests, count(*) FILTER (failed) AS errors FROM requests GROUP BY 1, 2)"


@query("usage_daily", f"{with_tables('requests')}, {_DAILY} SELECT * FROM daily")
def usage_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and errors by key and day."""
    return usage.daily(fx.requests(spark, sf_dir))


@query("usage_upsert", f"{with_tables('requests')}, {_DAILY} SELECT key, day, requests * 2 AS requests, errors * 2 AS errors FROM daily")
def usage_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rollup added to itself."""
    rolled = usage.daily(fx.requests(spark, sf_dir))
    return usage.upsert_add(rolled, rolled)


@query("usage_mtd", f"{with_tables('requests')}, {_DAILY} SELECT key, day, CAST(sum(requests) OVER (PARTITION BY key, day // 100 ORDER BY day) AS BIGINT) AS month_to_date FROM daily")
def usage_mtd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sums within the month."""
    return usage.month_to_date(usage.daily(fx.requests(spark, sf_dir)))


@query("quota_month", f"{with_tables('requests')} SELECT key, event_id, row_number() OVER (PARTITION BY key, date_trunc('month', ts) ORDER BY ts, event_id) AS nth, row_number() OVER (PARTITION BY key, date_trunc('month', ts) ORDER BY ts, event_id) <= 50 AS allowed FROM requests")
def quota_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests within a monthly quota."""
    return usage.monthly_quota(fx.requests(spark, sf_dir), 50).select("key", "event_id", "nth", "allowed")


@query("gcra_limit")
def gcra_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that a rate limit lets pass: one in six hours, bursts of a day."""
    return usage.rate_limited(fx.requests(spark, sf_dir), 6 * 3600 * 1_000_000, 24 * 3600 * 1_000_000)


@query(
    "decision_cascade",
    "SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'malformed' WHEN user_id % 11 = 0 THEN 'unknown' WHEN user_id % 7 = 0 THEN 'blocked' WHEN value > 90 THEN 'rate' WHEN event_type = 'error' THEN 'quota' ELSE 'ok' END AS decision FROM events",
)
def decision_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that rejects a request."""
    e = fx.table(spark, sf_dir, "events").select(
        "event_id", (F.col("event_id") % 13 != 0).alias("well_formed"), (F.col("user_id") % 11 != 0).alias("known"), (F.col("user_id") % 7 == 0).alias("blocked"), (F.col("value") <= 90).alias("within_rate"), (F.col("event_type") != "error").alias("within_quota")
    )
    return usage.decisions(e).select("event_id", "decision")


# --- rules and planning ----------------------------------------------------------------------

#: Boxes that stand in for countries, the first that holds a point wins.
_BOXES = [("aa", 59000000, 59080000, 18000000, 18200000), ("bb", 59040000, 59160000, 18100000, 18300000), ("cc", 59000000, 59200003, 18000000, 18350000)]


@query(
    "country_by_box",
    f"{with_tables('customers')} SELECT record_id, CASE WHEN lat_u BETWEEN 59000000 AND 59080000 AND lon_u BETWEEN 18000000 AND 18200000 THEN 'aa' WHEN lat_u BETWEEN 59040000 AND 59160000 AND lon_u BETWEEN 18100000 AND 18300000 THEN 'bb' WHEN lat_u BETWEEN 59000000 AND 59200003 AND lon_u BETWEEN 18000000 AND 18350000 THEN 'cc' END AS country FROM customers",
)
def country_by_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries by an ordered list of boxes."""
    return fx.customers(spark, sf_dir).select("record_id", rules.first_box(F.col("lat_u"), F.col("lon_u"), _BOXES).alias("country"))


@query(
    "admin_validity",
    "SELECT c_custkey AS record_id, CASE c_nationkey % 2 WHEN 0 THEN contains(c_name, '7') ELSE true END AS valid FROM customer",
)
def admin_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas whose names have their country's form."""
    country = F.when(F.col("c_nationkey") % 2 == 0, "even").otherwise("odd")
    return fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record_id"), rules.valid_for(F.col("c_name"), F.lit(7), country, {("even", 7): "7"}).alias("valid"))


@query(
    "nearest_settlement",
    f"{with_tables('points', 'customers')}, {_CELLS} SELECT point_id, record_id, metres FROM met WHERE kind IN ('city', 'town', 'village') AND metres <= 30000 QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY CASE kind WHEN 'city' THEN 0 WHEN 'town' THEN 1 ELSE 2 END, metres, record_id) = 1",
)
def nearest_settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The settlement of a point: by rank, then by distance."""
    rank = F.when(F.col("kind") == "city", 3).when(F.col("kind") == "town", 2).otherwise(1)
    towns = fx.customers(spark, sf_dir).where("kind IN ('city', 'town', 'village')").withColumn("priority", rank)
    return rules.best_settlement(fx.points(spark, sf_dir), towns, 30000)


@query(
    "postcode_settlement",
    f"{with_tables('points', 'customers')}, {_CELLS}, n AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY metres, record_id) <= 16) SELECT point_id, record_id FROM n WHERE metres <= 5000 QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY (record_id * 48271) % 65521 DESC, metres, record_id) = 1",
)
def postcode_settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most important of the nearest places."""
    places = fx.customers(spark, sf_dir).withColumn("importance", (F.col("record_id") * 48271) % 65521)
    return rules.important_nearby(fx.points(spark, sf_dir), places, 16, 5000)


@query(
    "zip_county",
    f"{with_tables('points', 'customers')}, m AS (SELECT p.point_id, c.record_id, {hav('p.lat_u', 'p.lon_u', 'c.lat_u', 'c.lon_u')} AS metres FROM points p JOIN customers c ON p.point_id % 25 = c.admin_id AND abs(p.lat_u - c.lat_u) <= 50000 AND abs(p.lon_u - c.lon_u) <= 50000) SELECT point_id, record_id, metres FROM m QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY metres, record_id) = 1",
)
def zip_county(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest place of a point's own state, within a band."""
    asked = fx.points(spark, sf_dir).withColumn("state", (F.col("point_id") % 25).cast("int"))
    return rules.nearest_in_state(asked, fx.customers(spark, sf_dir).withColumnRenamed("admin_id", "state"), 50000)


@query(
    "planned_phases",
    "WITH s AS (SELECT n_nationkey AS country, p AS phase, CAST(p AS INTEGER) AS ord, (n_nationkey * p) % 7 AS f, CASE WHEN (n_nationkey + p) % 4 <> 0 THEN (n_nationkey * p) % 7 WHEN (n_nationkey + p) % 8 = 0 THEN 99 END AS b FROM nation, range(1, 7) r(p)) SELECT country, phase, ord, max(CASE WHEN f IS DISTINCT FROM b THEN 1 ELSE 0 END) OVER (PARTITION BY country ORDER BY ord) = 1 AS run FROM s",
)
def planned_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build phases to run: those that changed and all behind them."""
    n = F.col("n_nationkey")
    states = fx.table(spark, sf_dir, "nation").select(n.alias("country"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("ord")).select("country", F.col("ord").cast("bigint").alias("phase"), "ord", (F.col("country") * F.col("ord") % 7).alias("fingerprint"))
    mark = (F.col("country") + F.col("ord")) % 8
    previous = states.where(mark != 4).withColumn("fingerprint", F.when(mark == 0, 99).otherwise(F.col("fingerprint")))
    return rules.planned_phases(states, previous)


@query("stitched_rings", "SELECT CAST(n_nationkey AS BIGINT) AS relation_id, 0 AS ring_no, 5 AS n_points FROM nation")
def stitched_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons cut into pieces and stitched again."""
    ring = fx.polygons(spark, sf_dir).select(F.col("admin_id").cast("bigint").alias("relation_id"), F.transform("ring", lambda p: F.struct((p["lat"] / 1e6).alias("lat"), (p["lon"] / 1e6).alias("lon"))).alias("r"))
    pieces = F.array(F.slice("r", 1, 3), F.reverse(F.slice("r", 3, 3)))
    members = ring.select("relation_id", F.posexplode(pieces).alias("ord", "points"))
    return rules.stitched_rings(members).select("relation_id", "ring_no", F.size("ring").alias("n_points"))
