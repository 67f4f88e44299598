"""Streets, houses, postcodes, interpolation and admin dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placeloom.functions import address, geo, hashing


def postcode_centroids(addresses: DataFrame) -> DataFrame:
    """(postcode, lat_u, lon_u, n, importance): integer means."""
    mean = lambda c: F.expr(f"sum({c}) div count(*)")
    grouped = addresses.groupBy("postcode").agg(mean("lat_u").alias("lat_u"), mean("lon_u").alias("lon_u"), F.count("*").alias("n"))
    return grouped.withColumn("importance", (3500 + F.floor(F.log10("n") * 250)).cast("int"))


def dominant_city(addresses: DataFrame, by: list[str]) -> DataFrame:
    """The most frequent city of every group, the alphabetically first of equals."""
    counted = addresses.groupBy(*by, "city").agg(F.count("*").alias("n"))
    best = counted.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("minus"), "city")).alias("b"))
    return best.select(*by, F.col("b.city").alias("city"), (-F.col("b.minus")).alias("n"))


def street_groups(addresses: DataFrame) -> DataFrame:
    """Streets by (street, muni): first display name, mean and median position, house list by number."""
    houses = F.sort_array(F.collect_list(F.struct("number", "suffix", "lat_u", "lon_u")))
    lats, lons = F.sort_array(F.collect_list("lat_u")), F.sort_array(F.collect_list("lon_u"))
    middle = lambda a: F.element_at(a, (F.size(a) / 2).cast("int") + 1)
    return addresses.groupBy("street", "muni").agg(
        F.min(F.struct("ord", "display"))["display"].alias("display"),
        F.count("*").alias("n_houses"),
        F.expr("sum(lat_u) div count(*)").alias("mean_lat"),
        F.expr("sum(lon_u) div count(*)").alias("mean_lon"),
        middle(lats).alias("base_lat"),
        middle(lons).alias("base_lon"),
        houses.alias("houses"),
    )


def find_houses(queries: DataFrame, houses: DataFrame) -> DataFrame:
    """The house of every query (query_id, street, muni, number, suffix): tier 0 exact, 1 by number, 2 nearest number.

    Houses are first reduced to one of each number and suffix, and to one of each number; queries
    then find their number by equality, and only the others look for the nearest one, as the last
    number before and the first behind them in one sorted run of their street.
    """
    street = ["street", "muni"]
    place = F.min(F.struct("lat_u", "lon_u")).alias("at")
    each = houses.groupBy(*street, "number", "suffix").agg(place)
    first = each.groupBy(*street, "number").agg(F.min(F.struct("suffix", "at")).alias("first"))
    asked = queries.join(each.withColumnRenamed("at", "same"), [*street, "number", "suffix"], "left").join(first, [*street, "number"], "left")
    same = F.col("same").isNotNull() & (F.col("suffix") != 0)
    met = asked.where("first IS NOT NULL").select(
        "query_id", F.when(same | (F.col("suffix") == 0), 0).otherwise(1).alias("tier"), F.lit(0).alias("apart"), "number", F.when(same, F.col("suffix")).otherwise(F.col("first.suffix")).alias("suffix"), F.when(same, F.col("same")).otherwise(F.col("first.at")).alias("at")
    )
    # houses and the other queries of a street in order of their numbers
    marks = first.select(*street, "number", F.struct("number", "first").alias("house"), F.lit(None).cast("bigint").alias("query_id"))
    lone = asked.where("first IS NULL").select(*street, "number", F.lit(None).cast(marks.schema["house"].dataType).alias("house"), F.col("query_id").cast("bigint"))
    up, down = W.partitionBy(*street).orderBy("number"), W.partitionBy(*street).orderBy(F.desc("number"))
    before = lambda order: F.last("house", True).over(order.rowsBetween(W.unboundedPreceding, -1))
    near = marks.unionByName(lone).withColumn("below", before(up)).withColumn("above", before(down)).where("query_id IS NOT NULL")
    closer = F.when(F.col("above").isNull() | (F.col("number") - F.col("below.number") <= F.col("above.number") - F.col("number")), F.col("below")).otherwise(F.col("above"))
    near = near.withColumn("house", closer).where("house IS NOT NULL")
    near = near.select("query_id", F.lit(2).alias("tier"), F.abs(F.col("number") - F.col("house.number")).alias("apart"), F.col("house.number").alias("number"), F.col("house.first.suffix").alias("suffix"), F.col("house.first.at").alias("at"))
    # a query_id may stand for several queries
    best = met.unionByName(near).groupBy("query_id").agg(F.min(F.struct("tier", "apart", "number", "suffix", "at")).alias("b"))
    return best.select("query_id", "b.tier", "b.number", "b.suffix", "b.at.lat_u", "b.at.lon_u")


def nearest_house(points: DataFrame, addresses: DataFrame, metres: float = 200.0) -> DataFrame:
    """The nearest address within reach of every point: an equi join on the nine cells around."""
    cells = geo.around(geo.cell_x(F.col("lon_u")), geo.cell_y(F.col("lat_u")))
    asked = points.select("point_id", "lat_u", "lon_u", F.explode(cells).alias("c")).select("point_id", "lat_u", "lon_u", "c.gx", "c.gy")
    placed = addresses.select("osm_id", "street", "housenumber", "postcode", F.col("lat_u").alias("a_lat"), F.col("lon_u").alias("a_lon"))
    placed = placed.withColumn("gx", geo.cell_x(F.col("a_lon"))).withColumn("gy", geo.cell_y(F.col("a_lat")))
    far = F.round(geo.haversine_m(F.col("lat_u"), F.col("lon_u"), F.col("a_lat"), F.col("a_lon")), 3)
    met = asked.join(placed, ["gx", "gy"]).withColumn("metres", far).where(F.col("metres") <= metres)
    best = met.groupBy("point_id").agg(F.min(F.struct("metres", "osm_id", "street", "housenumber", "postcode")).alias("b"))
    return best.select("point_id", "b.metres", "b.osm_id", "b.street", "b.housenumber", "b.postcode")


def search_addresses(queries: DataFrame, addresses: DataFrame) -> DataFrame:
    """The address of every query in words (query_id, q): street and number by equality, the city asked for first.

    Ranks: 0 the city agrees, 1 the postcode agrees, 2 neither was asked for, 3 elsewhere.
    """
    # generators keep the optimizer from repeating the parser for every field
    parsed = queries.select("query_id", F.inline(F.filter(F.array(address.parsed_address(F.col("q"))), lambda p: p.isNotNull())))
    named = parsed.select("query_id", "street", F.lower("city").alias("q_city"), F.regexp_replace("postcode", " ", "").alias("q_postcode"), F.inline(F.array(address.house_number(F.col("number")))))
    asked = named.select("query_id", "street", "number", "suffix", "q_city", "q_postcode")
    held = addresses.select(F.lower("street").alias("street"), "number", "suffix", "osm_id", "lat_u", "lon_u", F.lower("city").alias("city"), F.regexp_replace("postcode", " ", "").alias("postcode"))
    met = asked.join(held, ["street", "number", "suffix"])
    yes = lambda c: F.coalesce(c, F.lit(False))
    rank = (
        F.when(yes(F.col("q_city") == F.col("city")), 0)
        .when(yes(F.col("q_postcode") == F.col("postcode")), 1)
        .when(F.col("q_city").isNull() & F.col("q_postcode").isNull(), 2)
        .otherwise(3)
    )
    best = met.groupBy("query_id").agg(F.min(F.struct(rank.alias("rank"), "osm_id", "lat_u", "lon_u")).alias("b"))
    return best.select("query_id", "b.rank", "b.osm_id", "b.lat_u", "b.lon_u")


def street_and_city(queries: DataFrame, places: DataFrame, words: int = 3) -> DataFrame:
    """(query_id, street, city) of free texts without a comma whose last words, as few as possible, are a place's name."""
    tokens = F.filter(F.split(F.trim("q"), r"\s+"), lambda w: w != "")
    asked = queries.withColumn("w", tokens).where((F.size("w") >= 2) & ~F.exists(F.slice("w", F.lit(2), F.size("w")), lambda w: w.rlike("^[0-9]")))
    cut = asked.withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.size("w") - 1, F.lit(words)))))
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    split = cut.select("query_id", "n", F.lower(part(F.lit(1), F.size("w") - F.col("n"))).alias("street"), part(F.size("w") - F.col("n") + 1, F.col("n")).alias("city"))
    known = places.select(F.lower("name").alias("place")).distinct()
    met = split.where(F.octet_length("street") >= 2).join(known, F.lower("city") == F.col("place"), "left_semi")
    best = met.groupBy("query_id").agg(F.min(F.struct("n", "street", "city")).alias("b"))
    return best.select("query_id", "b.street", "b.city")


def street_tiers(queries: DataFrame, streets: DataFrame, metres: float = 15000.0) -> DataFrame:
    """The street of every query: under its municipality, else under the hash of its city, else the nearest of that name within reach."""
    asked = queries.withColumn("city_key", hashing.djb2_bucket(F.lower("city")))
    keyed = streets.select("street", F.col("muni").alias("s_muni"), "display", "mean_lat", "mean_lon")
    met = asked.join(keyed, "street")
    far = F.round(geo.haversine_m(F.col("near_lat"), F.col("near_lon"), F.col("mean_lat"), F.col("mean_lon")), 3)
    tier = F.when(F.col("muni") == F.col("s_muni"), 0).when(F.col("city_key") == F.col("s_muni"), 1).when(far < metres, 2)
    best = met.withColumn("tier", tier).where("tier IS NOT NULL").groupBy("query_id").agg(F.min(F.struct("tier", F.when(F.col("tier") == 2, far).otherwise(0.0).alias("metres"), "s_muni", "display")).alias("b"))
    return best.select("query_id", "b.tier", F.col("b.s_muni").alias("muni"), "b.display")


def street_cascade(queries: DataFrame, streets: DataFrame, metres: float = 15000.0) -> DataFrame:
    """The street of every query: in the municipality asked for, else the nearest of that name within reach."""
    met = queries.join(streets.withColumnRenamed("muni", "s_muni"), "street")
    far = F.round(geo.haversine_m(F.col("near_lat"), F.col("near_lon"), F.col("mean_lat"), F.col("mean_lon")), 3)
    met = met.withColumn("prio", F.when(F.col("muni") == F.col("s_muni"), 0).otherwise(1)).withColumn("metres", far)
    met = met.where((F.col("prio") == 0) | (F.col("metres") < metres))
    best = met.groupBy("query_id").agg(F.min(F.struct("prio", "metres", "s_muni", "display")).alias("b"))
    return best.select("query_id", F.col("b.prio").alias("prio"), F.col("b.metres").alias("metres"), F.col("b.s_muni").alias("muni"), F.col("b.display").alias("display"))


def interpolated(ways: DataFrame, most: int = 200) -> DataFrame:
    """Addresses along ways (way_id, lo, hi, step, start and end position), evenly spaced, ``most`` numbers at most."""
    low, high = F.least("first", "last"), F.greatest("first", "last")
    usable = ways.withColumn("low", low).withColumn("high", high).where(((F.col("high") - F.col("low")) / F.col("step") < most) & (F.col("high") > F.col("low")))
    numbers = usable.withColumn("number", F.explode(F.sequence(F.col("low"), F.col("high"), F.col("step"))))
    share = (F.col("number") - F.col("first")) / (F.col("last") - F.col("first"))
    at = lambda a, b: (F.col(a) + F.floor((F.col(b) - F.col(a)) * share)).cast("bigint")
    return numbers.select("way_id", "number", at("lat_a", "lat_b").alias("lat_u"), at("lon_a", "lon_b").alias("lon_u"))


def way_shapes(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ways from their node references (way_id, pos, node_id): centroid, box, number of nodes, running length."""
    placed = refs.join(nodes, "node_id")
    along = W.partitionBy("way_id").orderBy("pos")
    hop = geo.haversine_m(F.lag("lat_u").over(along), F.lag("lon_u").over(along), F.col("lat_u"), F.col("lon_u"))
    measured = placed.withColumn("hop", F.coalesce(hop, F.lit(0.0)))
    return measured.groupBy("way_id").agg(
        F.expr("sum(lat_u) div count(*)").alias("lat_u"),
        F.expr("sum(lon_u) div count(*)").alias("lon_u"),
        F.min("lat_u").alias("south"), F.max("lat_u").alias("north"), F.min("lon_u").alias("west"), F.max("lon_u").alias("east"),
        F.count("*").alias("n_nodes"),
        F.round(F.sum("hop"), 1).alias("metres"),
    )


def admin_dimension(admin: DataFrame) -> DataFrame:
    """Admin areas with dense ids from 1 in order of (name, osm_id).

    Areas are ranked within ranges of their names and shifted by the sizes of the ranges before,
    so no single task sorts them all.
    """
    head = F.substring(F.col("name"), 1, 2)
    ranked = admin.withColumn("head", head).withColumn("at", F.row_number().over(W.partitionBy("head").orderBy("name", "osm_id")))
    sizes = admin.groupBy(head.alias("head")).agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("head").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return ranked.join(F.broadcast(before), "head").withColumn("admin_id", (F.col("before") + F.col("at")).cast("int")).drop("head", "at", "before")


def backfill_population(admin: DataFrame, settlements: DataFrame) -> DataFrame:
    """Admin areas without a population get the sum of their settlements'."""
    sums = settlements.groupBy("admin_id").agg(F.sum("population").alias("__sum"))
    joined = admin.join(sums, "admin_id", "left")
    filled = F.when(F.col("population") == 0, F.coalesce("__sum", F.lit(0))).otherwise(F.col("population"))
    return joined.withColumn("population", filled.cast("bigint")).drop("__sum")


def relation_shapes(members: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations from their members (relation_id, kind, ref): mean of the members' centres, box over them, number placed.

    ``ways`` are shapes of ways (way_id, lat_u, lon_u, south, north, west, east), ``nodes`` points (node_id, lat_u, lon_u).
    """
    box = ["south", "north", "west", "east"]
    points = nodes.select(F.lit("node").alias("kind"), F.col("node_id").alias("ref"), "lat_u", "lon_u", *[F.col(c).alias(b) for b, c in zip(box, ("lat_u", "lat_u", "lon_u", "lon_u"))])
    shapes = ways.select(F.lit("way").alias("kind"), F.col("way_id").alias("ref"), "lat_u", "lon_u", *box)
    placed = members.join(points.unionByName(shapes), ["kind", "ref"])
    return placed.groupBy("relation_id").agg(
        F.expr("sum(lat_u) div count(*)").alias("lat_u"), F.expr("sum(lon_u) div count(*)").alias("lon_u"),
        F.min("south").alias("south"), F.max("north").alias("north"), F.min("west").alias("west"), F.max("east").alias("east"), F.count("*").alias("n_members"),
    )
