"""Reverse lookup: grid neighbours, point in polygon, nearest centroid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placeloom.functions import geo, scoring


def with_cell(df: DataFrame) -> DataFrame:
    """``df`` (lat_u, lon_u) with its grid cell."""
    return df.withColumn("gx", geo.cell_x(F.col("lon_u"))).withColumn("gy", geo.cell_y(F.col("lat_u")))


def neighbours(points: DataFrame, places: DataFrame) -> DataFrame:
    """(point_id, record_id, metres, and the places' columns) of all places in the nine cells around."""
    asked = points.select(
        "point_id", F.col("lat_u").alias("q_lat"), F.col("lon_u").alias("q_lon"), *[c for c in points.columns if c not in ("point_id", "lat_u", "lon_u")]
    )
    cells = F.explode(geo.around(geo.cell_x(F.col("q_lon")), geo.cell_y(F.col("q_lat")))).alias("cell")
    asked = asked.select("*", cells).select("*", "cell.gx", "cell.gy").drop("cell")
    met = asked.join(with_cell(places), ["gx", "gy"])
    metres = F.round(geo.haversine_m(F.col("q_lat"), F.col("q_lon"), F.col("lat_u"), F.col("lon_u")), 3)
    return met.withColumn("metres", metres)


#: Times that a cell of the grid is cut into four at most; cells are under 5 m wide then.
MAX_CUTS = 8


def close(points: DataFrame, places: DataFrame, k: int, shown: Column | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """Those of ``neighbours`` that may be among a point's ``k`` nearest, of each kind where ``shown`` (of kind and the points' columns) picks kinds.

    Cells are cut into four again and again, as often as the fullest one asks for.  The finest nine
    cells around a point that hold ``k`` places bound the distance of its k-th one; only cells
    within that reach are joined.  Work follows the points and the places, not their pairs.
    Points (point_id, lat_u, lon_u, and zoom) keep their columns, places their record_id, kind and the columns ``also``.
    """
    sorts, kinds = ([], []) if shown is None else (["sort"], ["sort", "kind"])
    placed = with_cell(places.select("record_id", "lat_u", "lon_u", *kinds[1:], *also))
    if sorts:
        placed = placed.withColumn("sort", F.coalesce(F.concat(F.lit("="), F.col("kind")), F.lit("")))
    fullest = placed.where("gx IS NOT NULL AND gy IS NOT NULL").groupBy(*sorts, "gx", "gy").count().agg(F.max("count")).first()[0] or 0
    cuts = 0
    while cuts < MAX_CUTS and 9 * fullest >= k * 4 ** (cuts + 1):
        cuts += 1
    if not cuts:
        met = neighbours(points, places)
        return met if shown is None else met.where(shown)
    bits = geo.GRID_BITS + cuts
    placed = placed.drop("gx", "gy").withColumn("fx", geo.cell_x(F.col("lon_u"), bits)).withColumn("fy", geo.cell_y(F.col("lat_u"), bits))
    up = F.lit(cuts) - F.col("level")
    at = [F.call_function("shiftright", F.col(c), up) for c in ("fx", "fy")]

    def at_levels(df: DataFrame) -> DataFrame:
        return df.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(cuts))))

    counts = at_levels(placed.groupBy(*kinds, "fx", "fy").agg(F.count("*").alias("n"))).groupBy(_numbered(*at).alias("cell"), *kinds).agg(F.sum("n").alias("n"))
    own = ["point_id", "q_lat", "q_lon", *(["zoom"] if "zoom" in points.columns else [])]
    # equal rows are asked once
    asked = points.withColumnsRenamed({"lat_u": "q_lat", "lon_u": "q_lon"}).groupBy(*own).agg(F.count("*").alias("copies"))
    own.append("copies")
    fine = at_levels(asked.withColumn("fx", geo.cell_x(F.col("q_lon"), bits)).withColumn("fy", geo.cell_y(F.col("q_lat"), bits)))
    wide = F.call_function("shiftleft", F.lit(1 << geo.GRID_BITS).cast("bigint"), F.col("level"))
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    held = fine.select(*own, "level", at[0].alias("gx"), at[1].alias("gy"), F.explode(steps).alias("d"))
    held = held.select(*own, "level", _numbered(F.pmod(F.col("gx") + F.col("d.dx"), wide), F.col("gy") + F.col("d.dy")).alias("cell"))
    held = held.join(counts, "cell")
    held = held if shown is None else held.where(shown)
    held = held.groupBy(*own, *sorts, "level").agg(F.sum("n").alias("n"))
    # with fewer than k places around, level 0 reaches all nine cells
    level = F.coalesce(F.max(F.when(F.col("n") >= k, F.col("level"))), F.lit(0))
    chosen = held.groupBy(*own, *sorts).agg(level.alias("level")).withColumn("reach", _reach(wide))
    # a small table of points is one partition, and a broadcast would leave all its pairs to one task
    spark = points.sparkSession
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    search = _within_reach(chosen.repartition(parts, "point_id"), wide)
    met = search.join(at_levels(placed).withColumn("cell", _numbered(*at)).drop("level", "fx", "fy"), ["cell", *sorts])
    met = met.withColumn("metres", geo.haversine_m(F.col("q_lat"), F.col("q_lon"), F.col("lat_u"), F.col("lon_u")))
    met = met.where(F.col("metres") <= F.col("reach")).withColumn("metres", F.round("metres", 3))
    return met.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))


def _numbered(gx: Column, gy: Column) -> Column:
    """One number for a cell of ``level``: joins sort numbers by their bits, but several keys by comparing them one after another."""
    # rows just outside the globe, which a search may ask for, have numbers that no place has
    rows = F.call_function("shiftleft", gx, F.lit(24)) + gy + 1
    return F.call_function("shiftleft", rows, F.lit(4)) + F.col("level")


def _reach(wide: Column) -> Column:
    """Metres to the farthest corner of the nine cells around (q_lat, q_lon), of a level with ``wide`` cells around the globe."""
    lat, lon = F.col("q_lat").cast("bigint"), F.col("q_lon").cast("bigint")
    tall, broad = F.lit(180e6) / wide, F.lit(360e6) / wide
    south = F.least(F.floor((lat + 90_000_000) / tall), wide - 1) * tall - tall - 90e6
    west = F.least(F.floor((lon + 180_000_000) / broad), wide - 1) * broad - broad - 180e6
    aside = F.greatest(lon - west, west + 3 * broad - lon)
    ends = (F.greatest(south, F.lit(-90e6)), F.least(south + 3 * tall, F.lit(90e6)))
    # a metre more than distances, their rounding and the cells' edges are wrong by
    return F.greatest(*[geo.haversine_m(lat, F.lit(0.0), end, aside) for end in ends]) + 1


def _within_reach(search: DataFrame, wide: Column) -> DataFrame:
    """``search`` (q_lat, q_lon, level, reach) once for every cell of its level that may hold a place within reach, of the nine cells of the grid itself."""
    lat, lon, up = F.col("q_lat").cast("bigint"), F.col("q_lon").cast("bigint"), F.col("level")
    tall, broad = F.lit(180e6) / wide, F.lit(360e6) / wide
    turn, flat = F.col("reach") / geo.EARTH_M, F.radians(geo.degrees(lat))
    y = F.degrees(turn) * 1e6 + 1
    x = F.when(turn < F.lit(1.57) - F.abs(flat), F.degrees(F.asin(F.least(F.lit(1.0), F.sin(turn) / F.cos(flat)))) * 1e6 + 1).otherwise(F.lit(360e6))
    shift = lambda cell: F.call_function("shiftleft", cell, up)

    def cells(at: Column, off: Column, size: Column, own: Column) -> Column:
        return F.sequence(F.greatest(F.floor((at - off) / size), shift(own - 1)), F.least(F.floor((at + off) / size), shift(own + 2) - 1))

    # columns of their own: generators compute an expression anew wherever they name it
    search = search.select("*", x.alias("dx"), y.alias("dy"))
    search = search.withColumn("gx", F.explode(cells(lon + 180_000_000, F.col("dx"), broad, geo.cell_x(lon))))
    search = search.withColumn("gy", F.explode(cells(lat + 90_000_000, F.col("dy"), tall, geo.cell_y(lat))))
    return search.withColumn("cell", _numbered(F.pmod("gx", wide), F.col("gy"))).drop("dx", "dy", "gx", "gy", "level")


def nearest(points: DataFrame, places: DataFrame, k: int, also: tuple[str, ...] = ()) -> DataFrame:
    """The ``k`` nearest places of every point, with their rank and their columns ``also``."""
    order = W.partitionBy("point_id").orderBy("metres", "record_id")
    met = close(points, places, k, also=also).select("point_id", "record_id", "metres", *also)
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def reverse(points: DataFrame, places: DataFrame, limit: int) -> DataFrame:
    """Places around points (point_id, lat_u, lon_u, zoom) that their zoom shows, best first."""
    # a head start is one number a kind, so the best are among the nearest of each kind
    met = close(points, places, limit, scoring.matches_zoom(F.col("kind"), F.col("zoom")))
    met = met.withColumn("effective", F.round(scoring.effective_distance(F.col("metres"), F.col("kind"), F.col("zoom")), 3))
    order = W.partitionBy("point_id").orderBy("effective", "record_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranked.select("point_id", "zoom", "record_id", "kind", "metres", "effective", "rank")


def polygons_in_cells(polygons: DataFrame) -> DataFrame:
    """Polygons (admin_id, ord, ring) once for every cell of their box."""
    lats, lons = F.transform("ring", lambda p: p["lat"]), F.transform("ring", lambda p: p["lon"])
    boxed = polygons.withColumn("ys", F.sequence(geo.cell_y(F.array_min(lats)), geo.cell_y(F.array_max(lats))))
    boxed = boxed.withColumn("xs", F.sequence(geo.cell_x(F.array_min(lons)), geo.cell_x(F.array_max(lons))))
    return boxed.withColumn("gx", F.explode("xs")).withColumn("gy", F.explode("ys")).drop("xs", "ys")


def containing(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """(point_id, admin_id): the first polygon, by ord, that a point lies in."""
    met = with_cell(points).join(polygons_in_cells(polygons), ["gx", "gy"])
    inside = met.where(geo.in_ring(F.col("lat_u"), F.col("lon_u"), F.col("ring")))
    return inside.groupBy("point_id").agg(F.min(F.struct("ord", "admin_id")).alias("m")).select("point_id", F.col("m.admin_id").alias("admin_id"))


def nearest_centroid(points: DataFrame, centroids: DataFrame, limit_rows: int = 100_000) -> DataFrame:
    """(point_id, admin_id, ord) of the nearest centroid, by flattened degrees.

    Centroids of administrative areas are few; they are collected into one array, after a check of
    their number, and every point scans it: no pairs are formed.
    """
    rows = centroids.select("ord", "admin_id", F.col("lat_u").cast("bigint").alias("lat_u"), F.col("lon_u").cast("bigint").alias("lon_u")).orderBy("ord").limit(limit_rows + 1).collect()
    if len(rows) > limit_rows:
        raise ValueError("more centroids than an array may hold; split them by country")
    listed = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("ord", "admin_id", "lat_u", "lon_u"), r)]) for r in rows])

    def ranked(c: Column) -> Column:
        far = F.round(geo.corrected_degrees2(F.col("lat_u"), F.col("lon_u"), c["lat_u"], c["lon_u"]), 9)
        return F.struct(far.alias("far"), c["ord"].alias("ord"), c["admin_id"].alias("admin_id"))

    return points.select("point_id", F.array_min(F.transform(listed, ranked)).alias("m")).select("point_id", F.col("m.admin_id").alias("admin_id"))


def assign_admin(points: DataFrame, polygons: DataFrame, centroids: DataFrame) -> DataFrame:
    """(point_id, admin_id, how): by polygon, else by the nearest centroid."""
    within = containing(points, polygons)
    missed = points.join(within.select("point_id"), "point_id", "left_anti")
    near = nearest_centroid(missed, centroids)
    return within.withColumn("how", F.lit("polygon")).unionByName(near.withColumn("how", F.lit("nearest")))
