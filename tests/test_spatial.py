"""Nearest places in crowded cells: the whole answer without all pairs."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placeloom.functions import scoring
from placeloom.operators import rules, spatial

CORNERS = [(59_003_000, 18_005_000), (0, 179_999_000), (-33_000_000, -179_999_500), (89_998_000, 12_000_000), (-89_999_900, -70_000_000), (80_000_000, 0)]
KINDS = ["city", "town", "hamlet", "unknown", "country", None]


@pytest.fixture(scope="module")
def crowded(spark):
    """Crowded, thin and empty cells, at the poles and the antimeridian; equal positions, points asked twice, missing values."""
    rng = random.Random(5)

    def spot(spread):
        lat, lon = rng.choice(CORNERS)
        lat = min(90_000_000, max(-90_000_000, lat + int(rng.gauss(0, spread))))
        lon = (lon + int(rng.gauss(0, spread)) + 180_000_000) % 360_000_001 - 180_000_000
        return lat, lon

    placed = [(i, *spot(rng.choice((30, 900, 9000))), rng.choice(KINDS), i * 48271 % 6553) for i in range(6000)]
    placed += [(6000 + i, 59_003_000, 18_005_000, "town", i) for i in range(40)] + [(7000, None, 5, "city", 1)]
    asked = [(i, *spot(rng.choice((30, 900, 9000))), rng.choice((5, 9, 12, 14, 16, 18, None))) for i in range(150)]
    asked += [asked[0], (1, *spot(900), 12), (900, 45_000_000, 3, 14), (901, None, None, 14), (902, 90_000_000, 180_000_000, 18)]
    points = spark.createDataFrame(asked, "point_id bigint, lat_u bigint, lon_u bigint, zoom int")
    return points, spark.createDataFrame(placed, "record_id bigint, lat_u bigint, lon_u bigint, kind string, importance bigint")


def sorted_rows(df, columns):
    return sorted(df.select(*columns).collect(), key=repr)


@pytest.mark.parametrize("k", [1, 5, 16])
def test_nearest_in_crowded_cells(crowded, k):
    order = W.partitionBy("point_id").orderBy("metres", "record_id")
    plain = spatial.neighbours(*crowded).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    columns = ["point_id", "record_id", "metres", "rank"]
    assert sorted_rows(spatial.nearest(*crowded, k), columns) == sorted_rows(plain, columns)


def test_pairs_do_not_grow_with_the_crowd(spark):
    rng = random.Random(6)
    spot = lambda: (59_000_000 + rng.randrange(10_000), 18_000_000 + rng.randrange(20_000))
    points = spark.createDataFrame([(i, *spot(), 12) for i in range(40)], "point_id bigint, lat_u bigint, lon_u bigint, zoom int")
    places = spark.createDataFrame([(i, *spot(), KINDS[i % 3]) for i in range(8000)], "record_id bigint, lat_u bigint, lon_u bigint, kind string")
    every = spatial.neighbours(points, places)
    assert every.count() > 20 * spatial.close(points, places, 5).count()
    shown = scoring.matches_zoom(F.col("kind"), F.col("zoom"))
    assert every.where(shown).count() > 20 * spatial.close(points, places, 3, shown).count()


def test_important_nearby_in_crowded_cells(crowded):
    order = W.partitionBy("point_id").orderBy("metres", "record_id")
    near = spatial.neighbours(*crowded).withColumn("rank", F.row_number().over(order)).where("rank <= 16 AND metres <= 500")
    best = near.groupBy("point_id").agg(F.min(F.struct((-F.col("importance")).alias("minus"), "metres", "record_id")).alias("b"))
    got = rules.important_nearby(*crowded, 16, 500)
    assert sorted_rows(got, ["point_id", "record_id"]) == sorted_rows(best.select("point_id", "b.record_id"), ["point_id", "record_id"])


def test_reverse_in_crowded_cells(crowded):
    shown = scoring.matches_zoom(F.col("kind"), F.col("zoom"))
    met = spatial.neighbours(*crowded).where(shown)
    met = met.withColumn("effective", F.round(scoring.effective_distance(F.col("metres"), F.col("kind"), F.col("zoom")), 3))
    plain = met.withColumn("rank", F.row_number().over(W.partitionBy("point_id").orderBy("effective", "record_id"))).where("rank <= 3")
    columns = ["point_id", "record_id", "kind", "metres", "effective", "rank"]
    assert sorted_rows(spatial.reverse(*crowded, 3), columns) == sorted_rows(plain, columns)


def test_important_nearby_weighs_the_rows_found(spark):
    places = [(1, 59_000_010, 18_000_000, 1), (2, 59_000_020, 18_000_000, 5), (3, 59_000_000, 18_000_000, None), (1, -10_000_000, 3_000_000, 9)]
    # a crowd beyond reach, so that cells are cut
    places += [(100 + i, 59_000_000, 18_090_000 + i, 100 + i) for i in range(50)]
    places = spark.createDataFrame(places, "record_id bigint, lat_u bigint, lon_u bigint, importance bigint")
    points = spark.createDataFrame([(7, 59_000_000, 18_000_000)], "point_id bigint, lat_u bigint, lon_u bigint")
    assert [tuple(r) for r in rules.important_nearby(points, places, 4, 500).collect()] == [(7, 2)]
    assert [tuple(r) for r in rules.important_nearby(points, places.where("record_id = 3"), 4, 500).collect()] == [(7, 3)]
