"""Building the model and asking it."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from placeloom.operators import search
from placeloom.plans import api, fixtures
from placeloom.plans.model import build, merged_sources


@pytest.fixture(scope="module")
def model(spark, sf):
    places = fixtures.places(spark, sf).withColumn("osm_type", F.lit("N")).withColumn("osm_id", F.col("record_id") + 1)
    admin = fixtures.table(spark, sf, "nation").select(F.col("n_nationkey").alias("admin_id"), F.col("n_name").alias("name"), F.lit(0).cast("bigint").alias("population"))
    made = build(places, fixtures.addresses(spark, sf), admin, fixtures.polygons(spark, sf), fixtures.centroids(spark, sf))
    made.places.cache()
    return made


def test_search_layers(spark, model):
    name = model.places.orderBy("record_id").first().name
    queries = spark.createDataFrame([(1, name.upper()), (2, name + "x"), (3, "zzzzqqqq")], "query_id bigint, q string")
    hits = api.search(queries, model, limit=5).collect()
    assert {h.query_id for h in hits} <= {1, 2} and {h.layer for h in hits if h.query_id == 1} == {"exact"}
    assert all(h.name == name for h in hits if h.query_id == 1) and {h.layer for h in hits if h.query_id == 2} <= {"phonetic", "ngram", "edit1", "edit2"}
    assert [h.rank for h in hits if h.query_id == 1] == list(range(1, 1 + sum(h.query_id == 1 for h in hits)))
    boxed = api.search(queries, model, viewbox=api.viewbox("18.0,59.0,18.2,59.1"), bounded=True).collect()
    assert all(59_000_000 <= h.lat <= 59_100_000 and h.lon <= 18_200_000 for h in boxed)
    documents = api.feature_collections(api.search(queries, model)).collect()
    assert json.loads(documents[0].document)["type"] == "FeatureCollection"


def test_other_lookups(spark, sf, model):
    first = model.places.orderBy("record_id").first()
    ids = spark.createDataFrame([("N", first.osm_id)], "osm_type string, osm_id bigint")
    assert api.lookup(ids, model).first().record_id == first.record_id
    document = json.loads(api.details(model.places.where(F.col("record_id") == first.record_id)).first().document)
    assert document["place_id"] == first.place_id and len(document["boundingbox"]) == 4
    assert api.status(model).where("country IS NULL").first().n_places == model.places.count()
    assert api.autocomplete(spark.createDataFrame([(1, first.name[:4])], "query_id int, q string"), model, 99).count() <= 20
    points = fixtures.points(spark, sf).withColumn("zoom", F.lit(18))
    assert api.reverse(points, model).groupBy("point_id").count().where("count > 1").count() == 0


def test_a_country_is_not_crowded_out(spark, model):
    crowd = [(i, "N", i, "Lund", 1, "city", 90_000 + i, True, 0, 59_000_000 + i, 18_000_000) for i in range(1, 41)] + [(99, "N", 99, "Lund", 2, "village", 10, False, 0, 59_100_000, 18_100_000)]
    places = spark.createDataFrame(crowd, "record_id bigint, osm_type string, osm_id bigint, name string, country int, kind string, population bigint, notable boolean, translations int, lat_u bigint, lon_u bigint")
    exact = search.postings(search.exact_keys(places.withColumn("importance", F.col("population").cast("int")), carried=("country",)), search.EXACT_CAP, ("country",))
    small = replace(model, places=places.withColumn("place_id", F.col("osm_id")).withColumn("importance", F.col("population").cast("int")).withColumn("admin_name", F.lit(None).cast("string")), exact=exact)
    asked = spark.createDataFrame([(1, "lund")], "query_id int, q string")
    assert [(h.record_id, h.layer) for h in api.search(asked, small, countries=[2]).collect()] == [(99, "exact")]


def test_houses_of_close_points(spark, sf):
    points, addresses = fixtures.points(spark, sf), fixtures.addresses(spark, sf)
    found = api.reverse_houses(points, addresses, 500.0).collect()
    zooms = {r.point_id: r.zoom for r in points.collect()}
    assert found and all(zooms[r.point_id] >= 17 and r.metres <= 500 for r in found)


def test_headers_and_boxes():
    assert api.accept_languages("da, en-gb;q=0.8, en;q=0.7, *;q=0.1, xx;q=0") == ["da", "en"]
    assert api.viewbox("2,3,1,4") == (3_000_000, 4_000_000, 1_000_000, 2_000_000) and api.viewbox("x") is None


def test_sql_functions_and_merging(spark):
    api.register(spark)
    row = spark.sql("SELECT normalize_name('Malmö') AS n, phonetic_key('Kjell') AS p, ascii_name('hôtel') AS a").first()
    assert row.n[0] == "malmö" and row.p == "XLL"[:2] and row.a == "hotel"
    schema = "osm_id bigint, name string, lat_u bigint, lon_u bigint"
    a = spark.createDataFrame([(1, "x", 0, 0)], schema)
    b = spark.createDataFrame([(1, "other", 9_000_000, 0), (2, "x", 500, 500), (3, "y", 0, 0)], schema)
    assert sorted(r.osm_id for r in merged_sources(a, b).collect()) == [1, 3]
    names = spark.createDataFrame([({"en": "E"},)], "m map<string,string>").select(api.localised(F.col("m"), F.lit("f"), ["de", "en"]).alias("l"))
    assert names.first().l == "E"
