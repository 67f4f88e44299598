"""Readers, sinks and streams over small files."""

import gzip
import json
import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from placeloom.operators import merge, search, usage
from placeloom.sources import documents, gazetteers, registries, sinks
from placeloom.streaming import usage as streams


def test_registry_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("vejnavn,husnr,postnr,postnrnavn,wgs84koordinat_bredde,wgs84koordinat_længde\nGade,12B,1000,København,55.7,12.5\n,1,1000,København,55.7,12.5\nGade,2,1000,København,0,0\n")
    rows = registries.read_addresses(spark, "dk_dawa", str(tmp_path / "a.csv")).collect()
    assert [(r.street, r.housenumber, r.postcode, r.city, r.lat, r.lon) for r in rows] == [("Gade", "12B", "1000", "København", 55.7, 12.5)]


def test_registry_grid_and_gzip(spark, tmp_path):
    with gzip.open(tmp_path / "n.csv.gz", "wt") as f:
        f.write("adressenavn;nummer;bokstav;postnummer;poststed;Nord;Øst\nVeien;3;A;0001;Oslo;6642000;262000\n")
    row = registries.read_addresses(spark, "no_kartverket", str(tmp_path / "n.csv.gz")).first()
    assert row.housenumber == "3A" and row.lat == pytest.approx(59.86, abs=0.05) and row.lon == pytest.approx(10.74, abs=0.05)


def test_decimal_commas_and_code_page(spark, tmp_path):
    (tmp_path / "b.csv").write_text("NOM_LOGRADOURO;NUM_ENDERECO;NUM_CEP;NOM_LOCALIDADE;LATITUDE;LONGITUDE\nRUA A;1;1;X;-23,5;-46,6\n")
    assert registries.read_addresses(spark, "br_cnefe", str(tmp_path / "b.csv")).first().lat == -23.5
    (tmp_path / "c.csv").write_bytes("Název obce;Název ulice;Číslo domovní;PSČ;Souřadnice Y;Souřadnice X\nPraha;Říční;5;11000;742700;1043100\n".encode("cp1250"))
    row = registries.read_addresses(spark, "cz_ruian", str(tmp_path / "c.csv")).first()
    assert row.street == "Říční" and row.lat == pytest.approx(50.09, abs=0.02)


def test_joined_registries(spark):
    details = spark.createDataFrame([("d", "s", "l", "7", "A", "2000")], "ADDRESS_DETAIL_PID string, STREET_LOCALITY_PID string, LOCALITY_PID string, NUMBER_FIRST string, NUMBER_FIRST_SUFFIX string, POSTCODE string")
    geocodes = spark.createDataFrame([("d", -33.8, 151.2)], "ADDRESS_DETAIL_PID string, LATITUDE double, LONGITUDE double")
    roads = spark.createDataFrame([("s", "HIGH", "STREET", None)], "STREET_LOCALITY_PID string, STREET_NAME string, STREET_TYPE_CODE string, STREET_SUFFIX_CODE string")
    places = spark.createDataFrame([("l", "SYDNEY", "n")], "LOCALITY_PID string, LOCALITY_NAME string, STATE_PID string")
    states = spark.createDataFrame([("n", "NSW")], "STATE_PID string, STATE_ABBREVIATION string")
    row = registries.australian(details, geocodes, roads, places, states).first()
    assert (row.street, row.housenumber, row.city, row.state) == ("High Street", "7A", "Sydney", "NSW")
    swiss = registries.swiss(
        spark.createDataFrame([("e", "3000", "1", 2600000.0, 1200000.0)], "STR_ESID string, ZIP4 string, ADR_NUMBER string, ADR_EASTING double, ADR_NORTHING double"),
        spark.createDataFrame([("e", "Weg")], "STR_ESID string, STN_LABEL string"),
        spark.createDataFrame([("3000", "Bern")], "ZIP4 string, PLZ_NAME string"),
    ).first()
    assert (swiss.street, swiss.city) == ("Weg", "Bern") and swiss.lat == pytest.approx(46.951, abs=0.001)


def test_photon(spark, tmp_path):
    (tmp_path / "p.json").write_text(
        '{"osm_id":1,"osm_key":"place","osm_value":"city","rank_address":16,"name":{"default":"Lund"},"centroid":{"coordinates":[13.2,55.7]}}\n'
        '{"osm_id":2,"osm_key":"building","housenumber":"4","street":"Gatan","centroid":{"coordinates":[13.2,55.7]}}\n'
    )
    places, addresses = documents.photon(spark, str(tmp_path / "p.json"))
    assert [(r.name, r.population) for r in places.collect()] == [("Lund", 100000)]
    assert [(r.street, r.housenumber) for r in addresses.collect()] == [("Gatan", "4")]


def test_change_feed(spark, tmp_path):
    xml = '<osmChange><create><node id="1" lat="1.5" lon="2.5"><tag k="name" v="A"/></node></create><modify><node id="2" lat="1" lon="2"/></modify><delete><node id="3" lat="0" lon="0"/></delete></osmChange>'
    with gzip.open(tmp_path / "c.osc.gz", "wt") as f:
        f.write(xml)
    rows = {r.osm_id: r for r in documents.change_feed(spark, str(tmp_path / "c.osc.gz"), 7).collect()}
    assert {k: v.action for k, v in rows.items()} == {1: "create", 2: "modify", 3: "delete"}
    assert rows[1].tags == {"name": "A"} and rows[1].sequence == 7


def test_sqlite_and_points(spark, tmp_path):
    with sqlite3.connect(tmp_path / "x.gpkg") as db:
        db.execute("CREATE TABLE a (id INTEGER, geom BLOB)")
        wkb = struct.pack("<BIdd", 1, 1, 12.5, 55.7)
        db.executemany("INSERT INTO a VALUES (?, ?)", [(1, b"GP\0\1" + struct.pack("<i", 4326) + wkb), (2, wkb), (3, None)])
    rows = documents.sqlite_rows(spark, str(tmp_path / "x.gpkg"), "SELECT id, geom FROM a ORDER BY id", "id bigint, geom binary")
    made = rows.select("id", documents.wkb_point(F.col("geom")).alias("p")).orderBy("id").collect()
    assert [(r.p.x, r.p.y) for r in made[:2]] == [(12.5, 55.7)] * 2 and made[2].p.x is None


def test_element_filters(spark):
    nodes = spark.createDataFrame(
        [
            (1, 1.0, 2.0, {"name": "A", "place": "town", "population": "1 200", "name:sv": "Å"}),
            (2, 1.0, 2.0, {"name": "B", "leisure": "park"}),
            (3, 1.0, 2.0, {"name": "C", "leisure": "park", "wikidata": "Q1"}),
            (4, 1.0, 2.0, {"addr:street": "G", "addr:housenumber": "1"}),
        ],
        "id bigint, lat double, lon double, tags map<string,string>",
    )
    places = documents.node_places(nodes).collect()
    assert [(r.name, r.population) for r in places] == [("A", 1200), ("C", None)] and places[0].name_intl == {"sv": "Å"}
    assert documents.node_addresses(nodes).count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, country string")
    sinks.write_table(df, str(tmp_path / "t"), by=["country"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    sinks.write_sorted(df, str(tmp_path / "s"), ["id"], 1)
    sinks.append_new(spark.createDataFrame([(2, "b"), (3, "c")], df.schema), str(tmp_path / "s"), "id")
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [1, 2, 3]
    sinks.replace_table(spark.read.parquet(str(tmp_path / "s")).where("id > 1"), str(tmp_path / "s"), str(tmp_path / "scratch"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    sinks.dump_sorted(df, str(tmp_path / "d"))
    assert [r.value for r in spark.read.text(str(tmp_path / "d")).collect()] == ['{"country":"a","id":1}', '{"country":"b","id":2}']


def test_gcra_against_a_plain_walk(spark):
    rows = [(k, i, 1_000_000 * (i * 37 % 101) + k) for k in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "key bigint, event_id bigint, us bigint").select("key", "event_id", F.timestamp_micros("us").alias("ts"))
    got = {(r.key, r.event_id): r.allowed for r in usage.rate_limited(df, 2_000_000, 6_000_000).collect()}
    for k in range(3):
        due = 0
        for us, i in sorted((us, i) for key, i, us in rows if key == k):
            ok = max(due, us) - us <= 6_000_000
            due = max(due, us) + 2_000_000 if ok else due
            assert got[k, i] == ok


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("failed"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    run = streams.rate_limit(stream, 3_600_000_000, 7_200_000_000).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    want = usage.rate_limited(events, 3_600_000_000, 7_200_000_000)
    assert spark.table("limited").exceptAll(want).count() == 0 and spark.table("limited").count() == want.count()
    daily = streams.daily_counts(stream, "60 days").writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    assert daily.awaitTermination(120)
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, usage.daily(events).collect()))


def test_upsert_sink_is_idempotent(spark, tmp_path):
    versions = lambda n: str(tmp_path / f"v{n}")
    spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, name string").write.parquet(versions(0))
    batch = spark.createDataFrame([(1, "delete", None, 1), (3, "create", "c", 2), (3, "modify", "d", 3)], "id bigint, action string, name string, seq bigint")
    sink = streams.upsert_sink("", "id", ["seq"], versions)
    sink(batch, 0)
    sink(batch, 0)
    assert sorted(map(tuple, spark.read.parquet(versions(1)).collect())) == [(2, "b"), (3, "d")]


def test_empty_inputs(spark):
    places = spark.createDataFrame([], "record_id bigint, name string, importance int, country int")
    queries = spark.createDataFrame([], "query_id bigint, q string")
    assert search.cascade(queries, places).count() == 0
    assert search.prefix(queries, places).count() == 0
    empty = spark.createDataFrame([], "osm_id bigint, name string")
    assert merge.by_id(empty, empty).count() == 0


def test_danish_and_norwegian_places(spark, tmp_path):
    rows = [
        {"id": "a-1", "hovedtype": "Bebyggelse", "undertype": "bydel", "primærtnavn": "Vesterbro", "visueltcenter": [12.55, 55.67], "sekundærenavne": [{"navn": "Westerbro"}, {"navn": "Vesterbro"}]},
        {"id": "a-2", "hovedtype": "Standsningssted", "undertype": "bus", "primærtnavn": "Holte", "visueltcenter": [12.4, 55.8]},
        {"id": "a-3", "hovedtype": "Bebyggelse", "undertype": "gård", "primærtnavn": "Gård", "visueltcenter": [12.4, 55.8]},
        {"id": "a-4", "hovedtype": "Bebyggelse", "undertype": "by", "primærtnavn": " ", "visueltcenter": [12.4, 55.8]},
        {"id": "a-5", "hovedtype": "Bebyggelse", "undertype": "by", "primærtnavn": "Nowhere", "visueltcenter": None},
    ]
    (tmp_path / "dk.json").write_text(json.dumps(rows))
    got = {r.name: r for r in gazetteers.danish_places(spark, f"{tmp_path}/dk.json").collect()}
    assert {k: (r.kind, r.alt_names, r.lat) for k, r in got.items()} == {"Vesterbro": ("suburb", ["Westerbro"], 55.67), "Holte": ("station", [], 55.8)}
    assert all(r.osm_id < 0 for r in got.values()) and got["Vesterbro"].osm_id != got["Holte"].osm_id
    spelling = lambda name, first, status: f"<app:skrivemåte><app:Skrivemåte><app:langnavn>{name}</app:langnavn><app:prioritertSkrivemåte>{first}</app:prioritertSkrivemåte><app:skrivemåtestatus>{status}</app:skrivemåtestatus></app:Skrivemåte></app:skrivemåte>"
    place = lambda number, status, kind, names: (
        f"<app:Sted><app:stedsnummer>{number}</app:stedsnummer><app:stedstatus>{status}</app:stedstatus><app:navneobjekttype>{kind}</app:navneobjekttype><app:sortering><app:Sortering><app:sortering1Kode>viktighetC</app:sortering1Kode></app:Sortering></app:sortering>"
        f"<app:posisjon><gml:Point><gml:pos>59.627 5.799</gml:pos></gml:Point></app:posisjon><app:kommune><app:Kommune><app:kommunenavn>Vindafjord</app:kommunenavn><app:fylkesnavn>Rogaland</app:fylkesnavn></app:Kommune></app:kommune><app:stedsnavn><app:Stedsnavn>{names}</app:Stedsnavn></app:stedsnavn></app:Sted>"
    )
    body = place(1, "aktiv", "tjern", spelling("Hamre", "false", "godkjent") + spelling("Hamra", "true", "godkjent") + spelling("Old", "false", "historisk")) + place(2, "slettet", "by", spelling("Gone", "true", "godkjent")) + place(3, "aktiv", "x", spelling("None", "true", "avslått"))
    (tmp_path / "no.xml").write_text(f"<root>{body}</root>")
    got = gazetteers.norwegian_places(spark, f"{tmp_path}/no.xml").collect()
    assert [(r.osm_id, r.name, r.alt_names, r.kind, r.population, r.municipality, r.lat) for r in got] == [(-1, "Hamra", ["Hamre"], "lake", 1000, "Vindafjord", 59.627)]


def test_paged_and_joined_addresses(spark, tmp_path):
    feature = lambda **p: {"properties": {"address_name_fin": "Katu", "number_part_of_address_number": 4, "postal_code": "00100", **p}, "geometry": {"coordinates": [25.0, 60.2]}}
    pages = [[feature(), feature(address_name_fin="", address_name_swe="Gatan", subdivision_letter_of_address_number="b")], [feature(number_part_of_address_number=0), {"properties": {}, "geometry": None}]]
    for i, features in enumerate(pages):
        (tmp_path / f"page{i}.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    got = gazetteers.finnish_addresses(spark, f"{tmp_path}/page*.json").collect()
    assert sorted((r.street, r.housenumber, r.postcode) for r in got) == [("Gatan", "4b", "00100"), ("Katu", "4", "00100")]
    held = spark.createDataFrame([("g1", "12", "A", "MAIN", "ST", None, "K1A", "OTTAWA", "ON"), ("g2", "5", None, "KING", None, "W", None, "X", "ON")], "LOC_GUID string, CIVIC_NO string, CIVIC_NO_SUFFIX string, OFFICIAL_STREET_NAME string, OFFICIAL_STREET_TYPE string, OFFICIAL_STREET_DIR string, MAIL_POSTAL_CODE string, CSD_ENG_NAME string, MAIL_PROV_ABVN string")
    placed = spark.createDataFrame([("g1", "45.4", "-75.7")], "LOC_GUID string, BG_LATITUDE string, BG_LONGITUDE string")
    assert [tuple(r) for r in gazetteers.canadian_addresses(held, placed).collect()] == [("Main St", "12A", "K1A", "Ottawa", "ON", 45.4, -75.7)]
    layer = spark.createDataFrame([("1", "45", "47", "A", "MEMORIAL", "AVENUE", "Ilam", "Christchurch", -43.5, 172.6), (None, "9", None, None, "Quay", None, None, "Town", -41.2, 174.7), (None, "9", None, None, "Far", None, None, None, 10.0, 174.7)], "unit_value string, address_number string, address_number_high string, address_number_suffix string, road_name string, road_type_name string, suburb_locality string, town_city string, lat double, lon double")
    assert [tuple(r)[:3] for r in gazetteers.new_zealand_addresses(layer).collect()] == [("Memorial Avenue", "1/45-47A", "Ilam"), ("Quay", "9", "Town")]


def test_catalogue_and_texts(spark):
    rows = gazetteers.catalogue('[country.se]\nname = "Sweden"\n[country.se.national]\ntype = "gpkg"\nurl = "x"\n[country.dk]\nname = "Denmark"\n')
    assert rows == [{"country": "se", "kind": "", "name": "Sweden"}, {"country": "se", "kind": "national", "type": "gpkg", "url": "x"}, {"country": "dk", "kind": "", "name": "Denmark"}]
    df = spark.createDataFrame([('"a"',), ('["b", "c"]',), ("[]",), ("5",), (None,)], "v string")
    assert [r[0] for r in df.select(gazetteers.first_text(F.col("v"))).collect()] == ["a", "b", None, None, None]
