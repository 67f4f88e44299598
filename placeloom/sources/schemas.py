"""Row schemas of the model tables."""

from __future__ import annotations

PLACES = (
    "osm_id bigint, osm_type int, name string, lat double, lon double, place_type int, admin_level int, population bigint, wikidata string, alt_names string, old_names string, "
    "name_intl string, extratags string, osm_class string, osm_class_value string, bbox_south int, bbox_north int, bbox_west int, bbox_east int"
)
ADDRESSES = "osm_id bigint, street string, housenumber string, postcode string, city string, state string, lat double, lon double"
ADMIN = "id int, name string, parent_id int, lat_u int, lon_u int, place_type int, population bigint"
ADMIN_RINGS = "level int, admin_id int, ring_no int, ring array<struct<lat:bigint,lon:bigint>>"
POSTINGS = "layer string, key string, country string, record_id bigint, importance int, rank int"
ZIPS = "zip string, lat_u int, lon_u int, city string, state string, county string"
NODES = "id bigint, lat double, lon double, tags map<string,string>"
WAYS = "id bigint, refs array<bigint>, tags map<string,string>"
RELATIONS = "id bigint, members array<struct<type:string,ref:bigint,role:string>>, tags map<string,string>"
