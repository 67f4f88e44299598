"""Registered queries of the sources: national registries and their joins, on columns derived from the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.functions import address, projections
from placeloom.plans import fixtures as fx
from placeloom.plans.lookup_queries import _mercator_sql
from placeloom.plans.queries import query
from placeloom.sources import registries

#: Grids whose series stands in SQL, by registry.
_GRIDS = {"no_kartverket": projections.UTM33, "pl_prg": projections.PUWG92}
#: Registries in degrees or in one of these grids.
_NAMES = [n for n, r in registries.REGISTRIES.items() if r.grid is None or n in _GRIDS]


def _raw(name: str) -> dict[str, str]:
    """A registry's columns as expressions that both engines read; of several names for one thing each is filled in turn."""
    r = registries.REGISTRIES[name]
    columns: dict[str, str] = {}
    for names, made in ((r.street, "' Gata ' || c_custkey"), (r.number, "CAST(c_custkey % 97 + 1 AS STRING)"), (r.postcode, "CAST(10000 + c_custkey AS STRING)"), (r.city, "'Stad ' || (c_custkey % 13)"), (r.state, "'S' || (c_custkey % 5)"), (r.suffix, "CASE WHEN c_custkey % 3 = 0 THEN 'b' ELSE ' ' END")):
        for i, column in enumerate(names):
            columns[column] = made if len(names) == 1 else f"CASE WHEN c_custkey % {len(names) + 1} = {i} THEN {made} ELSE '' END"
    if name in _GRIDS:
        columns[r.x], columns[r.y] = "CAST(300000 + (c_custkey * 7919) % 400009 AS STRING)", f"CAST({5800000 + int(_GRIDS[name].north0)} + (c_custkey * 104729) % 400007 AS STRING)"
    else:
        mark = "," if r.decimal_comma else "."
        for column, start in ((r.x, 10), (r.y, 50)):
            columns[column] = f"CASE WHEN c_custkey % 17 = 0 THEN 'x' ELSE (({start} + c_custkey % 7) || '{mark}' || (100 + c_custkey % 900)) END"
    return columns


def _mapped_sql(name: str) -> str:
    """The rows of a registry in SQL."""
    r, raw = registries.REGISTRIES[name], _raw(name)
    listed = ", ".join(f'{e} AS "{c}"' for c, e in raw.items())
    first = lambda names: "coalesce(" + ", ".join([f"nullif(trim(\"{n}\"), '')" for n in names] + ["CAST(NULL AS VARCHAR)"]) + ")"
    number = lambda c: f"TRY_CAST(replace(\"{c}\", ',', '.') AS DOUBLE)"
    lat, lon = _mercator_sql(_GRIDS[name], number(r.x), number(r.y)) if name in _GRIDS else (number(r.y), number(r.x))
    return (
        f"SELECT '{name}' AS registry, id, street, housenumber, postcode, city, state, round(lat, 6) AS lat, round(lon, 6) AS lon FROM (SELECT id, {first(r.street)} AS street, {first(r.number)} || coalesce({first(r.suffix)}, '') AS housenumber, "
        f"{first(r.postcode)} AS postcode, {first(r.city)} AS city, {first(r.state)} AS state, {lat} AS lat, {lon} AS lon FROM (SELECT c_custkey AS id, {listed} FROM customer)) WHERE street IS NOT NULL AND housenumber IS NOT NULL AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180"
    )


@query("registry_rows", " UNION ALL ".join(_mapped_sql(n).replace("id, street", "street", 1).replace("(SELECT id, ", "(SELECT ", 1) for n in _NAMES))
def registry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of ten registries as addresses."""
    customers, out = fx.table(spark, sf_dir, "customer"), None
    for name in _NAMES:
        raw = customers.select(*[F.expr(e).alias(c) for c, e in _raw(name).items()])
        mapped = registries.map_addresses(raw, registries.REGISTRIES[name])
        rows = mapped.select(F.lit(name).alias("registry"), "street", "housenumber", "postcode", "city", "state", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "registry_joins",
    "WITH d AS (SELECT o_orderkey AS id, o_custkey % 40 AS s, o_custkey % 7 AS l, o_orderkey % 90 + 1 AS n, o_orderkey % 4 AS x FROM orders) "
    "SELECT 'au' AS registry, upper(chr(CAST(97 + s % 26 AS INTEGER))) || 'x Road' AS street, n || CASE WHEN x = 1 THEN 'A' ELSE '' END AS housenumber, CAST(2000 + l AS VARCHAR) AS postcode, 'Loc ' || l AS city, CASE WHEN l % 2 = 0 THEN 'NSW' END AS state, CAST(-30 - l AS DOUBLE) AS lat, CAST(150 + s AS DOUBLE) AS lon FROM d WHERE x <> 3 AND s < 35 "
    "UNION ALL SELECT 'kr', 'Ro ' || s, n || CASE WHEN x > 0 THEN '-' || x ELSE '' END, CAST(10000 + l AS VARCHAR), 'Si', 'Do', CAST(37 AS DOUBLE), CAST(120 + l AS DOUBLE) FROM d WHERE s < 35",
)
def registry_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that stand in five tables, and in two."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    orders = fx.table(spark, sf_dir, "orders").select(k.alias("id"), (c % 40).alias("s"), (c % 7).alias("l"), (k % 90 + 1).alias("n"), (k % 4).alias("x"))
    details = orders.select(
        F.col("id").alias("ADDRESS_DETAIL_PID"), F.col("s").alias("STREET_LOCALITY_PID"), F.col("l").alias("LOCALITY_PID"), F.col("n").cast("string").alias("NUMBER_FIRST"), F.when(F.col("x") == 1, "A").alias("NUMBER_FIRST_SUFFIX"), (F.lit(2000) + F.col("l")).alias("POSTCODE")
    )
    geocodes = orders.where("x <> 3").select(F.col("id").alias("ADDRESS_DETAIL_PID"), (F.lit(-30) - F.col("l")).alias("LATITUDE"), (F.lit(150) + F.col("s")).alias("LONGITUDE"))
    numbers = spark.range(35)
    roads = numbers.select(F.col("id").alias("STREET_LOCALITY_PID"), F.concat(F.upper(F.char(97 + F.col("id") % 26)), F.lit("X")).alias("STREET_NAME"), F.lit("ROAD").alias("STREET_TYPE_CODE"), F.lit(None).cast("string").alias("STREET_SUFFIX_CODE"))
    localities = spark.range(7).select(F.col("id").alias("LOCALITY_PID"), F.concat(F.lit("LOC "), F.col("id").cast("string")).alias("LOCALITY_NAME"), (F.col("id") % 2).alias("STATE_PID"))
    states = spark.createDataFrame([(0, "NSW")], "STATE_PID bigint, STATE_ABBREVIATION string")
    au = registries.australian(details, geocodes, roads, localities, states).select(F.lit("au").alias("registry"), "*")
    buildings = orders.select(F.col("s").alias("road_code"), F.col("n").alias("main"), F.col("x").alias("sub"), (F.lit(10000) + F.col("l")).alias("zip"), F.lit("Si").alias("city"), F.lit("Do").alias("state"), F.lit(37).alias("lat"), (F.lit(120) + F.col("l")).alias("lon"))
    kr = registries.korean(numbers.select(F.col("id").alias("road_code"), F.concat(F.lit("Ro "), F.col("id").cast("string")).alias("road")), buildings)
    return au.unionByName(kr.select(F.lit("kr").alias("registry"), "*"))


@query(
    "us_forms",
    "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN lpad(CAST(c_custkey % 99999 AS VARCHAR), 5, '0') WHEN 1 THEN lpad(CAST(c_custkey % 99999 AS VARCHAR), 5, '0') END AS zip, ['Texas', 'New York', NULL, 'Puerto Rico'][CAST(c_custkey % 4 AS INTEGER) + 1] AS state, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS qid FROM customer",
)
def us_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ZIP codes, names of states and identifiers in their spellings."""
    k = F.col("c_custkey")
    five = F.lpad((k % 99999).cast("string"), 5, "0")
    typed = F.when(k % 4 == 0, five).when(k % 4 == 1, F.concat(F.lit(" "), five, F.lit("-0042 "))).when(k % 4 == 2, F.concat(five, F.lit("x"))).otherwise("1234")
    code = F.element_at(F.array(*map(F.lit, ("tx", " NY ", "ZZ", "PR"))), (k % 4).cast("int") + 1)
    number = F.when(k % 2 == 0, F.concat(F.lit("q"), k.cast("string"))).otherwise(F.concat(F.lit("Q"), k.cast("string"), F.lit("b")))
    return fx.table(spark, sf_dir, "customer").select(k.alias("id"), address.us_zip(typed).alias("zip"), address.state_name(code).alias("state"), address.qid(number).alias("qid"))
