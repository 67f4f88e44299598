"""Merging sources: anti-joins by id, by name and neighbourhood, by address; change feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.functions import geo

#: Cells of 0.001 degrees for places, 0.0001 degrees for addresses.
PLACE_CELL, ADDRESS_CELL = 1000, 100


def _cells(df: DataFrame, size: int) -> DataFrame:
    return df.withColumn("cx", F.floor(F.col("lon_u") / size)).withColumn("cy", F.floor(F.col("lat_u") / size))


def _spread(df: DataFrame, size: int) -> DataFrame:
    """Every row once for each of the nine cells at and around its own."""
    near = F.array(*[F.struct((F.floor(F.col("lon_u") / size) + dx).alias("cx"), (F.floor(F.col("lat_u") / size) + dy).alias("cy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    return df.withColumn("cell", F.explode(near)).select("*", "cell.cx", "cell.cy").drop("cell")


def by_id(old: DataFrame, new: DataFrame, key: str = "osm_id") -> DataFrame:
    """``old`` and the rows of ``new`` whose id it lacks; id 0 is no id."""
    known = old.where(F.col(key) != 0).select(key).distinct()
    return old.unionByName(new.join(known, key, "left_anti"))


def by_name_nearby(old: DataFrame, new: DataFrame, size: int = PLACE_CELL) -> DataFrame:
    """Rows of ``new`` without an ``old`` row of the same name in the nine cells around."""
    known = _spread(old.select("name", "lat_u", "lon_u"), size).select("name", "cx", "cy").distinct()
    return _cells(new, size).join(known, ["name", "cx", "cy"], "left_anti").drop("cx", "cy")


def self_dedup(rows: DataFrame, size: int = PLACE_CELL) -> DataFrame:
    """Rows without an earlier row (by record_id) of the same name in the nine cells around."""
    earlier = _spread(rows.select("name", "lat_u", "lon_u", F.col("record_id").alias("other")), size)
    first = earlier.groupBy("name", "cx", "cy").agg(F.min("other").alias("first"))
    return _cells(rows, size).join(first, ["name", "cx", "cy"]).where(F.col("record_id") <= F.col("first")).drop("cx", "cy", "first")


def addresses_apart(old: DataFrame, new: DataFrame, metres: float = 10.0) -> DataFrame:
    """Rows of ``new`` without an ``old`` address of the same street and number within ``metres``."""
    keyed = lambda df: df.withColumn("s", F.lower("street")).withColumn("h", F.lower("housenumber"))
    left = keyed(new).alias("n")
    right = keyed(old.select("street", "housenumber", "lat_u", "lon_u")).alias("o")
    near = geo.haversine_m(F.col("n.lat_u"), F.col("n.lon_u"), F.col("o.lat_u"), F.col("o.lon_u")) < metres
    return left.join(right, (F.col("n.s") == F.col("o.s")) & (F.col("n.h") == F.col("o.h")) & near, "left_anti").drop("s", "h")


def latest_changes(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last change of every key: a partial aggregate, so no key gathers its history."""
    rest = [c for c in changes.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("last"))
    return last.select(*keys, "last.*")


def apply_changes(base: DataFrame, changes: DataFrame, key: str, order: list[str], action: str = "action") -> DataFrame:
    """``base`` after a change feed: create and modify put a row, delete removes it."""
    last = latest_changes(changes, [key], order)
    kept = base.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where(F.col(action) != "delete").select(*base.columns))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with the side: empty for equal tables."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def with_fallback(rows: DataFrame, exact: DataFrame, loose: DataFrame, exact_on: list[str], loose_on: list[str], value: str) -> DataFrame:
    """``rows`` with a value looked up by all keys, else by fewer keys."""
    first = exact.select(*exact_on, F.col(value).alias("__first"))
    second = loose.select(*loose_on, F.col(value).alias("__second"))
    found = rows.join(first, exact_on, "left").join(second, loose_on, "left")
    return found.withColumn(value, F.coalesce("__first", "__second")).drop("__first", "__second")


def overwrite_where(rows: DataFrame, updates: DataFrame, key: str, columns: list[str], valid: Column | None = None) -> DataFrame:
    """``rows`` with the columns that an update has, where it is valid."""
    new = updates.select(key, *[F.col(c).alias(f"__{c}") for c in columns], (valid if valid is not None else F.lit(True)).alias("__valid"))
    joined = rows.join(new, key, "left")
    put = [F.when(F.col("__valid") & F.col(f"__{c}").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns]
    return joined.select(*put)
