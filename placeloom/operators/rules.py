"""Ordered rules, stitched rings and phase planning."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placeloom.functions import geo
from placeloom.operators import spatial


def first_box(lat: Column, lon: Column, boxes: list[tuple[str, int, int, int, int]]) -> Column:
    """Label of the first box (label, south, north, west, east) that holds a point, else null.

    The rules are one array in the plan; a point scans it, so no pairs are formed.
    """
    listed = F.array(*[F.struct(F.lit(b[0]).alias("label"), *[F.lit(v).cast("bigint").alias(k) for k, v in zip(("s", "n", "w", "e"), b[1:])]) for b in boxes])
    hits = F.filter(listed, lambda b: lat.between(b["s"], b["n"]) & lon.between(b["w"], b["e"]))
    return F.try_element_at(hits, F.lit(1))["label"]


def valid_for(name: Column, level: Column, country: Column, rules: dict[tuple[str, int], str]) -> Column:
    """Whether an area's name has the form that its country and level ask for; without a rule all are valid."""
    out = F.lit(True)
    for (code, lv), pattern in rules.items():
        out = F.when((country == code) & (level == lv), name.rlike(pattern)).otherwise(out)
    return out


def best_settlement(points: DataFrame, places: DataFrame, metres: float) -> DataFrame:
    """(point_id, record_id, metres): the settlement of the highest priority within reach, the nearest of equals."""
    met = spatial.neighbours(points, places).where(F.col("metres") <= metres)
    best = met.groupBy("point_id").agg(F.min(F.struct((-F.col("priority")).alias("minus"), "metres", "record_id")).alias("b"))
    return best.select("point_id", F.col("b.record_id").alias("record_id"), F.col("b.metres").alias("metres"))


def important_nearby(points: DataFrame, places: DataFrame, nearest: int, metres: float) -> DataFrame:
    """(point_id, record_id): of the nearest places within reach, the most important; those without importance come last."""
    near = spatial.nearest(points, places, nearest, also=("importance",)).where(F.col("metres") <= metres)
    order = F.struct(F.col("importance").isNull().alias("none"), (-F.col("importance")).alias("minus"), "metres", "record_id")
    best = near.groupBy("point_id").agg(F.min(order).alias("b"))
    return best.select("point_id", F.col("b.record_id").alias("record_id"))


def nearest_in_state(points: DataFrame, places: DataFrame, band: int) -> DataFrame:
    """(point_id, record_id): the nearest place of a point's state within ``band`` microdegrees each way."""
    p, q = points.alias("p"), places.alias("q")
    inside = (F.abs(F.col("p.lat_u") - F.col("q.lat_u")) <= band) & (F.abs(F.col("p.lon_u") - F.col("q.lon_u")) <= band)
    met = p.join(q, (F.col("p.state") == F.col("q.state")) & inside)
    far = F.round(geo.haversine_m(F.col("p.lat_u"), F.col("p.lon_u"), F.col("q.lat_u"), F.col("q.lon_u")), 3)
    best = met.groupBy("p.point_id").agg(F.min(F.struct(far.alias("metres"), "q.record_id")).alias("b"))
    return best.select("point_id", F.col("b.record_id").alias("record_id"), F.col("b.metres").alias("metres"))


def stitch(ways: list[list[tuple[float, float]]], tolerance: float = 1e-5) -> list[list[tuple[float, float]]]:
    """Closed rings of ways that meet at their ends, in either direction; what stays open is dropped."""
    near = lambda a, b: abs(a[0] - b[0]) <= tolerance and abs(a[1] - b[1]) <= tolerance
    left = [list(w) for w in ways if len(w) > 1]
    rings = []
    while left:
        ring = left.pop(0)
        grown = True
        while grown and not near(ring[0], ring[-1]):
            grown = False
            for i, w in enumerate(left):
                if near(ring[-1], w[0]) or near(ring[-1], w[-1]):
                    ring += (w if near(ring[-1], w[0]) else w[::-1])[1:]
                    left.pop(i)
                    grown = True
                    break
        if len(ring) > 3 and near(ring[0], ring[-1]):
            rings.append([*ring[:-1], ring[0]])
    return rings


def stitched_rings(members: DataFrame) -> DataFrame:
    """(relation_id, ring_no, ring) of member ways (relation_id, ord, points array<struct<lat,lon>>).

    One relation is one group: its ways are bounded by the relation itself.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ways = [[(p["lat"], p["lon"]) for p in row] for row in pdf.sort_values("ord")["points"]]
        rings = stitch(ways)
        return pd.DataFrame(
            {
                "relation_id": [pdf["relation_id"].iloc[0]] * len(rings),
                "ring_no": range(len(rings)),
                "ring": [[{"lat": a, "lon": b} for a, b in r] for r in rings],
            }
        )

    return members.groupBy("relation_id").applyInPandas(run, "relation_id bigint, ring_no int, ring array<struct<lat:double,lon:double>>")


def planned_phases(states: DataFrame, previous: DataFrame) -> DataFrame:
    """(country, phase, ord, run): phases whose fingerprint changed, and all that follow them."""
    both = states.join(previous.select("country", "phase", F.col("fingerprint").alias("before")), ["country", "phase"], "left")
    changed = (~F.col("fingerprint").eqNullSafe(F.col("before"))).cast("int")
    along = W.partitionBy("country").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("run", F.max(changed).over(along) == 1).select("country", "phase", "ord", "run")
