"""Geographic column expressions; coordinates are integer microdegrees unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371000.0
#: Cells of the place grid: 2^15 steps of longitude and of latitude, as in a six-letter geohash.
GRID_BITS = 15


def degrees(micro: Column) -> Column:
    """Microdegrees as degrees."""
    return micro / F.lit(1e6)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres between two points."""
    p1, p2 = F.radians(degrees(lat1)), F.radians(degrees(lat2))
    dp, dl = F.radians(degrees(lat2 - lat1)), F.radians(degrees(lon2 - lon1))
    a = F.sin(dp / 2) * F.sin(dp / 2) + F.cos(p1) * F.cos(p2) * F.sin(dl / 2) * F.sin(dl / 2)
    return F.lit(EARTH_M) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def equirectangular_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Flat-earth metres, good for short distances."""
    x = F.radians(degrees(lon2 - lon1)) * F.cos(F.radians(degrees(lat1 + lat2) / 2))
    y = F.radians(degrees(lat2 - lat1))
    return F.lit(EARTH_M) * F.sqrt(x * x + y * y)


def corrected_degrees2(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Squared degrees with longitude shrunk by the cosine of the first latitude."""
    x = degrees(lon2 - lon1) * F.cos(F.radians(degrees(lat1)))
    y = degrees(lat2 - lat1)
    return x * x + y * y


def destination(lat: Column, lon: Column, bearing_deg: Column, distance_m: Column) -> tuple[Column, Column]:
    """Degrees reached from a point in degrees along a bearing."""
    p, l, b = F.radians(lat), F.radians(lon), F.radians(bearing_deg)
    d = distance_m / F.lit(EARTH_M)
    p2 = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b))
    l2 = l + F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(p2))
    return F.degrees(p2), F.degrees(l2)


def cell_x(lon: Column, bits: int = GRID_BITS) -> Column:
    """Grid column; the antimeridian belongs to the last cell."""
    return F.least(F.floor((lon.cast("bigint") + 180_000_000) * (1 << bits) / 360_000_000), F.lit((1 << bits) - 1)).cast("bigint")


def cell_y(lat: Column, bits: int = GRID_BITS) -> Column:
    """Grid row; the pole belongs to the last cell."""
    return F.least(F.floor((lat.cast("bigint") + 90_000_000) * (1 << bits) / 180_000_000), F.lit((1 << bits) - 1)).cast("bigint")


def around(x: Column, y: Column, bits: int = GRID_BITS) -> Column:
    """The nine cells at and around (x, y), columns wrapping at the antimeridian."""
    steps = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    return F.array(*[F.struct(F.pmod(x + dx, F.lit(1 << bits)).alias("gx"), (y + dy).alias("gy")) for dx, dy in steps])


def in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Even-odd ray cast on a closed ring of struct<lat, lon>; integer arithmetic, no division."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, i + 1)
        straddles = (a["lat"] > lat) != (b["lat"] > lat)
        left = (lon - a["lon"]) * (b["lat"] - a["lat"])
        right = (lat - a["lat"]) * (b["lon"] - a["lon"])
        beside = F.when(b["lat"] > a["lat"], left < right).otherwise(left > right)
        return (straddles & beside).cast("int")

    hits = F.aggregate(F.transform(F.sequence(F.lit(1), n - 1), crosses), F.lit(0), lambda s, x: s + x)
    return hits % 2 == 1


def in_box(lat: Column, lon: Column, south, north, west, east) -> Column:
    """Inclusive box test."""
    return lat.between(south, north) & lon.between(west, east)


def box_delta(centre: Column, edge: Column) -> Column:
    """Distance of a box's edge from its centre in steps of 16 microdegrees, clamped to 16 bits."""
    step = ((edge - centre) / 16).cast("bigint")
    return F.greatest(F.lit(-32768), F.least(F.lit(32767), step))


def box_edge(centre: Column, delta: Column) -> Column:
    """Edge of a box from its encoded distance."""
    return centre + delta * 16
