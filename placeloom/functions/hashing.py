"""Hash functions of the data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HALF = (1 << 32) - 1


def utf8_bytes(text: Column) -> Column:
    """UTF-8 bytes of a string as numbers."""
    h = F.hex(F.encode(text, "UTF-8"))
    n = (F.length(h) / 2).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint"))).otherwise(
        F.array().cast("array<bigint>")
    )


def djb2_bucket(text: Column) -> Column:
    """djb2 of the bytes, 32 bits, folded to 1..65534."""
    h = F.aggregate(utf8_bytes(text), F.lit(5381).cast("bigint"), lambda h, b: (h * 33 + b) % F.lit(4294967296))
    return h % 65534 + 1


def fnv1a(data: Column) -> Column:
    """FNV-1a of an array of bytes, 64 bits, as struct<hi, lo> of its 32-bit halves."""

    def step(h: Column, b: Column) -> Column:
        # the prime is 2^40 + 435
        low = h["lo"].bitwiseXOR(b)
        product = low * 435
        high = h["hi"] * 435 + F.shiftright(product, 32) + low * 256
        return F.struct(high.bitwiseAND(_HALF).alias("hi"), product.bitwiseAND(_HALF).alias("lo"))

    start = F.struct(F.lit(0xCBF29CE4).cast("bigint").alias("hi"), F.lit(0x84222325).cast("bigint").alias("lo"))
    return F.aggregate(data, start, step)


def low_bits(h: Column, bits: int) -> Column:
    """The lowest ``bits`` (33 to 62) of a hash of two halves."""
    return h["hi"].bitwiseAND((1 << (bits - 32)) - 1) * F.lit(1 << 32) + h["lo"]


def place_id(kind: Column, osm_id: Column, place_type: Column) -> Column:
    """Stable 53-bit id of (N, W or R, osm_id, type number); 0 only for osm_id 0."""
    eight = F.array(*[F.shiftright(osm_id.cast("bigint"), 8 * i).bitwiseAND(255) for i in range(8)])
    data = F.concat(utf8_bytes(kind), eight, F.array(F.pmod(place_type.cast("bigint"), F.lit(256))))
    h = low_bits(fnv1a(data), 53)
    return F.when(osm_id == 0, F.lit(0)).when(h == 0, F.lit(1)).otherwise(h).cast("bigint")
