"""Number codecs of the record stores, clocks and addresses of change files, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zigzag(value: Column) -> Column:
    """Signed numbers as unsigned ones: 0, -1, 1, -2 become 0, 1, 2, 3."""
    return F.when(value >= 0, value * 2).otherwise(-value * 2 - 1).cast("bigint")


def unzigzag(value: Column) -> Column:
    """The signed number of a zigzag code."""
    half = F.floor(value / 2).cast("bigint")
    return F.when(value % 2 == 0, half).otherwise(-half - 1)


def varint(value: Column) -> Column:
    """Bytes of an unsigned number as hexadecimal digits, seven bits each, the lowest first; all but the last have the high bit."""

    def byte(i: Column) -> Column:
        low = F.pmod(F.floor(value / F.pow(F.lit(128.0), i)).cast("bigint"), F.lit(128))
        more = F.floor(value / F.pow(F.lit(128.0), i + 1)) > 0
        return F.when((i == 0) | (F.floor(value / F.pow(F.lit(128.0), i)) > 0), F.lpad(F.hex(low + F.when(more, 128).otherwise(0)), 2, "0")).otherwise("")

    # seven groups hold what a double counts exactly
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(6)), byte), "")


def unvarint(code: Column) -> Column:
    """The number of a code of hexadecimal digits."""

    def add(total: Column, i: Column) -> Column:
        return total + F.pmod(F.conv(F.substring(code, 2 * i + 1, F.lit(2)), 16, 10).cast("bigint"), F.lit(128)) * F.pow(F.lit(128.0), i).cast("bigint")

    return F.aggregate(F.sequence(F.lit(0), F.greatest((F.length(code) / 2).cast("int") - 1, F.lit(0))), F.lit(0).cast("bigint"), add)


def delta_encode(values: Column) -> Column:
    """The first value and the steps from each to the next."""
    step = lambda v, i: F.when(i == 0, v).otherwise(v - F.element_at(values, i))
    return F.transform(values, step)


def delta_decode(steps: Column) -> Column:
    """Values from their steps."""
    start = F.array().cast("array<bigint>")
    last = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("bigint"))
    return F.aggregate(steps, start, lambda acc, x: F.concat(acc, F.array(last(acc) + x)))


def utc_text(seconds: Column) -> Column:
    """A time in seconds as text, in UTC."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    of_day = F.pmod(seconds, F.lit(86400))
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), F.format_string("%02d:%02d:%02d", F.floor(of_day / 3600), F.floor(of_day / 60) % 60, of_day % 60), F.lit("Z"))


def change_file(base: Column, sequence: Column) -> Column:
    """Address of the change file with a sequence number, in folders of a thousand."""
    path = F.format_string("%03d/%03d/%03d", F.floor(sequence / 1000000), F.floor(sequence / 1000) % 1000, sequence % 1000)
    return F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), path, F.lit(".osc.gz"))
