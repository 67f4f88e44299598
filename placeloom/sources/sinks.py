"""Writers of the model tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, *, by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Parquet with zstd, a folder for each value of ``by``."""
    writer = df.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_sorted(df: DataFrame, path: str, keys: list[str], files: int, mode: str = "errorifexists") -> None:
    """Parquet in ranges of ``keys``, so that a lookup reads few row groups."""
    df.repartitionByRange(files, *keys).sortWithinPartitions(*keys).write.mode(mode).option("compression", "zstd").parquet(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """A table whose joins on ``key`` need no exchange."""
    df.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def replace_table(df: DataFrame, path: str, scratch: str) -> None:
    """Replace a table that ``df`` itself reads: write beside it, then read back and overwrite."""
    df.write.mode("overwrite").parquet(scratch)
    df.sparkSession.read.parquet(scratch).write.mode("overwrite").option("compression", "zstd").parquet(path)


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key the table lacks."""
    known = df.sparkSession.read.parquet(path).select(key)
    df.join(known, key, "left_anti").write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header."""
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines."""
    df.write.mode("errorifexists").json(path)


def dump_sorted(df: DataFrame, path: str) -> None:
    """All rows as sorted JSON text, for comparing tables."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).orderBy("value").write.mode("errorifexists").text(path)
