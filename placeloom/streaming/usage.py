"""Request logs and change feeds as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.operators import merge


def daily_counts(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """Requests and errors by key and day of a stream (key, ts, failed); rows later than ``late`` are dropped."""
    stamped = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = stamped.groupBy(F.window("ts", "1 day"), "key").agg(F.count("*").alias("requests"), F.count_if("failed").alias("errors"))
    return counted.select("key", F.date_format("window.start", "yyyyMMdd").cast("int").alias("day"), "requests", "errors")


def rate_limit(requests: DataFrame, every_us: int, burst_us: int) -> DataFrame:
    """Rate limit of a stream (key, event_id, ts): the state of a key is the time its next request is due."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        due = state.get[0] if state.exists else 0
        rows = pd.concat(batches).sort_values(["us", "event_id"], kind="stable")
        allowed = []
        for us in rows["us"]:
            ok = max(due, us) - us <= burst_us
            if ok:
                due = max(due, us) + every_us
            allowed.append(ok)
        state.update((int(due),))
        yield pd.DataFrame({"key": rows["key"], "event_id": rows["event_id"], "allowed": allowed})

    timed = requests.select("key", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return timed.groupBy("key").applyInPandasWithState(run, "key bigint, event_id bigint, allowed boolean", "due bigint", "append", "NoTimeout")


def upsert_sink(path: str, key: str, order: list[str], versions: Callable[[int], str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that applies change batches to a table of versions.

    Batch n reads version n and writes version n + 1, so a batch that runs twice gives the same table.
    """

    def run(batch: DataFrame, number: int) -> None:
        base = batch.sparkSession.read.parquet(versions(number))
        merge.apply_changes(base, batch, key, order).write.mode("overwrite").parquet(versions(number + 1))

    return run
