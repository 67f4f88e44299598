"""Usage, quotas and rate limits over request logs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Requests a second and requests a month by plan; 0: unlimited.
TIERS = {"free": (10, 100_000), "pro": (100, 1_000_000), "business": (500, 0)}
ANONYMOUS_PER_MINUTE = 60


def daily(requests: DataFrame) -> DataFrame:
    """(key, day, requests, errors) with day as yyyymmdd."""
    day = F.date_format("ts", "yyyyMMdd").cast("int")
    return requests.groupBy("key", day.alias("day")).agg(F.count("*").alias("requests"), F.count_if(F.col("failed")).alias("errors"))


def upsert_add(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two rollups added up by (key, day)."""
    return old.unionByName(new).groupBy("key", "day").agg(F.sum("requests").alias("requests"), F.sum("errors").alias("errors"))


def month_to_date(rollup: DataFrame) -> DataFrame:
    """Running sum of requests within each key's month."""
    month = F.floor(F.col("day") / 100).cast("int")
    along = W.partitionBy("key", month).orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    return rollup.select("key", "day", F.sum("requests").over(along).alias("month_to_date"))


def monthly_quota(requests: DataFrame, quota: int) -> DataFrame:
    """Requests with their number in the key's month and whether the quota allows them."""
    along = W.partitionBy("key", F.date_trunc("month", "ts")).orderBy("ts", "event_id")
    return requests.withColumn("nth", F.row_number().over(along)).withColumn("allowed", F.col("nth") <= quota)


def rate_limited(requests: DataFrame, every_us: int, burst_us: int) -> DataFrame:
    """(key, event_id, allowed) by the generic cell rate algorithm.

    Each key's requests are walked in time order with one number of state.  A key's rows are read
    as a stream of Arrow batches of a sorted partition, so a key of any size takes bounded memory.
    """
    ordered = requests.select("key", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    ordered = ordered.repartition("key").sortWithinPartitions("key", "us", "event_id")

    def run(batches):
        current, due = None, 0
        for pdf in batches:
            allowed = []
            for key, us in zip(pdf["key"], pdf["us"]):
                if key != current:
                    current, due = key, 0
                ok = max(due, us) - us <= burst_us
                if ok:
                    due = max(due, us) + every_us
                allowed.append(ok)
            yield pd.DataFrame({"key": pdf["key"], "event_id": pdf["event_id"], "allowed": allowed})

    return ordered.mapInPandas(run, "key bigint, event_id bigint, allowed boolean")


def decisions(requests: DataFrame) -> DataFrame:
    """First rule that rejects a request: malformed, unknown, blocked, rate, quota; else ok."""
    rule = (
        F.when(~F.col("well_formed"), "malformed")
        .when(~F.col("known"), "unknown")
        .when(F.col("blocked"), "blocked")
        .when(~F.col("within_rate"), "rate")
        .when(~F.col("within_quota"), "quota")
        .otherwise("ok")
    )
    return requests.withColumn("decision", rule)
