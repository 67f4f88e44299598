"""Audits and accuracy reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def category_report(runs: DataFrame, breakdowns: list[str]) -> DataFrame:
    """Counts and percentages of categories, over all runs and by each breakdown, in one pass."""
    sets = ", ".join(["(category)"] + [f"({b}, category)" for b in breakdowns])
    runs.createOrReplaceTempView("__runs")
    ids = ", ".join(f"grouping({b})" for b in breakdowns)
    dims = ", ".join(breakdowns)
    counted = runs.sparkSession.sql(f"SELECT {dims}, category, count(*) AS n, concat_ws('', {ids}) AS level FROM __runs GROUP BY {dims}, category GROUPING SETS ({sets})")
    total = F.sum("n").over(W.partitionBy("level", *breakdowns))
    return counted.withColumn("pct", F.round(F.col("n") * 100.0 / total, 3)).drop("level")


def nearest_rank(values: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """Percentiles as elements of the sorted values at round(p * (n - 1)).

    Equal values are counted first, and the running count over the distinct values finds each
    element: ranges of values are summed apart, so no task sorts all rows.
    """
    counted = values.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    cuts = counted.agg(F.percentile_approx(column, [i / 64 for i in range(1, 64)], F.lit(1000))).first()[0] or []
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda b: b < F.col(column))) if cuts else F.lit(0)
    counted = counted.withColumn("bucket", bucket)
    sizes = counted.groupBy("bucket").agg(F.sum("n").alias("size"))
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    before = before.withColumn("total", F.sum("size").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    inside = F.sum("n").over(W.partitionBy("bucket").orderBy(column))
    placed = counted.join(F.broadcast(before), "bucket").withColumn("last", F.col("before") + inside - 1)
    wanted = F.explode(F.array(*[F.lit(p) for p in shares])).alias("share")
    at = F.floor(F.col("share") * (F.col("total") - 1) + 0.5)
    hits = placed.select("*", wanted).withColumn("at", at).where((F.col("at") <= F.col("last")) & (F.col("at") > F.col("last") - F.col("n")))
    return hits.select("share", F.col(column).alias("value"))


def histogram(values: DataFrame, column: str, edges: list[float], labels: list[str]) -> DataFrame:
    """Counts of values under each edge, the last label for the rest."""
    bin_: Column = F.lit(labels[-1])
    for edge, label in reversed(list(zip(edges, labels))):
        bin_ = F.when(F.col(column) < edge, label).otherwise(bin_)
    return values.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


def audit(places: DataFrame, inside: Column) -> DataFrame:
    """Rows, rows at zero coordinates, rows outside the country, by type."""
    zero = (F.col("lat_u") == 0) & (F.col("lon_u") == 0)
    return places.groupBy("kind").agg(
        F.count("*").alias("n"), F.count_if(zero).alias("n_zero"), F.count_if(~inside & ~zero).alias("n_outside"), F.count_if(F.col("name").isNull() | (F.col("name") == "")).alias("n_unnamed")
    )


def trend(runs: DataFrame, good: Column, last: int = 1000) -> DataFrame:
    """Share of good rows overall and among the last rows by id, and the direction beyond half a point."""
    newest = runs.orderBy(F.desc("id")).limit(last)
    pct = lambda df, name: df.agg(F.round(F.avg(good.cast("double")) * 100, 4).alias(name))
    both = pct(runs, "overall").withColumn("j", F.lit(1)).join(pct(newest, "recent").withColumn("j", F.lit(1)), "j").drop("j")
    return both.withColumn("direction", F.when(F.col("recent") > F.col("overall") + 0.5, "up").when(F.col("recent") < F.col("overall") - 0.5, "down").otherwise("flat"))


def sample_by_stratum(rows: DataFrame, stratum: str, key: str, n: int, seed: int = 1) -> DataFrame:
    """``n`` rows of each stratum in an order that depends on key and seed alone."""
    mixed = F.pmod(F.col(key) * F.lit(2654435761) + F.lit(seed) * F.lit(40503), F.lit(4294967296))
    order = W.partitionBy(stratum).orderBy(mixed, key)
    return rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).drop("r")
