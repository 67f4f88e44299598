"""Connected components of an edge table, by minimum labels and pointer jumping.

Every round is two joins and a partial aggregation; the labels are written to the shared folder
after each round, so nothing is gathered on the driver but one row count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.llm.common import materialize


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for all nodes of ``edges`` (a, b); the component is its smallest node."""
    both = materialize(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(),
        f"{name}-edges",
    )
    labels = materialize(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), f"{name}-labels"
    )
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lowered = labels.join(near, "node", "left").select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("component")
        )
        lowered = materialize(lowered, f"{name}-lowered")
        jump = lowered.select(F.col("node").alias("component"), F.col("component").alias("root"))
        jumped = lowered.join(jump, "component", "left").select(
            "node", F.least("component", F.coalesce("root", "component")).alias("component"), "old"
        )
        jumped = materialize(jumped, f"{name}-labels")
        changed = jumped.where(F.col("component") != F.col("old")).limit(1).count()
        labels = jumped.select("node", "component")
        if not changed:
            return labels
