"""Connected components of a link table, by label propagation with shortcuts; nothing but the links is ever moved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(id, label): for each end of a link the least id of its component.  Links with a null end are passed over."""
    edges = links.select(F.col(a).alias("id"), F.col(b).alias("other")).dropna()
    edges = cut(edges.unionByName(edges.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct())
    labels = cut(edges.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("label")))
    for _ in range(most_rounds):
        near = edges.join(labels.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("label").alias("near"))
        now = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("new"))
        # shortcut: take over the label of one's label
        jump = labels.select(F.col("id").alias("new"), F.col("label").alias("further"))
        now = cut(now.join(jump, "new", "left").select("id", "label", F.coalesce("further", "new").alias("new")))
        changed = not now.filter("label <> new").isEmpty()
        labels = now.select("id", F.col("new").alias("label"))
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
