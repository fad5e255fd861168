"""Candidate pairs from hash buckets of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components

SMALL = 32


def grouped(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables that together cover each pair of rows of (id, bands array<long>) that share a key.

    The first is (a, b), a < b: distinct pairs that share a key which at most SMALL rows hold, but for those in one group.  The
    second is (id, label): the groups, which are what keys of more rows connect.  All pairs in a group are left to be compared.
    """
    once = own.select("id", F.explode("bands").alias("key"))
    sizes = once.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least")).filter("n > 1")
    member = once.join(sizes, "key")
    groups = components(member.filter(F.col("n") > SMALL).select("id", "least").distinct(), "id", "least")
    lists = member.filter(F.col("n") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # SMALL ids at most
    pairs = lists.select(F.posexplode("ids").alias("k", "a"), "ids").select("a", F.explode(F.slice("ids", F.col("k") + 2, F.lit(SMALL))).alias("b")).filter("a < b").distinct()
    x, y = (groups.select(F.col("id").alias(k), F.col("label").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    apart = F.coalesce(F.col("x") != F.col("y"), F.lit(True))
    return pairs.join(x, "a", "left").join(y, "b", "left").filter(apart).select("a", "b"), groups
