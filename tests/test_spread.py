"""Rows of a class are never dealt out by their class alone, so a class of any size is spread over tasks."""

import re

import pytest
from pyspark.sql import functions as F

from netweir.operators import iforest, models, sampling


@pytest.fixture()
def rows(spark):
    """Four partitions of rows of two classes and some without one."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(old, ("false", "-1")):
        spark.conf.set(k, v)
    yield spark.range(0, 400, 1, 4).select("id", F.when(F.col("id") % 10 == 0, "b").when(F.col("id") % 50 == 7, None).otherwise("a").alias("label"))
    for k, v in old.items():
        spark.conf.set(k, v)


def gathered(df) -> list[str]:
    """What lies below the exchanges by the class alone, aggregates of the rows aside."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return [y for x, y in zip(lines, lines[1:]) if re.search(r"Exchange hashpartitioning\((label|_class)#\d+L?, \d+\)", x) and "Aggregate" not in y]


@pytest.mark.parametrize("of", [lambda d: sampling.sample_by(d, "label", 40, ["id"]), lambda d: sampling.frequent_classes(d, "label"), lambda d: models.weighted(d, "label")])
def test_classes_are_not_gathered(rows, of):
    assert not gathered(of(rows))


def test_a_sample_by_class_has_each_class_in_proportion_and_in_order(rows):
    got = {r["id"]: r["label"] for r in sampling.sample_by(rows, "label", 40, ["id"]).collect()}
    sizes = {r["label"]: r["take"] for r in sampling.allocations(rows.groupBy("label").agg(F.count("*").alias("size")), "label", 40, 1).collect()}
    order = [(r["id"], r["label"]) for r in rows.orderBy(F.md5(F.concat(F.lit("42:"), F.col("id").cast("string")).cast("binary"))).collect()]
    want = {i: c for c in "ab" for i, x in [(i, x) for i, x in order if x == c][: sizes[c]]}
    assert got == want


def test_more_rows_are_numbered_in_more_tasks(rows, monkeypatch):
    monkeypatch.setattr(sampling, "ROWS", 20, raising=False)
    n = sampling.numbered_by(rows, ["label"], ["id"], 42, "at")
    sizes = n.rdd.glom().map(len).collect()
    assert len(sizes) == 20 and max(sizes) <= 50
    order = rows.orderBy(F.md5(F.concat(F.lit("42:"), F.col("id").cast("string")).cast("binary"))).collect()
    classes = [[r["id"] for r in order if r["label"] == c] for c in ("a", "b", None)]
    want = {i: (k, len(ids)) for ids in classes for k, i in enumerate(ids, 1)}
    assert {r["id"]: (r["at"], r["_size"]) for r in n.collect()} == want


def test_a_detector_reads_its_rows_once(spark):
    def counted(df):
        seen = spark.sparkContext.accumulator(0)

        @F.udf("double")
        def read(x):
            seen.add(1)
            return x

        return df.select("id", F.when(F.col("id") % 10 == 0, "DoS").otherwise("BENIGN").alias("label"), read(F.col("id") * 7919 % 1000 + 0.0).alias("a")), seen

    (d, rows), (more, extra) = counted(spark.range(0, 400, 1, 4)), counted(spark.range(400, 440, 1, 1))
    iforest.train(d, "label", ["a"], ["id"], references=more, trees=5, samples=16)
    assert (rows.value, extra.value) == (400, 40)


@pytest.mark.parametrize("samples", [16, 256])
def test_each_tree_has_its_rows(spark, samples):
    d = spark.range(0, 400, 1, 4).select("id", F.col("id").cast("double").alias("a"))
    d = d.unionByName(d.limit(3))
    nodes = iforest.fit(d, ["a"], ["id"], trees=5, samples=samples).nodes
    assert [int(n["size"]) for n in nodes if n["node"] == 0] == [samples] * 5
