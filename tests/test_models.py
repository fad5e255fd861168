"""Boosted trees, tuning, bundles, numbers of rows, CSV folders, and a history that survives a crash."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from netweir.operators import labels, models, sampling, store, thresholds
from netweir.operators.boosting import Boosting
from netweir.sources import tables


@pytest.fixture(scope="module")
def rows(spark):
    """Attacks have a greater a on the whole; one in eleven rows is of the other class."""
    rng = random.Random(4)
    data = []
    for k in range(600):
        attack = k % 3 == 0
        data.append((k, (2.0 if attack else 0.0) + rng.gauss(0, 0.7), rng.gauss(0, 1), rng.choice("xy"), "DoS" if attack != (k % 11 == 0) else "BENIGN"))
    return spark.createDataFrame(data, "id long, a double, b double, c string, label string").repartition(2).cache()


def assembled(rows):
    from pyspark.ml.feature import VectorAssembler

    d = rows.withColumn("target", (F.col("label") != "BENIGN").cast("int")).withColumn("weight", F.when(F.col("target") == 1, 2.0).otherwise(1.0))
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(d).select("id", "features", "target", "weight")


def test_a_boosting_step_is_a_newton_step(spark, rows):
    x = assembled(rows)
    m = Boosting(rounds=1, depth=1, rate=0.5, subsample=1.0, colsample=1.0).fit(x, ["id"])
    d = m.transform(x).select("target", "weight", vector_to_array("probability")[1].alias("p")).collect()
    leaves = {}
    for r in d:
        leaves.setdefault(round(r["p"], 9), []).append((r["target"], r["weight"]))
    assert len(leaves) == 2
    for p, of in leaves.items():
        g, h = sum(w * (0.5 - y) for y, w in of), sum(w * 0.25 for _, w in of)
        assert np.log(p / (1 - p)) == pytest.approx(-0.5 * g / h, abs=1e-6)


def test_trees_use_the_rows_and_columns_drawn_for_them(spark, rows):
    b = Boosting(rounds=3, depth=2, rate=0.3, subsample=0.5, colsample=0.5)
    m = b.fit(assembled(rows), ["id"])
    used = [{line.split("feature ")[1].split(" ")[0] for line in t.toDebugString.split("\n") if "feature" in line} for t in m.trees]
    assert all(u <= {str(c) for c in b.columns(k, 2)} for k, u in enumerate(used)) and all(len(b.columns(k, 2)) == 1 for k in range(3))
    again = b.fit(assembled(rows), ["id"])
    p = lambda m: sorted((r["id"], r["probability"][1]) for r in m.transform(assembled(rows)).collect())
    assert p(m) == p(again)


def test_folds_are_alike_in_every_class(spark, rows):
    d, k = models.folds(rows, "label", ["id"])
    sizes = {}
    for r in d.groupBy("label", "fold").count().collect():
        sizes.setdefault(r["label"], []).append(r["count"])
    assert k == 3 and all(len(s) == 3 and max(s) - min(s) <= 1 for s in sizes.values())
    few = rows.filter("label = 'BENIGN'").unionByName(rows.filter("label = 'DoS'").limit(2))
    assert models.folds(few, "label", ["id"])[1] == 2


def test_the_grid_takes_the_best_parameters(spark, rows):
    class Constant:
        def __init__(self, right):
            self.right = right

        def transform(self, df):
            return df.withColumn("prediction", F.col("target") if self.right else F.lit(0))

    x = rows.withColumn("target", (F.col("label") != "BENIGN").cast("int"))
    best, f1, k = models.grid_search(x, lambda part, right, other: Constant(right), {"right": [False, True], "other": [1, 2]}, ["id"])
    assert (best, f1, k) == ({"right": True, "other": 1}, 1.0, 3)


def test_no_vectors_are_kept(spark, rows, monkeypatch):
    """A cached batch of vectors is one large array, which fills heap that Spark does not count."""
    kept, persist = [], type(rows).persist
    monkeypatch.setattr(type(rows), "persist", lambda d, *level: kept.append(d.schema) or persist(d, *level))
    models.train(rows, "label", ["a", "b"], ["c"], ["id"], "XGBoost", grid={"depth": [1, 2]}, rounds=2, rate=0.3)
    assert len(kept) > 3 and not [f for s in kept for f in s if f.dataType.typeName() == "vectorudt"]


@pytest.mark.parametrize("algorithm, given", [("Random Forest", {"numTrees": 8, "maxDepth": 6}), ("XGBoost", {"rounds": 4, "depth": 3, "rate": 0.3})])
def test_life_cycle_of_a_supervised_model(spark, rows, tmp_path, algorithm, given):
    t = models.train(rows, "label", ["a", "b"], ["c"], ["id"], algorithm, test=0.25, **given)
    assert t.metrics["fpr"] <= 0.01 and t.metrics["precision"] > 0.8
    folder = f"{tmp_path}/models"
    t.save(spark, folder, "first", "NSL-KDD")
    t.save(spark, folder, "second", "NSL-KDD", notes={"rows": 600})
    assert [r["name"] for r in models.listed(spark, folder).collect()] == ["second", "first"]
    again = models.Trained.load(spark, folder, "first")
    score = lambda m: sorted(tuple(r) for r in m.score(rows).select("id", "attack_prob", "prediction", F.element_at("probabilities", 2)).collect())
    got = score(t)
    assert score(again) == got and again.threshold == t.threshold and again.params == given
    assert all(p == pytest.approx(q) and (name == "Attack") == (q > 0.5) for _, p, name, q in got if abs(q - 0.5) > 1e-9)
    manifest = models.listed(spark, folder).first()["manifest"]
    assert f'"policy_id": "{thresholds.POLICY}"' in manifest
    # a bundle without a manifest, or of another version, is not there
    t.model.write().save(f"{folder}/half/model")
    spark.createDataFrame([('{"name": "old", "algorithm": "XGBoost", "dataset_type": "NSL-KDD", "manifest_version": 1, "saved_at": "9"}',)], "value string").write.text(f"{folder}/manifests/old")
    assert models.listed(spark, folder).count() == 2
    with pytest.raises(ValueError, match="no model"):
        models.Trained.load(spark, folder, "old")
    # columns of the scored table stay as they are
    clash = rows.withColumnsRenamed({"id": "features"}).withColumn("prediction", F.lit(5)).drop("prediction")
    assert t.score(clash).select("features", "a").collect() == clash.select("features", "a").collect()


def test_rows_are_numbered_without_one_task(spark):
    rng = random.Random(2)
    data = [(k, rng.choice([1, 2, None]) if k % 3 else 1, "x") for k in range(500)]
    df = spark.createDataFrame(data, "id long, v int, row_number string").repartition(5)
    got = labels.numbered(df, F.desc("v"), F.col("id"))
    assert got.columns == ["id", "v", "row_number", "_row_number"] and "SinglePartition" not in got._jdf.queryExecution().toString()
    want = sorted(data, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [r["id"] for r in got.orderBy("_row_number").collect()] == [r[0] for r in want]
    assert sorted(r["_row_number"] for r in labels.numbered(df.select("row_number"), F.col("row_number")).collect()) == list(range(1, 501))
    assert labels.numbered(df.limit(0), F.col("id")).count() == 0


def test_the_first_rows_by_hash_are_cut_exactly(spark, monkeypatch):
    data = [(f"k{k}",) for k in range(300)] + [("same",)] * 40
    df = spark.createDataFrame(data, "key string")
    order = sorted((hashlib.md5(f"42:{k}".encode()).hexdigest(), k) for (k,) in data)
    at = [i for i, (_, k) in enumerate(order) if k == "same"][0]
    for digits in (1, 4):
        monkeypatch.setattr(sampling, "DIGITS", digits)
        for n in (0, 1, 57, at + 7, 339, 340, 1000):
            out = sampling.uniform(df, n, ["key"])
            assert sorted(r["key"] for r in out.collect()) == sorted(k for _, k in order[:n])
    plan = sampling.uniform(df, 57, ["key"])._jdf.queryExecution().toString()
    assert "TakeOrdered" not in plan and "Exchange" not in plan


def test_files_of_a_folder_keep_their_own_headers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in {"a": "x,y\n1,2\n", "b": "y,x\n2,1\n", "c c": '"x",z,x\n1,"3,4",5\n', "d": "x,y\n7,8\nx,y\n9,10,11\n", "e": ""}.items():
        (tmp_path / "in" / f"{name}.csv").write_text(text)
    df = tables.raw_csv(spark, f"{tmp_path}/in")
    assert sorted(df.columns) == ["x", "x__0", "x__1", "y", "z"]
    assert sorted((tuple(r) for r in df.select("x", "y", "z", "x__0", "x__1").collect()), key=str) == sorted([("1", "2", None, None, None)] * 2 + [("7", "8", None, None, None), (None, None, "3,4", "1", "5")], key=str)
    got = {r["file"].rsplit("/", 1)[1]: (r["input_type"], r["dataset_type"], r["length"]) for r in tables.inspected(spark, [f"{tmp_path}/in"]).collect()}
    assert got["a.csv"] == ("csv", "Unknown", 8) and len(got) == 4  # empty files are passed over
    (tmp_path / "f.txt").write_text("x")
    with pytest.raises(ValueError, match="f.txt"):
        tables.inspected(spark, [f"{tmp_path}/in", f"{tmp_path}/f.txt"])
    with pytest.raises(ValueError, match="not of domain"):
        tables.training_tables(spark, [f"{tmp_path}/in/a.csv"], "CIC-IDS")


def test_a_crash_leaves_the_old_history_or_the_new_one(spark, tmp_path, monkeypatch):
    kind = "id long, found int"
    part = lambda *ids: spark.createDataFrame([(i, 1) for i in ids], kind)
    h = store.Store(spark, f"{tmp_path}/h")
    seen = lambda: [sorted(r["id"] for r in h.read(t, kind).collect()) for t in ("sessions", "anomalies")]
    assert seen() == [[], []] and h.clear() == 0
    h.append("one", sessions=part(1, 2), anomalies=part(1))
    h.append("one", sessions=part(1, 2), anomalies=part(1))
    assert seen() == [[1, 2], [1]]

    class Broken(Exception):
        pass

    def failing(step):
        """Fail at the n-th write."""
        from pyspark.sql.readwriter import DataFrameWriter

        count = iter(range(100))
        for name in ("parquet", "text"):
            real = getattr(DataFrameWriter, name)

            def write(self, path, *a, real=real, **b):
                if next(count) == step:
                    raise Broken
                return real(self, path, *a, **b)

            monkeypatch.setattr(DataFrameWriter, name, write)

    for step in range(3):
        failing(step)
        with pytest.raises(Broken):
            h.append("two", sessions=part(3), anomalies=part(3))
        monkeypatch.undo()
        assert seen() == [[1, 2], [1]]
    failing(0)
    with pytest.raises(Broken):
        h.clear()
    monkeypatch.undo()
    assert seen() == [[1, 2], [1]]
    h.append("two", sessions=part(3), anomalies=part(3))
    assert seen() == [[1, 2, 3], [1, 3]]
    h.retain("sessions", h.read("sessions").filter("id > 1"))
    assert seen() == [[2, 3], [1, 3]] and h.clear() == 2 and seen() == [[], []]


def test_reports_and_benchmarks_are_written_and_read_again(spark, tmp_path):
    summary = spark.createDataFrame([(10, 4, 40.0, "high")], "total long, anomalies long, risk_score double, risk_level string")
    top = spark.createDataFrame([({"DoS": 3, "Scan": 1},)], "top map<string,long>")
    notes = spark.createDataFrame([(0.3, "csv")], "threshold double, kind string")
    tables.write_report(tables.scan_report(summary, top, notes), f"{tmp_path}/report")
    back = spark.read.json(f"{tmp_path}/report").first()
    assert (back["summary"]["anomalies"], back["top_anomalies"]["DoS"], back["diagnostics"]["kind"]) == (4, 3, "csv")
    assert "diagnostics" not in tables.scan_report(summary, top).columns
    scans = spark.createDataFrame([("a.csv", 0.1), ("b, c.csv", None)], "file string, error double")
    tables.write_benchmark(scans, scans.limit(1), summary, f"{tmp_path}/bench")
    read = lambda name: spark.read.option("header", True).csv(f"{tmp_path}/bench/{name}")
    assert sorted(r["file"] for r in read("scans").collect()) == ["a.csv", "b, c.csv"] and read("training").count() == 1
    assert spark.read.json(f"{tmp_path}/bench/summary").first()["risk_level"] == "high"
    tables.write_alerts(scans.withColumn("_helper", F.lit(1)), f"{tmp_path}/alerts")
    text = "".join(r["value"] for r in spark.read.text(f"{tmp_path}/alerts").collect())
    assert "_helper" not in text and "a.csv" in text
