"""Queries on model tables, thresholds by policy, models and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import LABELLED_SQL, PACKETS_SQL, SCORES_SQL, TIMEOUT_S, labelled, packets, scores, table
from ..domains import CIC_FEATURES
from ..operators import flows, history, iforest, models, sampling, scan, thresholds
from ..sources.shared import scratch
from ..streaming import flows as streams
from .flows import _flow_sql

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


MANIFESTS_SQL = """
SELECT s_name AS name, CASE s_suppkey % 3 WHEN 0 THEN 'Random Forest' WHEN 1 THEN 'XGBoost' ELSE 'Isolation Forest' END AS algorithm,
    CASE s_suppkey % 4 WHEN 0 THEN 'NSL-KDD' WHEN 1 THEN 'UNSW-NB15' ELSE 'CIC-IDS' END AS dataset_type,
    CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE (s_suppkey % 100) / 100.0 END AS recommended_threshold,
    s_suppkey % 2 = 0 AS has_hard_cases, s_suppkey % 6 <> 0 AS trained_on_pcap_metrics, CAST(s_suppkey AS VARCHAR) AS saved_at,
    CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE (s_suppkey % 10) / 10.0 END AS f1, (s_suppkey % 9) / 9.0 AS recall, (s_suppkey % 8) / 8.0 AS precision
FROM supplier
"""


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    return s.select(
        F.col("s_name").alias("name"),
        F.when(k % 3 == 0, "Random Forest").when(k % 3 == 1, "XGBoost").otherwise("Isolation Forest").alias("algorithm"),
        F.when(k % 4 == 0, "NSL-KDD").when(k % 4 == 1, "UNSW-NB15").otherwise("CIC-IDS").alias("dataset_type"),
        F.when(k % 5 != 0, k % 100 / 100.0).alias("recommended_threshold"),
        (k % 2 == 0).alias("has_hard_cases"),
        (k % 6 != 0).alias("trained_on_pcap_metrics"),
        k.cast("string").alias("saved_at"),
        F.when(k % 7 != 0, k % 10 / 10.0).alias("f1"),
        (k % 9 / 9.0).alias("recall"),
        (k % 8 / 8.0).alias("precision"),
        F.array(F.lit("csv"), F.lit("pcap")).alias("compatible_input_types"),
        F.when(k % 7 < 3, "holdout_rate_calibrated").otherwise("f1").alias("selection_policy"),
    )


def inputs(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES ('CIC-IDS', 'csv'), ('CIC-IDS', 'pcap'), ('NSL-KDD', 'csv'), ('UNSW-NB15', 'csv') AS t(dataset_type, input_type)")


INPUTS_SQL = "SELECT * FROM (VALUES ('CIC-IDS', 'csv'), ('CIC-IDS', 'pcap'), ('NSL-KDD', 'csv'), ('UNSW-NB15', 'csv')) t(dataset_type, input_type)"
CLAMP = "least(greatest({}, 0.01), 0.99)"


@query(
    "g9_legacy_thresholds",
    f"""SELECT name, m.dataset_type, input_type, round(CASE
        WHEN input_type = 'pcap' AND algorithm = 'Random Forest' THEN greatest(t, 0.2)
        WHEN input_type = 'pcap' AND algorithm = 'XGBoost' AND has_hard_cases THEN greatest(t, 0.2) WHEN input_type = 'pcap' AND algorithm = 'XGBoost' THEN 0.05
        WHEN input_type = 'csv' AND m.dataset_type = 'CIC-IDS' AND algorithm = 'Random Forest' THEN greatest(t, 0.3)
        WHEN input_type = 'csv' AND m.dataset_type = 'CIC-IDS' AND algorithm = 'XGBoost' THEN least(t, 0.02)
        WHEN m.dataset_type = 'NSL-KDD' THEN 0.3 ELSE t END, 6)::DOUBLE AS threshold
    FROM (SELECT *, {CLAMP.format("coalesce(recommended_threshold, 0.3)")} AS t FROM ({MANIFESTS_SQL})) m JOIN ({INPUTS_SQL}) i ON m.dataset_type = i.dataset_type""",
)
def legacy_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifests(spark, sf_dir)
    none = F.lit(None).cast("double")
    m = m.withColumns({"base_threshold": none, "pcap_threshold": none, "csv_threshold": none, "policy_id": F.lit(None).cast("string")})
    pairs = inputs(spark).join(m, "dataset_type")
    return thresholds.resolved(pairs).select("name", "dataset_type", "input_type", F.round("threshold", 6).alias("threshold"))


@query(
    "g8_threshold_provenance",
    f"""SELECT name, round(b, 6)::DOUBLE AS base_threshold, round(CASE WHEN dataset_type = 'CIC-IDS' AND algorithm = 'Random Forest' THEN greatest(b, 0.2)
        WHEN dataset_type = 'CIC-IDS' AND algorithm = 'XGBoost' THEN CASE WHEN has_hard_cases THEN greatest(b, 0.2) ELSE 0.05 END END, 6)::DOUBLE AS pcap_threshold,
        round(CASE WHEN dataset_type = 'CIC-IDS' AND algorithm = 'Random Forest' THEN greatest(b, 0.3) WHEN dataset_type = 'CIC-IDS' AND algorithm = 'XGBoost' THEN CASE WHEN CAST(saved_at AS BIGINT) % 7 < 3 THEN b ELSE least(b, 0.02) END
        WHEN dataset_type = 'NSL-KDD' THEN 0.3 WHEN dataset_type = 'UNSW-NB15' THEN b END, 6)::DOUBLE AS csv_threshold
    FROM (SELECT *, {CLAMP.format("recommended_threshold")} AS b FROM ({MANIFESTS_SQL}) WHERE recommended_threshold IS NOT NULL)""",
)
def threshold_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifests(spark, sf_dir).filter("recommended_threshold is not null")
    return thresholds.provenance(m).select("name", *(F.round(c, 6).alias(c) for c in ("base_threshold", "pcap_threshold", "csv_threshold")))


FITS_SQL = f"SELECT i.dataset_type, i.input_type, m.name, row_number() OVER (PARTITION BY i.dataset_type, i.input_type ORDER BY coalesce(f1, -1) DESC, recall DESC, precision DESC, saved_at DESC, name DESC) AS model_rank FROM ({INPUTS_SQL}) i JOIN ({MANIFESTS_SQL}) m ON i.dataset_type = m.dataset_type AND (algorithm <> 'Isolation Forest' OR input_type <> 'pcap' OR trained_on_pcap_metrics)"


@query("h13_h14_model_ranking", FITS_SQL)
def model_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = history.compatible(manifests(spark, sf_dir), inputs(spark)).withColumn("_in", F.concat_ws("|", "dataset_type", "input_type"))
    return history.ranked(pairs, "_in").select("dataset_type", "input_type", "name", "model_rank")


@query("h12_model_table", f"SELECT name, algorithm, f1 FROM ({MANIFESTS_SQL}) WHERE dataset_type = 'CIC-IDS' ORDER BY f1 DESC NULLS LAST, name LIMIT 50")
def model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests(spark, sf_dir).filter("dataset_type = 'CIC-IDS'").orderBy(F.desc_nulls_last("f1"), "name").limit(50).select("name", "algorithm", "f1")


@query("l12_best_candidate", f"SELECT name FROM ({MANIFESTS_SQL}) ORDER BY f1 DESC NULLS LAST, recall DESC NULLS LAST, precision DESC NULLS LAST, name LIMIT 1")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.best_candidate(manifests(spark, sf_dir).withColumn("accuracy", F.lit(0.0))).select("name")


@query("l14_readiness", f"WITH l AS ({LABELLED_SQL}) SELECT coalesce(CAST(supplier AS VARCHAR), 'all') AS supplier, count(*) AS rows, count(*) FILTER (WHERE label = 'BENIGN') AS benign, count(*) FILTER (WHERE label <> 'BENIGN') AS attack, 0::BIGINT AS unknown, count(*) FILTER (WHERE label = 'BENIGN') >= 20 AS ready FROM l GROUP BY ROLLUP (l.supplier)")
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.readiness(labelled(spark, sf_dir), "supplier", "label").withColumn("supplier", F.coalesce(F.col("supplier").cast("string"), F.lit("all")))


@query("l5_class_weights", f"WITH l AS ({LABELLED_SQL}), n AS (SELECT label, count(*) AS n FROM l GROUP BY label) SELECT label, n AS rows, round(sum(n) OVER () / (count(*) OVER () * n), 6)::DOUBLE AS weight FROM n")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.weighted(labelled(spark, sf_dir), "label").groupBy("label").agg(F.count("*").alias("rows"), F.round(F.max("weight"), 6).alias("weight"))


@query("m2_allocations", "WITH s AS (SELECT l_suppkey AS supplier, count(*) AS size FROM lineitem GROUP BY 1), e AS (SELECT *, 1000 * size / sum(size) OVER () AS x FROM s), f AS (SELECT *, 1000 - sum(floor(x)) OVER () AS spare, row_number() OVER (ORDER BY x - floor(x) DESC, size DESC, supplier) AS turn FROM e) SELECT supplier, size, CAST(floor(x) + CASE WHEN turn <= spare THEN 1 ELSE 0 END AS BIGINT) AS take FROM f")
def allocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("supplier")).agg(F.count("*").alias("size"))
    return sampling.allocations(sizes, "supplier", 1000)


@query("m14_frequent_classes", f"WITH l AS ({LABELLED_SQL}) SELECT supplier, count(*) AS rows FROM l GROUP BY supplier HAVING count(*) >= 550")
def frequent_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.frequent_classes(labelled(spark, sf_dir).select("supplier"), "supplier", 550).groupBy("supplier").agg(F.count("*").alias("rows"))


@query("x1_supervised_labels", f"WITH s AS ({SCORES_SQL}) SELECT row_id, round(score, 6) AS attack_prob, CASE WHEN score >= 0.3 THEN CASE WHEN label = 1 THEN 'DoS' ELSE 'Scan' END ELSE 'Normal' END AS prediction FROM s")
def supervised_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    big, small = F.col("score") * 0.7, F.col("score") * 0.3
    one = F.col("label") == 1
    p = F.array(1 - F.col("score"), F.when(one, big).otherwise(small), F.when(one, small).otherwise(big))
    out = scan.supervised_labels(scores(spark, sf_dir).withColumn("p", p), "p", ["Normal", "DoS", "Scan"], 0, 0.2995)
    return out.select("row_id", F.round("attack_prob", 6).alias("attack_prob"), "prediction")


@query("l3_l4_isolation_forest")
def isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors shifted for one label in ten; their decisions are the lowest."""
    e = table(spark, sf_dir, "embeddings")
    x = [(F.get("embedding", F.lit(k)).cast("double") + F.when(F.col("label") == 0, 3.0).otherwise(0.0)).alias(f"f{k}") for k in range(64)]
    d = e.select("vec_id", "label", *x)
    model = iforest.fit(d.filter("label <> 0"), [f"f{k}" for k in range(64)], ["vec_id"])
    return model.transform(d).select("vec_id", "label", F.round("decision", 6).alias("decision"))


@query("l1_l10_random_forest")
def random_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest on the labelled rows, its attack probability for each row, and the threshold that it picked."""
    l = labelled(spark, sf_dir)
    t = models.train(l, "label", ["quantity", "extendedprice", "discount", "tax"], ["linestatus", "orderstatus"], ["row_id"], "Random Forest", numTrees=10, maxDepth=5)
    return t.score(l).select("row_id", F.round("attack_prob", 6).alias("attack_prob"), (F.col("attack_prob") >= t.threshold).alias("is_alert"))


#: What is read of each labelled row by the boosted detectors.
NUMERIC, CATEGORICAL = ["quantity", "extendedprice", "discount", "tax"], ["linestatus", "orderstatus"]


@query("l2_boosted_trees")
def boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees on the labelled rows, with rows and columns sampled for each of six trees, and classes and probabilities."""
    l = labelled(spark, sf_dir)
    t = models.train(l, "label", NUMERIC, CATEGORICAL, ["row_id"], "XGBoost", rounds=6, depth=4, rate=0.3)
    return t.score(l).select("row_id", F.round("attack_prob", 6).alias("attack_prob"), "prediction", (F.col("attack_prob") >= t.threshold).alias("is_alert"))


@query("l6_grid_search")
def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees whose depth is chosen by F1 in three stratified folds; what was chosen, beside each row's score."""
    l = labelled(spark, sf_dir)
    t = models.train(l, "label", NUMERIC, CATEGORICAL, ["row_id"], "XGBoost", grid={"depth": [1, 4]}, rounds=2, rate=0.3)
    return t.score(l).select("row_id", F.round("attack_prob", 6).alias("attack_prob"), F.lit(t.params["depth"]).alias("depth"))


@query("l6_folds", f"WITH l AS ({LABELLED_SQL}), n AS (SELECT row_id, label, (row_number() OVER (PARTITION BY label ORDER BY md5('42:' || row_id), row_id) - 1) % 3 AS fold FROM l) SELECT label, CAST(fold AS INTEGER) AS fold, count(*) AS rows FROM n GROUP BY label, fold")
def fold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each class in each of three folds."""
    d, _ = models.folds(labelled(spark, sf_dir).select("row_id", "label"), "label", ["row_id"])
    return d.groupBy("label", "fold").agg(F.count("*").alias("rows"))


def packet_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of projected packets."""
    kind = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(sf_dir)

    class Stream:  # the adapter reads its table from here
        class read:
            parquet = staticmethod(lambda path: events)

    return flows.projected(packets(Stream, sf_dir))


@query("t4_alerts_per_window", f"WITH p AS ({PACKETS_SQL}), w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS \"at\", count(*) AS alerts FROM p GROUP BY 1) SELECT \"at\", alerts FROM w WHERE \"at\" + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM p)")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.alerts_per_window(packet_stream(spark, sf_dir), "1 hour", delay="10 minutes")
    return streams.drained(out, scratch(spark)).withColumn("at", F.col("at").cast("timestamp_ntz"))


#: Flows of the batch whose idle gap has passed at the end of the stream, by the SQL of the batch's flows.
CLOSED_SQL = f"""FROM ({_flow_sql().replace("SELECT CAST(flow_seq AS BIGINT) AS flow_seq,", "SELECT key, last,").replace("any_value(protocol) AS proto,", "any_value(protocol) AS proto, max(ts) AS last,").replace("EXCLUDE (key, flow_seq,", "EXCLUDE (key, last, flow_seq,")}) f
    WHERE last + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"""


def rounded(flows_: DataFrame) -> DataFrame:
    """Features with the digits that the batch's query compares."""
    kinds = dict(flows_.dtypes)
    drop = ("capture_id", "conversation", "started_at", "target_label")
    return flows_.select(*(F.round(c, 1 if "iat" in c or c == "flow_duration" else 4).alias(c) if kinds[c] == "double" else F.col(c) for c in flows_.columns if c not in drop))


@query("t1_stream_flows", f"SELECT * EXCLUDE (key, last) EXCLUDE_IAT {CLOSED_SQL}".replace("EXCLUDE (key, last) EXCLUDE_IAT", "EXCLUDE (key, last, " + ", ".join(c for c in CIC_FEATURES if "iat" in c) + ")"))
def stream_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features that need no order of packets, of constant state in the engine."""
    return rounded(streams.drained(streams.closed_flows(packet_stream(spark, sf_dir), "6 hours", "10 minutes"), scratch(spark)))


@query("t2_exact_stream_flows", f"SELECT * EXCLUDE (key, last) {CLOSED_SQL}")
def exact_stream_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of the batch's flows."""
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = streams.drained(streams.exact_flows(packet_stream(spark, sf_dir), TIMEOUT_S, "10 minutes"), scratch(spark))
    finally:
        spark.conf.set(key, old)
    return rounded(out)


@query("t4_sliding_alert_rate", f"""WITH p AS ({PACKETS_SQL}), w AS (SELECT time_bucket(INTERVAL 1 MINUTE, ts) - INTERVAL 1 MINUTE * k AS "at", src_ip, pkt_len FROM p, range(5) r(k))
    SELECT "at", src_ip, count(*) AS packets, count(*) FILTER (WHERE pkt_len >= 100) AS alerts, round(count(*) FILTER (WHERE pkt_len >= 100) / count(*), 6) AS rate
    FROM w WHERE "at" + INTERVAL 5 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM p) GROUP BY "at", src_ip""")
def sliding_alert_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.alert_rates(packet_stream(spark, sf_dir), F.col("pkt_len") >= 100, delay="10 minutes")
    return streams.drained(out, scratch(spark)).withColumn("at", F.col("at").cast("timestamp_ntz")).withColumn("rate", F.round("rate", 6))


#: Packets of the batch's flows whose idle gap has passed at the end of the stream.
FLOW_PARTS_SQL = f"WITH f AS (SELECT key AS conversation, last, total_fwd_packets AS fwd, total_backward_packets AS bwd {CLOSED_SQL})"


@query("t3_stream_scan", FLOW_PARTS_SQL + " SELECT conversation, fwd + bwd AS packets, (fwd + bwd) / 10.0 >= 0.3 AS is_alert FROM f")
def stream_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows_ = streams.closed_flows(packet_stream(spark, sf_dir), "6 hours", "10 minutes")
    n = F.col("total_fwd_packets") + F.col("total_backward_packets")
    out = streams.drained(streams.labelled_flows(flows_, n / 10.0, 0.3), scratch(spark))
    return out.select("conversation", n.alias("packets"), "is_alert")


@query("t5_session_append", "SELECT 'TCP' AS protocol, count(*) AS packets FROM events WHERE user_id % 3 = 0 UNION ALL SELECT 'UDP', count(*) FROM events WHERE user_id % 3 = 1 UNION ALL SELECT 'ICMP', count(*) FROM events WHERE user_id % 3 = 2")
def session_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each batch of a stream is appended to a history as counts; the batch's number makes a repeated batch replace itself."""
    folder = scratch(spark)
    name = F.when(F.col("protocol") == 6, "TCP").when(F.col("protocol") == 17, "UDP").otherwise("ICMP")
    stream = packet_stream(spark, sf_dir).select(name.alias("protocol"))
    save = lambda batch, number: history.appended(batch.groupBy("protocol").agg(F.count("*").alias("packets")), f"{folder}/sessions", str(number))
    streams.each_batch(stream, save, folder).awaitTermination()
    return spark.read.parquet(f"{folder}/sessions").groupBy("protocol").agg(F.sum("packets").alias("packets"))


@query("m6_blend", f"WITH l AS ({LABELLED_SQL}), b AS (SELECT row_id, label FROM l WHERE label = 'BENIGN'), r AS (SELECT row_id, label FROM l WHERE label <> 'BENIGN' ORDER BY md5('42:' || row_id), row_id LIMIT (SELECT CAST(floor(count(*) * 0.1) AS BIGINT) FROM b)) SELECT * FROM b UNION ALL SELECT * FROM r")
def blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = labelled(spark, sf_dir).select("row_id", "label")
    return sampling.blended(l.filter("label = 'BENIGN'"), l.filter("label <> 'BENIGN'"), 0.1, ["row_id"])
