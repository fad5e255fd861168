"""Queries on labels, reports, history, sampling, features, thresholds and scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import LABELLED_SQL, SCORES_SQL, TIMEOUT_S, labelled, packets, scores, table
from ..functions.expressions import is_benign
from ..operators import features, flows, history, labels, report, sampling, scan, thresholds, threats
from ..sources import tables as sources
from ..sources.shared import scratch
from .flows import SEQUENCED_SQL

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    """Register a query with the SQL of its expected rows."""

    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


#: A label of every row that has blanks and cases to clean: language and source of a document, some of them empty spellings.
DIRTY_SQL = """
SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN ' Benign ' WHEN 1 THEN 'NORMAL.' WHEN 2 THEN '0' WHEN 3 THEN ' unknown' WHEN 4 THEN '' WHEN 5 THEN upper(lang) || '..' ELSE '  ' || source || ' ' END AS label,
    source, lang, CAST(doc_id % 3 AS VARCHAR) AS flag
FROM documents
"""


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("doc_id") % 7
    text = F.when(m == 0, " Benign ").when(m == 1, "NORMAL.").when(m == 2, "0").when(m == 3, " unknown").when(m == 4, "").when(m == 5, F.concat(F.upper("lang"), F.lit(".."))).otherwise(F.concat(F.lit("  "), "source", F.lit(" ")))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("label"), "source", "lang", (F.col("doc_id") % 3).cast("string").alias("flag"))


BENIGN_SQL = "lower(trim({})) IN ('0', '0.0', 'benign', 'normal', 'normal.', 'benigntraffic')"
EMPTY_SQL = "lower(trim({})) IN ('', 'unknown', 'nan', 'none')"


@query(
    "b11_b16_labels",
    f"""SELECT doc_id, {BENIGN_SQL.format("label")} AS benign,
    CASE WHEN {BENIGN_SQL.format("label")} THEN 'BENIGN' ELSE trim(label) END AS cic,
    CASE WHEN {BENIGN_SQL.format("regexp_replace(trim(label), '[.]+$', '')")} THEN 'normal' ELSE regexp_replace(trim(label), '[.]+$', '') END AS nsl,
    CASE WHEN lower(trim(label)) IN ('', 'nan', 'none', 'normal') OR flag = '0' THEN 'Normal' ELSE trim(label) END AS unsw,
    CASE WHEN {BENIGN_SQL.format("label")} THEN 'Normal' ELSE 'Attack' END AS binary_label,
    CASE WHEN {EMPTY_SQL.format("label")} THEN 'Attack' ELSE label END AS coerced,
    CASE WHEN lower(trim(label)) IN ('', '-', 'nan', 'none', 'null', 'unknown', 'n/a', 'other') THEN 'unlabeled' ELSE trim(label) END AS service
    FROM ({DIRTY_SQL})""",
)
def label_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = labels.collapsed(dirty(spark, sf_dir), "label")
    c = F.col("label")
    return d.select("doc_id", is_benign(c).alias("benign"), labels.resolved("CIC-IDS", c).alias("cic"), labels.resolved("NSL-KDD", c).alias("nsl"), labels.resolved("UNSW-NB15", c, F.col("flag")).alias("unsw"), "binary_label", labels.coerced(c, True).alias("coerced"), labels.service_label(c).alias("service"))


@query("b17_mostly_labelled", f"SELECT doc_id, source FROM ({DIRTY_SQL}) d WHERE (SELECT avg(CASE WHEN {EMPTY_SQL.format('e.label')} THEN 1.0 ELSE 0 END) FROM ({DIRTY_SQL}) e WHERE e.source = d.source) < 0.285")
def mostly_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.mostly_labelled(dirty(spark, sf_dir), "source", "label", 0.285).select("doc_id", "source")


@query("b18_clean_text", f"SELECT doc_id, trim(regexp_replace(replace(replace(label || ' – fin' || lang, '–', ' - '), chr(7), ''), ' {{2,}}', ' ', 'g')) AS label FROM ({DIRTY_SQL})")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dash, a ligature and a control character are added to each label."""
    d = dirty(spark, sf_dir).withColumn("label", F.concat("label", F.lit(" – ﬁn\u0007"), "lang"))
    return labels.cleaned(d, "label").select("doc_id", "label")


@query("b20_informative", f"SELECT c AS \"column\", bool_or(lower(trim(v)) NOT IN ('', 'nan', 'n/a')) AS informative FROM (SELECT unnest(['label', 'flag', 'blank']) AS c, unnest([label, flag, ' ']) AS v FROM ({DIRTY_SQL})) GROUP BY c")
def informative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.informative(dirty(spark, sf_dir).withColumn("blank", F.lit(" ")), ["label", "flag", "blank"])


HEADERS_SQL = """
SELECT source AS file, doc_id AS position, CASE doc_id % 6 WHEN 0 THEN ' Flow Duration' WHEN 1 THEN 'Tot Fwd Pkts' WHEN 2 THEN 'SYN Flag Cnt' WHEN 3 THEN 'Down/Up Ratio' WHEN 4 THEN 'attack_cat' ELSE 'proto' END AS name
FROM documents
"""


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("doc_id") % 6
    name = F.when(m == 0, " Flow Duration").when(m == 1, "Tot Fwd Pkts").when(m == 2, "SYN Flag Cnt").when(m == 3, "Down/Up Ratio").when(m == 4, "attack_cat").otherwise("proto")
    return table(spark, sf_dir, "documents").select(F.col("source").alias("file"), F.col("doc_id").alias("position"), name.alias("name"))


NAMES_SQL = f"""
SELECT file, position, CASE WHEN count(*) OVER (PARTITION BY file, n) > 1 THEN n || '__' || (row_number() OVER (PARTITION BY file, n ORDER BY position) - 1) ELSE n END AS name
FROM (SELECT file, position, CASE trim(name) WHEN 'Flow Duration' THEN 'flow_duration' WHEN 'Tot Fwd Pkts' THEN 'total_fwd_packets' WHEN 'SYN Flag Cnt' THEN 'syn_flag_count' WHEN 'Down/Up Ratio' THEN 'down_up_ratio' WHEN 'attack_cat' THEN 'label' ELSE 'proto' END AS n FROM ({HEADERS_SQL}))
"""


@query("b1_b2_header_names", NAMES_SQL)
def header_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.header_names(headers(spark, sf_dir))


@query(
    "b3_b4_detect_domain",
    f"""WITH n AS (SELECT DISTINCT file, regexp_replace(name, '__[0-9]+$', '') AS name FROM ({NAMES_SQL})),
    s AS (SELECT file, count(*) FILTER (WHERE name IN ('flow_duration', 'total_fwd_packets', 'flow_iat_mean', 'syn_flag_count', 'down_up_ratio')) / 5 AS c, count(*) FILTER (WHERE name IN ('proto', 'state', 'spkts', 'ct_srv_src')) / 5 AS u FROM n GROUP BY file)
    SELECT file, CASE WHEN greatest(c, u) < 0.6 THEN 'Unknown' WHEN c >= u THEN 'CIC-IDS' ELSE 'UNSW-NB15' END AS domain, CAST(greatest(c, u) AS DOUBLE) AS confidence FROM s""",
)
def detect_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = labels.header_names(headers(spark, sf_dir)).withColumn("name", F.regexp_replace("name", "__[0-9]+$", ""))
    return labels.detected(h).select("file", "domain", "confidence")


#: Alerts: flows with a label by rule, a severity and a confidence.
ALERTS_SQL = f"""
{SEQUENCED_SQL},
f AS (
    SELECT key, flow_seq, arg_min(ts, pkt_no) AS started_at, arg_min(src_ip, pkt_no) AS src_ip, arg_min(dst_port, pkt_no) AS destination_port, any_value(protocol) AS proto, count(*) AS n, sum(payload_len) AS bytes
    FROM q GROUP BY key, flow_seq
),
alerts AS (
    SELECT started_at, src_ip, destination_port, CASE proto WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'ICMP' END AS protocol,
        CASE WHEN n >= 4 THEN 'DDoS' WHEN proto = 1 THEN 'PortScan' WHEN destination_port = 22 THEN 'SSH-Patator' WHEN n >= 2 THEN 'DoS Hulk' ELSE 'BENIGN' END AS attack,
        least(bytes / 1000.0, 1.0) AS confidence
    FROM f
)
"""
SEVERITY_SQL = "CASE attack WHEN 'DDoS' THEN 'critical' WHEN 'PortScan' THEN 'medium' WHEN 'BENIGN' THEN 'safe' ELSE 'high' END"


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = flows.assemble(packets(spark, sf_dir), TIMEOUT_S)
    n = F.col("total_fwd_packets") + F.col("total_backward_packets")
    size = F.col("total_length_of_fwd_packets") + F.col("total_length_of_bwd_packets")
    attack = F.when(n >= 4, "DDoS").when(F.col("protocol") == "ICMP", "PortScan").when(F.col("destination_port") == 22, "SSH-Patator").when(n >= 2, "DoS Hulk").otherwise("BENIGN")
    return f.select("started_at", "src_ip", "destination_port", "protocol", attack.alias("attack"), F.least(size / 1000.0, F.lit(1.0)).alias("confidence"))


@query(
    "flagship_top_sources",
    f"""{ALERTS_SQL}, a AS (SELECT * FROM alerts WHERE attack <> 'BENIGN'), m AS (SELECT src_ip, attack, count(*) AS n FROM a GROUP BY ALL),
    d AS (SELECT src_ip, attack AS dominant_attack FROM m QUALIFY row_number() OVER (PARTITION BY src_ip ORDER BY n DESC, attack) = 1)
    SELECT src_ip, count(*) AS count, any_value(dominant_attack) AS dominant_attack FROM a JOIN d USING (src_ip) GROUP BY src_ip ORDER BY count DESC, src_ip LIMIT 20""",
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets to flows to alerts: the sources of most alerts and what they mostly do."""
    return report.top(alerts(spark, sf_dir).filter("attack <> 'BENIGN'"), "src_ip", 20, "attack")


@query("r1_r2_top_ports", f"{ALERTS_SQL}, m AS (SELECT destination_port, attack, count(*) AS n FROM alerts GROUP BY ALL) SELECT destination_port, sum(n)::BIGINT AS count, arg_min(attack, (-n, attack)) AS dominant_attack FROM m GROUP BY destination_port")
def top_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.top(alerts(spark, sf_dir), "destination_port", None, "attack")


@query("r3_top_share", f"{ALERTS_SQL} SELECT 'src_ip' AS \"column\", src_ip AS value, count(*) AS count, round(count(*) * 100 / (SELECT count(*) FROM alerts), 2) AS share FROM alerts GROUP BY src_ip ORDER BY count DESC, src_ip LIMIT 1")
def top_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.top_share(alerts(spark, sf_dir), "src_ip")


@query("r4_indicators", f"{ALERTS_SQL}, l AS (SELECT unnest(['src_ip', 'protocol', 'destination_port']) AS \"column\", unnest([src_ip, protocol, destination_port::VARCHAR]) AS value FROM alerts) SELECT \"column\", value, count(*) AS count FROM l GROUP BY \"column\", value QUALIFY row_number() OVER (PARTITION BY \"column\" ORDER BY count(*) DESC, value) <= 10")
def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.indicators(alerts(spark, sf_dir), ["src_ip", "protocol", "destination_port"])


@query("r5_r6_severities", f"{ALERTS_SQL} SELECT {SEVERITY_SQL} AS severity, count(*) AS count, round(count(*) * 100 / sum(count(*)) OVER (), 2) AS share, CASE {SEVERITY_SQL} WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 0 END AS rank FROM alerts GROUP BY severity")
def severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.severities(threats.enriched(alerts(spark, sf_dir), "attack"))


@query("r7_confidence_histogram", f"{ALERTS_SQL}, e AS (SELECT min(confidence) AS lo, max(confidence) AS hi FROM alerts) SELECT protocol, CAST(least(floor((confidence - lo) / ((hi - lo) / 25)), 24) AS INTEGER) AS bin, count(*) AS count FROM alerts, e GROUP BY ALL")
def confidence_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.histogram(alerts(spark, sf_dir), "confidence", "protocol")


@query("r8_timeline", f"{ALERTS_SQL} SELECT date_trunc('hour', started_at) AS at, count(*) AS alerts, count(*) = max(count(*)) OVER () AS is_peak FROM alerts WHERE attack <> 'BENIGN' GROUP BY 1")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.timeline(alerts(spark, sf_dir).filter("attack <> 'BENIGN'"), "started_at", "hour").withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("r9_details", f"{ALERTS_SQL} SELECT attack, src_ip, started_at, round(confidence, 6) AS confidence FROM alerts ORDER BY CASE {SEVERITY_SQL} WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 0 END DESC, alerts.confidence DESC, started_at, src_ip LIMIT 100")
def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = report.details(threats.enriched(alerts(spark, sf_dir), "attack"), "severity", "confidence", "started_at", "src_ip")
    return d.select("attack", "src_ip", F.col("started_at").cast("timestamp_ntz").alias("started_at"), F.round("confidence", 6).alias("confidence"))


@query("r11_generic_share", f"{ALERTS_SQL} SELECT round(avg(CASE WHEN attack = 'DoS Hulk' THEN 1.0 ELSE 0 END), 4) AS share, avg(CASE WHEN attack = 'DoS Hulk' THEN 1.0 ELSE 0 END) >= 0.5 AS notice FROM alerts")
def generic_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.generic_share(alerts(spark, sf_dir), F.col("attack") == "DoS Hulk")


@query("r17_r18_benchmark", f"""{ALERTS_SQL}, r AS (SELECT src_ip, avg(CASE WHEN attack <> 'BENIGN' THEN 1.0 ELSE 0 END) AS rate FROM alerts GROUP BY src_ip),
    v AS (SELECT CASE WHEN src_ip LIKE '%.3' THEN 'ERROR' WHEN src_ip NOT LIKE '10.%' THEN 'NO_TARGET' WHEN abs(rate - 0.6) > 0.08 THEN 'POOR' ELSE 'OK' END AS verdict,
        CASE WHEN src_ip LIKE '10.%' THEN 'client' ELSE 'server' END AS family, 'rules ' || right(src_ip, 1) AS algorithm FROM r)
    SELECT count(*) AS runs, count(*) FILTER (WHERE verdict = 'OK') AS ok, count(*) FILTER (WHERE verdict = 'POOR') AS poor, count(*) FILTER (WHERE verdict = 'NO_TARGET') AS no_target, count(*) FILTER (WHERE verdict = 'ERROR') AS error, string_agg(DISTINCT family, ',' ORDER BY family) AS families, count(DISTINCT algorithm) AS algorithms FROM v""")
def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = alerts(spark, sf_dir).groupBy("src_ip").agg(F.avg((F.col("attack") != "BENIGN").cast("double")).alias("rate"))
    client = F.col("src_ip").startswith("10.")
    r = report.rate_verdicts(r, F.col("rate"), F.when(client, F.lit(0.6)), F.col("src_ip").endswith(".3"))
    return report.benchmark_summary(r.withColumn("family", F.when(client, "client").otherwise("server")).withColumn("algorithm", F.concat(F.lit("rules "), F.right("src_ip", F.lit(1)))))


@query("x10_x14_threats", f"{ALERTS_SQL} SELECT attack, CASE attack WHEN 'DDoS' THEN 'Distributed denial of service' WHEN 'PortScan' THEN 'Port scan' WHEN 'SSH-Patator' THEN 'SSH brute force' WHEN 'DoS Hulk' THEN 'DoS Hulk' ELSE 'Normal' END AS threat, {SEVERITY_SQL} AS severity, attack <> 'BENIGN' AS is_threat, count(*) AS count FROM alerts GROUP BY attack")
def threat_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threats.enriched(alerts(spark, sf_dir), "attack").groupBy("attack", "threat", "severity", "is_threat").agg(F.count("*").alias("count"))


SESSIONS_SQL = "SELECT o_orderkey AS session_id, o_orderdate AS created_at, o_totalprice AS total, o_totalprice / 10000 AS risk, CAST(o_orderkey % 50 AS BIGINT) AS found, CASE WHEN o_orderkey % 11 = 0 THEN -1 ELSE o_custkey % 40 END AS model_id FROM orders"


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("total"), (F.col("o_totalprice") / 10000).alias("risk"), (F.col("o_orderkey") % 50).cast("long").alias("found"), F.when(F.col("o_orderkey") % 11 == 0, -1).otherwise(F.col("o_custkey") % 40).alias("model_id"))


@query("h3_h4_history", f"SELECT session_id, found, coalesce(s_name, 'Unknown') AS model_name FROM (SELECT * FROM ({SESSIONS_SQL}) ORDER BY created_at DESC, session_id DESC LIMIT 200) LEFT JOIN supplier ON model_id = s_suppkey")
def history_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return history.view(sessions(spark, sf_dir), s, F.col("model_id") == F.col("s_suppkey"), "s_name", "created_at", "session_id").select("session_id", "found", "model_name")


@query("h6_attack_distribution", f"{ALERTS_SQL} SELECT attack AS anomaly_type, count(*) AS count FROM alerts GROUP BY attack")
def attack_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.attack_distribution(alerts(spark, sf_dir).withColumnRenamed("attack", "anomaly_type"))


@query("h8_history_kpis", f"SELECT count(*) AS scans, sum(found)::BIGINT AS alerts, round(avg(risk), 4) AS mean_risk FROM ({SESSIONS_SQL})")
def history_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.history_kpis(sessions(spark, sf_dir), "found", "risk")


@query("h9_home_kpis", f"SELECT round(avg(risk), 4) AS mean_risk, round(avg(CASE WHEN total <> 0 THEN found / total ELSE 0 END), 6) AS mean_alert_rate, round(max(risk), 4) AS peak_risk FROM ({SESSIONS_SQL})")
def home_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.home_kpis(sessions(spark, sf_dir), "found", "total", "risk")


@query("h10_alerts_by_model", f"SELECT model_id, sum(found)::BIGINT AS alerts FROM ({SESSIONS_SQL}) GROUP BY model_id ORDER BY alerts DESC, model_id LIMIT 10")
def alerts_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.alerts_by_model(sessions(spark, sf_dir), "model_id", "found")


@query("h11_alert_severity", f"{ALERTS_SQL} SELECT attack, CASE WHEN confidence >= 0.9 THEN 3 WHEN confidence >= 0.7 THEN 2 ELSE 1 END AS score, count(*) AS count FROM alerts GROUP BY ALL")
def alert_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts(spark, sf_dir).groupBy("attack", history.severity_score(F.col("confidence")).alias("score")).agg(F.count("*").alias("count"))


ORDER_SQL = "md5('42:' || row_id), row_id"


@query(
    "m1_class_guard",
    f"""WITH l AS ({LABELLED_SQL}), s AS (SELECT label, count(*) AS size FROM l GROUP BY label),
    e AS (SELECT label, size, 2000 * size / sum(size) OVER () AS x FROM s), f AS (SELECT *, 2000 - sum(floor(x)) OVER () AS spare, row_number() OVER (ORDER BY x - floor(x) DESC, size DESC, label) AS turn FROM e),
    t AS (SELECT label, floor(x) + CASE WHEN turn <= spare THEN 1 ELSE 0 END AS take FROM f)
    SELECT row_id, label FROM l JOIN t USING (label) QUALIFY row_number() OVER (PARTITION BY label ORDER BY {ORDER_SQL}) <= max(take) OVER (PARTITION BY label)""",
)
def class_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_by(labelled(spark, sf_dir).select("row_id", "label"), "label", 2000, ["row_id"])


@query("m5_quota", f"WITH l AS ({LABELLED_SQL}) SELECT row_id, supplier, label FROM l QUALIFY row_number() OVER (PARTITION BY supplier, label ORDER BY {ORDER_SQL}) <= CASE label WHEN 'BENIGN' THEN 20 ELSE 10 END")
def quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.quota(labelled(spark, sf_dir).select("row_id", "supplier", "label"), ["supplier", "label"], F.when(F.col("label") == "BENIGN", 20).otherwise(10), ["row_id"])


@query("m13_split", f"WITH l AS ({LABELLED_SQL}) SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY {ORDER_SQL}) <= round(count(*) OVER (PARTITION BY label) * 0.2) AS is_test FROM l")
def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.split(labelled(spark, sf_dir).select("row_id", "label"), "label", 0.2, ["row_id"])


@query("m16_uniform", f"WITH l AS ({LABELLED_SQL}) SELECT row_id FROM l ORDER BY {ORDER_SQL} LIMIT 500")
def uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.uniform(labelled(spark, sf_dir).select("row_id"), 500, ["row_id"])


@query("m15_expected_rate", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN (doc_id % 100) / 100.0 WHEN 1 THEN 0.0 END AS rate FROM documents")
def expected_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("doc_id") % 3
    name = F.when(m == 0, F.concat(F.lit("Mix_"), (F.col("doc_id") % 100).cast("string"), F.lit("pct_anomaly.pcap"))).when(m == 1, "Benign_day.csv").otherwise("other.csv")
    return table(spark, sf_dir, "documents").select("doc_id", sampling.expected_rate(name).alias("rate"))


def _stat(c: str, clip: str) -> str:
    return f"SELECT '{c}' AS feature, round(median({c}), 6) AS median, round(quantile_cont({c}, 0.01), 6) AS low, round(quantile_cont({c}, 0.99), 6) AS high FROM l"


NUMERIC = ("quantity", "extendedprice", "discount", "tax")


@query("f1_f3_feature_fit", f"WITH l AS ({LABELLED_SQL}) " + " UNION ALL ".join(_stat(c, "") for c in NUMERIC))
def feature_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = features.fit(labelled(spark, sf_dir), list(NUMERIC), [])
    return spark.createDataFrame([(c, round(s.medians[c], 6), round(s.bounds[c][0], 6), round(s.bounds[c][1], 6)) for c in NUMERIC], "feature string, median double, low double, high double")


@query(
    "f4_f5_feature_transform",
    f"""WITH l AS ({LABELLED_SQL}), b AS (SELECT quantile_cont(extendedprice, 0.01) AS lo, quantile_cont(extendedprice, 0.99) AS hi FROM l),
    c AS (SELECT row_id, least(greatest(extendedprice, lo), hi) AS x, dense_rank() OVER (ORDER BY orderpriority) - 1.0 AS orderpriority FROM l, b),
    q AS (SELECT median(x) AS m, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS r FROM c)
    SELECT row_id, round((x - m) / r, 6) AS extendedprice, CAST(orderpriority AS DOUBLE) AS orderpriority FROM c, q""",
)
def feature_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = labelled(spark, sf_dir)
    s = features.fit(l, ["extendedprice"], ["orderpriority"])
    return features.transform(l, s, "robust").select("row_id", F.round("extendedprice", 6).alias("extendedprice"), "orderpriority")


CURVE_SQL = f"""
WITH s AS ({SCORES_SQL}), g AS (SELECT 0.01::DOUBLE + i * 0.01::DOUBLE AS threshold FROM range(99) r(i)),
c AS (SELECT threshold, count(*) FILTER (WHERE label = 1 AND score >= threshold) AS tp, count(*) FILTER (WHERE label = 0 AND score >= threshold) AS fp,
    count(*) FILTER (WHERE label = 0 AND score < threshold) AS tn, count(*) FILTER (WHERE label = 1 AND score < threshold) AS fn FROM g, s GROUP BY threshold),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r, CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END AS fpr FROM c)
"""


@query("g3_threshold_curve", f"{CURVE_SQL} SELECT round(threshold, 6) AS threshold, tp, fp, tn, fn, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, round(fpr, 6) AS fpr FROM m")
def threshold_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thresholds.curve(scores(spark, sf_dir)).select(F.round("threshold", 6).alias("threshold"), "tp", "fp", "tn", "fn", F.round("f1", 6).alias("f1"), F.round("fpr", 6).alias("fpr"))


@query("g3_threshold_pick", f"{CURVE_SQL}, f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM m) SELECT round(threshold, 6) AS threshold FROM f ORDER BY fpr <= 0.01 DESC, f1 DESC, CASE WHEN fpr <= 0.01 THEN -r ELSE 0 END, threshold LIMIT 1")
def threshold_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thresholds.pick(thresholds.curve(scores(spark, sf_dir))).select(F.round("threshold", 6).alias("threshold"))


@query("g1_evaluation", f"WITH s AS ({SCORES_SQL}), c AS (SELECT count(*) FILTER (WHERE label = 1 AND score >= 0.3) AS tp, count(*) FILTER (WHERE label = 0 AND score >= 0.3) AS fp, count(*) FILTER (WHERE label = 0 AND score < 0.3) AS tn, count(*) FILTER (WHERE label = 1 AND score < 0.3) AS fn FROM s) SELECT *, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c")
def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thresholds.evaluation(scores(spark, sf_dir).withColumn("predicted", (F.col("score") >= 0.3).cast("int")), "label", "predicted", 1)


@query("g2_confusion", f"WITH s AS ({SCORES_SQL}) SELECT label, CAST(score >= 0.3 AS INTEGER) AS predicted, count(*) AS count, round(count(*) / sum(count(*)) OVER (PARTITION BY label), 6) AS share FROM s GROUP BY label, predicted")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thresholds.confusion(scores(spark, sf_dir).withColumn("predicted", (F.col("score") >= 0.3).cast("int")), "label", "predicted")


@query("g4_anomaly_threshold", f"""WITH s AS ({SCORES_SQL}), q AS (SELECT DISTINCT unnest(quantile_cont(score, [k / 99 for k in range(0, 100)])) AS threshold FROM s),
    a AS (SELECT sum(label) AS p, sum(1 - label) AS n FROM s), c AS (SELECT threshold, count(*) FILTER (WHERE label = 1 AND score < threshold) AS tp, count(*) FILTER (WHERE label = 0 AND score < threshold) AS fp FROM q, s GROUP BY threshold),
    m AS (SELECT threshold, tp / p AS recall, CASE WHEN tp > 0 THEN 2 * tp / (tp + fp + p) ELSE 0 END AS f1, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, fp / n AS fpr FROM c, a)
    SELECT round(threshold, 6) AS threshold, round(recall, 6) AS recall, round(fpr, 6) AS fpr FROM m WHERE m.fpr <= 0.05 ORDER BY m.recall DESC, f1 DESC, precision DESC, m.fpr, m.threshold DESC LIMIT 1""")
def anomaly_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thresholds.anomaly_threshold(scores(spark, sf_dir), 0.05, 100).select(F.round("threshold", 6).alias("threshold"), F.round("recall", 6).alias("recall"), F.round("fpr", 6).alias("fpr"))


@query("g6_rate_errors", f"""WITH s AS ({SCORES_SQL}), g AS (SELECT 0.01::DOUBLE + i * 0.01::DOUBLE AS threshold FROM range(99) r(i)),
    f AS (SELECT source, threshold, avg(CASE WHEN score >= threshold THEN 1.0 ELSE 0 END) AS rate, CASE WHEN source IN ('s0', 's1') THEN 0.0 ELSE 0.2 END AS e FROM s, g GROUP BY source, threshold)
    SELECT round(threshold, 6) AS threshold, round(avg(abs(rate - e)), 6) AS mae, round(max(rate) FILTER (WHERE e = 0), 6) AS benign_most FROM f GROUP BY threshold""")
def rate_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = scores(spark, sf_dir).withColumn("expected_rate", F.when(F.col("source").isin("s0", "s1"), 0.0).otherwise(0.2))
    return thresholds.rate_errors(cases, file="source").withColumn("threshold", F.round("threshold", 6))


@query("g7_score_distribution", f"WITH s AS ({SCORES_SQL}) SELECT source, min(score) AS least, max(score) AS greatest, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, " + ", ".join(f"round(quantile_cont(score, {p / 100}), 6) AS q{p:02d}" for p in (1, 5, 25, 50, 75, 95, 99)) + " FROM s GROUP BY source")
def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thresholds.distribution(scores(spark, sf_dir), "score", ["source"])


@query("x2_x6_scan_summary", f"WITH s AS ({SCORES_SQL}), t AS (SELECT quantile_cont(score, 0.02) - 0.2 * 2 * greatest(stddev_pop(score), 1e-6) * -1 AS t FROM s), c AS (SELECT count(*) AS total, count(*) FILTER (WHERE score < t) AS anomalies FROM s, t) SELECT total, anomalies, round(anomalies * 100 / total, 2) AS risk_score, CASE WHEN round(anomalies * 100 / total, 2) < 15 THEN 'LOW' WHEN round(anomalies * 100 / total, 2) < 40 THEN 'MEDIUM' WHEN round(anomalies * 100 / total, 2) < 75 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level FROM c")
def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scores(spark, sf_dir)
    return scan.summary(scan.anomaly_labels(s, "score", scan.anomaly_cut(s, "score", 0.10)), "is_alert")


@query("x4_x5_lowest", f"WITH s AS ({SCORES_SQL}) SELECT row_id, row_number() OVER (ORDER BY score, row_id) <= ceil(0.15 * count(*) OVER ()) AS is_alert FROM s")
def lowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.lowest(scores(spark, sf_dir).select("row_id", "score"), "score", ["row_id"], 0.15).select("row_id", "is_alert")


@query("x8_confidence", f"WITH s AS ({SCORES_SQL}) SELECT row_id, round((score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()), 6) AS confidence FROM s")
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.confidence(scores(spark, sf_dir), "score").select("row_id", F.round("confidence", 6).alias("confidence"))


@query("x12_anomaly_severity", f"WITH s AS ({SCORES_SQL}) SELECT CASE WHEN score - 0.5 < -0.4 THEN 'critical' WHEN score - 0.5 < -0.2 THEN 'high' WHEN score - 0.5 < -0.1 THEN 'medium' ELSE 'low' END AS severity, count(*) AS count FROM s GROUP BY severity")
def anomaly_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).groupBy(scan.anomaly_severity(F.col("score") - 0.5).alias("severity")).agg(F.count("*").alias("count"))


@query("g11_outcomes", f"WITH s AS ({SCORES_SQL}) SELECT CASE WHEN label = p THEN 'OK' WHEN label = 0 THEN 'FP' ELSE 'FN' END AS outcome, count(*) AS count FROM (SELECT label, CAST(score >= 0.3 AS INTEGER) AS p FROM s) GROUP BY outcome")
def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c: F.when(c, "Attack").otherwise("Normal")
    return scores(spark, sf_dir).groupBy(scan.outcome(name(F.col("label") == 1), name(F.col("score") >= 0.3)).alias("outcome")).agg(F.count("*").alias("count"))


NATION_FILES = (("Flow Duration", "Tot Fwd Pkts", "Flow IAT Mean", "SYN Flag Cnt", "Down/Up Ratio"), ("protocol_type", "src_bytes", "dst_bytes", "serror_rate", "n"), ("a", "b", "c", "d", "e"))


@query("s1_csv_headers", "SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 3 <> 2 THEN o_orderpriority END AS o_orderpriority FROM orders")
def csv_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as CSV to one folder, in files of three different headers, and read back."""
    o, folder = table(spark, sf_dir, "orders"), scratch(spark, "csv")
    k = F.col("o_orderkey") % 3
    for part, columns in enumerate((["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], ["o_orderpriority", "o_orderstatus", "o_custkey", "o_orderkey"], ["o_custkey", "o_orderkey", "o_orderstatus"])):
        o.filter(k == part).select(columns).write.mode("append").option("header", True).csv(folder)
    back = sources.raw_csv(spark, folder)
    return back.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_custkey").cast("long").alias("o_custkey"), "o_orderstatus", "o_orderpriority")


@query("s4_inspection", "SELECT n_nationkey, 'csv' AS input_type, CASE n_nationkey % 3 WHEN 0 THEN 'CIC-IDS' WHEN 1 THEN 'NSL-KDD' ELSE 'Unknown' END AS dataset_type, CASE n_nationkey % 3 WHEN 0 THEN 'NIDS' WHEN 1 THEN 'SIEM' ELSE 'Unknown' END AS mode, CASE n_nationkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 ELSE 0.0 END::DOUBLE AS confidence, true AS has_size FROM nation")
def inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each nation, with a header of one of three kinds; all are inspected together."""
    n, folder = table(spark, sf_dir, "nation"), scratch(spark, "csv")
    for part, columns in enumerate(NATION_FILES):
        one = n.filter(F.col("n_nationkey") % 3 == part)
        one.select("n_nationkey", *(F.col("n_name").alias(c) for c in columns)).write.mode("append").partitionBy("n_nationkey").option("header", True).csv(folder)
    key = F.regexp_extract("file", "n_nationkey=([0-9]+)", 1).cast("long")
    return sources.inspected(spark, [folder]).select(key.alias("n_nationkey"), "input_type", "dataset_type", "mode", "confidence", (F.col("length") > 0).alias("has_size"))
