"""Network tables derived from the given ones, so that every operator runs on data of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A gap that separates flows of these packets, in seconds.
TIMEOUT_S = 21600.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A packet for each event, between one of 16 clients and one of 7 servers."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    u = F.col("user_id")
    client = F.concat(F.lit("10.0.0."), (u % 16).cast("string"))
    server = F.concat(F.lit("192.168.0."), (u % 7).cast("string"))
    protocol = F.element_at(F.array(F.lit(6), F.lit(17), F.lit(1)), (u % 3 + 1).cast("int"))
    ports = protocol != 1
    cport = F.when(ports, 1024 + u).otherwise(0).cast("int")
    sport = F.when(ports, F.element_at(F.array(F.lit(80), F.lit(443), F.lit(22), F.lit(53)), (u % 4 + 1).cast("int"))).otherwise(0).cast("int")
    out = F.col("event_type").isin("click", "view", "purchase")
    kind = F.col("event_type")
    return e.select(
        F.lit("ev").alias("capture_id"),
        F.col("event_id").alias("pkt_no"),
        "ts",
        (F.unix_micros("ts") / F.lit(1e6)).alias("ts_s"),
        F.lit(4).alias("ip_version"),
        F.lit(False).alias("is_arp"),
        F.lit(0).alias("frag_offset"),
        F.when(out, client).otherwise(server).alias("src_ip"),
        F.when(out, server).otherwise(client).alias("dst_ip"),
        F.when(out, cport).otherwise(sport).alias("src_port"),
        F.when(out, sport).otherwise(cport).alias("dst_port"),
        protocol.alias("protocol"),
        (54 + F.floor("value")).cast("int").alias("pkt_len"),
        F.lit(20).alias("ip_hdr_len"),
        F.when(protocol == 6, 20).when(protocol == 17, 8).otherwise(0).alias("l4_hdr_len"),
        F.when(protocol != 6, "").when(kind == "signup", "S").when(kind == "click", "PA").when(kind == "view", "A").when(kind == "purchase", "FA").when(kind == "error", "R").otherwise("").alias("tcp_flags"),
        F.lit("ok").alias("parse_status"),
    )


PACKETS_SQL = """
SELECT 'ev' AS capture_id, event_id AS pkt_no, ts, epoch_us(ts) / 1e6 AS ts_s,
    CASE WHEN event_type IN ('click', 'view', 'purchase') THEN c_ip ELSE s_ip END AS src_ip,
    CASE WHEN event_type IN ('click', 'view', 'purchase') THEN s_ip ELSE c_ip END AS dst_ip,
    CASE WHEN event_type IN ('click', 'view', 'purchase') THEN c_port ELSE s_port END AS src_port,
    CASE WHEN event_type IN ('click', 'view', 'purchase') THEN s_port ELSE c_port END AS dst_port,
    protocol, 54 + CAST(floor(value) AS INTEGER) AS pkt_len, 20 AS ip_hdr_len,
    CASE protocol WHEN 6 THEN 20 WHEN 17 THEN 8 ELSE 0 END AS l4_hdr_len,
    CASE WHEN protocol <> 6 THEN '' WHEN event_type = 'signup' THEN 'S' WHEN event_type = 'click' THEN 'PA'
        WHEN event_type = 'view' THEN 'A' WHEN event_type = 'purchase' THEN 'FA' WHEN event_type = 'error' THEN 'R' ELSE '' END AS tcp_flags
FROM (
    SELECT *, '10.0.0.' || (user_id % 16) AS c_ip, '192.168.0.' || (user_id % 7) AS s_ip,
        CASE user_id % 3 WHEN 2 THEN 0 ELSE CAST(1024 + user_id AS INTEGER) END AS c_port,
        CASE WHEN user_id % 3 = 2 THEN 0 WHEN user_id % 4 = 0 THEN 80 WHEN user_id % 4 = 1 THEN 443 WHEN user_id % 4 = 2 THEN 22 ELSE 53 END AS s_port,
        CASE user_id % 3 WHEN 0 THEN 6 WHEN 1 THEN 17 ELSE 1 END AS protocol
    FROM events
)
"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows: line items with the state of their order, labelled by their return flag."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return l.join(o.select("o_orderkey", "o_orderstatus", "o_orderpriority"), l["l_orderkey"] == F.col("o_orderkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("extendedprice"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_linestatus").alias("linestatus"),
        F.col("o_orderpriority").alias("orderpriority"),
        F.col("o_orderstatus").alias("orderstatus"),
        F.when(F.col("l_returnflag") == "N", "BENIGN").when(F.col("l_returnflag") == "R", "DoS Hulk").otherwise("PortScan").alias("label"),
        F.col("l_suppkey").alias("supplier"),
    )


LABELLED_SQL = """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_id, l_quantity AS quantity, l_extendedprice AS extendedprice,
    l_discount AS discount, l_tax AS tax, l_linestatus AS linestatus, o_orderpriority AS orderpriority, o_orderstatus AS orderstatus,
    CASE l_returnflag WHEN 'N' THEN 'BENIGN' WHEN 'R' THEN 'DoS Hulk' ELSE 'PortScan' END AS label, l_suppkey AS supplier
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label of 0 or 1 and a score of three decimals for each line item, by supplier as source."""
    l = table(spark, sf_dir, "lineitem")
    return l.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"),
        F.concat(F.lit("s"), (F.col("l_suppkey") % 8).cast("string")).alias("source"),
        (F.col("l_returnflag") != "N").cast("int").alias("label"),
        ((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 1000 / 1000.0).alias("score"),
    )


SCORES_SQL = """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_id, 's' || (l_suppkey % 8) AS source,
    CAST(l_returnflag <> 'N' AS INTEGER) AS label, ((l_orderkey * 7919 + l_linenumber * 104729) % 1000) / 1000.0 AS score
FROM lineitem
"""
