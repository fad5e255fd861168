"""Queries on packets and flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import PACKETS_SQL, TIMEOUT_S, packets
from ..domains import CIC_FEATURES
from ..operators import flows as ops

#: Packets with key, flow number, direction and inter-arrival time.
SEQUENCED_SQL = f"""
WITH p AS ({PACKETS_SQL}),
k AS (
    SELECT *, greatest(pkt_len - ip_hdr_len - l4_hdr_len, 0) AS payload_len,
        CASE WHEN (src_ip, src_port) <= (dst_ip, dst_port) THEN concat_ws('|', src_ip, src_port, dst_ip, dst_port, protocol)
            ELSE concat_ws('|', dst_ip, dst_port, src_ip, src_port, protocol) END AS key
    FROM p
),
g AS (SELECT *, ts_s - lag(ts_s) OVER (PARTITION BY key ORDER BY pkt_no) AS gap FROM k),
s AS (SELECT *, sum(CASE WHEN gap > {TIMEOUT_S} THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY pkt_no) AS flow_seq FROM g),
q AS (
    SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0.0 ELSE greatest(gap, 0.0) END AS iat,
        src_ip = first_value(src_ip) OVER w AND src_port = first_value(src_port) OVER w AS fwd
    FROM s WINDOW w AS (PARTITION BY key, flow_seq ORDER BY pkt_no)
)
"""


def _stats(name: str, value: str, cond: str, mean: str = "{}_mean", std: str = "{}_std", most: str = "{}_max", least: str = "{}_min", times: str = "") -> str:
    f = f"FILTER (WHERE {cond})"
    digits = 1 if times else 4  # microseconds are too large for more
    return ", ".join(f"round(coalesce({fn}({value}) {f}{times}, 0.0), {digits}) AS {n.format(name)}" for fn, n in (("avg", mean), ("stddev_pop", std), ("max", most), ("min", least)))


def _flow_sql() -> str:
    us = " * 1e6"
    flags = ", ".join(f"CAST(count(*) FILTER (WHERE contains(tcp_flags, '{x}')) AS BIGINT) AS {n}_flag_count" for n, x in zip(("fin", "syn", "rst", "psh", "ack", "urg", "cwr", "ece"), "FSRPAUCE"))
    sides = ", ".join(f"CAST(count(*) FILTER (WHERE {'' if s == 'fwd' else 'NOT '}fwd AND contains(tcp_flags, '{x}')) AS BIGINT) AS {s}_{n}_flags" for n, x in (("psh", "P"), ("urg", "U")) for s in ("fwd", "bwd"))
    return f"""
{SEQUENCED_SQL},
a AS (
    SELECT key, flow_seq, arg_min(src_ip, pkt_no) AS src_ip, arg_min(dst_ip, pkt_no) AS dst_ip, arg_min(src_port, pkt_no) AS src_port,
        arg_min(dst_port, pkt_no) AS destination_port, any_value(protocol) AS proto,
        greatest(arg_max(ts_s, pkt_no) - arg_min(ts_s, pkt_no), 0.001) AS secs,
        count(*) FILTER (WHERE fwd) AS nf, count(*) FILTER (WHERE NOT fwd) AS nb,
        CAST(coalesce(sum(payload_len) FILTER (WHERE fwd), 0) AS BIGINT) AS bf, CAST(coalesce(sum(payload_len) FILTER (WHERE NOT fwd), 0) AS BIGINT) AS bb,
        {_stats("fwd_packet_length", "payload_len", "fwd")}, {_stats("bwd_packet_length", "payload_len", "NOT fwd")},
        {_stats("flow_iat", "iat", "true", times=us)}, {_stats("fwd_iat", "iat", "fwd", times=us)}, {_stats("bwd_iat", "iat", "NOT fwd", times=us)},
        round(coalesce(sum(iat) FILTER (WHERE fwd), 0) * 1e6, 1) AS fwd_iat_total, round(coalesce(sum(iat) FILTER (WHERE NOT fwd), 0) * 1e6, 1) AS bwd_iat_total,
        {_stats("packet_length", "payload_len", "true", most="max_packet_length", least="min_packet_length")},
        round(var_pop(payload_len), 4) AS packet_length_variance, {sides}, {flags}
    FROM q GROUP BY key, flow_seq
)
SELECT CAST(flow_seq AS BIGINT) AS flow_seq, src_ip, dst_ip, src_port,
    CASE proto WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 1 THEN 'ICMP' ELSE CAST(proto AS VARCHAR) END AS protocol,
    round(secs * 1e6, 1) AS flow_duration, nf AS total_fwd_packets, nb AS total_backward_packets, bf AS total_length_of_fwd_packets, bb AS total_length_of_bwd_packets,
    round(least((bf + bb) / secs, 1.25e9), 4) AS flow_bytes_s, round(least((nf + nb) / secs, 1.25e9), 4) AS flow_packets_s,
    round(least(nf / secs, 1.25e9), 4) AS fwd_packets_s, round(least(nb / secs, 1.25e9), 4) AS bwd_packets_s,
    round(nf / greatest(nb, 1), 4) AS down_up_ratio, round((bf + bb) / greatest(nf + nb, 1), 4) AS average_packet_size,
    fwd_packet_length_mean AS avg_fwd_segment_size, bwd_packet_length_mean AS avg_bwd_segment_size,
    nf AS subflow_fwd_packets, bf AS subflow_fwd_bytes, nb AS subflow_bwd_packets, bb AS subflow_bwd_bytes,
    * EXCLUDE (key, flow_seq, src_ip, dst_ip, src_port, proto, secs, nf, nb, bf, bb)
FROM a
"""


def flow_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ops.assemble(packets(spark, sf_dir), TIMEOUT_S)
    kinds = dict(f.dtypes)
    return f.select("flow_seq", "src_ip", "dst_ip", "src_port", "protocol", *(F.round(c, 1 if "iat" in c or c == "flow_duration" else 4).alias(c) if kinds[c] == "double" else F.col(c) for c in CIC_FEATURES))


def packet_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.projected(packets(spark, sf_dir), most=5000).select("pkt_no", "src_ip", "dst_ip", "src_port", "dst_port", "payload_len", "tcp_flags")


def packet_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.sequenced(ops.projected(packets(spark, sf_dir)), TIMEOUT_S).select("pkt_no", "flow_seq", "is_fwd", F.round("iat", 4).alias("iat"))


def capture_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.capture_check(packets(spark, sf_dir))


def packet_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.statuses(packets(spark, sf_dir))


QUERIES = {
    "s6_s7_packet_projection": (packet_projection, f"SELECT pkt_no, src_ip, dst_ip, src_port, dst_port, greatest(pkt_len - ip_hdr_len - l4_hdr_len, 0) AS payload_len, tcp_flags FROM ({PACKETS_SQL}) WHERE pkt_no <= 5000"),
    "s8_capture_check": (capture_check, "SELECT 'ev' AS capture_id, count(*) AS sampled, true AS has_ip, false AS has_arp FROM events WHERE event_id <= 5000"),
    "p1_p5_packet_sequence": (packet_sequence, f"{SEQUENCED_SQL} SELECT pkt_no, CAST(flow_seq AS BIGINT) AS flow_seq, fwd AS is_fwd, round(iat, 4) AS iat FROM q"),
    "p1_p11_flows": (flow_table, _flow_sql()),
    "p12_packet_statuses": (packet_statuses, "SELECT 'ev' AS capture_id, 'ok' AS parse_status, count(*) AS packets FROM events"),
}
