"""Packets to bidirectional flows.

A conversation is cut into ranges of packet numbers, so one of any size is spread over many tasks.  Each range is walked alone and
folds to one small row (first and last time, gaps that part flows, who began the last flow); these rows, few a conversation, are
combined in order, and tell each range what was open at its begin.  Flows are then partial aggregates of ranges, put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import protocol_label

#: Packet numbers in a range.
RANGE = 1 << 16
TIMEOUT_S, LEAST_DURATION_S, MOST_RATE = 120.0, 1e-3, 1.25e9
US = 1_000_000.0
CONTEXT = ("src_ip", "dst_ip", "src_port", "destination_port", "protocol")


def projected(packets: DataFrame, most: int | None = None) -> DataFrame:
    """IPv4 packets that are no later fragments, with their payload length; of each capture the first ``most`` if given."""
    keep = (F.col("ip_version") == 4) & (F.col("frag_offset") == 0) & (F.col("parse_status") == "ok")
    if most is not None:
        keep &= F.col("pkt_no") <= most
    return packets.filter(keep).withColumn("payload_len", F.greatest(F.col("pkt_len") - F.col("ip_hdr_len") - F.col("l4_hdr_len"), F.lit(0)))


def capture_check(packets: DataFrame, most: int = 5000) -> DataFrame:
    """For each capture: packets looked at, and whether any is IP or ARP."""
    ok = F.col("parse_status") == "ok"
    return packets.filter(F.col("pkt_no") <= most).groupBy("capture_id").agg(F.count("*").alias("sampled"), F.bool_or(ok & (F.col("ip_version") == 4)).alias("has_ip"), F.bool_or(ok & F.col("is_arp")).alias("has_arp"))


def statuses(packets: DataFrame) -> DataFrame:
    """Packets of each capture by how reading them went."""
    return packets.groupBy("capture_id", "parse_status").agg(F.count("*").alias("packets"))


def endpoints() -> tuple[Column, Column]:
    """The source and the destination of a packet, as address and port."""
    return F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port")), F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))


def sequenced(packets: DataFrame, timeout_s: float = TIMEOUT_S, range_: int = RANGE) -> DataFrame:
    """Projected packets with conversation key, number of the flow in it, direction and inter-arrival time.

    A gap of more than the timeout starts a new flow.  The first packet of a flow says which way is forward, and has an
    inter-arrival time of 0; that of others is the gap to the packet before, of either direction.
    """
    a, b = endpoints()
    p = packets.withColumn("_from", a).withColumn("_key", F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col("protocol")))
    p = p.withColumn("_range", F.floor(F.col("pkt_no") / range_))
    own = ["capture_id", "_key", "_range"]
    w = Window.partitionBy(*own).orderBy("pkt_no")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    # within a range: gaps, flows that begin at one, and who began the flow that is open
    p = p.withColumns({"_gap": F.col("ts_s") - F.lag("ts_s").over(w), "_first": F.row_number().over(w) == 1, "_end": F.lead("pkt_no").over(w).isNull(), "_t0": F.first("ts_s").over(so_far)})
    p = p.withColumn("_new", F.coalesce((F.col("_gap") > timeout_s).cast("int"), F.lit(0)))
    p = p.withColumns({"_at": F.sum("_new").over(so_far), "_began": F.last(F.when((F.col("_new") == 1) | F.col("_first"), F.col("_from")), True).over(so_far)})
    # the last packet of a range says all that the next one needs; what each finds open follows in order
    ends = p.filter("_end").select(*own, "_t0", F.col("ts_s").alias("_t1"), F.col("_at").alias("_breaks"), F.col("_began").alias("_last"))
    r = Window.partitionBy("capture_id", "_key").orderBy("_range")
    ends = ends.withColumn("_before", F.lag("_t1").over(r))
    ends = ends.withColumn("_opens", F.coalesce(F.col("_t0") - F.col("_before") > timeout_s, F.lit(True)))
    more = (F.col("_opens") & F.col("_before").isNotNull()).cast("int") + F.col("_breaks")
    base = F.sum(more).over(r.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_breaks")
    carried = F.last(F.when(F.col("_opens") | (F.col("_breaks") > 0), F.col("_last")), True).over(r.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.withColumns({"_base": base, "_carried": carried})
    p = p.join(ends.select(*own, "_before", "_opens", "_base", "_carried"), own)
    began = F.when((F.col("_at") == 0) & ~F.col("_opens"), F.col("_carried")).otherwise(F.col("_began"))
    wait = F.when(~F.col("_first"), F.when(F.col("_new") == 1, 0.0).otherwise(F.greatest(F.col("_gap"), F.lit(0.0))))
    wait = F.coalesce(wait, F.when(F.col("_opens"), 0.0).otherwise(F.greatest(F.col("ts_s") - F.col("_before"), F.lit(0.0))))
    return p.select(*packets.columns, "_key", (F.col("_base") + F.col("_at")).alias("flow_seq"), (F.col("_from") == began).alias("is_fwd"), wait.alias("iat"))


def moments(name: str, value: Column, mean: str = "{}_mean", std: str = "{}_std", most: str = "{}_max", least: str = "{}_min", times: float = 1.0) -> list[Column]:
    """Mean, population deviation, greatest and least value; 0 where there is none.  Nulls do not count."""
    z = lambda c: F.coalesce(c * times if times != 1 else c, F.lit(0.0))
    return [z(F.avg(value)).alias(mean.format(name)), z(F.stddev_pop(value)).alias(std.format(name)), z(F.max(value).cast("double")).alias(most.format(name)), z(F.min(value).cast("double")).alias(least.format(name))]


def assemble(packets: DataFrame, timeout_s: float = TIMEOUT_S, least_duration_s: float = LEAST_DURATION_S, most_rate: float = MOST_RATE, range_: int = RANGE) -> DataFrame:
    """A row for each flow: capture, number, start, context columns and the 57 features in their fixed order."""
    p = sequenced(projected(packets), timeout_s, range_)
    fwd, size = F.col("is_fwd"), F.col("payload_len").cast("double")
    of = lambda side, c: F.when(side, c)
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    flag = lambda x: F.col("tcp_flags").contains(x)
    start = F.min_by(F.struct("src_ip", "dst_ip", "src_port", "dst_port"), "pkt_no")
    g = p.groupBy("capture_id", "_key", "flow_seq").agg(
        start.alias("_s"),
        F.min_by("ts", "pkt_no").alias("started_at"),
        F.min_by("ts_s", "pkt_no").alias("_t0"),
        F.max_by("ts_s", "pkt_no").alias("_t1"),
        count(fwd).alias("total_fwd_packets"),
        count(~fwd).alias("total_backward_packets"),
        F.coalesce(F.sum(of(fwd, F.col("payload_len"))), F.lit(0)).alias("total_length_of_fwd_packets"),
        F.coalesce(F.sum(of(~fwd, F.col("payload_len"))), F.lit(0)).alias("total_length_of_bwd_packets"),
        *moments("fwd_packet_length", of(fwd, size)),
        *moments("bwd_packet_length", of(~fwd, size)),
        *moments("flow_iat", F.col("iat"), times=US),
        (F.coalesce(F.sum(of(fwd, F.col("iat"))), F.lit(0.0)) * US).alias("fwd_iat_total"),
        *moments("fwd_iat", of(fwd, F.col("iat")), times=US),
        (F.coalesce(F.sum(of(~fwd, F.col("iat"))), F.lit(0.0)) * US).alias("bwd_iat_total"),
        *moments("bwd_iat", of(~fwd, F.col("iat")), times=US),
        count(fwd & flag("P")).alias("fwd_psh_flags"),
        count(~fwd & flag("P")).alias("bwd_psh_flags"),
        count(fwd & flag("U")).alias("fwd_urg_flags"),
        count(~fwd & flag("U")).alias("bwd_urg_flags"),
        *moments("packet_length", size, most="max_packet_length", least="min_packet_length"),
        F.coalesce(F.var_pop(size), F.lit(0.0)).alias("packet_length_variance"),
        *(count(flag(x)).alias(f"{n}_flag_count") for n, x in (("fin", "F"), ("syn", "S"), ("rst", "R"), ("psh", "P"), ("ack", "A"), ("urg", "U"), ("cwr", "C"), ("ece", "E"))),
    )
    return completed(g.withColumn("_protocol", F.col("_key.protocol")), least_duration_s, most_rate)


def completed(g: DataFrame, least_duration_s: float = LEAST_DURATION_S, most_rate: float = MOST_RATE) -> DataFrame:
    """Flows with all features, from what is counted and summed of each: those features, ``_s``, the ends of its first packet,
    ``_t0`` and ``_t1``, its first and last time, and ``_protocol``.  Features that g has no column for are left out."""
    f, b = F.col("total_fwd_packets"), F.col("total_backward_packets")
    bytes_ = F.col("total_length_of_fwd_packets") + F.col("total_length_of_bwd_packets")
    seconds = F.greatest(F.col("_t1") - F.col("_t0"), F.lit(least_duration_s))
    rate = lambda n: F.least(n / seconds, F.lit(most_rate))
    extra = {
        "src_ip": F.col("_s.src_ip"),
        "dst_ip": F.col("_s.dst_ip"),
        "src_port": F.col("_s.src_port"),
        "destination_port": F.col("_s.dst_port"),
        "protocol": protocol_label(F.col("_protocol")),
        "flow_duration": seconds * US,
        "flow_bytes_s": rate(bytes_),
        "flow_packets_s": rate(f + b),
        "fwd_packets_s": rate(f),
        "bwd_packets_s": rate(b),
        "down_up_ratio": f / F.greatest(b, F.lit(1)),
        "average_packet_size": bytes_ / F.greatest(f + b, F.lit(1)),
        "avg_fwd_segment_size": F.col("fwd_packet_length_mean"),
        "avg_bwd_segment_size": F.col("bwd_packet_length_mean"),
        "subflow_fwd_packets": f,
        "subflow_fwd_bytes": F.col("total_length_of_fwd_packets"),
        "subflow_bwd_packets": b,
        "subflow_bwd_bytes": F.col("total_length_of_bwd_packets"),
    }
    from ..domains import CIC_FEATURES

    wide = g.select("*", *(c.alias(n) for n, c in extra.items()))
    others = [c for c in CONTEXT if c not in CIC_FEATURES]
    given = [c for c in ("capture_id", "flow_seq", "started_at") if c in g.columns]
    return wide.select(*given, *others, *(c for c in CIC_FEATURES if c in wide.columns), F.lit("Unknown").alias("target_label"))
