"""Packets to flows and alerts on streams.

A stream of packets has the columns of the projected packets with ts as event time.  The watermark closes flows; packets that
come later than its delay are dropped, and Spark counts them (see ``dropped``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.flows import US, completed, endpoints

#: Names of flags by their letters, in the order in which they are counted.
FLAGS = {"F": "fin", "S": "syn", "R": "rst", "P": "psh", "A": "ack", "U": "urg", "C": "cwr", "E": "ece"}


def conversation(packets: DataFrame) -> DataFrame:
    """packets with one key for both directions."""
    a, b = endpoints()
    low, high = F.least(a, b), F.greatest(a, b)
    key = F.concat_ws("|", low["ip"], low["port"].cast("string"), high["ip"], high["port"].cast("string"), F.col("protocol").cast("string"))
    return packets.withColumn("conversation", key).withColumn("from_low", a <= b)


def closed_flows(packets: DataFrame, timeout: str = "120 seconds", delay: str = "60 seconds") -> DataFrame:
    """Flows whose idle gap has passed, with all features that do not need the order of packets: all but inter-arrival times.

    The first packet of a flow says which way is forward.  Counts, sums and moments are kept for each end of the conversation, and
    which end came first, so the state of a session has one size whatever its packets, and parts of it can be merged.
    """
    p = conversation(packets).withWatermark("ts", delay)
    low, size = F.col("from_low"), F.col("payload_len").cast("double")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    ends = {}
    for end, of in (("low", low), ("high", ~low)):
        x = F.when(of, size)
        ends |= {f"n_{end}": F.count_if(of), f"bytes_{end}": F.coalesce(F.sum(F.when(of, F.col("payload_len").cast("long"))), F.lit(0)), f"psh_{end}": F.count_if(of & F.col("tcp_flags").contains("P")), f"urg_{end}": F.count_if(of & F.col("tcp_flags").contains("U"))}
        ends |= {f"{k}_{end}": zero(fn(x)) for k, fn in (("mean", F.avg), ("std", F.stddev_pop), ("max", F.max), ("min", F.min))}
    g = p.groupBy("conversation", F.session_window("ts", timeout).alias("session")).agg(
        F.min_by(F.struct("src_ip", "dst_ip", "src_port", "dst_port", "from_low", "protocol"), F.struct("ts", "pkt_no")).alias("_s"),
        F.min("ts").alias("started_at"),
        F.min("ts_s").alias("_t0"),
        F.max("ts_s").alias("_t1"),
        *(c.alias(n) for n, c in ends.items()),
        zero(F.avg(size)).alias("packet_length_mean"),
        zero(F.stddev_pop(size)).alias("packet_length_std"),
        zero(F.var_pop(size)).alias("packet_length_variance"),
        zero(F.max(size)).alias("max_packet_length"),
        zero(F.min(size)).alias("min_packet_length"),
        *(F.count_if(F.col("tcp_flags").contains(x)).alias(f"{n}_flag_count") for x, n in FLAGS.items()),
    )
    side = lambda name, fwd: F.when(F.col("_s.from_low") == F.lit(fwd), F.col(f"{name}_low")).otherwise(F.col(f"{name}_high"))
    named = {}
    for way, fwd, packets_ in (("fwd", True, "total_fwd_packets"), ("bwd", False, "total_backward_packets")):
        named |= {packets_: side("n", fwd), f"total_length_of_{way}_packets": side("bytes", fwd), f"{way}_psh_flags": side("psh", fwd), f"{way}_urg_flags": side("urg", fwd)}
        named |= {f"{way}_packet_length_{k}": side(k, fwd) for k in ("mean", "std", "max", "min")}
    wide = g.withColumns({**named, "_protocol": F.col("_s.protocol")})
    return completed(wide.withColumn("capture_id", F.col("conversation"))).withColumnRenamed("capture_id", "conversation")


# What a running flow consists of: where its first packet came from and when, its last time, and moments of sizes and gaps.
KINDS = ("fwd_size", "bwd_size", "size", "gap", "fwd_gap", "bwd_gap")
KEY, FIRST = ("capture_id", "conversation"), ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")
PACKET = (*KEY, "ts_s", "pkt_no", *FIRST, "payload_len", "tcp_flags")
#: How many groups conversations are dealt to by a hash; each keeps its waiting packets and its running flows together.
BUCKETS = 1024


class Flows:
    """Flows, each of constant size, as arrays: ``first`` (key, ends of the first packet), ``time`` (first and last), ``moments`` (of
    each kind number, mean, squared deviations, greatest and least) and ``flags`` (counts)."""

    def __init__(self, first: pd.DataFrame, time: np.ndarray, moments: np.ndarray, flags: np.ndarray):
        self.first, self.time, self.moments, self.flags = first, time, moments, flags

    @classmethod
    def none(cls) -> Flows:
        return cls(pd.DataFrame({c: np.zeros(0, object) for c in (*KEY, *FIRST)}), np.zeros((0, 2)), np.zeros((0, len(KINDS), 5)), np.zeros((0, len(FLAGS) + 4), np.int64))

    def __len__(self) -> int:
        return len(self.first)

    def at(self, which: np.ndarray) -> Flows:
        return Flows(self.first[which].reset_index(drop=True), self.time[which], self.moments[which], self.flags[which])

    def and_(self, other: Flows) -> Flows:
        if not len(self) or not len(other):
            return self if len(self) else other
        return Flows(pd.concat([self.first, other.first], ignore_index=True), *(np.concatenate((getattr(self, k), getattr(other, k))) for k in ("time", "moments", "flags")))

    def keys(self) -> list[tuple]:
        return list(zip(*(self.first[c] for c in KEY)))

    def dump(self) -> bytes:
        wide = {"time": self.time, "moments": self.moments.reshape(len(self), -1), "flags": self.flags}
        return written(self.first.assign(**{k: list(v) for k, v in wide.items()}))

    @classmethod
    def load(cls, frame: bytes) -> Flows:
        d = read(frame)
        time, moments, flags = (np.stack(d[k].to_list()) for k in ("time", "moments", "flags"))
        return cls(d[[*KEY, *FIRST]], time, moments.reshape(len(d), len(KINDS), 5), flags)

    def rows(self) -> pd.DataFrame:
        """The rows of these flows, with the columns of ROW."""
        n, mean, m2, most, least = np.moveaxis(self.moments, 2, 0)
        some = n > 0
        std = np.sqrt(np.divide(m2, n, out=np.zeros_like(m2), where=some))
        figures = [np.where(some, x, 0.0) for x in (mean, std, most, least)]
        of = lambda k, unit: [x[:, KINDS.index(k)] * unit for x in figures]
        total = lambda k: (n * mean)[:, KINDS.index(k)]
        count = lambda x: np.rint(x).astype(np.int64)
        started = pd.to_datetime(count(self.time[:, 0] * 1e6), unit="us")
        numbers = [count(n[:, 0]), count(n[:, 1]), count(total("fwd_size")), count(total("bwd_size"))]
        sizes = [x for k in ("fwd_size", "bwd_size", "size") for x in of(k, 1)]
        gaps = [x for k in ("gap", "fwd_gap", "bwd_gap") for x in of(k, US)]
        columns = [*(self.first[c] for c in (*KEY, *FIRST)), started, *self.time.T, *numbers, *sizes, m2[:, 2] / n[:, 2], *gaps, total("fwd_gap") * US, total("bwd_gap") * US, *self.flags.T]
        return pd.DataFrame(dict(zip((c.split(" ")[0] for c in ROW.split(", ")), columns)))


def moments_of(x: np.ndarray, of: np.ndarray, flows_: int) -> np.ndarray:
    """Of values x, sorted by their flow ``of``, the moments of each flow."""
    n = np.bincount(of, minlength=flows_)
    mean = np.bincount(of, x, flows_) / np.maximum(n, 1)
    out = np.stack([n, mean, np.bincount(of, np.square(x - mean[of]), flows_), np.full(flows_, -np.inf), np.full(flows_, np.inf)], 1)
    if len(x):
        begin = np.flatnonzero(np.diff(of, prepend=-1))
        out[of[begin], 3], out[of[begin], 4] = np.maximum.reduceat(x, begin), np.minimum.reduceat(x, begin)
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The moments of the values of both."""
    n = a[..., 0] + b[..., 0]
    step, share = b[..., 1] - a[..., 1], b[..., 0] / np.maximum(n, 1)
    return np.stack([n, a[..., 1] + step * share, a[..., 2] + b[..., 2] + step * step * a[..., 0] * share, np.maximum(a[..., 3], b[..., 3]), np.minimum(a[..., 4], b[..., 4])], -1)


def _figures(*names: str) -> list[str]:
    return [f"{n} double" for name in names for n in name.split()]


ROW = ", ".join(
    [
        "capture_id string, conversation string, src_ip string, dst_ip string, src_port int, dst_port int, _protocol int, started_at timestamp, _t0 double, _t1 double",
        "total_fwd_packets long, total_backward_packets long, total_length_of_fwd_packets long, total_length_of_bwd_packets long",
        *_figures(*(" ".join(f"{w}_packet_length_{k}" for k in ("mean", "std", "max", "min")) for w in ("fwd", "bwd")), "packet_length_mean packet_length_std max_packet_length min_packet_length packet_length_variance"),
        *_figures(*(" ".join(f"{w}_iat_{k}" for k in ("mean", "std", "max", "min")) for w in ("flow", "fwd", "bwd")), "fwd_iat_total bwd_iat_total"),
        *(f"{n}_flag_count long" for n in FLAGS.values()),
        "fwd_psh_flags long, bwd_psh_flags long, fwd_urg_flags long, bwd_urg_flags long",
    ]
)


class FlowFold(StatefulProcessor):
    """Packets wait in a buffer until the watermark has passed them; then they go, in the order of time and number, into the running
    flow of their conversation.  So the order in which packets come, and how they are cut into frames, changes nothing.

    A key is a bucket of conversations, which go through arrays together.  The buffer holds the packets of one delay; a flow is some
    fifty numbers.
    """

    def __init__(self, timeout_s: float):
        self.timeout_s = timeout_s

    def init(self, handle) -> None:
        self.handle = handle
        self.flows = handle.getValueState("flows", "frame binary")
        self.waiting = handle.getListState("waiting", "frame binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames, least = [], np.inf
        for f in rows:
            if len(f):
                frames.append((written(f[list(PACKET)]),))
                least = min(least, float(f["ts_s"].min()))
        if frames:
            self.waiting.appendList(frames)
            self.wake(least)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() / 1000
        frames = [read(x[0]) for x in self.waiting.get()] if self.waiting.exists() else []
        flows_, closed = (Flows.load(self.flows.get()[0]) if self.flows.exists() else Flows.none()), Flows.none()
        if frames:
            p = pd.concat(frames, ignore_index=True)
            ready = p["ts_s"].to_numpy(float) <= passed
            flows_, closed = folded(flows_, p[ready], self.timeout_s)
            rest = p[~ready]
            self.waiting.clear()
            if len(rest):
                self.waiting.appendList([(written(rest),)])
                self.wake(float(rest["ts_s"].min()))
        idle = flows_.time[:, 1] + self.timeout_s <= passed  # what comes now is later than the watermark
        closed, flows_ = closed.and_(flows_.at(idle)), flows_.at(~idle)
        if len(flows_):
            self.flows.update((flows_.dump(),))
            self.wake(float(flows_.time[:, 1].min()) + self.timeout_s)
        else:
            self.flows.clear()
        if len(closed):
            yield closed.rows()

    def wake(self, at: float) -> None:
        self.handle.registerTimer(int(np.ceil(at * 1000)))

    def close(self) -> None:
        pass


def written(p: pd.DataFrame) -> bytes:
    t = pa.Table.from_pandas(p, preserve_index=False)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, t.schema) as w:
        w.write_table(t)
    return out.getvalue().to_pybytes()


def read(frame: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(frame).read_all().to_pandas()


def folded(flows_: Flows, p: pd.DataFrame, timeout_s: float) -> tuple[Flows, Flows]:
    """The running flows after packets, and those that a gap of more than the timeout closed.

    Packets go in the order of time and number within their conversation; each flow is a stretch of them.
    """
    if not len(p):
        return flows_, Flows.none()
    p = p.sort_values([*KEY, "ts_s", "pkt_no"], ignore_index=True)
    t, size = p["ts_s"].to_numpy(float), p["payload_len"].to_numpy(float)
    fresh = np.zeros(len(p), bool)
    for c in KEY:
        code = pd.factorize(p[c])[0]
        fresh |= np.diff(code, prepend=-2) != 0
    begin = np.flatnonzero(fresh)
    # the running flow of each conversation, -1 for none
    where = {k: i for i, k in enumerate(flows_.keys())}
    own = np.array([where.get(k, -1) for k in zip(*(p[c].to_numpy()[begin] for c in KEY))])
    before = np.concatenate((t[:1], t[:-1]))
    before[begin] = np.where(own >= 0, flows_.time[own, 1] if len(flows_) else t[begin], t[begin])
    parted = t - before > timeout_s
    parted[begin] |= own < 0
    starts = np.flatnonzero(fresh | parted)
    of = np.cumsum(fresh | parted) - 1
    n = len(starts)
    goes_on = ~parted[starts]  # with the running flow
    old = own[np.searchsorted(begin, starts, side="right") - 1]
    first = p.loc[starts, [*KEY, *FIRST]].reset_index(drop=True)
    if goes_on.any():
        first.loc[goes_on, :] = flows_.first.iloc[old[goes_on]].to_numpy()
    gap = np.where(parted, 0.0, np.maximum(t - before, 0.0))
    fwd = (p["src_ip"].to_numpy() == first["src_ip"].to_numpy()[of]) & (p["src_port"].to_numpy() == first["src_port"].to_numpy()[of])
    moments = np.stack([moments_of(x[m], of[m], n) for x, m in ((size, fwd), (size, ~fwd), (size, fwd | True), (gap, fwd | True), (gap, fwd), (gap, ~fwd))], 1)
    code, texts = pd.factorize(p["tcp_flags"], use_na_sentinel=False)
    has = np.array([[isinstance(f, str) and x in f for x in FLAGS] for f in texts], bool).reshape(-1, len(FLAGS))[code]
    push, urgent = has[:, list(FLAGS).index("P")], has[:, list(FLAGS).index("U")]
    flags = np.stack([np.bincount(of[m], minlength=n) for m in (*has.T, push & fwd, push & ~fwd, urgent & fwd, urgent & ~fwd)], 1)
    last = np.append(starts[1:], len(p)) - 1
    time = np.stack([t[starts], t[last]], 1)
    if goes_on.any():
        at = old[goes_on]
        moments[goes_on], time[goes_on, 0] = merged(flows_.moments[at], moments[goes_on]), flows_.time[at, 0]
        flags[goes_on] += flows_.flags[at]
    now = Flows(first, time, moments, flags)
    runs = np.append(fresh[starts[1:]], True)  # the last flow of its conversation
    # running flows that are closed by a gap, and those of conversations without packets
    stays = np.ones(len(flows_), bool)
    stays[own[own >= 0]] = False
    gone = np.zeros(len(flows_), bool)
    gone[own[(own >= 0) & parted[begin]]] = True
    return flows_.at(stays).and_(now.at(runs)), flows_.at(gone).and_(now.at(~runs))


def exact_flows(packets: DataFrame, timeout_s: float = 120.0, delay: str = "60 seconds") -> DataFrame:
    """Flows with all features, those of inter-arrival times too, equal to those of a batch over the same packets.

    Packets are ordered by time, then number.  Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    p = conversation(packets).withWatermark("ts", delay)
    p = p.withColumn("_bucket", F.pmod(F.xxhash64("capture_id", "conversation"), F.lit(BUCKETS)))
    out = p.groupBy("_bucket").transformWithStateInPandas(FlowFold(timeout_s), ROW, "Append", "EventTime")
    return completed(out.withColumn("_s", F.struct("src_ip", "dst_ip", "src_port", "dst_port")).drop("src_ip", "dst_ip", "src_port", "dst_port"))


def dropped(query) -> int:
    """How many packets of a streaming query came later than its watermark, by its recent progress."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def labelled_flows(flows: DataFrame, score: Column, threshold: float) -> DataFrame:
    """Stateless scan of a stream of flows with a fixed threshold."""
    return flows.withColumn("score", score).withColumn("is_alert", F.col("score") >= threshold)


def alerts_per_window(alerts: DataFrame, width: str = "1 minute", slide: str | None = None, delay: str = "60 seconds", by: tuple[str, ...] = ()) -> DataFrame:
    """(at, *by, alerts) for tumbling or sliding windows of event time."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return alerts.withWatermark("ts", delay).groupBy(w.alias("w"), *by).agg(F.count("*").alias("alerts")).select(F.col("w.start").alias("at"), *by, "alerts")


def alert_rates(packets: DataFrame, alert: Column, width: str = "5 minutes", slide: str = "1 minute", delay: str = "60 seconds", by: tuple[str, ...] = ("src_ip",)) -> DataFrame:
    """(at, *by, packets, alerts, rate) for sliding windows of event time: two aggregates of one stream under one watermark."""
    g = packets.withWatermark("ts", delay).groupBy(F.window("ts", width, slide).alias("w"), *by).agg(F.count("*").alias("packets"), F.count_if(alert).alias("alerts"))
    return g.select(F.col("w.start").alias("at"), *by, "packets", "alerts", (F.col("alerts") / F.col("packets")).alias("rate"))


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """All that a stream has now, written to Parquet below a shared folder and read back."""
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def each_batch(stream: DataFrame, save: Callable[[DataFrame, int], None], folder: str):
    """Hand every batch to ``save`` with its number, which a repeated batch has again, so that saving can be made idempotent."""
    return stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
