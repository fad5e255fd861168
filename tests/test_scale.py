"""What makes operators whole at any size: ranges of conversations, streams in any order, quantiles of many columns."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from netweir.operators import features, flows, quantiles, thresholds
from netweir.sources import capture
from netweir.streaming import flows as streams

PACKETS = "capture_id string, pkt_no long, ts_s double, ip_version int, is_arp boolean, frag_offset int, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, pkt_len int, ip_hdr_len int, l4_hdr_len int, tcp_flags string, parse_status string"


def drawn(n, seed=1, hot=3):
    """Packets of which one conversation has a third, with gaps around the timeout of 120 s."""
    rng, t, out = random.Random(seed), 1000.0, []
    for k in range(n):
        t += rng.choice([0.25, 1.5, 5.0, 30.0, 130.0 if k % 50 == 0 else 2.0])
        c = 0 if k % hot == 0 else rng.randint(1, 6)
        ends = [(f"10.0.0.{c}", 1000 + c), ("10.9.9.9", 80)]
        (s, sp), (d, dp) = ends if rng.random() < 0.6 else ends[::-1]
        out.append(("c", k, t, 4, False, 0, s, d, sp, dp, 6, 40 + rng.randint(0, 900), 20, 20, rng.choice(["", "S", "PA", "FA", "R", None]), "ok"))
    return out


def packets(spark, rows):
    return spark.createDataFrame(rows, PACKETS).withColumn("ts", F.timestamp_micros((F.col("ts_s") * 1e6).cast("long")))


def plain(df, columns):
    return sorted(tuple(round(x, 4) if isinstance(x, float) else x for x in (r[c] for c in columns)) for r in df.collect())


def test_a_conversation_in_ranges_gives_the_same_flows(spark):
    p = packets(spark, drawn(900))
    columns = ("pkt_no", "flow_seq", "is_fwd", "iat")
    whole = plain(flows.sequenced(flows.projected(p)), columns)
    for size in (1, 7, 100):
        assert plain(flows.sequenced(flows.projected(p), range_=size), columns) == whole
    # brute force, packet by packet
    last, want = {}, []
    for r in drawn(900):
        key, t, end = frozenset([(r[6], r[8]), (r[7], r[9])]), r[2], (r[6], r[8])
        before = last.get(key)
        if before is None or t - before[0] > 120:
            last[key] = [t, 0 if before is None else before[1] + 1, end]
            want.append((r[1], last[key][1], True, 0.0))
        else:
            want.append((r[1], before[1], end == before[2], round(t - before[0], 4)))
            before[0] = t
    assert whole == sorted(want)


def streamed(spark, folder, batches, delay):
    """Closed flows of packets that come in some batches, and how many packets were dropped."""
    for k, rows in enumerate(batches):
        flows.projected(packets(spark, rows)).coalesce(1).write.mode("append").option("compression", "snappy").parquet(f"{folder}/in/{k:03d}")
    schema = spark.read.parquet(f"{folder}/in/000").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    out = streams.exact_flows(stream, 120.0, delay)
    q = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out"), streams.dropped(q)


@pytest.fixture()
def rocks(spark):
    """State in RocksDB, and frames of three rows."""
    given = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.execution.arrow.maxRecordsPerBatch": "3", "spark.sql.shuffle.partitions": "2"}
    old = {k: spark.conf.get(k) for k in given}
    for k, v in given.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_flows_of_a_shuffled_stream_equal_those_of_the_batch(spark, tmp_path, rocks):
    rows = drawn(240, seed=5)
    end = rows[-1][2]
    rows.append(("c", 10**6, end + 10_000, 4, False, 0, "a", "b", 1, 2, 17, 60, 20, 8, "", "ok"))  # moves the watermark on
    rng, batches = random.Random(3), []
    for a in range(0, len(rows), 60):  # within a batch in any order
        part = rows[a : a + 60]
        rng.shuffle(part)
        batches.append(part)
    got, dropped = streamed(spark, tmp_path, batches, "200 seconds")
    whole = flows.assemble(packets(spark, rows[:240] + rows[240:])).filter("src_ip <> 'a'")
    columns = [c for c in whole.columns if c not in ("flow_seq", "started_at")]
    assert dropped == 0 and plain(got.filter("src_ip <> 'a'"), columns) == plain(whole, columns)


def test_packets_beyond_the_delay_are_dropped_and_counted(spark, tmp_path, rocks):
    rows = drawn(60, seed=7)
    far = ("c", 10**6, rows[-1][2] + 10_000, 4, False, 0, "a", "b", 1, 2, 17, 60, 20, 8, "", "ok")
    later = [[(*far[:1], far[1] + k, far[2] + 10_000 * k, *far[3:])] for k in (1, 2)]
    # a batch drops what the watermark of the batch before had passed: packets up to that are still put in order
    got, dropped = streamed(spark, tmp_path, [[*rows[:50], far], later[0], rows[50:], later[1]], "60 seconds")
    whole = flows.assemble(packets(spark, rows[:50]))
    columns = [c for c in whole.columns if c not in ("flow_seq", "started_at")]
    assert dropped == 10 and plain(got.filter("src_ip <> 'a'"), columns) == plain(whole, columns)


def test_order_statistics_of_many_columns(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = {"a": rng.normal(size=4000), "b": rng.integers(0, 5, 4000).astype(float), "c": np.exp(9 * rng.normal(size=4000)), "d": np.full(4000, 7.0)}
    rows = [tuple(float(v[i]) if i % 10 or k == "a" else None for k, v in x.items()) for i in range(4000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").withColumn("e", F.lit(None).cast("double"))
    ranks = lambda rows, n: [0, 1, n // 3, n // 2, n - 2, n - 1, n + 5]
    true = {k: np.sort(v if k == "a" else np.delete(v, np.arange(0, 4000, 10))) for k, v in x.items()}
    astray = lambda ranks, n, grid: [(grid[10], grid[2000])] if n else []
    for around, few in ((quantiles.around, quantiles.FEW), (astray, 0)):  # intervals that miss their ranks are mended
        monkeypatch.setattr(quantiles, "around", around)
        monkeypatch.setattr(quantiles, "FEW", few)
        total, got = quantiles.statistics(df, list("abcde"), ranks)
        assert total == 4000 and got["e"] == (0, {})
        for k, v in true.items():
            assert got[k] == (len(v), {r: v[r] for r in ranks(0, len(v)) if r < len(v)})


def test_features_are_fit_on_filled_and_clipped_values(spark):
    rng = np.random.default_rng(1)
    a = [None if i % 7 == 0 else float(v) for i, v in enumerate(rng.normal(size=1501))]
    df = spark.createDataFrame([(v, 3.0, None) for v in a], "a double, b double, c double")
    s = features.fit(df, ["a", "b", "c"], [])
    known = np.array([v for v in a if v is not None])
    filled = np.array([np.median(known) if v is None else v for v in a])
    lo, hi = np.quantile(filled, [0.01, 0.99])
    q = np.quantile(np.clip(filled, lo, hi), [0.25, 0.5, 0.75])
    assert s.medians == pytest.approx({"a": np.median(known), "b": 3.0, "c": 0.0})
    assert s.bounds["a"] == pytest.approx((lo, hi)) and s.bounds["b"] == (2.0, 4.0) and s.bounds["c"] == (-1.0, 1.0)
    assert s.scales["a"] == pytest.approx((q[1], q[2] - q[0])) and s.knots["a"] == pytest.approx(np.quantile(np.clip(filled, lo, hi), np.linspace(0, 1, features.KNOTS)))
    empty = features.fit(df.limit(0), ["a"], [])
    assert (empty.medians, empty.bounds) == ({"a": 0.0}, {"a": (-1.0, 1.0)})


def test_quantiles_by_group_need_no_group_in_one_task(spark):
    rng = np.random.default_rng(2)
    rows = [("hot", float(v)) for v in rng.normal(size=3000)] + [("x", 1.0), (None, 2.0), (None, 4.0), ("nan", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    out = thresholds.distribution(df, "v", ["g"])
    assert "percentile(" not in out._jdf.queryExecution().toString()
    got = {r["g"]: r for r in out.collect()}
    hot = np.array([v for g, v in rows[:3000]])
    assert [got["hot"][f"q{p:02d}"] for p in (1, 5, 25, 50, 75, 95, 99)] == pytest.approx(np.quantile(hot, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]), abs=1e-6)
    assert (got["x"]["q50"], got[None]["q25"], got[None]["q50"], got["nan"]["q50"], got["none"]["mean"]) == (1.0, 2.5, 3.0, None, None)
    assert thresholds.distribution(df.filter("g = 'x'"), "v").first()["q99"] == 1.0


def frame(link, k, size=40):
    """A packet from 10.0.0.1 to 10.0.0.2 with its link layer."""
    ip = struct.pack("!BBHHHBBH4s4s", 0x45, 0, 28 + size, k % 65536, 0, 64, 17, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2])) + struct.pack("!HHHH", 1000 + k % 50, 53, 8 + size, 0)
    before = {1: bytes(12) + b"\x08\x00", 101: b"", 113: bytes(14) + b"\x08\x00", 276: b"\x08\x00" + bytes(18), 0: b"\x02\x00\x00\x00"}[link]
    return before + ip + random.Random(k).randbytes(size)


def classic(frames, link, order="<", start=1_700_000_000):
    out = struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, link)
    at = []
    for k, f in enumerate(frames):
        at.append(len(out))
        out += struct.pack(order + "IIII", start + k, k % 1000, len(f), len(f)) + f
    return out, at


@pytest.mark.parametrize("link, order", [(1, "<"), (101, ">"), (113, "<"), (276, "<"), (0, ">")])
def test_a_capture_in_splits_gives_the_same_rows(spark, tmp_path, link, order):
    data, at = classic([frame(link, k, 20 + k * 37 % 400) for k in range(300)], link, order)
    damaged = bytearray(data)
    damaged[at[100] + 8 : at[100] + 12] = b"\xff\xff\xff\x7f"  # a length that can't be
    files = {"whole": data, "cut": data[: at[250] + 30], "damaged": bytes(damaged)}
    for name, body in files.items():
        path = tmp_path / f"{name}.pcap"
        path.write_bytes(body)
        one = [tuple(r) for r in capture.read(spark, [str(path)]).orderBy("pkt_no").collect()]
        for size in (len(body) // 8 + 1,):
            assert len(capture.split(spark, [str(path)], size)) > 7
            assert [tuple(r) for r in capture.read(spark, [str(path)], size).orderBy("pkt_no").collect()] == one
        ports = [r[9] for r in one]
        assert ports == [1000 + k % 50 for k in range(300) if name == "whole" or name == "cut" and k < 250 or name == "damaged" and k != 100]
        assert [r[1] for r in one] == list(range(1, len(one) + 1)) and {r[7] for r in one} == {"10.0.0.1"}


def test_splits_that_begin_amid_a_record_are_walked_again(spark, tmp_path, monkeypatch):
    inner, _ = classic([frame(1, k, 10) for k in range(12)], 1)
    data, _ = classic([frame(1, k, 10) + inner[24:] for k in range(40)], 1)  # frames that hold a capture
    (tmp_path / "n.pcap").write_bytes(data)
    rows = lambda *a: [tuple(r) for r in capture.read(spark, [f"{tmp_path}/n.pcap"], *a).orderBy("pkt_no").collect()]
    assert len(rows()) == 40 and rows(500) == rows()


def test_conversations_of_a_bucket_are_folded_together_and_in_parts():
    import pandas as pd

    rng = np.random.default_rng(2)
    n = 400
    c, flip = rng.integers(0, 9, n), rng.random(n) < 0.4
    ends = [np.where(flip, x, y) for x, y in ((np.char.add("s", c.astype(str)), "d"), ("d", np.char.add("s", c.astype(str))))]
    t = np.cumsum(rng.choice([0.0, 1.0, 4.0, 40.0], n))
    p = pd.DataFrame({"capture_id": "c", "conversation": c.astype(str), "ts_s": t, "pkt_no": np.arange(n), "src_ip": ends[0], "dst_ip": ends[1], "src_port": np.where(flip, 7, 80), "dst_port": np.where(flip, 80, 7), "protocol": 6, "payload_len": rng.integers(0, 900, n), "tcp_flags": rng.choice(["", "S", "PA", None], n)})
    want = []
    for _, g in p.groupby("conversation"):  # flow by flow
        for _, f in g.groupby((g["ts_s"].diff() > 120).cumsum()):
            fwd = (f["src_ip"] == f["src_ip"].iloc[0]).to_numpy()
            size, gap = f["payload_len"].to_numpy(float), np.diff(f["ts_s"], prepend=f["ts_s"].iloc[0])
            want.append((f["conversation"].iloc[0], f["src_ip"].iloc[0], fwd.sum(), (~fwd).sum(), size.std(), gap.mean() * 1e6, gap[fwd].max() * 1e6, gap[~fwd].sum() * 1e6, sum("P" in (x or "") for x in f["tcp_flags"])))
    columns = ["conversation", "src_ip", "total_fwd_packets", "total_backward_packets", "packet_length_std", "flow_iat_mean", "fwd_iat_max", "bwd_iat_total", "psh_flag_count"]
    for parts in (1, 2, 17):
        now, closed = streams.Flows.none(), []
        for part in np.array_split(np.arange(n), parts):
            now, done = streams.folded(now, p.iloc[part].sample(frac=1, random_state=1), 120.0)
            now = streams.Flows.load(now.dump())
            closed += [x.rows() for x in (done,) if len(x)]
        got = pd.concat([*closed, now.rows()])[columns].itertuples(index=False)
        key = lambda r: (r[0], *(round(float(x), 4) for x in r[2:]), r[1])
        x, y = sorted(map(key, got)), sorted(map(key, want))
        assert [(r[0], r[-1]) for r in x] == [(r[0], r[-1]) for r in y] and np.allclose([r[1:-1] for r in x], [r[1:-1] for r in y])
