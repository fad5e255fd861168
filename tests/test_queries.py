"""Every query of the network operators against its SQL, on the smallest tables, and the golden cases."""

import os
import struct

import duckdb
import pytest
from pyspark.sql import functions as F

from netweir.operators import features, flows, history, iforest, labels, quantiles, thresholds
from netweir.plans import registry
from netweir.sources import capture, tables

SF = "/root/testdata/sf0.001"
SLOW = ("l1_l10_random_forest", "l11_forest_training", "l3_l4_isolation_forest")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(rows, columns):
    return sorted((tuple(str(round(x, 5) if isinstance(x, float) else x) for x in (r[c] for c in columns)) for r in rows), key=str)


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in SLOW])
def test_query_equals_its_sql(spark, duck, name):
    query, sql = registry.QUERIES[name]
    df = query(spark, SF)
    rows = df.collect()
    assert len(df.columns) == len(set(df.columns))
    if sql:
        got = duck.sql(sql)
        assert sorted(got.columns) == sorted(df.columns)
        expected = [dict(zip(got.columns, r)) for r in got.fetchall()]
        num = lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) or type(x).__name__ == "Decimal" else x
        fix = lambda r: {k: num(v) for k, v in r.items()}
        assert plain([fix(r.asDict()) for r in rows], sorted(df.columns)) == plain([fix(r) for r in expected], sorted(df.columns))


def six_packets(spark):
    """Two flows between A and B: the gap of 120 s keeps, one of more parts."""
    rows, n = [], 0
    for t, out, size in ((0, True, 100), (1, False, 200), (3, True, 0), (123, True, 50), (243.001, False, 10), (243.5, True, 20)):
        n += 1
        a, b = ("A", 1000), ("B", 80)
        (s, sp), (d, dp) = (a, b) if out else (b, a)
        rows.append(("c", n, float(t), 4, False, 0, s, d, sp, dp, 6, size + 40, 20, 20, "A", "ok"))
    names = "capture_id string, pkt_no long, ts_s double, ip_version int, is_arp boolean, frag_offset int, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, pkt_len int, ip_hdr_len int, l4_hdr_len int, tcp_flags string, parse_status string"
    return spark.createDataFrame(rows, names).withColumn("ts", F.timestamp_micros((F.col("ts_s") * 1e6).cast("long")))


def test_golden_flows(spark):
    one, two = flows.assemble(six_packets(spark)).orderBy("flow_seq").collect()
    assert (one["src_ip"], two["src_ip"]) == ("A", "B")
    assert [one[c] for c in ("total_fwd_packets", "total_backward_packets", "total_length_of_fwd_packets", "total_length_of_bwd_packets")] == [3, 1, 150, 200]
    assert [two[c] for c in ("total_fwd_packets", "total_backward_packets", "total_length_of_fwd_packets", "total_length_of_bwd_packets")] == [1, 1, 10, 20]
    for row, want in ((one, {"flow_duration": 123e6, "flow_iat_mean": 30750000, "fwd_iat_total": 122e6, "bwd_iat_total": 1e6, "fwd_packet_length_mean": 50, "fwd_packet_length_std": 40.824829, "down_up_ratio": 3, "average_packet_size": 87.5, "flow_bytes_s": 2.845528}), (two, {"flow_duration": 499000, "flow_iat_mean": 249500, "fwd_iat_total": 0, "bwd_iat_total": 499000, "down_up_ratio": 1, "average_packet_size": 15, "flow_bytes_s": 60.120240})):
        for k, v in want.items():
            assert row[k] == pytest.approx(v, rel=1e-6), k
    assert len(registry.QUERIES) > 60


def test_golden_thresholds(spark):
    kind = "dataset_type string, algorithm string, name string, input_type string, recommended_threshold double, base_threshold double, pcap_threshold double, csv_threshold double, has_hard_cases boolean, policy_id string"
    rows = [("CIC-IDS", "Random Forest", "m", "pcap", 0.82, 0.82, 0.23, None, False, thresholds.POLICY), ("CIC-IDS", "Random Forest", "m", "pcap", 0.85, None, None, None, False, None)]
    got = thresholds.resolved(spark.createDataFrame(rows, kind)).collect()
    assert [(r["threshold"], r["source"]) for r in got] == [(0.23, "training_provenance"), (0.85, "legacy")]
    assert got[1]["policy"].endswith("legacy.v0")


def test_captures_are_read(spark, tmp_path):
    ip = struct.pack("!BBHHHBBH4s4s", 0x45, 0, 44, 0, 0, 64, 6, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2]))
    tcp = struct.pack("!HHIIBBHHH", 1234, 80, 0, 0, 0x50, 0x12, 0, 0, 0)
    frames = [bytes(12) + b"\x08\x00" + ip + tcp + b"data", bytes(12) + b"\x08\x06" + bytes(28), bytes(12) + b"\x86\xdd" + bytes(40), bytes(12) + b"\x08\x00\x45"]
    body = b"".join(struct.pack("<IIII", 5, 500000, len(f), len(f)) + f for f in frames)
    (tmp_path / "a.pcap").write_bytes(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + body)
    rows = capture.read(spark, [f"{tmp_path}/a.pcap"]).orderBy("pkt_no").collect()
    assert [r["parse_status"] for r in rows] == ["ok", "ok", "non_ip", "corrupt"] and rows[1]["is_arp"]
    r = rows[0]
    assert (r["src_ip"], r["dst_port"], r["tcp_flags"], r["ts_s"], r["l4_hdr_len"]) == ("10.0.0.1", 80, "SA", 5.5, 20)


def test_csv_rows_are_cleaned(spark, tmp_path):
    (tmp_path / "x.csv").write_text("﻿Tot Fwd Pkts, Label,class\n1,BENIGN,a\n2,x,b,too many\n3\nTot Fwd Pkts,Label,class\n4,DoS,c\n", encoding="utf-8")
    df = tables.raw_csv(spark, f"{tmp_path}/x.csv")
    assert df.columns == ["total_fwd_packets", "label__0", "label__1"]
    assert sorted(r[0] for r in df.collect()) == ["1", "3", "4"]
    with pytest.raises(ValueError):
        labels.require(df, ["flow_duration"])


def test_isolation_forest_finds_a_shifted_cluster(spark):
    d = spark.range(900).select(F.col("id"), *(F.randn(k).alias(f"f{k}") for k in range(4)))
    far = spark.range(900, 950).select(F.col("id"), *((F.randn(k + 9) + 6).alias(f"f{k}") for k in range(4)))
    m = iforest.fit(d, [f"f{k}" for k in range(4)], ["id"], trees=40)
    low = m.transform(d.union(far)).orderBy("decision").limit(50).collect()
    assert sum(r["id"] >= 900 for r in low) >= 45


def test_captures_of_blocks_are_read(spark, tmp_path):
    ip = struct.pack("!BBHHHBBH4s4s", 0x45, 0, 44, 0, 0, 64, 17, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2])) + struct.pack("!HHHH", 53, 5353, 8, 0)
    block = lambda kind, body: struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)
    when = 1_700_000_000_250_000
    data = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 101, 0, 0)) + block(4, b"skip")
    data += block(6, struct.pack("<IIIII", 0, when >> 32, when & 0xFFFFFFFF, len(ip), len(ip)) + ip + bytes(-len(ip) % 4))
    (tmp_path / "b.pcapng").write_bytes(data)
    r = capture.read(spark, [f"{tmp_path}/b.pcapng"]).collect()
    assert [(x["src_ip"], x["src_port"], x["protocol"], x["ts_s"], x["l4_hdr_len"]) for x in r] == [("10.0.0.1", 53, 17, when / 1e6, 8)]


def test_headers_of_a_folder_are_read_in_one_job(spark, tmp_path):
    for name, line in (("a", "x, y"), ("b", '"p",q,r')):
        (tmp_path / f"{name}.csv").write_text(f"{line}\n1,2,3\n4,5,6\n")
    got = sorted((r["file"][-5], r["position"], r["name"]) for r in tables.headers(spark, str(tmp_path)).collect())
    assert got == [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "p"), ("b", 1, "q"), ("b", 2, "r")]


def test_quantiles_by_ranges_equal_numpy(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.concatenate((rng.normal(0, 1, 3000), rng.integers(0, 4, 500)))
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    points = [0.0, 0.01, 0.3, 0.5, 0.99, 1.0]
    for few in (0, 10**6):
        monkeypatch.setattr(quantiles, "FEW", few)
        assert quantiles.quantiles(df, "v", points) == pytest.approx(np.quantile(x, points).tolist(), abs=1e-12)
    assert quantiles.quantiles(df.limit(0), "v", points) == []


def test_normal_scores_equal_the_library():
    from statistics import NormalDist

    import numpy as np

    p = np.array([1e-7, 1e-4, 0.02, 0.0750, 0.3, 0.5, 0.77, 0.999, 1 - 1e-7])
    assert features.inverse_normal(p) == pytest.approx([NormalDist().inv_cdf(x) for x in p], abs=2e-6)


def test_golden_forest_calibration(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(42)
    names = [f"f{k}" for k in range(4)]
    rows = lambda n, mean, dev, label, start: [(start + i, *map(float, x), label) for i, x in enumerate(rng.normal(mean, dev, (n, 4)))]
    kind = "id long, f0 double, f1 double, f2 double, f3 double, label string"
    train = spark.createDataFrame(rows(220, 0, 1, "BENIGN", 0), kind)
    evaluation = spark.createDataFrame(rows(120, 0, 1, "BENIGN", 1000) + rows(60, 5, 0.9, "Attack", 2000), kind)
    forest = iforest.fit(train, names, ["id"], trees=60)
    scored = forest.transform(evaluation).select((F.col("label") != "BENIGN").cast("int").alias("label"), F.col("decision").alias("score"))
    m = thresholds.calibrated(scored, 0.05)
    assert (m["benign_support"], m["attack_support"], m["selection_policy"]) == (120, 60, "supervised_fp_bound")
    assert m["recall"] > 0.9 and m["fpr"] <= 0.05 and isinstance(m["threshold"], float)
    assert thresholds.calibrated(scored.filter("label = 0"), 0.08)["selection_policy"] == "unsupervised_fp_quantile"
    assert thresholds.calibrated(scored.limit(0))["selection_policy"] == "invalid_input"
    made = iforest.train(evaluation, "label", names, ["id"], trees=40, test=0.4)
    made.save(spark, f"{tmp_path}/m")
    again = iforest.Detector.load(spark, f"{tmp_path}/m")
    one, two = ({r["id"]: r["decision"] for r in d.score(evaluation).collect()} for d in (made, again))
    assert one == pytest.approx(two) and again.calibration == made.calibration
    with pytest.raises(ValueError, match="too little normal traffic"):
        iforest.train(evaluation.filter("label = 'Attack'"), "label", names, ["id"])


def test_calibration_has_as_many_candidates_for_many_rows(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    y = (rng.random(20_000) < 0.2).astype(int)
    x = rng.normal(0, 1, len(y)) - 2 * y
    cuts = np.unique(np.quantile(x, [0.001 + k * (0.994 / 899) for k in range(900)]))
    tp, fp = (np.searchsorted(np.sort(x[y == k]), cuts) for k in (1, 0))
    recall, fpr = tp / (y == 1).sum(), fp / (y == 0).sum()
    most = recall[fpr <= 0.05].max()
    m = thresholds.calibrated(spark.createDataFrame(list(zip(y.tolist(), x.tolist())), "label int, score double"), 0.05)
    assert m["recall"] == pytest.approx(most, abs=1e-12)
    assert m["threshold"] == pytest.approx(cuts[(fpr <= 0.05) & (recall == most)].min(), abs=1e-9)


def test_history_is_appended_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    for _ in range(2):
        history.appended(rows, f"{tmp_path}/s", "7")
    assert spark.read.parquet(f"{tmp_path}/s").count() == 2
