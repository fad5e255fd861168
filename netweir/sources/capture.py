"""A data source for packet captures: header fields of each packet as rows, a large capture in several tasks.

A classic capture is cut into ranges of bytes.  A first job walks each range from the first place that looks like a record, from
record to record without reading frames, and gives back where it began, where it ended and how many packets it has; a range whose
begin is not the end of the one before is walked again from there.  So ranges meet exactly and packets are numbered through the
file.  Captures of blocks carry state from block to block and are one task each.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = (
    "capture_id string, pkt_no bigint, ts timestamp, ts_s double, ip_version int, is_arp boolean, frag_offset int, src_ip string, dst_ip string,"
    " src_port int, dst_port int, protocol int, pkt_len int, ip_hdr_len int, l4_hdr_len int, tcp_flags string, parse_status string"
)
FLAGS = "FSRPAUEC"
NANO, MICRO, SECTION = 0xA1B23C4D, 0xA1B2C3D4, b"\x0a\x0d\x0d\x0a"
# Link types of captures.
LOOPBACK, ETHERNET, RAW, COOKED, IPV4, COOKED2 = 0, 1, 101, 113, 228, 276
BATCH = 5000
#: Bytes of a capture in one task, the longest frame, and how many records in a row make a place look like one.
SPLIT_BYTES, LONGEST, CHAIN = 64 << 20, 1 << 18, 5
WINDOW = 1 << 20


class Range(InputPartition):
    """Bytes start to end of a capture, whose first packet has the number ``first``; end None: up to its end."""

    def __init__(self, path: str, start: int, end: int | None, first: int):
        self.path, self.start, self.end, self.first = path, start, end, first


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        given = options.get("ranges")
        paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]
        self.ranges = [Range(*r) for r in json.loads(given)] if given else [Range(p, 0, None, 1) for p in paths]

    def partitions(self) -> list[Range]:
        return self.ranges

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        name, kind = partition.path.rsplit("/", 1)[-1], arrow_schema()
        with opened(partition.path) as f:
            rows: list[tuple] = []
            for k, (seconds, frame, size, link) in enumerate(packets(f, partition.start, partition.end), partition.first):
                rows.append(row(name, k, seconds, frame, size, link))
                if len(rows) == BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind.types)], schema=kind)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind.types)], schema=kind)


def opened(path: str) -> pa.NativeFile:
    store, inner = fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")
    return store.open_input_file(inner)


def arrow_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "timestamp": pa.timestamp("us", "UTC"), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in SCHEMA.split(","))])


class CaptureSource(DataSource):
    """``spark.read.format("capture").option("paths", "a.pcap,b.pcap")``; files must be readable on every worker."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self.options)


class Records:
    """The records of an open classic capture."""

    def __init__(self, f, head: bytes):
        for self.order in "<>":
            magic, *_, link = struct.unpack(self.order + "IHHiIII", head)
            if magic in (NANO, MICRO):
                break
        else:
            raise ValueError("not a packet capture")
        self.f, self.size, self.link, self.units = f, f.size(), link & 0xFFFF, 1_000_000_000 if magic == NANO else 1_000_000

    def header(self, at: int) -> tuple[int, int, int, int] | None:
        """(seconds, fraction, bytes kept, bytes on the wire) of a record, None if the file is cut there."""
        self.f.seek(at)
        h = self.f.read(16)
        return struct.unpack(self.order + "IIII", h) if len(h) == 16 else None

    def sound(self, h: tuple[int, int, int, int]) -> bool:
        return h[1] < self.units and h[2] <= LONGEST

    def next(self, at: int) -> int:
        """The first place from ``at`` on that looks like a record, being followed by others or by the end of the file."""
        while at < self.size:
            self.f.seek(at)
            data = np.frombuffer(self.f.read(WINDOW + 15), np.uint8)
            n = len(data) - 15
            if n <= 0:
                break
            word = lambda k, data=data, n=n: np.lib.stride_tricks.sliding_window_view(data, 4)[k : k + n].copy().view(self.order + "u4").reshape(-1)
            good = (word(4) < self.units) & (word(8) <= LONGEST) & (word(8) <= word(12)) & (word(12) <= LONGEST) & (word(12) > 0)
            for i in np.flatnonzero(good).tolist():
                if self.chained(at + i):
                    return at + i
            at += n
        return self.size

    def chained(self, at: int) -> bool:
        first = None
        for _ in range(CHAIN):
            h = self.header(at)
            if h is None:
                return at == self.size and first is not None
            first = h[0] if first is None else first
            if not (self.sound(h) and 0 < h[3] <= LONGEST and h[2] <= h[3] and abs(h[0] - first) < 1 << 25):
                return False
            at += 16 + h[2]
            if at > self.size:
                return False
        return True

    def walk(self, at: int, end: int) -> Iterator[tuple[int, tuple[int, int, int, int]]]:
        """(place, header) of each record that begins before ``end``.  After a record that can't be one, reading goes on at the next
        place that looks like one; a cut last record is passed over.  ``at`` is left at the first place beyond."""
        self.at = at
        while self.at < end:
            h = self.header(self.at)
            if h is None:
                self.at = self.size
            elif not self.sound(h):
                self.at = self.next(self.at + 1)
            elif self.at + 16 + h[2] > self.size:
                self.at = self.size if self.size - self.at <= LONGEST + 16 and self.next(self.at + 1) >= self.size else self.next(self.at + 1)
            else:
                yield self.at, h
                self.at += 16 + h[2]


def packets(f, start: int = 0, end: int | None = None) -> Iterator[tuple[float, bytes, int, int]]:
    """(seconds, frame, length on the wire, link type) of each record of a capture, classic or of blocks, between two places."""
    head = f.read(24)
    if head[:4] == SECTION:
        f.seek(8)
        yield from blocks(f, head[:8])
        return
    if len(head) < 24:
        raise ValueError("not a packet capture")
    r = Records(f, head)
    for at, (s, part, kept, size) in r.walk(max(start, 24), r.size if end is None else end):
        f.seek(at + 16)
        yield s + part / r.units, f.read(kept), size, r.link


def walked(path: str, start: int, end: int, exact: bool) -> tuple[int, int, int]:
    """(begin, end, packets) of the records that begin in a range: from ``start`` if that is exact, else from where one seems to."""
    with opened(path) as f:
        r = Records(f, f.read(24))
        begin = max(start, 24) if exact else r.next(max(start, 24))
        n = sum(1 for _ in r.walk(begin, end))
        return begin, r.at, n


def split(spark: SparkSession, paths: list[str], split_bytes: int = SPLIT_BYTES) -> list[tuple[str, int, int | None, int]]:
    """(path, start, end, first number) of the ranges that some captures are read in; the driver takes a row a range."""
    whole, cut = [], []
    for p in paths:
        with opened(p) as f:
            if f.read(4) == SECTION or f.size() <= split_bytes:
                whole.append((p, 0, None, 1))
            else:
                cut += [(p, at, min(at + split_bytes, f.size()), at == 0) for at in range(0, f.size(), split_bytes)]
    if not cut:
        return whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                begin, end, n = walked(r["path"], r["start"], r["end"], r["exact"])
                yield pa.RecordBatch.from_pylist([{**r, "begin": begin, "to": end, "n": n}])

    kind = "path string, start long, end long, exact boolean"
    asked = spark.createDataFrame(cut, kind).repartition(len(cut))
    found = sorted(asked.mapInArrow(run, f"{kind}, begin long, to long, n long").collect(), key=lambda r: (r["path"], r["start"]))
    out, last, at, number = [], None, 0, 1
    for r in found:
        if r["path"] != last:
            last, at, number = r["path"], 24, 1
        begin, end, n = r["begin"], r["to"], r["n"]
        if begin != at and at < r["end"]:  # it began amid a record
            begin, end, n = walked(r["path"], at, r["end"], True)
        if at < r["end"]:
            out.append((r["path"], at, r["end"], number))
            at, number = end, number + n
    return whole + out


def blocks(f, head: bytes) -> Iterator[tuple[float, bytes, int, int]]:
    """Packets of a capture made of blocks; blocks of other kinds are passed over.  A section has its own byte order and interfaces,
    an interface its link type and the unit of its times."""
    order, interfaces = "<", []
    while len(head) == 8:
        if head[:4] == SECTION:
            magic = f.read(4)
            order, interfaces = ("<" if magic == b"\x4d\x3c\x2b\x1a" else ">"), []
            size = struct.unpack(order + "I", head[4:])[0]
            body = magic + f.read(size - 12)
        else:
            size = struct.unpack(order + "I", head[4:])[0]
            body = f.read(size - 8)
        if size < 12 or len(body) < size - 8:
            return
        kind, body = struct.unpack(order + "I", head[:4])[0], body[:-4]
        if kind == 1:  # an interface
            unit, at = 1e-6, 8
            while at + 4 <= len(body):
                code, n = struct.unpack(order + "HH", body[at : at + 4])
                if code == 9 and n:
                    x = body[at + 4]
                    unit = 2.0 ** -(x & 0x7F) if x & 0x80 else 10.0**-x
                if code == 0:
                    break
                at += 4 + n + -n % 4
            interfaces.append((struct.unpack(order + "H", body[:2])[0], unit))
        elif kind == 6 and len(body) >= 20:  # a packet with its time
            which, high, low, kept, wire = struct.unpack(order + "IIIII", body[:20])
            link, unit = interfaces[which] if which < len(interfaces) else (ETHERNET, 1e-6)
            yield ((high << 32) + low) * unit, body[20 : 20 + kept], wire, link
        elif kind == 3 and len(body) >= 4 and interfaces:  # a packet without
            yield 0.0, body[4:], struct.unpack(order + "I", body[:4])[0], interfaces[0][0]
        head = f.read(8)


def layer3(frame: bytes, link: int) -> tuple[int, int]:
    """The protocol above the link layer, as Ethernet numbers it, and where it begins."""
    if link in (LOOPBACK, RAW, IPV4):
        at = 4 if link == LOOPBACK else 0
        return {4: 0x0800, 6: 0x86DD}.get(frame[at] >> 4, 0), at
    place, at = {COOKED: (14, 16), COOKED2: (0, 20)}.get(link, (12, 14))
    return struct.unpack("!H", frame[place : place + 2])[0], at


def row(name: str, number: int, seconds: float, frame: bytes, size: int, link: int = ETHERNET) -> tuple:
    """A packet's row."""
    ts = round(seconds * 1e6)
    none = (name, number, ts, seconds, 0, False, 0, None, None, 0, 0, 0, size, 0, 0, "")
    try:
        kind, at = layer3(frame, link)
        while kind in (0x8100, 0x88A8):  # VLAN tags
            kind, at = struct.unpack("!H", frame[at + 2 : at + 4])[0], at + 4
        if kind == 0x0806:
            return (*none[:5], True, *none[6:], "ok")
        if kind != 0x0800:
            return (*none, "non_ip")
        ip = frame[at:]
        header, protocol = (ip[0] & 15) * 4, ip[9]
        offset = struct.unpack("!H", ip[6:8])[0] & 0x1FFF
        sport = dport = l4 = 0
        flags = ""
        if protocol in (6, 17) and not offset:
            sport, dport = struct.unpack("!HH", ip[header : header + 4])
            l4 = (ip[header + 12] >> 4) * 4 if protocol == 6 else 8
            if protocol == 6:
                flags = "".join(x for k, x in enumerate(FLAGS) if ip[header + 13] >> k & 1)
        dotted = lambda b: ".".join(map(str, b))
        return (name, number, ts, seconds, 4, False, offset, dotted(ip[12:16]), dotted(ip[16:20]), sport, dport, protocol, size, header, l4, flags, "ok")
    except (struct.error, IndexError):
        return (*none, "corrupt")


def read(spark: SparkSession, paths: list[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The packets of some captures; files must be readable on the driver and on every worker."""
    spark.dataSource.register(CaptureSource)
    return spark.read.format("capture").option("ranges", json.dumps(split(spark, paths, split_bytes))).load()
