"""WARC archives: a writer, and a normaliser that makes monolithic gzip archives seekable.

A monolithic archive is one gzip stream over all its records.  The normaliser inflates it once from its start, rewrites
each record as a gzip member of its own, and writes a sidecar index with each member's offset and length; any record can
then be read alone.  Archives are files in a folder that driver and executors share; each task writes its own, under a
temporary name that is moved to the final one when the file is whole, so a task that runs again replaces its own files.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_dir

ARCHIVE_BYTES, READ_BYTES, LEVEL = 32 << 20, 1 << 20, 4
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: int | None) -> str:
    return f"<urn:x-page:{'' if key is None else key}>"


def key_of(record_id_: str) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", record_id_)
    return int(found[1]) if found else None


def record(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A response record with its HTTP head and payload, or a revisit record with the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    uri = re.sub(r"[\x00-\x20\x7f]+", "%20", url or "") or f"urn:x-page:{key}"
    fields = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(key)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        fields += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    fields += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(["WARC/1.1", *fields]).encode() + END + block + END


def fields_of(head: bytes) -> dict[str, str]:
    """Fields of a record's or an HTTP message's head by lower-case name."""
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records from the bytes of an archive, however they are cut."""
    have = bytearray()
    for chunk in chunks:
        have += chunk
        while (at := have.find(END)) >= 0:
            size = at + len(END) + int(fields_of(bytes(have[:at]))["content-length"]) + len(END)
            if len(have) < size:
                break
            yield bytes(have[:size])
            del have[:size]
    if have.strip():
        raise ValueError("an archive ends within a record")


def inflated(stream, size: int = READ_BYTES) -> Iterator[bytes]:
    """The bytes of a gzip file, member by member if it has several, in pieces of bounded size."""
    z = zlib.decompressobj(31)
    rest = b""
    while data := rest or stream.read(size):
        rest = b""
        if out := z.decompress(data, size):
            yield out
        while z.unconsumed_tail and not z.eof:
            if out := z.decompress(z.unconsumed_tail, size):
                yield out
        if z.eof:
            rest, z = z.unused_data, zlib.decompressobj(31)


class Output:
    """A file that gets its final name when it is closed whole."""

    def __init__(self, folder: str, name: str):
        self.fs, base = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(base, recursive=True)
        self.path, self.draft = f"{base}/{name}", f"{base}/.{name}.{uuid.uuid4().hex}"
        self.stream, self.size = self.fs.open_output_stream(self.draft, compression=None), 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.stream.close()
        self.fs.move(self.draft, self.path)


#: A page with more copies than COPIES is dealt out over tasks; of such pages the HOT most common ones, about 6 MB of rows.
COPIES, HOT = 1000, 100_000


def rows_of(batches: Iterator[pa.RecordBatch], most: int = 200) -> Iterator[tuple]:
    for b in batches:
        for i in range(0, b.num_rows, most):
            yield from zip(*(c.to_pylist() for c in b.slice(i, most).columns))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for each row into monolithic gzip archives under ``folder``; (archive, records) of each file.

    The payload is the page in UTF-8, null as empty.  Of rows with equal payloads that of least id is the response and the
    others revisit it.  A null id is never the response of others; rows that repeat the least id are all responses.  A
    null url is written as the record's own id, and an empty table gives no file.  The files are written when this is called.

    Pages meet their response by digest.  The pages with the most copies, HOT at most, have theirs broadcast and are dealt
    out by their own ids and addresses, so that no task gets all copies of a very common page.
    """
    page = pages.select(pages[id_col].cast("long").alias("id"), pages[url_col].alias("url"), F.coalesce(pages[html_col], F.lit("")).cast("binary").alias("payload"))
    page = page.withColumn("sha", F.sha1("payload"))
    firsts = page.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    hot = firsts.filter(F.col("copies") > COPIES).orderBy(F.desc("copies"), "sha").limit(HOT).select("sha", F.struct("first").alias("common"))
    dealt = F.concat_ws("/", F.lit("own"), "id", "url")  # no digest, so nothing is found for it below
    page = page.join(F.broadcast(hot), "sha", "left").withColumn("sha", F.when(F.col("common").isNull(), F.col("sha")).otherwise(dealt))
    found = F.when(F.col("common").isNull(), F.col("first")).otherwise(F.col("common.first"))
    rows = page.join(firsts.drop("copies"), "sha", "left").select("id", "url", "payload", found.alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, z, names, counts, raw = None, None, [], [], 0
        for key, url, payload, first in rows_of(batches):
            if out is None:
                out = Output(folder, f"part-{TaskContext.get().partitionId():05d}-{len(names):04d}.warc.gz")
                z, raw = zlib.compressobj(LEVEL, wbits=31), 0
                names.append(out.path.rsplit("/", 1)[-1])
                counts.append(0)
            made = record(key, url, payload, payload_digest(payload), first, first is not None and key != first)
            out.write(z.compress(made))
            raw += len(made)
            counts[-1] += 1
            if raw >= ARCHIVE_BYTES:
                out.write(z.flush())
                out.close()
                out = None
        if out is not None:
            out.write(z.flush())
            out.close()
        if names:
            yield pa.record_batch([pa.array(names), pa.array(counts, pa.int64())], ["archive", "records"])

    return cut(rows.mapInArrow(run, "archive string, records long"))


def normalise(archives: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrite each archive with a gzip member for each record, and its index beside it; (archive, records, bytes) of each.

    The index has a line of JSON for each record: offset, length, type and id.  An archive without records gets empty files, no
    archives give no rows, and an archive that is named twice is written twice, the last one staying.  The files are written
    when this is called.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (name,) in rows_of(batches):
            store, base = fs.FileSystem.from_uri(source)
            out, index, n = Output(target, name), Output(target, f"{name}.idx"), 0
            with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                for data in records(inflated(stream)):
                    z = zlib.compressobj(LEVEL, wbits=31)
                    member = z.compress(data) + z.flush()
                    f = fields_of(data[: data.find(END)])
                    index.write(json.dumps({"offset": out.size, "length": len(member), "type": f["warc-type"], "id": f["warc-record-id"]}).encode() + b"\n")
                    out.write(member)
                    n += 1
            size = out.size
            out.close()
            index.close()
            yield pa.record_batch([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["archive", "records", "bytes"])

    spread = archives.select("archive").repartition(int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")), "archive")
    return cut(spread.mapInArrow(run, "archive string, records long, bytes long"))


def parsed(data: bytes) -> tuple:
    """(id, payload bytes, digest, type, id referred to, payload or None for a revisit) of a record."""
    at = data.find(END)
    f = fields_of(data[:at])
    block = data[at + len(END) : -len(END)]
    cut_ = block.find(END)
    kind = f["warc-type"]
    payload = block[cut_ + len(END) :] if kind == "response" else None
    digest = f["warc-payload-digest"].removeprefix("sha1:")
    if payload is not None and payload_digest(payload) != digest:
        raise ValueError(f"{f['warc-record-id']}: payload and digest differ")
    size = len(payload) if payload is not None else int(fields_of(block[:cut_])["content-length"])
    return key_of(f["warc-record-id"]), size, digest, kind, key_of(f.get("warc-refers-to", "")), payload


def read_archives(archives: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to, archive, offset[, payload]) of each record, by the index.

    A null id comes back as null, an empty payload as 0 bytes, and each archive's records as often as it is named.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (name,) in rows_of(batches):
            store, base = fs.FileSystem.from_uri(folder)
            with store.open_input_stream(f"{base}/{name}.idx", compression=None) as f:
                index = [json.loads(x) for x in f.read().splitlines()]
            with store.open_input_file(f"{base}/{name}") as f:
                for i in range(0, len(index), 500):
                    out = []
                    for x in index[i : i + 500]:
                        f.seek(x["offset"])
                        out.append((*parsed(zlib.decompress(f.read(x["length"]), 31)), name, x["offset"]))
                    k, n, d, t, r, p, a, o = map(list, zip(*out))
                    long = pa.int64()
                    made = [pa.array(k, long), pa.array(n, long), pa.array(d), pa.array(t), pa.array(r, long), pa.array(a), pa.array(o, long)]
                    yield pa.record_batch([*made, pa.array(p, pa.binary())] if payloads else made, names=names)

    kind = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long" + ", payload binary" * payloads
    names = [x.split(" ")[0] for x in kind.split(", ")]
    spread = archives.select("archive").repartition(int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")), "archive")
    return spread.mapInArrow(run, kind)


def drop_folder(folder: str) -> None:
    store, base = fs.FileSystem.from_uri(folder)
    store.delete_dir(base)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write pages to archives, normalise these, and read the normalised ones back.  The monolithic ones are removed."""
    folder = f"{uri(shared_dir(pages.sparkSession))}/warc-{uuid.uuid4().hex}"
    written = write_archives(pages, f"{folder}/monolithic")
    ready = normalise(written, f"{folder}/monolithic", f"{folder}/members")
    if not written.isEmpty():
        drop_folder(f"{folder}/monolithic")
    return read_archives(ready, f"{folder}/members")


def uri(folder: str) -> str:
    """A folder as Arrow's file systems want it."""
    return re.sub(r"^file:/(?!/)", "file:///", folder.rstrip("/"))
