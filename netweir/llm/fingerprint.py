"""Document fingerprints: content-defined chunks by a normalised gear hash, and digest sets weighted by chunk length.

A cut falls after a byte where the gear hash of the bytes before it has some zero bits: many bits up to the normal chunk
size, few beyond it, so sizes stay near the normal one.  Cuts depend on nearby bytes only, so text that moves keeps its
chunks.  A fingerprint is the sorted set of (32-bit digest, length) of the chunks, in base64; the likeness of one to another
is the share of its length whose chunks the other holds.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, mix, parts, tidy, total_bytes

LEAST, NORMAL, MOST, WINDOW = 6, 24, 96, 16
#: Bits that must be zero before and after the normal size; high bits, which all bytes of the window reach.
STRICT, LOOSE = np.uint32(0x3F << 20), np.uint32(0x07 << 20)
GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
CHUNK = np.dtype([("digest", "<u4"), ("length", "u1")])


def cuts(data: bytes) -> list[int]:
    """End offsets of the chunks of some bytes."""
    n = len(data)
    h = GEAR[np.frombuffer(data, np.uint8)]
    k = 1
    while k < WINDOW:  # the hash over 2k bytes from two hashes over k bytes
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
        k *= 2
    at = np.arange(n, dtype=np.int64)

    def following(mask: np.uint32) -> np.ndarray:
        """For each offset the first cut place at or after it; n - 1 where there is none."""
        return np.minimum.accumulate(np.where(h & mask == 0, at, n - 1)[::-1])[::-1]

    strict, loose = following(STRICT), following(LOOSE)
    early = strict[np.minimum(at + LEAST - 1, n - 1)]
    late = np.minimum(loose[np.minimum(at + NORMAL - 1, n - 1)], np.minimum(at + MOST - 1, n - 1))
    end = np.where(early < at + NORMAL - 1, early, late) + 1
    out, s = [], 0
    while s < n:
        s = end.item(s)
        out.append(s)
    return out


def chunk_set(text: str) -> np.ndarray:
    """Sorted distinct chunks of a text."""
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return np.zeros(0, CHUNK)
    ends = cuts(data)
    digest = xxhash.xxh32_intdigest
    return np.unique(np.array([(digest(data[a:b]), b - a) for a, b in zip([0, *ends], ends)], CHUNK))


def packed(chunks: np.ndarray) -> str:
    """The fingerprint as text."""
    return base64.b64encode(chunks.tobytes()).decode()


def unpacked(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), CHUNK)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Share of a's length in chunks that b holds too; two empty sets are alike, an empty and another one are not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    shared = np.intersect1d(a, b, assume_unique=True)
    return float(shared["length"].sum(dtype=np.int64) / a["length"].sum(dtype=np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row; null and empty texts have the empty fingerprint, repeated rows equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([packed(chunk_set(x or "")) for x in b.column(1).to_pylist()], pa.string())], ["id", "fingerprint"])

    bounded(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(tidy(run), f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


#: The most bounds of ranges of ids that a plan holds.
BOUNDS = 256
#: Ranges whose first ids are few enough for every task to have them all; beyond, rows meet them by a shuffle.
FEW_RANGES = 100_000
#: Ranges that are looked at together to find which follows which.
BLOCK = 1000


def range_bucket(value: Column, bounds: list[int], each: int) -> Column:
    """A number that grows with the value: the range between two of the sorted bounds that it is in, and which of ``each`` equal
    parts of that range.  The bounds include the least and the greatest value; null is in the first range."""
    if len(bounds) < 2:
        return F.lit(0).cast("long")
    all_ = F.array(*map(F.lit, bounds))
    k = F.least(F.greatest(F.size(F.filter(all_, lambda b: b <= value)) - 1, F.lit(0)), F.lit(len(bounds) - 2))
    low, high = F.get(all_, k).cast("double"), F.get(all_, k + 1).cast("double")
    part = F.least(F.greatest(F.floor((value.cast("double") - low) / (high - low) * each), F.lit(0)), F.lit(each - 1))
    return F.coalesce(k.cast("long") * each + part, F.lit(0)).cast("long")


def followers(tops: DataFrame, block: int = BLOCK) -> DataFrame:
    """(bucket, top) from (bucket, own): the ``own`` of the next bucket below, or for the least bucket the greatest of all.

    Buckets are looked at in blocks of ``block`` numbers side by side; what is carried from one block to the next is a row a
    block.  Nulls are carried as they are.
    """
    tops = tops.withColumn("block", F.floor(F.col("bucket") / block))
    w, across = Window.partitionBy("block").orderBy("bucket"), Window.orderBy("block")
    ends = tops.groupBy("block").agg(F.max_by(F.struct("own"), "bucket").alias("last"), F.max("own").alias("most"))
    first = F.row_number().over(across) == 1
    carried = ends.select("block", F.when(first, F.max("most").over(Window.partitionBy())).otherwise(F.lag("last.own").over(across)).alias("carried"))
    inside = tops.select("block", "bucket", F.lag("own").over(w).alias("below"), (F.row_number().over(w) == 1).alias("lowest"))
    return inside.join(carried, "block").select("bucket", F.when(F.col("lowest"), F.col("carried")).otherwise(F.col("below")).alias("top"))


def edited_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, whose last third is the beginning of the next document's text.

    Documents follow each other by falling id, repeated ids by text, null ids last; after the last comes the first.  A null
    text is empty.  Rows are dealt out by ranges of ids and read in order; each range also gets the one row that
    follows its last, so that no task holds more than two texts beside its batch.
    """
    spark = docs.sparkSession
    bounded(spark)
    d = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    n = 4 * parts(spark, total_bytes(d))
    k = min(n, BOUNDS)
    ends = d.agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.percentile_approx("id", [i / k for i in range(1, k)] or [0.5], 20 * k).alias("mid")).first()
    bounds = [] if ends["lo"] is None else sorted({ends["lo"], ends["hi"], *ends["mid"]})
    d = d.withColumn("bucket", range_bucket(F.col("id"), bounds, -(-n // k)))
    after = followers(d.groupBy("bucket").agg(F.max("id").alias("own")))
    if k * -(-n // k) <= FEW_RANGES:  # as many rows at most
        after = F.broadcast(after)
    firsts = d.drop("bucket").join(after, F.col("id").eqNullSafe(F.col("top")), "inner").groupBy("bucket").agg(F.min("text").alias("text"))
    rows = d.select("bucket", "id", "text", F.lit(False).alias("borrowed")).unionByName(firsts.select("bucket", F.lit(None).cast("long").alias("id"), "text", F.lit(True).alias("borrowed")))
    rows = rows.repartition(n // 4, "bucket").sortWithinPartitions("bucket", "borrowed", F.desc_nulls_last("id"), "text")
    sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # bucket, id, text, chunks of the row before
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                out: list[tuple] = []
                for bucket, key, text, borrowed in zip(*(c.to_pylist() for c in batch.slice(i, 1000).columns)):
                    chunks = chunk_set(text)
                    if before and before[0] == bucket:
                        k = len(before[2]) // 3
                        edited = before[2][: len(before[2]) - k] + text[:k]
                        other = chunk_set(edited)
                        out.append((before[1], len(before[2]), sha(edited), packed(before[3]), packed(other), containment(before[3], other), containment(before[3], chunks)))
                    before = None if borrowed else (bucket, key, text, chunks)
                if out:
                    yield pa.record_batch([pa.array(c) if j else pa.array(c, pa.int64()) for j, c in enumerate(zip(*out))], names=names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInArrow(tidy(run), schema)
