"""Incremental line dedup: exact reference counts of lines, and sharded cuckoo filters in front of them.

An index has three tables, all cut into shards by key: ``refs`` says which document holds which line key, ``counts`` has the
exact reference count and the largest holder of each key that is in enough documents to be dropped, and ``filters`` has a
cuckoo filter of those keys for each shard.  Inserting documents raises counts and adds fingerprints; deleting documents
lowers counts and takes the fingerprints of keys out again, so the index is as if the documents had never been there.  A
change writes the shards that it touches; the rows of others stay where they lie.  A text's lines are dealt out to the filters
of their shards; only what these do not rule out is joined with the exact counts, which alone decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, grouped_tidy, map_arrow, mix, strings, tidy

BLANK = " \t\n\v\f\r"
SLOTS, MAX_KICKS = 4, 500
#: Keys in one filter shard, and how many lines of a shard are asked together; a shard of more lines is asked in parts.
SHARD_KEYS, PART_REFS = 1 << 14, 200_000
#: After so many changes the tables of an index are written as one again.
LAYERS = 16


def line_key(line: str, least: int) -> bytes | None:
    """The key of a line: blanks stripped at both ends, A-Z in lower case; None if it has fewer code points than ``least``."""
    key = line.strip(BLANK)
    return key.encode("utf-8", "surrogatepass").lower() if len(key) >= least else None


def digest(key: bytes) -> tuple[int, int]:
    """128 bits of a key, as two signed 64-bit numbers."""
    h = xxhash.xxh3_128_digest(key)
    return int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True)


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints, four to a bucket, over 64-bit hashes; bulk reads are vectorised.

    Equal hashes are stored once each time they are inserted, so that deletion stays exact for keys that were inserted.
    """

    def __init__(self, buckets: int):
        self.slots = np.zeros((buckets, SLOTS), np.uint16)

    @classmethod
    def of(cls, hashes: np.ndarray) -> Cuckoo:
        """A filter that holds the hashes, of a size that takes them."""
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, len(hashes)) / SLOTS / 0.8))))
        while True:
            made = cls(buckets)
            if all(made.insert(f, i, j) for f, i, j in zip(*(x.tolist() for x in made.places(hashes)))):
                return made
            buckets *= 2

    @classmethod
    def load(cls, data: bytes) -> Cuckoo:
        made = cls(0)
        made.slots = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return made

    def dump(self) -> bytes:
        return self.slots.tobytes()

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and the two buckets of each hash."""
        f = (hashes & np.uint64(0xFFFF)) | np.uint64(1)
        mask = np.uint64(len(self.slots) - 1)
        i = (hashes >> np.uint64(16)) & mask
        return f.astype(np.uint16), i.astype(np.int64), (i ^ (mix(f) & mask)).astype(np.int64)

    def insert(self, f: int, i: int, j: int) -> bool:
        slots, buckets = self.slots, np.uint64(len(self.slots))
        for b in (i, j):
            for s in range(SLOTS):
                if slots[b, s] == 0:
                    slots[b, s] = f
                    return True
        b = i
        for k in range(MAX_KICKS):
            f, slots[b, k % SLOTS] = int(slots[b, k % SLOTS]), f
            b = b ^ int(mix(np.array([f], np.uint64))[0] & (buckets - np.uint64(1)))
            for s in range(SLOTS):
                if slots[b, s] == 0:
                    slots[b, s] = f
                    return True
        return False

    def delete(self, f: int, i: int, j: int) -> bool:
        for b in (i, j):
            for s in range(SLOTS):
                if self.slots[b, s] == f:
                    self.slots[b, s] = 0
                    return True
        return False

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        f, i, j = self.places(hashes)
        return (self.slots[i] == f[:, None]).any(1) | (self.slots[j] == f[:, None]).any(1)


def places(hashes: np.ndarray, buckets: np.ndarray | np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    f = (hashes & np.uint64(0xFFFF)) | np.uint64(1)
    mask = buckets - np.uint64(1)
    i = (hashes >> np.uint64(16)) & mask
    return f.astype(np.uint16), i.astype(np.int64), (i ^ (mix(f) & mask)).astype(np.int64)


def line_refs(docs: DataFrame, least: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, id): the keys of each row's lines, each once a row; rows without an id give none."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        k1, k2, ids = [], [], []
        for i, text in zip(b.column(0).to_pylist(), strings(b, "text")):
            if i is not None:
                own = {digest(k) for x in text.split("\n") if (k := line_key(x, least)) is not None}
                k1 += [k[0] for k in own]
                k2 += [k[1] for k in own]
                ids += [i] * len(own)
        return pa.record_batch([pa.array(x, pa.int64()) for x in (k1, k2, ids)], ["k1", "k2", "id"]) if ids else None

    return map_arrow(docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")), run, "k1 long, k2 long, id long")


def made_filter(rows: pa.Table) -> pa.Table:
    """A filter of all keys of a shard."""
    made = Cuckoo.of(rows["k2"].to_numpy().view(np.uint64))
    return pa.table({"shard": rows["shard"][:1], "filter": pa.array([made.dump()], pa.binary())})


def changed_filter(old: pa.Table, changes: pa.Table) -> pa.Table:
    """A shard's filter after keys came in or went out; null for one that must be made anew, as it is new or full."""
    shard = (old if len(old) else changes)["shard"][0].as_py()
    made = Cuckoo.load(old["filter"][0].as_py()) if len(old) else None
    fine = made is not None
    if fine and len(changes):
        hashes = changes["k2"].to_numpy().view(np.uint64)
        was, now = (changes[c].to_numpy().astype(bool) for c in ("was", "now"))
        for f, i, j in zip(*(x.tolist() for x in made.places(hashes[was & ~now]))):
            fine = fine and made.delete(f, i, j)
        for f, i, j in zip(*(x.tolist() for x in made.places(hashes[now & ~was]))):
            fine = fine and made.insert(f, i, j)
    return pa.table({"shard": pa.array([shard], pa.int32()), "filter": pa.array([made.dump() if fine else None], pa.binary())})


def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by shard and part, each part's filter first, the line keys that their filter may hold."""
    own = None
    for b in batches:
        k2 = b.column(1).to_numpy().view(np.uint64)
        may = np.zeros(b.num_rows, bool)
        heads = np.flatnonzero(b.column(3).to_numpy(zero_copy_only=False))
        for i, j in zip([-1, *heads.tolist()], [*heads.tolist(), b.num_rows]):
            if i >= 0:
                data = b.column(4)[i].as_py()
                own = Cuckoo.load(data) if data else None
            if own is not None and j > i + 1:
                may[i + 1 : j] = own.contains(k2[i + 1 : j])
        yield pa.RecordBatch.from_arrays(b.columns[:3], ["k1", "k2", "id"]).filter(pa.array(may))


def numbers(df: DataFrame) -> list[int]:
    """The shards that a table has rows of, one for SHARD_KEYS keys of the index."""
    return sorted(r["shard"] for r in df.select("shard").distinct().collect())


def within(df: DataFrame, shards: list[int]) -> DataFrame:
    return df.filter(F.col("shard").isin(shards))


def without(df: DataFrame, shards: list[int]) -> DataFrame:
    return df.filter(~F.col("shard").isin(shards))


@dataclass(frozen=True)
class LineIndex:
    """An index of lines; all changes give a new index, and the tables of the old one stay as they are.

    ``keys`` is the number of counted keys, None if it is not known yet, and ``layers`` how many changes lie over the base.
    """

    spark: SparkSession
    refs: DataFrame | None = None
    counts: DataFrame | None = None
    filters: DataFrame | None = None
    shards: int = 1
    keys: int | None = None
    layers: int = 0
    least: int = 40
    min_docs: int = 5

    def _shard(self, df: DataFrame, shards: int | None = None) -> DataFrame:
        return df.withColumn("shard", F.pmod("k1", F.lit(shards or self.shards)).cast("int"))

    def _counted(self, refs: DataFrame) -> DataFrame:
        return refs.groupBy("shard", "k1", "k2").agg(F.count("*").alias("n_docs"), F.max("id").alias("last")).filter(F.col("n_docs") >= self.min_docs)

    def _made(self, counts: DataFrame) -> DataFrame:
        return counts.select("shard", "k2").groupBy("shard").applyInArrow(grouped_tidy(made_filter), "shard int, filter binary")

    def _fresh(self, refs: DataFrame) -> LineIndex:
        """An index of all refs, with as many shards as its keys ask for."""
        counts = cut(self._counted(self._shard(refs, 1)))
        keys = counts.count()
        shards = max(1, -(-keys // SHARD_KEYS))
        counts = self._shard(counts, shards)
        return replace(self, refs=self._shard(refs, shards), counts=counts, filters=cut(self._made(counts)), shards=shards, keys=keys, layers=0)

    def _changed(self, old: DataFrame, new: DataFrame, touched: DataFrame, shards: list[int]) -> LineIndex:
        """The index in whose ``shards`` the refs are ``old``, those that stay where they lie, and ``new``.

        ``touched`` has the (shard, k1, k2) whose holders changed.  Keys are counted, filters changed and both written in these
        shards alone; the rows of others stay in the tables where they lie.  So a table is a base and a layer for each change,
        written as one again after LAYERS changes.
        """
        key = ["shard", "k1", "k2"]
        refs = old.unionByName(new)
        had = within(self.counts, shards)
        was = had.join(touched, key, "left_semi")
        now = cut(self._counted(within(refs, shards).join(touched, key, "left_semi")))
        counts = cut(had.join(touched, key, "left_anti").unionByName(now))
        keys = (self.counts.count() if self.keys is None else self.keys) + counts.count() - had.count()
        if keys > 2 * self.shards * SHARD_KEYS:
            return self._fresh(cut(refs.drop("shard")))
        mark = lambda t, n: t.select(*key, F.lit(1).alias(n))
        changes = mark(was, "was").join(mark(now, "now"), key, "full_outer").select("shard", "k2", F.coalesce("was", F.lit(0)).alias("was"), F.coalesce("now", F.lit(0)).alias("now"))
        asked = within(self.filters, shards).groupBy("shard").cogroup(changes.groupBy("shard"))
        made = cut(asked.applyInArrow(grouped_tidy(changed_filter), "shard int, filter binary"))
        again = self._made(counts.join(made.filter("filter is null"), "shard", "left_semi"))
        filters = cut(made.filter("filter is not null").unionByName(again))
        tables = {"refs": refs, "counts": without(self.counts, shards).unionByName(counts), "filters": without(self.filters, shards).unionByName(filters)}
        layers = (self.layers + 1) % LAYERS
        return replace(self, **(tables if layers else {n: cut(t) for n, t in tables.items()}), keys=keys, layers=layers)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """Add documents.  Ids that are there already gain the new lines; rows without an id are not indexed."""
        bounded(self.spark)
        new = line_refs(docs, self.least, id_col, text_col).distinct()
        if self.refs is None:
            return self._fresh(cut(new))
        new = cut(self._shard(new))
        shards = numbers(new)
        new = cut(new.join(within(self.refs, shards), ["shard", "k1", "k2", "id"], "left_anti"))
        shards = numbers(new)
        return self._changed(self.refs, new, new.select("shard", "k1", "k2").distinct(), shards) if shards else self

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        """Take documents out again; ids that are not there change nothing.  Refs lie by key, so all are read for their ids once."""
        if self.refs is None:
            return self
        gone = ids.select(ids[id_col].cast("long").alias("id")).distinct()
        touched = cut(self.refs.join(gone, "id", "left_semi").select("shard", "k1", "k2").distinct())
        shards = numbers(touched)
        if not shards:
            return self
        stay = cut(within(self.refs, shards).join(gone, "id", "left_anti"))
        return self._changed(without(self.refs, shards), stay, touched, shards)

    def possible(self, refs: DataFrame) -> DataFrame:
        """The (k1, k2, id) of refs whose key their shard's filter may hold.

        Refs are dealt out by shard, and those of a shard that has many, as one with a very common line does, by id as well;
        each part's filter comes before its refs, which then pass by without being gathered.
        """
        sizes = refs.groupBy("shard").agg(F.ceil(F.count("*") / PART_REFS).cast("int").alias("parts"))
        zero = F.lit(0).cast("long")
        heads = sizes.join(self.filters, "shard", "left").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), zero.alias("k1"), zero.alias("k2"), zero.alias("id"), F.lit(True).alias("head"), "filter")
        rows = refs.join(sizes, "shard").select("shard", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "k1", "k2", "id", F.lit(False).alias("head"), F.lit(None).cast("binary").alias("filter"))
        dealt = heads.unionByName(rows).repartition("shard", "part").sortWithinPartitions("shard", "part", F.desc("head"))
        return dealt.select("k1", "k2", "id", "head", "filter").mapInArrow(tidy(asked), "k1 long, k2 long, id long")

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), refs: DataFrame | None = None) -> DataFrame:
        """(id, text, n_lines, n_dropped, *keep): each row's text without the lines that a document of larger id holds too.

        A key of at least ``least`` code points in at least ``min_docs`` documents loses all its lines but those of its
        largest holder.  Null or empty texts are one empty line.  Rows without an id keep all lines; rows that repeat an id
        are the same document and lose the same lines.  ``refs`` are those of docs, if they are known.
        """
        bounded(self.spark)
        refs = self._shard(line_refs(docs, self.least, id_col, text_col).distinct()) if refs is None else refs
        drop = self.possible(refs).join(self.counts.drop("shard"), ["k1", "k2"]).filter(F.col("id") < F.col("last")).groupBy("id").agg(F.collect_list(F.struct("k1", "k2")).alias("drop"))
        others = [f"_k{n}" for n in range(len(keep))]
        rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"), *(docs[c].alias(o) for c, o in zip(keep, others))).join(drop, "id", "left")
        least = self.least

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            kept, lines, dropped = [], [], []
            for text, keys in zip(strings(b, "text"), b.column(2).to_pylist()):
                all_ = text.split("\n")
                stay = all_
                if keys:
                    out = {(k["k1"], k["k2"]) for k in keys}
                    stay = [x for x in all_ if (k := line_key(x, least)) is None or digest(k) not in out]
                kept.append("\n".join(stay))
                lines.append(len(all_))
                dropped.append(len(all_) - len(stay))
            made = [pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
            return pa.record_batch([b.column(0), *made, *b.columns[3:]], ["id", "text", "n_lines", "n_dropped", *others])

        kinds = "".join(f", {o} {docs.schema[c].dataType.simpleString()}" for c, o in zip(keep, others))
        out = map_arrow(rows.select("id", "text", "drop", *others), run, "id long, text string, n_lines long, n_dropped long" + kinds)
        return out.select(F.col("id").alias(id_col), "text", "n_lines", "n_dropped", *(F.col(o).alias(c) for c, o in zip(keep, others)))

    def save(self, path: str) -> None:
        """Write the three tables under a new folder, each shard in a folder of its own, so that changes read only theirs."""
        for name in ("refs", "counts", "filters"):
            getattr(self, name).write.partitionBy("shard").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, shards: int, **given) -> LineIndex:
        kinds = {"refs": "k1 long, k2 long, id long, shard int", "counts": "k1 long, k2 long, n_docs long, last long, shard int", "filters": "filter binary, shard int"}
        return cls(spark, *(spark.read.schema(k).parquet(f"{path}/{name}") for name, k in kinds.items()), shards=shards, **given)


def dedup_lines(docs: DataFrame, least: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Index a corpus and apply the index to it: (id, text, n_lines, n_dropped, *keep); see LineIndex.apply."""
    index = LineIndex(docs.sparkSession, least=least, min_docs=min_docs).insert(docs, id_col, text_col)
    return index.apply(docs, id_col, text_col, keep, index.refs)
