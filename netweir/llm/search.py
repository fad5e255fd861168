"""Ranked lexical search with documents streamed through an inverted index of the queries.

The items' terms are an inverted index of bounded size that is broadcast.  A first pass over the documents counts how many hold
each term of the index, and their terms in all; a second scores each document against the items it shares terms with and keeps
a bounded heap for each item and task.  The heaps are merged in two steps.  Items whose texts are beyond the bound are searched
in blocks, each against all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, pieces, tidy

#: Bytes of items' texts in one index, about; a broadcast index takes some ten times as much.
INDEX_BYTES = 4 << 20
#: Scores that are held at once, documents times items.
CELLS = 1 << 21
#: Tasks' heaps are merged in so many groups first.
GROUPS = 64
#: Each byte as itself if it belongs to a term, A-Z lower-cased, else as a blank; all bytes of other letters belong to terms.
FOLD = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order, A-Z lower-cased; none of a null."""
    return (text or b"").translate(FOLD).split()


class Index:
    """The terms of some items by number, and for each term the items that have it: ``of[start[t]:start[t + 1]]``."""

    def __init__(self, items: list[bytes | None]):
        held = [sorted(set(terms(x))) for x in items]
        self.items = len(items)
        self.number = {t: k for k, t in enumerate(sorted({t for h in held for t in h}))}
        pairs = sorted((self.number[t], k) for k, h in enumerate(held) for t in h)
        self.start = np.searchsorted([t for t, _ in pairs], np.arange(len(self.number) + 1))
        self.of = np.array([k for _, k in pairs], np.int64)

    def found(self, text: bytes | None) -> tuple[int, Counter]:
        """How many terms a text has, and how often it has each of the index."""
        words = terms(text)
        c = Counter(map(self.number.get, words))
        c.pop(None, None)
        return len(words), c


def texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()


def statistics(docs: DataFrame, index) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and documents with each term of the (broadcast) index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = index.value
        some, total, df = 0, 0, np.zeros(len(x.number), np.int64)
        for b in batches:
            for text in texts(b):
                n, c = x.found(text)
                some += n > 0
                total += n
                df[list(c)] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((at, [-1, -2]))), pa.array(np.concatenate((df[at], [some, total])))], ["term", "n"])

    bounded(docs.sparkSession)
    counts = docs.select("text").mapInArrow(tidy(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row a term
    got = {r["term"]: r["n"] for r in counts}
    return got.get(-1, 0), got.get(-2, 0), np.array([got.get(k, 0) for k in range(len(index.value.number))], np.int64)


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))) for each term."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)


def shares(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What a term that a document of n terms holds tf times counts, before its weight."""
    m = 10 + (90 * n * documents) // max(total, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Heaps:
    """The ``top`` best (score, id) of each item; of equal scores least ids first, no id last."""

    def __init__(self, items: int, top: int):
        self.top, self.least = top, np.ones(items, np.int64)
        self.item, self.score, self.doc, self.none = (np.zeros(0, np.int64) for _ in range(4))

    def take(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, none: np.ndarray) -> None:
        good = score >= self.least[item]
        item, score, doc, none = (np.concatenate((a, b[good])) for a, b in ((self.item, item), (self.score, score), (self.doc, doc), (self.none, none)))
        order = np.lexsort((doc, none, -score, item))
        item = item[order]
        first = np.searchsorted(item, item)  # where an item's entries begin
        place = np.arange(len(item)) - first
        keep = place < self.top
        full = place == self.top - 1
        self.least[item[full]] = score[order][full]
        self.item, self.score, self.doc, self.none = item[keep], score[order][keep], doc[order][keep], none[order][keep]


def best(docs: DataFrame, index, weight: np.ndarray, documents: int, total: int, top: int) -> DataFrame:
    """(item, doc_id, score): every task's best documents of each item of the (broadcast) index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = index.value
        heaps, step = Heaps(x.items, top), max(1, CELLS // max(1, x.items))
        for b in batches:
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                row, term, tf, size = [], [], [], []
                for k, text in enumerate(texts(part)):
                    n, c = x.found(text)
                    row.extend([k] * len(c))
                    term.extend(c.keys())
                    tf.extend(c.values())
                    size.extend([n] * len(c))
                if not row:
                    continue
                row, term, tf, size = (np.array(v, np.int64) for v in (row, term, tf, size))
                gain = weight[term] * shares(tf, size, documents, total)
                lengths = x.start[term + 1] - x.start[term]
                ends = np.cumsum(lengths)
                place = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths) + np.repeat(x.start[term], lengths)
                cells = np.zeros(part.num_rows * x.items, np.int64)
                np.add.at(cells, np.repeat(row * x.items, lengths) + x.of[place], np.repeat(gain, lengths))
                at = np.flatnonzero(cells)
                ids = part.column(part.schema.get_field_index("id"))
                none = np.asarray(ids.is_null().to_numpy(zero_copy_only=False), np.int64)
                doc = ids.fill_null(0).to_numpy(zero_copy_only=False)
                heaps.take(at % x.items, cells[at], doc[at // x.items], none[at // x.items])
        if len(heaps.item):
            doc = pa.array(heaps.doc, mask=heaps.none.astype(bool))
            yield pa.RecordBatch.from_arrays([pa.array(heaps.item), doc, pa.array(heaps.score)], ["item", "doc_id", "score"])

    bounded(docs.sparkSession)
    return docs.select("id", "text").mapInArrow(tidy(run), "item long, doc_id long, score long")


def merged(found: DataFrame, top: int, by: list[str]) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def ranked(docs: DataFrame, items: DataFrame, top: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of each item with a score over 0.

    Null and empty texts have no terms: such documents are found by no item, such items find nothing.  Rows of docs are
    documents each, also where ids repeat; ids are whole numbers; a document without an id comes last of equal scores.  Items
    that repeat id and text are one; of an id with several texts each text has ranks of its own.  Empty tables give none.
    Other columns are not looked at.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    asked = items.select(F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("text")).distinct()
    number = pieces(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0, index_bytes)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(number))
    out = None
    for k in range(number):
        rows = asked.filter(block == k).sort("item_id", "text").collect()  # index_bytes of text, about
        index = spark.sparkContext.broadcast(Index([None if r["text"] is None else r["text"].encode() for r in rows]))
        documents, total, df = statistics(own, index)
        found = best(own, index, weights(df, documents), documents, total, top)
        found = merged(merged(found.withColumn("group", F.spark_partition_id() % GROUPS), top, ["item", "group"]), top, ["item"])
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item long, item_id {asked.schema['item_id'].dataType.simpleString()}")
        one = found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = one if out is None else out.unionByName(one)
    return out
