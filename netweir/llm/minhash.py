"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

A shingle is five words in a row; its weight is its count in the text times the mean inverse document frequency of its words.
Document frequencies are counted over all documents, in a table of SLOTS slots by a hash of the word, so the table's size
does not depend on the corpus.  Each text gets SAMPLES consistent weighted samples; texts that agree on all samples of a band
share a bucket.  Buckets of few texts give all their pairs.  Texts that larger buckets connect are a group: it is cut into
blocks by total weight, and each two blocks that may hold similar texts are compared whole, as matrices, so that counts of
links and a forest leave them, not pairs.  Pairs whose samples agree too seldom are put aside, all others that share a bucket
are verified by the exact weighted Jaccard similarity.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import grouped
from .common import bounded, cut, grouped_tidy, mix, pack, strings, tidy, unpack, unzipped, zipped
from .components import components

WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 14, 3
SAMPLES = BANDS * ROWS
SLOTS, RANGES = 1 << 20, 64
#: Share of equal samples below which a pair cannot reach the similarity, but for a chance of about one in ten million.
FEWEST = 0.48
#: The most texts, and about the most shingles, of a block; columns and cells of the matrices that compare two blocks.
BLOCK_TEXTS, BLOCK_SHINGLES, COLUMNS, CELLS = 1024, 1 << 19, 4096, 1 << 22
ODD = mix(np.arange(1, 64, dtype=np.uint64)) | np.uint64(1)
PIECE = 1 << 20


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some texts in order, and where each text's words start; words are in lower case."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    blank = data <= 32
    first = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1]))) if len(data) else np.zeros(0, np.int64)
    starts = np.searchsorted(first, np.cumsum([0, *(len(x) + 1 for x in raw)]))
    if not len(first):
        return np.zeros(0, np.uint64), starts
    length = np.diff(np.append(first, len(data)))
    place = np.arange(len(data) - first[0]) - np.repeat(first - first[0], length)
    powers = np.cumprod(np.full(int(length.max()), ODD[0], np.uint64))
    value = np.where(blank[first[0] :], np.uint64(0), (data[first[0] :].astype(np.uint64) + np.uint64(1)) * powers[place])
    return mix(np.add.reduceat(value, first - first[0])), starts


def slot(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(44)).astype(np.int64)


def shingles(words: np.ndarray, starts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, shingle hash, weight) of the distinct shingles of each text, sorted by text and hash.

    A text of fewer than five words, but at least one, is one shingle.
    """
    n = len(words)
    count = np.diff(starts)
    each = np.where(count >= WORDS, count - WORDS + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(len(count)), each)
    if not len(owner):
        return owner, np.zeros(0, np.uint64), np.zeros(0)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each) + starts[owner]
    end = starts[owner + 1]
    weight_of = idf[slot(words)]
    h, w, k = np.zeros(len(owner), np.uint64), np.zeros(len(owner)), np.zeros(len(owner))
    for i in range(WORDS):
        j = np.minimum(at + i, n - 1)
        inside = at + i < end
        h += np.where(inside, words[j] * ODD[i + 1], np.uint64(0))
        w += np.where(inside, weight_of[j], 0.0)
        k += inside
    h, w = mix(h), np.round(w / k * 256) / 256  # few distinct weights pack well
    order = np.lexsort((h, owner))
    owner, h, w = owner[order], h[order], w[order]
    new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (h[1:] != h[:-1]))))
    times = np.diff(np.append(new, len(h)))
    return owner[new], h[new], w[new] * times


def uniform(bits: np.ndarray) -> np.ndarray:
    """Numbers between 0 and 1, both excluded, from 32 bits."""
    return ((bits >> np.uint64(9)).astype(np.float32) + np.float32(0.5)) * np.float32(2**-23)  # 23 bits are exact in float32


def sampled(owner: np.ndarray, h: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
    """Samples of each text, texts x SAMPLES; a text without shingles has zeros."""
    out = np.zeros((texts, SAMPLES), np.uint64)
    if not len(h):
        return out
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    length = np.diff(np.append(first, len(h)))
    log_w, low, shift = np.log(weight).astype(np.float32), np.uint64(0xFFFFFFFF), np.uint64(32)
    for k in range(SAMPLES):
        x = mix(h ^ mix(np.array([3 * k + 1], np.uint64)))
        y, z = mix(x + ODD[7]), mix(x + ODD[8])
        r = -np.log(uniform(x & low) * uniform(x >> shift))
        c = np.log(-np.log(uniform(y & low) * uniform(y >> shift)))
        beta = uniform(z & low)
        t = np.floor(log_w / r + beta)
        a = c - r * (t - beta) - r
        best = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, first), length))
        best = best[np.concatenate(([True], owner[best][1:] != owner[best][:-1]))]
        out[owner[best], k] = mix(h[best] + t[best].astype(np.int64).view(np.uint64) * ODD[9])
    return out


def by_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[str]]]:
    """(ids, texts) of rows, in pieces of about PIECE bytes; rows without an id are left out."""
    ids, texts, size = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), strings(b, "text")):
            if i is None:
                continue
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size >= PIECE:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def packed(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def frequencies(rows: DataFrame) -> tuple[int, np.ndarray]:
    """How many texts there are, and in how many of them each slot's words are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(SLOTS, np.int64), 0
        for ids, texts in by_pieces(batches):
            words, starts = words_of(texts)
            owner = np.repeat(np.arange(len(texts)), np.diff(starts))
            seen += np.bincount(np.unique(owner * SLOTS + slot(words)) % SLOTS, minlength=SLOTS)
            n += len(texts)
        if n:
            own = seen.reshape(RANGES, -1)
            yield pa.record_batch([pa.array(range(RANGES), pa.int32()), pa.array([n] + [0] * (RANGES - 1), pa.int64()), pa.array([packed(x) for x in own], pa.binary())], ["part", "n", "seen"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in batches:
            for p, n, x in zip(*(c.to_pylist() for c in b.columns)):
                was = total.setdefault(p, [0, np.zeros(SLOTS // RANGES, np.int64)])
                was[0] += n
                was[1] += np.frombuffer(pa.decompress(x, SLOTS // RANGES * 8, codec="zstd"), np.int64)
        if total:
            yield pa.record_batch([pa.array(total, pa.int32()), pa.array([x[0] for x in total.values()], pa.int64()), pa.array([x[1].tobytes() for x in total.values()], pa.binary())], ["part", "n", "seen"])

    kind = "part int, n long, seen binary"
    parts = rows.mapInArrow(tidy(count), kind).repartition(RANGES // 4, "part").mapInArrow(tidy(add), kind).collect()  # RANGES rows
    out = np.zeros((RANGES, SLOTS // RANGES), np.int64)
    for r in parts:
        out[r["part"]] = np.frombuffer(r["seen"], np.int64)
    return sum(r["n"] for r in parts), out.reshape(-1)


def signatures(rows: DataFrame, idf) -> DataFrame:
    """(id, digest of the text, samples in 4 bytes each, bands) for rows of (id, text); idf is a broadcast table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in by_pieces(batches):
            words, starts = words_of(texts)
            s = sampled(*shingles(words, starts, idf.value), len(texts))
            grouped = s.reshape(len(texts), BANDS, ROWS)
            bands = mix((grouped * ODD[20 : 20 + ROWS]).sum(2, dtype=np.uint64) + ODD[30 : 30 + BANDS]).view(np.int64)
            bands = [x if any_ else [] for x, any_ in zip(bands.tolist(), np.diff(starts) > 0)]
            small = (s & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array([hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() for t in texts], pa.binary()), pa.array([x.tobytes() for x in small], pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["id", "digest", "samples", "bands"],
            )

    return rows.mapInArrow(tidy(run), "id long, digest binary, samples binary, bands array<long>")


def likely(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """The pairs of which enough samples agree."""
    both = pairs.join(own.select(F.col("id").alias("b"), F.col("samples").alias("y")), "b").join(own.select(F.col("id").alias("a"), F.col("samples").alias("x")), "a").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint32).reshape(-1, SAMPLES) for k in (2, 3))
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array((x == y).mean(1) >= FEWEST))

    return both.mapInArrow(tidy(run), "a long, b long")


def weighted_sets(rows: DataFrame, idf) -> DataFrame:
    """(id, hashes, weights, total weight): the distinct shingles of each text in order of their hashes, as packed numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in by_pieces(batches):
            words, starts = words_of(texts)
            owner, h, w = shingles(words, starts, idf.value)
            cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array([pack(h[i:j] >> np.uint64(16)) for i, j in zip(cuts, cuts[1:])], pa.binary()), pa.array([zipped(w[i:j].astype(np.float32)) for i, j in zip(cuts, cuts[1:])], pa.binary()), pa.array([float(w[i:j].astype(np.float32).sum(dtype=float)) for i, j in zip(cuts, cuts[1:])], pa.float64())],
                ["id", "h", "w", "total"],
            )

    return rows.mapInArrow(tidy(run), "id long, h binary, w binary, total double")


def jaccard(h: bytes, w: bytes, g: bytes, v: bytes) -> float:
    """Weighted Jaccard similarity of two packed sets; 0 if both are empty."""
    h, g, w, v = unpack(h), unpack(g), unzipped(w, np.float32).astype(float), unzipped(v, np.float32).astype(float)
    _, i, j = np.intersect1d(h, g, assume_unique=True, return_indices=True)
    shared = np.minimum(w[i], v[j]).sum()
    total = w.sum() + v.sum() - shared
    return float(shared / total) if total else 0.0


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of the pairs that are similar enough."""
    x = pairs.join(sets.select(F.col("id").alias("b"), F.col("h").alias("g"), F.col("w").alias("v")), "b")
    both = x.join(sets.select(F.col("id").alias("a"), "h", "w"), "a").select("a", "b", "h", "w", "g", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.array([jaccard(*(c.as_py() for c in x)) for x in zip(*b.columns[2:])], float)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(s)], ["a", "b", "similarity"]).filter(pa.array(s >= least))

    return both.mapInArrow(tidy(run), "a long, b long, similarity double")


def blocks(groups: DataFrame, sets: DataFrame, own: DataFrame, least: float) -> DataFrame:
    """The texts of (id, label) groups, once for each two blocks they are compared in: (label, c, s, t, right, id, ...).

    Class c of a text is the power of 1/least that its total weight reaches.  Similar texts are in one class or in neighbours,
    as the weight of one is at least ``least`` of the other's.  Classes are dealt to blocks by a hash of the id.  Block s of
    class c meets block t of the same class, s <= t, and the blocks of class c + 1, whose numbers t are negative: -1 is the first.
    """
    base = 1 / min(least * (1 - 1e-9), 0.99)  # a little more, so that rounding can't part neighbours
    level = F.floor(F.log("total") / float(np.log(base))).cast("int")
    each = F.greatest(F.lit(16), F.least(F.lit(BLOCK_TEXTS), F.floor(F.lit(BLOCK_SHINGLES) / F.pow(F.lit(base), F.col("c")))))
    member = cut(groups.join(sets.select("id", "total"), "id").withColumn("c", level).select("id", "label", "c"))
    count = member.groupBy("label", "c").agg(F.count("*").alias("n")).withColumn("k", F.ceil(F.col("n") / each).cast("int")).select("label", "c", "k")
    up, down = count.select("label", (F.col("c") - 1).alias("c"), F.col("k").alias("above")), count.select("label", (F.col("c") + 1).alias("c"), F.col("k").alias("below"))
    dealt = member.join(count, ["label", "c"]).join(up, ["label", "c"], "left").join(down, ["label", "c"], "left").withColumn("s", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    at = lambda c, s, t, right: F.struct(c.alias("c"), s.cast("int").alias("s"), t.cast("int").alias("t"), F.lit(right).alias("right"))
    same = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda t: at(F.col("c"), F.least("s", t), F.greatest("s", t), False))
    same = F.transform(same, lambda x: F.struct(x["c"].alias("c"), x["s"].alias("s"), x["t"].alias("t"), ((x["t"] == F.col("s")) & (x["s"] != x["t"])).alias("right")))
    none = F.array().cast("array<struct<c:int,s:int,t:int,right:boolean>>")
    higher = F.when(F.col("above") > 0, F.transform(F.sequence(F.lit(1), F.col("above")), lambda t: at(F.col("c"), F.col("s"), -t, False))).otherwise(none)
    lower = F.when(F.col("below") > 0, F.transform(F.sequence(F.lit(0), F.col("below") - 1), lambda s: at(F.col("c") - 1, s, -1 - F.col("s"), True))).otherwise(none)
    places = dealt.select("id", "label", F.explode(F.concat(same, higher, lower)).alias("at")).select("id", "label", "at.*")
    return places.join(own.select("id", "bands", "samples"), "id").join(sets, "id")


def shared_weights(h: list[np.ndarray], w: list[np.ndarray], m: int) -> np.ndarray | None:
    """Sums of the lesser weights of the sets before m with those from m on; None if that takes too many cells.

    A shingle is a column for each of its weights, of the step from the weight before: products of rows then add up minima.
    """
    row, key, weight = np.repeat(np.arange(len(h)), [len(x) for x in h]), np.concatenate(h), np.concatenate(w)
    order = np.lexsort((weight, key))
    row, key, weight = row[order], key[order], weight[order]
    fresh = np.concatenate(([True], key[1:] != key[:-1]))
    step = fresh | np.concatenate(([True], weight[1:] != weight[:-1]))
    column = np.cumsum(step) - 1
    start = np.flatnonzero(step)
    height = weight[start] - np.where(fresh[start], 0.0, np.concatenate(([0.0], weight[start][:-1])))
    base = np.maximum.accumulate(np.where(fresh[start], np.arange(len(start)), 0))[column]
    times = column - base + 1
    if times.sum() > CELLS:
        return None
    row = np.repeat(row, times)
    column = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(base, times)
    both = (np.bincount(column[row < m], minlength=len(start)) > 0) & (np.bincount(column[row >= m], minlength=len(start)) > 0)
    inside = both[column]
    row, column, height = row[inside], (np.cumsum(both) - 1)[column[inside]], height[both]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((m, len(h) - m))
    for c in range(0, len(height), COLUMNS):
        i, j = np.searchsorted(column, (c, c + COLUMNS))
        x = np.zeros((len(h), min(COLUMNS, len(height) - c)))
        x[row[i:j], column[i:j] - c] = 1
        out += (x[:m] * height[c : c + COLUMNS]) @ x[m:].T
    return out


def compared(table: pa.Table, least: float) -> pa.Table:
    """(a, b, n) for the texts of two blocks, or of one: how many links a has if b is null, else that both are of one class."""
    t = table.to_pydict()
    right = np.array(t["right"], bool)
    one = not right.any() and t["t"][0] == t["s"][0]
    x = np.arange(len(right)) if one else np.flatnonzero(~right)
    y = x if one else np.flatnonzero(right)
    none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    if not len(x) or not len(y):
        return none
    bands = np.array(t["bands"], np.int64)
    samples = np.frombuffer(b"".join(t["samples"]), np.uint32).reshape(len(right), -1)
    meet = np.zeros((len(x), len(y)), bool)
    for k in range(bands.shape[1]):
        meet |= bands[x, k][:, None] == bands[y, k]
    alike = np.zeros(meet.shape, np.int16)
    for k in range(samples.shape[1]):
        alike += samples[x, k][:, None] == samples[y, k]
    meet &= alike / samples.shape[1] >= FEWEST
    total = np.array(t["total"])
    low, high = np.minimum(total[x][:, None], total[y]), np.maximum(total[x][:, None], total[y])
    meet &= low >= least * high * (1 - 1e-9)
    if one:
        meet = np.triu(meet, 1)
    i, j = np.nonzero(meet)
    if not len(i):
        return none
    shared, p, q = None, np.unique(i), np.unique(j)
    h, w = {}, {}
    for k in {*x[p].tolist(), *y[q].tolist()}:
        h[k], w[k] = unpack(t["h"][k]), unzipped(t["w"][k], np.float32).astype(float)
    if len(i) > 2 * (len(p) + len(q)):
        shared = shared_weights([h[k] for k in (*x[p], *y[q])], [w[k] for k in (*x[p], *y[q])], len(p))
    if shared is not None:
        shared = shared[np.searchsorted(p, i), np.searchsorted(q, j)]
    else:
        shared = np.zeros(len(i))
        for n, (a, b) in enumerate(zip(x[i], y[j])):
            _, f, g = np.intersect1d(h[a], h[b], assume_unique=True, return_indices=True)
            shared[n] = np.minimum(w[a][f], w[b][g]).sum()
    good = shared / (total[x[i]] + total[y[j]] - shared) >= least
    i, j = x[i[good]], y[j[good]]
    n_links = np.bincount(i, minlength=len(right)) + np.bincount(j, minlength=len(right))
    label = np.arange(len(right))
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            break
        label = new
    ids, linked, moved = np.array(t["id"]), np.flatnonzero(n_links), np.flatnonzero(label != np.arange(len(right)))
    return pa.table({"a": pa.array([*ids[linked], *ids[moved]], pa.int64()), "b": pa.array([*[None] * len(linked), *ids[label[moved]]], pa.int64()), "n": pa.array([*n_links[linked], *[0] * len(moved)], pa.int64())})


def near_duplicates(docs: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, n_links) of every row: the least id of its group, and with how many other texts it was found similar.

    Equal texts are one class from the start, whatever their length; null texts are empty ones.  A link is a pair of different
    texts of similarity ``similar`` or more, and classes are what links connect.  Rows without an id have no class; rows that
    repeat an id count as the text of least digest.  Of a group of copies only the least id is compared with others.
    """
    spark = docs.sparkSession
    bounded(spark)
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    n, seen = frequencies(rows)
    idf = spark.sparkContext.broadcast(1 + np.log((1 + n) / (1 + seen)) / np.log(2 + n))  # from 1, words of all texts, to 2
    all_ = cut(signatures(rows, idf))
    heads = cut(all_.groupBy("digest").agg(F.min("id").alias("head")))
    copies = all_.select("id", "digest").join(heads, "digest").groupBy("id").agg(F.min("head").alias("head"))
    first = heads.groupBy(F.col("head").alias("id")).agg(F.min("digest").alias("digest"))
    own = cut(all_.join(first, ["id", "digest"], "left_semi"))
    pairs, groups = grouped(own.select("id", "bands"))
    pairs = cut(likely(pairs, own))
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(groups.select("id")).distinct().join(first, "id")
    sets = cut(weighted_sets(rows.withColumn("digest", F.unhex(F.md5("text"))).join(wanted, ["id", "digest"], "left_semi").select("id", "text"), idf))
    links = cut(verified(pairs, sets, similar).dropDuplicates(["a", "b"]))
    # what the blocks of large groups give
    within = cut(blocks(groups, sets, own, similar).groupBy("label", "c", "s", "t").applyInArrow(grouped_tidy(lambda t: compared(t, similar)), "a long, b long, n long"))
    one = F.lit(1).cast("long").alias("n")
    ends = links.select("a", one).union(links.select("b", one)).union(within.filter("b is null").select("a", "n")).groupBy(F.col("a").alias("head")).agg(F.sum("n").alias("n_links"))
    label = components(links.select("a", "b").union(within.select("a", "b"))).select(F.col("id").alias("head"), "label")
    known = copies.join(label, "head", "left").join(ends, "head", "left").select("id", F.coalesce("label", "head").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = rows.select("id").join(known, "id", "left").select("id", "class_id", "n_links")
    return out.withColumnRenamed("id", id_col)


def kept(docs: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but the first of each class; rows without an id stay, rows that repeat a kept id stay too."""
    drop = near_duplicates(docs, similar, id_col, text_col).filter(F.col(id_col) != F.col("class_id")).select(id_col).distinct()
    return docs.join(drop, id_col, "left_anti").select(docs.columns)
