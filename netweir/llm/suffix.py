"""Substring dedup by suffix sorting: remove what a document of smaller id holds too, in matches of at least 50 bytes.

Every 50-byte string is filed under its anchor, the 16-byte string in it of least hash, so equal strings meet wherever they
are.  First only anchors travel, to find those that more than one batch of documents holds.  Then the stretches around
these anchors travel, distinct ones once a batch, and for each bucket of anchors the suffixes that start in them are sorted
deep-shallow: a multikey quicksort takes eight bytes at a time down to a shallow depth, and groups that still agree are
ordered by blind tries, which look only at the bytes where their members part.  Suffixes that agree over 50 bytes are the
same string, and the least document among them keeps it.  The answers, a bit for each string, go back to the batches.

An anchor that very many batches hold is no good file: its strings are filed one by one under their own hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY_BITS, bounded, grouped_tidy, mix, pack, parts, pieces, total_bytes, unpack, unzipped, zipped

LENGTH, ANCHOR, SHALLOW = 50, 16, 16
SPAN = LENGTH - ANCHOR + 1
BATCH, BUCKET, CHUNK, HOT = 3 << 20, 3 << 20, 1 << 19, 1024
#: Ranges of anchors in a bucket, which are sorted one after another; runs whose strings are marked at once.
SLICES, RUNS = 16, 50_000
#: Members of a group that the quicksort splits no more.
SMALL = 512
ODD = mix(np.arange(101, 108, dtype=np.uint64)) | np.uint64(1)


def words_at(data: np.ndarray, order: str) -> np.ndarray:
    """The eight bytes from each offset as a number; order is numpy's byte order mark."""
    out = np.zeros(max(0, len(data) - 7), np.uint64)
    for s in range(min(8, len(out))):
        m = (len(data) - s) // 8
        out[s : s + 8 * m : 8] = data[s : s + 8 * m].view(order + "u8")
    return out


def deep_shallow(text: np.ndarray, starts: np.ndarray, depth: int = LENGTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Sort the suffixes of a text that begin at ``starts`` by their first ``depth`` bytes.

    Gives their order, and for each place in it whether the suffix there differs from the one before.  Bytes past the end
    of the text count as zeros.
    """
    padded = np.concatenate((text, np.zeros(depth + 16, np.uint8)))
    word = words_at(padded, ">")
    order = np.arange(len(starts))
    head = np.zeros(len(starts), bool)
    head[:1] = True
    for d in range(0, shallow, 8):
        quicksort(word, starts, order, head, d, depth)
    blind_tries(padded, word, starts, order, head, min(depth, -(-shallow // 8) * 8), depth)
    return order, head


def shared(head: np.ndarray) -> np.ndarray:
    """Places whose group has more than one member."""
    alone = head & np.append(head[1:], True)
    return np.flatnonzero(~alone)


def quicksort(word: np.ndarray, starts: np.ndarray, order: np.ndarray, head: np.ndarray, d: int, depth: int) -> None:
    """One depth of the multikey quicksort: parts each group, of suffixes that agree in ``d`` bytes, by the eight bytes there.

    A group is split in three about the median of some of its members: what is less and what is greater is split again, what
    is equal is through with this depth and goes on to the next.  Groups of at most SMALL members are split no more, but put
    in order by a plain sort, all of them at once.
    """
    live = shared(head)
    if not len(live):
        return
    key = word[starts[order[live]] + d]
    if depth - d < 8:
        key &= ~np.uint64((1 << (8 * (8 - depth + d))) - 1)
    first = np.flatnonzero(head[live])
    size = np.diff(np.append(first, len(live)))
    small = np.repeat(size <= SMALL, size)
    todo = list(zip(first[size > SMALL].tolist(), size[size > SMALL].tolist()))
    while todo:
        s, n = todo.pop()
        if n <= SMALL:
            small[s : s + n] = n > 1
            continue
        keys, at = key[s : s + n], int(live[s])
        members = order[at : at + n]  # a group's places follow each other
        some = np.sort(keys[:: n // 9])
        pivot = some[len(some) // 2]
        less, greater = keys < pivot, keys > pivot
        equal = ~(less | greater)
        members[:] = np.concatenate((members[less], members[equal], members[greater]))
        keys[:] = np.concatenate((keys[less], keys[equal], keys[greater]))
        a, b = int(np.count_nonzero(less)), n - int(np.count_nonzero(greater))
        head[at + a] = True
        if b < n:
            head[at + b] = True
        todo += [(s, a), (s + b, n - b)]
    regroup(order, head, live[small], key[small])


def regroup(order: np.ndarray, head: np.ndarray, live: np.ndarray, key: np.ndarray) -> None:
    """Sort the members of each live group by a key and part those that differ."""
    if not len(live):
        return
    group = np.cumsum(head[live])
    by = np.lexsort((key, group))
    order[live], key = order[live][by], key[by]
    head[live[1:]] |= key[1:] != key[:-1]


def agreement(word: np.ndarray, a: np.ndarray, b: np.ndarray, known: int, depth: int) -> np.ndarray:
    """How many bytes the suffixes at a and b agree in, ``known`` at least and ``depth`` at most."""
    out = np.full(len(a), depth)
    open_ = np.arange(len(a))
    for d in range(known, depth, 8):
        x = word[a[open_] + d] ^ word[b[open_] + d]
        parted = x != 0
        if parted.any():
            first = (x[parted].astype(">u8").view(np.uint8).reshape(-1, 8) != 0).argmax(1)
            out[open_[parted]] = np.minimum(d + first, depth)
            open_ = open_[~parted]
    return out


def blind_tries(padded: np.ndarray, word: np.ndarray, starts: np.ndarray, order: np.ndarray, head: np.ndarray, known: int, depth: int) -> None:
    """Order each group of suffixes that agree in ``known`` bytes, all groups' tries level by level.

    A node skips to the first byte in which any member parts from the first one, and has a child for each value of that byte.
    """
    closed = np.zeros(len(order), bool)
    while len(live := np.flatnonzero(~closed & ~(head & np.append(head[1:], True)))):
        first = np.flatnonzero(head[live])
        size = np.diff(np.append(first, len(live)))
        at = starts[order[live]]
        skip = np.minimum.reduceat(agreement(word, at, np.repeat(at[first], size), known, depth), first)
        leaf = np.repeat(skip >= depth, size)
        closed[live[leaf]] = True
        live, at = live[~leaf], at[~leaf]
        regroup(order, head, live, padded[at + np.repeat(skip, size)[~leaf]])


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Which of the buckets, which are ranges of keys, each key belongs to."""
    return ((keys >> np.uint64(KEY_BITS - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def runs(data: np.ndarray, ends: np.ndarray, offset: int, first_doc: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, strings, anchor's key, document) of the stretches of strings with one anchor, in documents that end at ``ends``."""
    none = np.zeros(0, np.int64)
    nothing = (none, none, np.zeros(0, np.uint64), none)
    n = len(data)
    if n < LENGTH:
        return nothing
    word = words_at(np.concatenate((data, np.zeros(8, np.uint8))), "<")
    h = word[: n - ANCHOR + 1] * ODD[0] + word[8 : n - ANCHOR + 9] * ODD[1]
    del word
    h = (h ^ (h >> np.uint64(31))) * ODD[2]
    h ^= h >> np.uint64(29)
    best, at, wide = h, np.arange(len(h), dtype=np.int32), 1
    while wide < SPAN:  # the least hash, leftmost first, over windows of growing width
        step = min(wide, SPAN - wide)
        right = best[step:] < best[:-step]
        at = np.where(right, at[step:], at[:-step])
        best = np.where(right, best[step:], best[:-step])
        wide += step
    begin = np.concatenate(([0], ends[:-1]))
    whole = np.zeros(n + 1, np.int32)
    long = ends - begin >= LENGTH
    whole[begin[long]] += 1
    np.add.at(whole, ends[long] - LENGTH + 1, -1)
    valid = np.flatnonzero(np.cumsum(whole[: n - LENGTH + 1]) > 0)
    if not len(valid):
        return nothing
    anchor = at[valid]
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    start = valid[first]
    key = h[anchor[first]] >> np.uint64(64 - KEY_BITS)
    return start + offset, np.diff(np.append(first, len(valid))), key, np.searchsorted(ends, start, side="right") + first_doc


class Batch:
    """The documents of a batch in the order of their ids, and the runs of strings that have the same anchor."""

    def __init__(self, docs: pa.Table):
        rows = sorted(zip(docs["id"].to_pylist(), (x or b"" for x in docs["text"].to_pylist())))
        self.ids = np.array([i for i, _ in rows], np.int64)
        self.ends = np.cumsum([len(t) for _, t in rows])
        self.raw = b"".join(t for _, t in rows)
        self.data = np.frombuffer(self.raw, np.uint8)
        none = np.zeros(0, np.int64)
        found = [(none, none, np.zeros(0, np.uint64), none)]
        first = begin = 0
        for k, end in enumerate(self.ends.tolist(), 1):  # some documents at a time, to bound the memory of the hashes
            if end - begin >= CHUNK or k == len(self.ends):
                found.append(runs(self.data[begin:end], self.ends[first:k] - begin, begin, first))
                first, begin = k, end
        self.start, self.count, self.key, self.doc = map(np.concatenate, zip(*found))

    def keep(self, keys: np.ndarray, hot: np.ndarray) -> None:
        """Only runs whose anchor is one of the keys, or in several documents of this batch; runs of hot anchors string by string."""
        order = np.lexsort((self.doc, self.key))
        k, d = self.key[order], self.doc[order]
        local = np.unique(k[1:][(k[1:] == k[:-1]) & (d[1:] != d[:-1])])
        stay = inside(self.key, keys) | inside(self.key, local)
        start, count, key, doc = (x[stay] for x in (self.start, self.count, self.key, self.doc))
        split = inside(key, hot)
        each = np.where(split, count, 1)
        self.start = np.repeat(start, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        self.count = np.where(np.repeat(split, each), 1, np.repeat(count, each))
        self.doc = np.repeat(doc, each)
        own = np.zeros(len(self.start), np.uint64)
        if split.any():
            word = words_at(np.concatenate((self.data, np.zeros(8, np.uint8))), "<")
            for j, o in enumerate((0, 8, 16, 24, 32, 40, 42)):
                own += word[self.start + o] * ODD[j]
        self.key = np.where(np.repeat(split, each), mix(own) >> np.uint64(64 - KEY_BITS), np.repeat(key, each))

    def distinct(self, buckets: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """For each run the number of its stretch, and the first run of each stretch by bucket; numbers follow the buckets' slices."""
        fine = bucket_of(self.key, buckets * SLICES)
        order = np.argsort(fine, kind="stable")
        seen: dict[bytes, int] = {}
        number, firsts = np.zeros(len(order), np.int64), []
        raw = self.raw
        for r, s, e in zip(order.tolist(), self.start[order].tolist(), (self.start + self.count + LENGTH - 1)[order].tolist()):
            piece = raw[s:e]
            if (i := seen.get(piece)) is None:
                i = seen[piece] = len(firsts)
                firsts.append(r)
            number[r] = i
        firsts = np.array(firsts, np.int64)
        own = fine[firsts] // SLICES
        at = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else []
        return number, [x for x in np.split(firsts, at[1:]) if len(x)]


def inside(keys: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_, keys), len(sorted_) - 1)
    return sorted_[at] == keys


def rows(**columns) -> pa.Table:
    kinds = {"batch": pa.int32(), "bucket": pa.int32(), "kind": pa.int32()}
    return pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in columns.items()})


def anchors_of(docs: pa.Table, buckets: int) -> pa.Table:
    """A batch's distinct anchors, by bucket."""
    keys = np.unique(Batch(docs).key)
    cuts = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
    full = [k for k in range(buckets) if cuts[k] < cuts[k + 1]]
    return rows(bucket=full, batch=[docs["batch"][0].as_py()] * len(full), a=[pack(keys[cuts[k] : cuts[k + 1]]) for k in full])


def common_anchors(sent: pa.Table, hot: int) -> pa.Table:
    """Of a bucket's anchors those that several batches hold, back to each of these batches; a: all, b: hot ones."""
    each = [unpack(x) for x in sent["a"].to_pylist()]
    keys, times = np.unique(np.concatenate(each), return_counts=True)
    many, most = keys[times > 1], keys[times > hot]
    found = [(b, x[inside(x, many)], x[inside(x, most)]) for b, x in zip(sent["batch"].to_pylist(), each)]
    found = [x for x in found if len(x[1])]
    return rows(batch=[b for b, _, _ in found], kind=[0] * len(found), bucket=[sent["bucket"][0].as_py()] * len(found), a=[pack(x) for _, x, _ in found], b=[pack(x) for _, _, x in found])


def opened(docs: pa.Table, control: pa.Table) -> Batch:
    """A batch cut down to the runs that can matter."""
    batch = Batch(docs)
    mine = control.filter(pc.equal(control["kind"], 0))
    none = np.zeros(0, np.uint64)
    batch.keep(*(np.sort(np.concatenate([none, *map(unpack, mine[c].to_pylist())])) for c in "ab"))
    return batch


def stretches_of(docs: pa.Table, control: pa.Table, buckets: int) -> pa.Table:
    """A batch's distinct stretches with the first document that has each, by bucket; d: how many each slice of the bucket has."""
    out: dict[str, list] = {"bucket": [], "batch": [], "a": [], "b": [], "c": [], "d": []}
    if len(docs):
        batch = opened(docs, control)
        for firsts in batch.distinct(buckets)[1]:
            fine = bucket_of(batch.key[firsts], buckets * SLICES)
            out["bucket"].append(int(fine[0]) // SLICES)
            out["batch"].append(docs["batch"][0].as_py())
            out["a"].append(zipped(batch.count[firsts].astype(np.uint8)))
            out["b"].append(zipped(batch.ids[batch.doc[firsts]]))
            ends = batch.start[firsts] + batch.count[firsts] + LENGTH - 1
            out["c"].append(zipped(np.frombuffer(b"".join(batch.raw[s:e] for s, e in zip(batch.start[firsts].tolist(), ends.tolist())), np.uint8)))
            out["d"].append(zipped(np.bincount(fine % SLICES, minlength=SLICES).astype(np.int32)))
    return rows(**out)


def judged(sent: pa.Table) -> pa.Table:
    """For each stretch that a batch sent, a bit for each string in it: whether a document before the batch's first has it.

    Equal strings have equal anchors, so a bucket is sorted slice by slice, each slice's stretches of all batches together.
    """
    packed = list(zip(*(sent[k].to_pylist() for k in "abcd")))
    # what of each batch's stretches comes before each slice: stretches, and bytes
    cuts, bytes_ = [], []
    for a, _, _, d in packed:
        n = np.concatenate(([0], np.cumsum(unzipped(d, np.int32))))
        size = np.concatenate(([0], np.cumsum(unzipped(a, np.uint8).astype(np.int64) + LENGTH - 1)))
        cuts.append(n)
        bytes_.append(size[n])
    opened_ = [(unzipped(a, np.uint8), unzipped(b, np.int64), unzipped(c, np.uint8)) for a, b, c, _ in packed]
    del packed
    masks = [[] for _ in opened_]
    for k in range(SLICES):
        part = [(count[n[k] : n[k + 1]].astype(np.int64), first[n[k] : n[k + 1]], raw[m[k] : m[k + 1]].tobytes()) for (count, first, raw), n, m in zip(opened_, cuts, bytes_)]
        for out, mask in zip(masks, slice_judged(part)):
            out.append(mask)
    n = len(masks)
    return rows(batch=sent["batch"].to_pylist(), kind=[1] * n, bucket=sent["bucket"].to_pylist(), a=[zipped(np.concatenate(x)) for x in masks], b=[None] * n)


def slice_judged(part: list[tuple[np.ndarray, np.ndarray, bytes]]) -> list[np.ndarray]:
    """The bits of each batch's stretches, from (strings in each, first document of each, their bytes)."""
    seen: dict[bytes, int] = {}
    least, own = [], []
    for count, first, raw in part:
        ends = np.cumsum(count + LENGTH - 1).tolist()
        index = []
        for s, e, d in zip([0, *ends], ends, first.tolist()):
            i = seen.setdefault(raw[s:e], len(least))
            if i == len(least):
                least.append(d)
            elif d < least[i]:
                least[i] = d
            index.append(i)
        own.append((np.array(index, np.int64), first))
    if not seen:
        return [np.zeros(0, np.int64) for _ in part]
    text = np.frombuffer(b"".join(seen), np.uint8)
    size = np.array([len(x) for x in seen]) - LENGTH + 1
    del seen
    which = np.repeat(np.arange(len(size), dtype=np.int32), size)
    place = (np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
    starts = place + np.repeat(np.cumsum(size + LENGTH - 1) - size - LENGTH + 1, size)
    order, head = deep_shallow(text, starts)
    first = np.flatnonzero(head)
    holder = np.array(least)[which]
    keeper = np.zeros(len(order), np.int64)
    keeper[order] = np.repeat(np.minimum.reduceat(holder[order], first), np.diff(np.append(first, len(order))))
    table = np.full((len(size), SPAN), np.iinfo(np.int64).max)
    table[which, place] = keeper
    bit = np.int64(1) << np.arange(SPAN, dtype=np.int64)
    return [((table[i] < d[:, None]) * bit).sum(1) if len(i) else np.zeros(0, np.int64) for i, d in own]


def cleaned(docs: pa.Table, control: pa.Table, buckets: int) -> pa.Table:
    """The documents of a batch without what smaller documents hold."""
    batch = opened(docs, control)
    number, firsts = batch.distinct(buckets)
    mine = control.filter(pc.equal(control["kind"], 1)).sort_by("bucket")
    none = np.zeros(0, np.int64)
    masks = np.concatenate([none, *(unzipped(x, np.int64) for x in mine["a"].to_pylist())])
    first = np.concatenate([none, *firsts])
    # a later document of this batch loses the whole stretch, the first one what the answer says
    later = batch.ids[batch.doc] > batch.ids[batch.doc[first[number]]] if len(number) else np.zeros(0, bool)
    mask = np.where(later, (np.int64(1) << SPAN) - 1, masks[number] if len(number) else none)
    mark = np.zeros(len(batch.data) + 1, np.int32)
    for i in range(0, len(mask), RUNS):
        count = batch.count[i : i + RUNS]
        run = np.repeat(np.arange(i, i + len(count)), count)
        place = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
        gone = (mask[run] >> place) & 1 == 1
        mark[(batch.start[run] + place)[gone]] += 1
    total = np.concatenate((np.zeros(LENGTH, np.int32), np.cumsum(mark[:-1], dtype=np.int32)))
    covered = total[LENGTH:] > total[:-LENGTH]
    out: dict[str, list] = {"id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
    for i, s, e in zip(batch.ids.tolist(), [0, *batch.ends.tolist()], batch.ends.tolist()):
        c = covered[s:e]
        out["id"].append(i)
        out["n_bytes"].append(e - s)
        out["n_removed"].append(int(c.sum()))
        out["n_spans"].append(int((c[1:] & ~c[:-1]).sum() + c[0]) if len(c) else 0)
        out["kept"].append(batch.data[s:e][~c].tobytes() if c.any() else batch.raw[s:e])
    return pa.table({k: pa.array(v, pa.binary() if k == "kept" else pa.int64()) for k, v in out.items()})


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, batch_bytes: int = BATCH, bucket_bytes: int = BUCKET) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept binary) of every row with an id.

    Texts are UTF-8 bytes, null is empty.  Every byte is removed that a 50-byte string covers which also starts in a row of
    smaller id; strings never cross rows, and all are judged on the input.  Texts under 50 bytes stay whole.  Rows that
    repeat an id do not judge each other.  Rows without an id are neither judged nor searched, and keep all bytes.
    """
    spark = docs.sparkSession
    d = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).cast("binary").alias("text"))
    total = total_bytes(docs, text_col)
    batches, buckets = pieces(total, batch_bytes), pieces(total, bucket_bytes)
    n = parts(spark, total)
    bounded(spark)
    dealt = d.dropna(subset=["id"]).withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int")).repartition(n, "batch")
    by = dealt.groupBy("batch")
    control = "batch int, kind int, bucket int, a binary, b binary"
    sent = by.applyInArrow(grouped_tidy(lambda t: anchors_of(t, buckets)), "bucket int, batch int, a binary")
    common = sent.groupBy("bucket").applyInArrow(grouped_tidy(lambda t: common_anchors(t, hot)), control)
    stretches = by.cogroup(common.groupBy("batch")).applyInArrow(grouped_tidy(lambda t, c: stretches_of(t, c, buckets)), "bucket int, batch int, a binary, b binary, c binary, d binary")
    answers = stretches.groupBy("bucket").applyInArrow(grouped_tidy(judged), control)
    kind = "id long, n_bytes long, n_removed long, n_spans long, kept binary"
    out = by.cogroup(common.unionByName(answers).groupBy("batch")).applyInArrow(grouped_tidy(lambda t, c: cleaned(t, c, buckets)), kind)
    zero = F.lit(0).cast("long")
    rest = d.filter(F.col("id").isNull()).select("id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("text").alias("kept"))
    return out.unionByName(rest).withColumnRenamed("id", id_col)
