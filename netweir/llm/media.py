"""Copies among images: multiscale corners, orientation-normalised binary tests, Hamming tables and geometric consensus.

Each image gets its strongest Harris corners at three scales.  A corner's direction is that of its patch's centroid; its
descriptor are BITS comparisons of smoothed grey values at places that turn with it.  A key of a Hamming table joins one slice
of a corner's bits with the same slice of a near corner's, and how the two lie to each other: two slices that agree at once, so
that chance rarely fills a bucket.  Rows that meet are compared in another slice of both corners, bit by bit, and images that
have VOTES such rows descriptor by descriptor; these are linked if enough matches agree on one shift, turn and scale.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, map_arrow, mix, tidy
from .components import components

SCALES, CORNERS, RADIUS = (1.0, 0.75, 0.5), (16, 10, 6), 7
#: The side of an image that has CORNERS corners; larger ones have more, in proportion to the root of their area.
SIDE = 64
BITS, SLICE, TURNS = 128, 25, 32
#: Near corners that a corner is joined with, parts of a circle that directions between them are told in.
NEIGHBOURS, SECTORS = 2, 8
#: Bits that differ at most: of a descriptor, and of the slices that are compared where two keys meet.
MOST_BITS, MOST_SKETCH = 16, 6
#: Rows in which two images meet at least; two chance meetings of the same images are a thousand times as rare as one.
VOTES = 2
NEAR, AGREEING = 2.0, 7
#: Rows of a key that meet all others of that key as it passes by; the others of a larger key meet each other in blocks of CROWD rows.
LEADERS, CROWD = 32, 2048
#: A corner: place in the full image, scale, direction in TURNS, descriptor.
CORNER = np.dtype([("x", "<f4"), ("y", "<f4"), ("scale", "<f4"), ("turn", "u1"), ("bits", "u1", BITS // 8)])


def tests() -> np.ndarray:
    """For each turn the BITS pairs of places, turns x BITS x 4: made by a rule, denser near the centre."""
    h = mix(np.arange(1, 4 * BITS + 1, dtype=np.uint64)).reshape(BITS, 2, 2)
    u = ((h >> np.uint64(11)).astype(float) / 2.0**53 + ((h & np.uint64(0x7FF)).astype(float) + 0.5) / 2048 - 1) * (RADIUS - 1.5)
    angle = np.arange(TURNS) * 2 * np.pi / TURNS
    c, s = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
    x, y = u[None, :, :, 0], u[None, :, :, 1]
    return np.rint(np.stack((c * x - s * y, s * x + c * y), -1) + 1e-9).astype(int).reshape(TURNS, BITS, 4)


TESTS = tests()
DISC = [(y, x) for y in range(-RADIUS, RADIUS + 1) for x in range(-RADIUS, RADIUS + 1) if x * x + y * y <= RADIUS * RADIUS]
DISC_Y, DISC_X = np.array(DISC).T


def pgm(image: np.ndarray) -> bytes:
    """A grey image as a portable graymap."""
    return b"P5\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + image.astype(np.uint8).tobytes()


def decoded(payload: bytes | None) -> np.ndarray | None:
    """Pixels of a portable graymap; None for what is none."""
    part = (payload or b"").split(None, 4) if payload else []
    try:
        if len(part) < 4 or part[0] != b"P5":
            return None
        w, h = int(part[1]), int(part[2])
        return np.frombuffer(payload[-w * h :], np.uint8).reshape(h, w) if w > 0 and h > 0 else None
    except ValueError:
        return None


def box(a: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of 2r+1, edges repeated."""
    p = np.pad(a, r, mode="edge")
    c = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    n = 2 * r + 1
    return c[n:, n:] - c[:-n, n:] - c[n:, :-n] + c[:-n, :-n]


def resized(a: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear reduction."""
    if scale == 1:
        return a
    h, w = (max(1, round(n * scale)) for n in a.shape)
    y, x = (np.arange(h) + 0.5) / scale - 0.5, (np.arange(w) + 0.5) / scale - 0.5
    i, j = np.clip(y.astype(int), 0, a.shape[0] - 2), np.clip(x.astype(int), 0, a.shape[1] - 2)
    f, g = np.clip(y - i, 0, 1)[:, None], np.clip(x - j, 0, 1)[None]
    return (1 - f) * ((1 - g) * a[i][:, j] + g * a[i][:, j + 1]) + f * ((1 - g) * a[i + 1][:, j] + g * a[i + 1][:, j + 1])


def corners(image: np.ndarray) -> np.ndarray:
    """The strongest corners of an image; an image too small for a patch has none."""
    out = []
    for scale, most in zip(SCALES, CORNERS):
        if min(image.shape) * scale < 2 * RADIUS + 6:
            continue
        a = resized(image.astype(float), scale)
        dy, dx = np.gradient(a)
        xx, yy, xy = box(dx * dx, 1), box(dy * dy, 1), box(dx * dy, 1)
        r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        m = RADIUS + 2
        inner = r[m:-m, m:-m]
        around = np.max([r[m + i : r.shape[0] - m + i, m + j : r.shape[1] - m + j] for i in (-1, 0, 1) for j in (-1, 0, 1)], axis=0)
        y, x = np.nonzero((inner == around) & (inner > 1.0))
        best = np.argsort(-inner[y, x], kind="stable")[: round(most * max(1.0, image.size**0.5 / SIDE))]
        y, x = y[best] + m, x[best] + m
        if not len(y):
            continue
        patch = a[y[:, None] + DISC_Y, x[:, None] + DISC_X]
        angle = np.arctan2((patch * DISC_Y).sum(1), (patch * DISC_X).sum(1))
        turn = np.rint(angle / (2 * np.pi) * TURNS).astype(int) % TURNS
        smooth = box(a, 1)
        t = TESTS[turn]
        bits = smooth[y[:, None] + t[:, :, 1], x[:, None] + t[:, :, 0]] < smooth[y[:, None] + t[:, :, 3], x[:, None] + t[:, :, 2]]
        c = np.zeros(len(y), CORNER)
        c["x"], c["y"], c["scale"], c["turn"], c["bits"] = (x + 0.5) / scale, (y + 0.5) / scale, scale, turn, np.packbits(bits, axis=1)
        out.append(c)
    return np.concatenate(out) if out else np.zeros(0, CORNER)


def table_keys(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of an image's pairs of near corners, one for each slice of bits, and with each the pair's bits in the next slice."""
    slices = BITS // SLICE
    bits = np.unpackbits(found["bits"], axis=1)[:, : slices * SLICE].reshape(-1, slices, SLICE) @ (np.uint64(1) << np.arange(SLICE, dtype=np.uint64))
    keys, sketches = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for scale in SCALES:
        at = np.flatnonzero(found["scale"] == np.float32(scale))
        if len(at) < 2:
            continue
        z = (found["x"][at] + 1j * found["y"][at]) * scale
        far = np.abs(z[:, None] - z)
        np.fill_diagonal(far, np.inf)
        near = np.argsort(far, axis=1, kind="stable")[:, : min(NEIGHBOURS, len(at) - 1)]
        i, j = np.repeat(np.arange(len(at)), near.shape[1]), near.reshape(-1)
        one = np.unique(np.minimum(i, j) * len(at) + np.maximum(i, j))
        i, j = one // len(at), one % len(at)
        angle = np.angle(z[j] - z[i]) / (2 * np.pi) * TURNS
        seen = lambda k, a: np.floor((a - found["turn"][at[k]]) % TURNS / TURNS * SECTORS).astype(np.uint64) % np.uint64(SECTORS)
        reach = np.floor(np.log2(np.maximum(far[i, j], 1))).astype(np.uint64)
        p, q = bits[at[i]] * np.uint64(SECTORS) + seen(i, angle)[:, None], bits[at[j]] * np.uint64(SECTORS) + seen(j, angle + TURNS / 2)[:, None]
        low, high = np.minimum(p, q), np.maximum(p, q)
        place = (np.arange(1, slices + 1, dtype=np.uint64) << np.uint64(40)) + reach[:, None]
        keys.append(mix(mix(low ^ mix(place)) + high).reshape(-1))
        # the same pair in the same order: that of its key
        x, y = np.roll(bits, -1, axis=1)[at[i]], np.roll(bits, -1, axis=1)[at[j]]
        first, second = np.where(p < q, x, np.where(p > q, y, np.minimum(x, y))), np.where(p < q, y, np.where(p > q, x, np.maximum(x, y)))
        sketches.append((first << np.uint64(32) | second).reshape(-1))
    return np.concatenate(keys), np.concatenate(sketches)


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n), a < b, of rows (key, id, sketch) sorted by key: how often rows of a key have sketches that differ in few bits.

    The first LEADERS rows of a key are paired with all its rows.  Only these are kept while a key goes on.
    """
    held, done = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)], 0
    for b in batches:
        new = [b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy().view(np.uint64)]
        rows = [np.concatenate(x) for x in zip(held, new)]
        if not len(rows[0]):
            continue
        begin = int(np.argmax(rows[0] == rows[0][-1]))  # the last key may go on in the next batch
        whole = begin if begin or len(rows[0]) <= 2 * LEADERS else len(rows[0])
        yield paired(*(x[:whole] for x in rows), done)
        if whole > begin:  # all rows are of one key
            held, done = [x[:LEADERS] for x in rows], LEADERS
        else:
            held, done = [x[whole:] for x in rows], 0 if whole else done
    yield paired(*held, done)


def paired(key: np.ndarray, ids: np.ndarray, sketch: np.ndarray, done: int) -> pa.RecordBatch:
    """Pairs of rows; the first ``done`` rows, which are of one key, were paired among themselves before."""
    fresh = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
    rank = np.arange(len(key)) - start
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(LEADERS):
        later = np.flatnonzero(rank > k)
        if not len(later):
            break
        later = later[later >= done]
        leader = start[later] + k
        close = (np.bitwise_count(sketch[later] ^ sketch[leader]) <= MOST_SKETCH) & (ids[later] != ids[leader])
        a.append(np.minimum(ids[later], ids[leader])[close])
        b.append(np.maximum(ids[later], ids[leader])[close])
    a, b = np.concatenate(a), np.concatenate(b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.zeros(0, np.int64)
    return pa.record_batch([pa.array(a[first]), pa.array(b[first]), pa.array(np.diff(np.append(first, len(a))))], ["a", "b", "n"])


class Crowds:
    """Collects, from rows (key, id, sketch) sorted by key, those that come after the LEADERS first of their key, in blocks."""

    def __init__(self):
        self.key, self.seen = None, 0
        self.own, self.block, self.ids, self.sketches = None, 0, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def take(self, b: pa.RecordBatch) -> Iterator[tuple]:
        """The blocks (key, block, ids, sketches) that are full, or whose key is through, with the rows of a batch."""
        key, ids, sketch = (b.column(c).to_numpy() for c in range(3))
        if not len(key):
            return
        at = np.arange(len(key))
        start = np.maximum.accumulate(np.where(np.concatenate(([True], key[1:] != key[:-1])), at, 0))
        rank = at - start + np.where((start == 0) & (key[0] == self.key), self.seen, 0)
        self.key, self.seen = key[-1], int(rank[-1]) + 1
        rest = np.flatnonzero(rank >= LEADERS)
        for part in np.split(rest, np.flatnonzero(np.diff(start[rest])) + 1) if len(rest) else ():
            if key[part[0]] != self.own:
                yield from self.flush()
                self.own, self.block = key[part[0]], 0
            self.ids, self.sketches = np.concatenate((self.ids, ids[part])), np.concatenate((self.sketches, sketch[part]))
            while len(self.ids) >= CROWD:
                yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        if len(self.ids):
            yield int(self.own), self.block, self.ids[:CROWD].tobytes(), self.sketches[:CROWD].tobytes()
            self.ids, self.sketches, self.block = self.ids[CROWD:], self.sketches[CROWD:], self.block + 1


SWEPT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("block", pa.int32()), ("ids", pa.binary()), ("sketches", pa.binary())])


def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What met() gives, and beside it the blocks of rows that only met their leaders there: one or the other in each row."""
    crowds, full = Crowds(), []

    def passing() -> Iterator[pa.RecordBatch]:
        for b in batches:
            full.extend(crowds.take(b))
            yield b

    def blocks() -> Iterator[pa.RecordBatch]:
        for x in full:
            yield pa.RecordBatch.from_pylist([dict(zip(SWEPT.names[3:], x))], SWEPT)
        full.clear()

    for p in met(passing()):
        yield pa.RecordBatch.from_arrays([*p.columns, *(pa.nulls(p.num_rows, SWEPT.field(k).type) for k in range(3, 7))], schema=SWEPT)
        yield from blocks()
    full.extend(crowds.flush())
    yield from blocks()


def crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n), a < b, of rows (s, t, ids, sketches, ids, sketches), two blocks of a key: all pairs of rows that differ in few bits."""
    for batch in batches:
        for s, t, *rows in zip(*(c.to_pylist() for c in batch.columns)):
            ids, sketch, others, their = (np.frombuffer(x, d) for x, d in zip(rows, (np.int64, np.uint64) * 2))
            for k in range(0, len(ids), 128):
                i, j = np.nonzero(np.bitwise_count(sketch[k : k + 128, None] ^ their[None]) <= MOST_SKETCH)
                i += k
                i, j = (i[i < j], j[i < j]) if s == t else (i, j)
                apart = ids[i] != others[j]
                x, y = ids[i][apart], others[j][apart]
                if len(x):
                    yield pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(np.ones(len(x), np.int64))], ["a", "b", "n"])


def candidates(own: DataFrame) -> DataFrame:
    """(a, b), a < b: images of (id, corners) that meet in VOTES rows of the Hamming tables; each key's rows pass by in order, in one
    shuffle.

    In a key of more than LEADERS rows the first ones meet all others as these pass; the others are cut into blocks, and each two
    blocks are a row of their own, so that a key of any size is spread and none of its pairs is left out.
    """

    def keyed(b: pa.RecordBatch) -> pa.RecordBatch | None:
        made = [table_keys(np.frombuffer(x, CORNER)) for x in b.column(1).to_pylist()]
        ids = np.repeat(b.column(0).to_numpy(), [len(k) for k, _ in made])
        keys, sketches = (np.concatenate(x).view(np.int64) for x in zip(*made))
        return pa.record_batch([pa.array(keys), pa.array(ids), pa.array(sketches)], ["key", "id", "sketch"]) if len(ids) else None

    rows = map_arrow(own.select("id", "corners"), keyed, "key long, id long, sketch long", 500)
    dealt = rows.repartition("key").sortWithinPartitions("key", F.xxhash64("id", "key"))
    both = cut(dealt.mapInArrow(tidy(swept), "a long, b long, n long, key long, block int, ids binary, sketches binary"))
    blocks = both.filter("key is not null").select("key", "block", "ids", "sketches")
    last = blocks.groupBy("key").agg(F.max("block").alias("last"))
    x = blocks.join(last, "key").select("key", F.col("block").alias("s"), F.explode(F.sequence("block", "last")).alias("t"), "ids", "sketches")
    y = blocks.select("key", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("s"), F.col("block").alias("t"), F.col("ids").alias("others"), F.col("sketches").alias("their"))
    rest = x.join(y, ["key", "s", "t"]).select("s", "t", "ids", "sketches", "others", "their").mapInArrow(tidy(crowded), "a long, b long, n long")
    votes = both.filter("a is not null").select("a", "b", "n").unionByName(rest).groupBy("a", "b").agg(F.sum("n").alias("n"))
    return votes.filter(F.col("n") >= VOTES).select("a", "b")


def agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many matched corners of two images agree on one similarity transform, at best."""
    if not len(a) or not len(b):
        return 0
    distance = np.bitwise_count(a["bits"][:, None] ^ b["bits"][None]).sum(2, dtype=int)
    i, j = np.nonzero(distance <= MOST_BITS)
    if len(i) < AGREEING:
        return 0
    p, q = a[i], b[j]
    # each match proposes a turn, a scale and a shift; count the others that it fits
    angle = (q["turn"].astype(float) - p["turn"]) * 2 * np.pi / TURNS
    factor = p["scale"] / q["scale"]
    z, w = p["x"] + 1j * p["y"], q["x"] + 1j * q["y"]
    k = factor * np.exp(1j * angle)
    moved = k[:, None] * (z[None] - z[:, None]) + w[:, None]
    turned = np.abs((angle[:, None] - angle[None] + np.pi) % (2 * np.pi) - np.pi) < 3 * np.pi / TURNS
    fits = (np.abs(moved - w[None]) < NEAR / p["scale"][None]) & turned & (np.abs(np.log(factor[:, None] / factor[None])) < 0.1)
    best = 0
    for row in fits:
        best = max(best, min(len(np.unique(i[row])), len(np.unique(j[row]))))
    return best


def describe(media: DataFrame, id_col: str = "media_id", image_col: str = "image") -> DataFrame:
    """(id, digest, corners): what later steps need of each image; rows without an id or an image are left out, repeated ids stay."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = [(i, x, c) for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if i is not None and (c := decoded(x)) is not None]
        if not rows:
            return None
        return pa.record_batch(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([hashlib.md5(r[1]).digest() for r in rows], pa.binary()), pa.array([corners(c).tobytes() for _, _, c in rows], pa.binary())],
            ["id", "digest", "corners"],
        )

    return map_arrow(media.select(media[id_col].cast("long").alias("id"), media[image_col].alias("image")), run, "id long, digest binary, corners binary", 500)


def copies(media: DataFrame, agreeing: int = AGREEING, id_col: str = "media_id", image_col: str = "image") -> DataFrame:
    """(id, class_id, n_links) of every image with an id: the least id of its class, and how many different images it is linked with.

    Equal files are one class; of these only the least id is compared.  Ids without a readable image are classes of their
    own.  Repeated ids count as the image of least digest, and an empty table gives an empty one.
    """
    bounded(media.sparkSession)
    all_ = cut(describe(media, id_col, image_col))
    heads = cut(all_.groupBy("digest").agg(F.min("id").alias("head")))
    # an id's head: that of its image of least digest
    same = all_.select("id", "digest").join(heads, "digest").groupBy("id").agg(F.min("head").alias("head"))
    first = heads.groupBy(F.col("head").alias("id")).agg(F.min("digest").alias("digest"))
    own = all_.join(first, ["id", "digest"], "left_semi").dropDuplicates(["id"])
    pairs = cut(candidates(own))
    x, y = (own.select(F.col("id").alias(k), F.col("corners").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    both = pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [agree(np.frombuffer(p, CORNER), np.frombuffer(q, CORNER)) for p, q in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(np.array(n, int) >= agreeing))

    links = cut(both.mapInArrow(tidy(run), "a long, b long").distinct())
    ends = links.union(links.select("b", "a")).groupBy(F.col("a").alias("head")).agg(F.count("*").alias("n_links"))
    label = components(links).select(F.col("id").alias("head"), "label")
    known = same.join(label, "head", "left").join(ends, "head", "left").select("id", F.coalesce("label", "head").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    ids = media.select(media[id_col].cast("long").alias("id")).dropna()
    return ids.join(known, "id", "left").select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def drawn(vector: bytes, side: int = 64, shapes: int = 8) -> np.ndarray:
    """An image that a vector's bytes determine: cloudy grey with some rectangles of other grey on it."""
    rng = np.random.default_rng(int.from_bytes(hashlib.md5(vector).digest(), "little"))
    coarse, place = rng.integers(0, 200, (15, 15)).astype(float), np.arange(side) * 13.0 / side
    i, f = place.astype(int), place - place.astype(int)
    rows = coarse[i] * (1 - f[:, None]) + coarse[i + 1] * f[:, None]
    out = rows[:, i] * (1 - f) + rows[:, i + 1] * f
    for x, y, w, h, g in zip(*(rng.integers(0, side, (2, shapes))), *(rng.integers(6, side // 3, (2, shapes))), rng.integers(-60, 60, shapes)):
        out[max(0, y - h // 2) : y + h // 2, max(0, x - w // 2) : x + w // 2] += g
    return np.clip(out, 0, 255)


def changed(image: np.ndarray, kind: int) -> np.ndarray:
    """An edited copy: cropped, brightened, turned by a quarter, or with a patch put on."""
    if kind == 0:
        return image[5:-3, 4:-6]
    if kind == 1:
        return np.clip(image * 0.8 + 30, 0, 255)
    if kind == 2:
        return np.rot90(image)
    out = image.copy()
    out[4:20, 6:24] = 255
    return out


def media_of_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(media_id, image): for each vector an image drawn from it, 2 * id, and an edited copy of that, 2 * id + 1.

    Equal vectors give equal images; the kind of edit goes by the id.  Null vectors give null images, null ids none.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, images = [], []
        for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if i is None:
                continue
            image = None if v is None else drawn(np.array([np.nan if x is None else x for x in v], "<f4").tobytes())
            ids += [2 * i, 2 * i + 1]
            images += [None, None] if image is None else [pgm(image), pgm(changed(image, i % 4))]
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(images, pa.binary())], ["media_id", "image"]) if ids else None

    return map_arrow(vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].alias("v")), run, "media_id long, image binary")
