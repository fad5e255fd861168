"""Operators over whole corpora: archives, images, mixing, substrings, near copies, and the pipeline."""

import gzip
import hashlib
import itertools
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from netweir.llm import media, minhash, mixing, suffix, warc
from netweir.llm.components import components

from .test_text import brute_lines, docs


def pages(spark, *rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, sha string, first int")


@pytest.mark.parametrize("copies,most", [(1000, 100_000), (0, 2), (1, 100_000)])
def test_archives_round_trip(spark, copies, most, monkeypatch):
    monkeypatch.setattr(warc, "COPIES", copies)
    monkeypatch.setattr(warc, "HOT", most)
    p = pages(spark, (3, "http://a/", "<p>x", "s", 1), (1, None, None, "s", 1), (2, "u v\r\n", "", "s", 1), (9, "u", "<p>x", "s", 1), (5, "u", "é" * 300000, "s", 1), (None, "u", "<p>x", "s", 1), (3, "u", "<p>x", "s", 1))
    out = {}
    for r in warc.archive_pages(p).collect():
        out.setdefault(r["page_id"], []).append(r)
    assert {k: len(v) for k, v in out.items()} == {1: 1, 2: 1, 3: 2, 5: 1, 9: 1, None: 1}
    assert [out[k][0]["record_type"] for k in (1, 2, 3, 9, 5, None)] == ["response", "revisit", "response", "revisit", "response", "revisit"]
    assert [out[k][0]["refers_to"] for k in (2, 9, None, 5)] == [1, 3, 3, None]
    assert out[5][0]["payload_bytes"] == 600000 and out[9][0]["payload_bytes"] == 4
    assert out[1][0]["payload_digest"] == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert warc.archive_pages(p.limit(0)).count() == 0


def test_archives_of_a_very_common_page(spark, monkeypatch):
    monkeypatch.setattr(warc, "COPIES", 5)
    rows = [(i, f"http://h/{i}", "<p>same" if i % 3 else f"<p>{i // 6}", "s", 1) for i in range(5, 300)] + [(None, None, "<p>none", "s", 1)] * 9
    out = warc.archive_pages(pages(spark, *rows)).collect()
    least = {}
    for i, _, t, _, _ in rows:
        least[t] = min(least.get(t, i), i) if i is not None else None
    want = [(i, "response" if least[t] in (None, i) else "revisit", None if least[t] in (None, i) else least[t]) for i, _, t, _, _ in rows]
    assert sorted(map(str, ((r["page_id"], r["record_type"], r["refers_to"]) for r in out))) == sorted(map(str, want))


def test_monolithic_archives_get_a_member_for_each_record(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i}" * 50, "s", 1) for i in range(30)]
    written = warc.write_archives(pages(spark, *rows), f"file://{tmp_path}/raw")
    warc.normalise(written, f"file://{tmp_path}/raw", f"file://{tmp_path}/new")
    for f in Path(f"{tmp_path}/new").glob("*.warc.gz"):
        raw = Path(f"{tmp_path}/raw", f.name).read_bytes()
        assert gzip.decompress(f.read_bytes()) == gzip.decompress(raw)
        assert len(list(warc.records(warc.inflated(f.open("rb"), 100)))) == len(Path(f"{f}.idx").read_text().splitlines())
    back = warc.read_archives(written.select("archive"), f"file://{tmp_path}/new", payloads=True).collect()
    assert {r["page_id"]: r["payload"].decode() for r in back} == {r[0]: r[2] for r in rows}


def test_images_edited_copies_are_found(spark):
    v = spark.createDataFrame([(i, [float(i % 40), 1.0], 0) for i in range(60)] + [(100, None, 0), (None, [1.0], 0)], "vec_id long, embedding array<float>, label int")
    m = media.media_of_vectors(v)
    out = {r["media_id"]: r["class_id"] for r in media.copies(m).collect()}
    assert len(out) == 122 and out[200] == 200
    assert sum(out[2 * i] == out[2 * i + 1] for i in range(60)) >= 58
    assert all(out[2 * i] == out[2 * (i + 40)] for i in range(20))
    assert len({out[2 * i] for i in range(40)}) == 40
    assert media.copies(m.limit(0)).count() == 0
    bad = spark.createDataFrame([(1, b"no image"), (2, None), (3, media.pgm(np.zeros((3, 3))))], "media_id long, image binary")
    assert {r["media_id"]: r["class_id"] for r in media.copies(bad).collect()} == {1: 1, 2: 2, 3: 3}


def test_images_tables_find_what_brute_force_finds(spark):
    # edits of the adapter, and noise, coarse grey values and a small shift together
    rng = np.random.default_rng(5)
    noisy = lambda x: np.round(np.clip(x[3:, 2:] * 1.1 - 5 + rng.normal(0, 2, (x.shape[0] - 3, x.shape[1] - 2)), 0, 255) / 8) * 8
    images = [media.drawn(bytes([k, 1])) for k in range(60)]
    both = [*images, *(noisy(x) if k % 5 == 4 else media.changed(x, k % 5) for k, x in enumerate(images))]
    files = [media.pgm(np.ascontiguousarray(x)) for x in both]
    found = [media.corners(media.decoded(x)) for x in files]
    links = {(a, b) for a, b in itertools.combinations(range(120), 2) if media.agree(found[a], found[b]) >= media.AGREEING}
    own = media.describe(spark.createDataFrame(list(enumerate(files)), "media_id long, image binary"))
    pairs = {(r["a"], r["b"]) for r in media.candidates(own).collect()}
    assert len(links & pairs) >= 0.95 * len(links) and len(links) >= 59 and len(pairs) < 200
    # the whole query: links and classes of those pairs
    label = {k: k for k in range(120)}
    for a, b in sorted(links & pairs):
        label[b] = min(label[a], label[b])
    got = {r["media_id"]: r for r in media.copies(spark.createDataFrame([(k, x, "x", 1) for k, x in enumerate(files)], "media_id long, image binary, corners string, key int")).collect()}
    assert {k: r["class_id"] for k, r in got.items()} == label
    assert sum(r["n_links"] for r in got.values()) == 2 * len(links & pairs)


@pytest.mark.parametrize("each", [1, 7, 50, 1000])
def test_images_keys_of_many_rows_meet_their_leaders(each, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(media, "LEADERS", 4)
    sizes = [1, 3, 5, 40, 2, 5]
    rows = [(k, 100 * k + i, 0) for k, n in enumerate(sizes) for i in range(n)]
    batches = [pa.record_batch([pa.array([r[c] for r in rows[i : i + each]], pa.int64()) for c in range(3)], ["key", "id", "sketch"]) for i in range(0, len(rows), each)]
    got = sorted((a, b) for x in media.met(iter(batches)) for a, b, n in zip(*(c.to_pylist() for c in x.columns)) for _ in range(n))
    assert got == [(100 * k + i, 100 * k + j) for k, n in enumerate(sizes) for i in range(min(4, n)) for j in range(i + 1, n)]


def test_images_of_crowded_keys_all_meet(spark):
    # two corners an image, their places and nearly all of their bits alike: a few keys hold most of 300 images
    rng, rows = np.random.default_rng(3), []
    for k in range(300):
        c = np.zeros(2, media.CORNER)
        c["x"], c["y"], c["scale"], c["turn"] = (10, 30), (10, 22), 1, (3, 9)
        bits = np.zeros((2, media.BITS), np.uint8)
        bits[0, rng.integers(0, media.BITS, rng.integers(0, 12))] = 1
        c["bits"] = np.packbits(bits, axis=1)
        rows.append((k, c.tobytes()))
    votes, sizes = {}, {}
    for k, x in rows:
        for key, sketch in zip(*media.table_keys(np.frombuffer(x, media.CORNER))):
            for other, seen in sizes.setdefault(int(key), []):
                if (int(sketch) ^ seen).bit_count() <= media.MOST_SKETCH:
                    votes[other, k] = votes.get((other, k), 0) + 1
            sizes[int(key)].append((k, int(sketch)))
    want = {p for p, n in votes.items() if n >= media.VOTES}
    got = media.candidates(spark.createDataFrame(rows, "id long, corners binary").repartition(3)).collect()
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)
    assert max(map(len, sizes.values())) > 2 * media.LEADERS and len(want) > 1000


@pytest.mark.parametrize("each", [1, 7, 50, 1000])
def test_images_beyond_the_leaders_are_cut_into_blocks(each, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(media, "LEADERS", 4)
    monkeypatch.setattr(media, "CROWD", 8)
    sizes = [1, 3, 5, 40, 2, 30, 5]
    rows = [(k, 100 * k + i, i) for k, n in enumerate(sizes) for i in range(n)]
    batches = [pa.record_batch([pa.array([r[c] for r in rows[i : i + each]], pa.int64()) for c in range(3)], ["key", "id", "sketch"]) for i in range(0, len(rows), each)]
    got = [r for x in media.swept(iter(batches)) for r in x.to_pylist() if r["key"] is not None]
    assert sorted((r["key"], r["block"], i) for r in got for i in np.frombuffer(r["ids"], np.int64)) == [(k, (i - 4) // 8, 100 * k + i) for k, n in enumerate(sizes) for i in range(4, n)]


def test_images_that_repeat_an_id(spark):
    a, b = (media.pgm(media.drawn(bytes([k]))) for k in (1, 2))
    d = spark.createDataFrame([(1, a), (1, b), (2, a), (2, a), (None, a)], "media_id long, image binary")
    got = [(r["media_id"], r["class_id"]) for r in media.copies(d).collect()]
    assert len(got) == 4 and {i for i, _ in got} == {1, 2} and all(c == 1 for _, c in got)


def test_mix_is_pfair_and_whole(spark):
    rng = random.Random(0)
    rows = [(i, rng.choice("aaaaaabbc")) for i in range(3000)] + [(5000, None), (None, "b"), (7, "a")]
    d = spark.createDataFrame([(i, s, 1, "x") for i, s in rows], "doc_id long, source string, slot int, block string")
    weights = {"a": 0.5, "b": 0.3, "c": 0.15, mixing.NO_SOURCE: 0.05}
    out = mixing.mix(d, weights, block_rows=4, cycle=100).collect()
    assert sorted((str(r["doc_id"]), str(r["source"])) for r in out) == sorted((str(i), str(s)) for i, s in rows)
    blocks = {(r["source"], r["block"]): (r["slot"], r["release"], r["deadline"]) for r in out}
    slots = sorted(x[0] for x in blocks.values())
    assert slots == list(range(len(blocks))) and all(r <= s < e for s, r, e in blocks.values())
    done, left = Counter(), Counter(s for s, _ in blocks)
    name = lambda s: mixing.NO_SOURCE if s is None else s
    order = sorted((x[0], s) for (s, _), x in blocks.items())
    # in each phase, from one source's end to the next, the shares of those that are left hold to less than a block
    start, since = 0, Counter()
    for t, s in order:
        live = {k for k in left if done[k] < left[k]}
        q = mixing.quotas({name(k): weights[name(k)] for k in live}, 100)
        done[s] += 1
        since[s] += 1
        n = t + 1 - start
        if live == {k for k in left if done[k] < left[k]}:
            assert all(abs(since[k] - n * q[name(k)] / sum(q.values())) < 1 for k in live)
        else:
            # the source that ended leaves the phase at the slot where it would be next
            break
    assert mixing.mix(d.limit(0)).count() == 0
    own = spark.createDataFrame([(i, s, 1000 + k, f"b{k}", k, -k, f"d{k}") for k, (i, s) in enumerate(rows)], "doc_id long, source string, slot int, block string, _k int, _row int, doc string")
    back = mixing.mixed(own, block_rows=4)
    assert back.columns == own.columns and sorted(map(str, back.collect())) == sorted(map(str, own.collect()))


def holds_pfair(spark, blocks, weights, least):
    """All blocks have a slot of their own within their windows, and no share is off by a block after any slot of a phase."""
    made = mixing.phases(blocks, weights, least)
    out = mixing.places(spark, made).collect()
    order = {r["slot"]: (r["_source"], r["block"]) for r in out}
    assert sorted(order) == list(range(sum(blocks.values()))) and len(out) == len(set(order.values())) == len(order)
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in out)
    for start, length, _, total, names, part, base, _ in made:
        assert all(abs(p / total - weights[s] / sum(weights[k] for k in names)) < 1e-9 for s, p in zip(names, part))
        done = dict(zip(names, base))
        for t in range(length):
            s, k = order[start + t]
            assert done[s] == k
            done[s] += 1
            assert all(abs((done[s] - b) * total - p * (t + 1)) < total for s, p, b in zip(names, part, base)), t
    return made


def test_mix_stretches_hold_the_bound(spark):
    rng = random.Random(1)
    assert mixing.phases({}, {}, 5) == [] and mixing.places(spark, []).count() == 0
    holds_pfair(spark, {"a": 1}, {"a": 1.0}, 5)
    made = holds_pfair(spark, {f"s{i}": 60 for i in range(20)}, dict.fromkeys([f"s{i}" for i in range(20)], 1.0), 10)
    assert len(made) == 1 and made[0][1] // made[0][2] > 50  # many stretches
    for n in (2, 3, 8, 30):
        weights = {f"s{i}": rng.choice([rng.random() + 0.02, 1.0, rng.random() ** 3 + 0.01]) for i in range(n)}
        holds_pfair(spark, {s: rng.choice([rng.randrange(1, 300), int(300 * w) + 1]) for s, w in weights.items()}, weights, rng.choice([1, 5, 50]))


def test_mix_keeps_to_the_target_weights(spark):
    # one source of half the weight beside many small ones, and a cycle too short for them
    weights = {"big": 0.5, **{f"s{k}": 0.5 / 60 for k in range(60)}}
    rows = [(i, "big" if i % 2 else f"s{i // 2 % 60}") for i in range(2400)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), weights, block_rows=2, cycle=24).collect()
    order = [s for _, s in sorted({(r["slot"], r["source"]) for r in out})]
    assert len(order) == len({r["slot"] for r in out}) == 1200
    done = Counter()
    for t, s in enumerate(order, 1):
        done[s] += 1
        assert all(abs(done[k] - t * w) < 1 for k, w in weights.items()), t


def test_mix_does_not_drift(spark):
    sizes = {f"s{k}": 100000 if k == 0 else 900 + 97 * k for k in range(20)}
    made = holds_pfair(spark, {s: int(0.15 * n) for s, n in sizes.items()}, {s: n**0.5 for s, n in sizes.items()}, 240)
    assert sum(m[1] // m[2] for m in made) > 60


@pytest.mark.parametrize("shallow", [8, 16, 32])
@pytest.mark.parametrize("letters", [1, 2, 250])
@pytest.mark.parametrize("small", [9, 512, 10_000])
def test_deep_shallow_sorts(shallow, letters, small, monkeypatch):
    monkeypatch.setattr(suffix, "SMALL", small)
    rng = np.random.default_rng(letters)
    t = rng.integers(0, letters, 3000).astype(np.uint8)
    t[100:260] = t[2000:2160]
    starts = rng.permutation(3000)
    order, head = suffix.deep_shallow(t, starts, 50, shallow)
    raw = t.tobytes() + bytes(50)
    keys = [raw[s : s + 50] for s in starts[order]]
    assert keys == sorted(keys) and [bool(h) for h in head] == [k == 0 or keys[k] != keys[k - 1] for k in range(3000)]


def test_quicksort_parts_groups_at_one_depth():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 600, 5000):
        word = rng.integers(0, 40, n).astype(np.uint64) << np.uint64(60 if n % 2 else 3)
        starts, order, head = rng.permutation(n), np.arange(n), np.arange(n) % max(1, n) == 0
        suffix.quicksort(word, starts, order, head, 0, 8)
        got = word[starts[order]]
        assert (got == np.sort(word)).all() and sorted(order) == list(range(n))
        assert head.tolist() == [k == 0 or bool(got[k] != got[k - 1]) for k in range(n)]


def brute_substrings(rows, n=50):
    first = {}
    for i, t in sorted(rows):
        for p in range(len(t) - n + 1):
            first.setdefault(t[p : p + n], i)
    out = {}
    for i, t in rows:
        gone = [False] * len(t)
        for p in range(len(t) - n + 1):
            if first[t[p : p + n]] < i:
                gone[p : p + n] = [True] * n
        out[i] = bytes(b for b, g in zip(t, gone) if not g)
    return out


@pytest.mark.parametrize("settings", [{}, {"hot": 1, "batch_bytes": 2000, "bucket_bytes": 3000}])
def test_substrings_against_brute_force(spark, settings):
    rng = random.Random(6)
    passages = ["".join(rng.choice("ab cé") for _ in range(rng.choice([30, 49, 50, 51, 120]))) for _ in range(12)]
    rows = [(i, "".join(rng.choice([*passages, "".join(rng.choice("xyzé ") for _ in range(40))]) for _ in range(rng.randint(0, 6)))) for i in range(80)]
    rows += [(200, "a" * 400), (201, "a" * 70), (202, "ab" * 100)]
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix.dedup_substrings(docs(spark, *rows), **settings).collect()}
    assert got == brute_substrings([(i, t.encode()) for i, t in rows])


def test_substrings_odd_rows(spark):
    long = "q" * 30 + "w" * 40
    d = docs(spark, (1, None), (2, ""), (3, long), (3, long), (None, long), (4, long))
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix.dedup_substrings(d).collect())
    assert got == [("1", 0, 0, 0), ("2", 0, 0, 0), ("3", 70, 0, 0), ("3", 70, 0, 0), ("4", 70, 70, 1), ("None", 70, 0, 0)]
    assert suffix.dedup_substrings(d.limit(0)).count() == 0


def test_substrings_of_very_long_texts(spark):
    rng = random.Random(2)
    long = " ".join(str(rng.random()) for _ in range(60_000))  # over a million characters
    part = long[700_000:700_500]
    rows = [(5, long), (2, part), (9, long), (7, "x" + long[10:]), (8, "a" * 1_000_000)]
    out = {r["doc_id"]: r for r in suffix.dedup_substrings(docs(spark, *rows)).collect()}
    assert bytes(out[5]["kept"]).decode() == long[:700_000] + long[700_500:] and out[5]["n_spans"] == 1
    assert bytes(out[2]["kept"]).decode() == part and bytes(out[9]["kept"]) == b"" and bytes(out[7]["kept"]) == b"x"
    assert out[8]["n_removed"] == 0 and out[8]["n_bytes"] == 1_000_000


def near_corpus(rng, n=120):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for i in range(n):
        if i % 3 == 0 or not rows:
            rows.append((i, " ".join(word() for _ in range(rng.randint(60, 200)))))
        else:
            w = rng.choice(rows)[1].split(" ")
            for _ in range(rng.choice([0, 1, 2])):
                w[rng.randrange(len(w))] = word()
            rows.append((i, " ".join(w)))
    return rows


def brute_classes(rows, least):
    """Components of weighted Jaccard links by plain sets, with weights from a plain count of documents."""
    words = [t.lower().split() for _, t in rows]
    df = Counter(w for x in words for w in set(x))
    n = len(rows)
    idf = {w: 1 + np.log((1 + n) / (1 + k)) / np.log(2 + n) for w, k in df.items()}
    sets = []
    for x in words:
        s = Counter(tuple(x[k : k + 5]) for k in range(len(x) - 4)) if len(x) >= 5 else Counter([tuple(x)] if x else [])
        sets.append({g: c * np.round(sum(idf[w] for w in g) / len(g) * 256) / 256 for g, c in s.items()})
    label = {i: i for i, _ in rows}
    sim = {}
    for (a, (i, t)), (b, (j, u)) in itertools.combinations(enumerate(rows), 2):
        shared = sum(min(w, sets[b][g]) for g, w in sets[a].items() if g in sets[b])
        total = sum(sets[a].values()) + sum(sets[b].values()) - shared
        sim[i, j] = 1.0 if t == u else shared / total if total else 0.0
    for _ in rows:
        for (i, j), s in sim.items():
            if s >= least:
                label[i] = label[j] = min(label[i], label[j])
    return label, sim


def test_near_copies_against_brute_force(spark):
    rows = near_corpus(random.Random(2)) + [(500, ""), (501, None), (502, "two words"), (503, "Two  words"), (504, "three more words")]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs(spark, *rows)).collect()}
    expected, sim = brute_classes([(i, t or "") for i, t in rows], 0.8)
    assert got == expected


def test_near_copies_odd_rows(spark):
    t = "one two three four five six seven"
    d = docs(spark, (1, t), (1, t), (None, t), (2, t), (3, "other"))
    got = sorted((str(r["doc_id"]), r["class_id"]) for r in minhash.near_duplicates(d).collect())
    assert got == [("1", 1), ("1", 1), ("2", 1), ("3", 3), ("None", None)]
    assert sorted(str(r["doc_id"]) for r in minhash.kept(d).collect()) == ["1", "1", "3", "None"]
    assert minhash.near_duplicates(d.limit(0)).count() == 0 and minhash.kept(d).columns == d.columns


def test_large_groups_give_all_links(spark, monkeypatch):
    # copies of one text are similar to it, not to each other: every link of the group counts, in blocks of any size
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    text = [word() for _ in range(200)]
    rows = [(1000, " ".join(text))]
    for i in range(150):
        w = list(text)
        for k in rng.sample(range(10, 190, 9), 3):
            w[k] = word()
        rows.append((i, " ".join(w)))
    rows += [(2000 + i, " ".join(text + [word() for _ in range(4 * i)])) for i in range(1, 40)]
    expected, sim = brute_classes(rows, 0.8)
    sure, most = Counter(), Counter()
    for (a, _), (b, _) in itertools.combinations(rows, 2):
        for k in (a, b):
            sure[k] += sim[(a, b)] >= 0.802
            most[k] += sim[(a, b)] >= 0.798
    assert sure[1000] >= 150
    for texts in (1024, 16):
        monkeypatch.setattr(minhash, "BLOCK_TEXTS", texts)
        got = {r["doc_id"]: r for r in minhash.near_duplicates(docs(spark, *rows)).collect()}
        assert {k: r["class_id"] for k, r in got.items()} == expected
        assert all(sure[k] <= r["n_links"] <= most[k] for k, r in got.items())


def test_weights_shared_by_matrices():
    rng = np.random.default_rng(3)
    h = [np.sort(rng.choice(500, 300, replace=False)).astype(np.uint64) for _ in range(7)]
    w = [rng.integers(1, 4, 300) * (1 + x / 512) for x in h]
    got = minhash.shared_weights(h, w, 3)
    for i in range(3):
        for j in range(3, 7):
            _, f, g = np.intersect1d(h[i], h[j], return_indices=True)
            assert abs(got[i, j - 3] - np.minimum(w[i][f], w[j][g]).sum()) < 1e-9


def test_samples_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    h = np.sort(rng.integers(0, 1 << 62, 300).astype(np.uint64))
    w = rng.uniform(0.5, 3, 300)
    v = np.where(rng.random(300) < 0.3, w * 0.5, w)
    each = [minhash.sampled(np.zeros(300, int), h + np.uint64(k), x, 1)[0] for k in range(30) for x in (w, v)]
    same = np.mean([(a == b).mean() for a, b in zip(each[::2], each[1::2])])
    assert abs(same - np.minimum(w, v).sum() / np.maximum(w, v).sum()) < 0.04


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (None, 5)], "a long, b long")
    got = {r["id"]: r["label"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components(links.limit(0)).count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    from netweir.llm import bpe, toxicity
    from netweir.llm.queries import vocabulary_path

    rng = random.Random(9)
    line = "a line of more than forty characters that many documents hold"
    rows = [(i, t + ("\n" + line if i % 4 == 0 else "") + (" you stupid idiot." if i % 10 == 7 else "")) for i, t in near_corpus(rng)]
    d = spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 7)) for i, _ in rows], "doc_id long, quality int, toxic int")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    clean = [(i, t) for i, t in rows if i % 10 != 7]
    cut = list(brute_lines(clean).items())
    label, _ = brute_classes(cut, 0.8)
    keep = {i: t for i, t in cut if label[i] == i}
    codec = bpe.Codec(vocabulary_path())
    assert got == {i: codec.encode_all([t])[0] for i, t in keep.items()}
    docs_ = d
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_ = stage(spark, docs_, str(tmp_path))
        assert docs_.columns == d.columns, name
    assert toxicity.Model().score("") < 0.5 and hashlib


def test_pipeline_keeps_the_order_of_the_mix(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    rng = random.Random(11)
    rows = [(i, " ".join(str(rng.random()) for _ in range(9)), "en", "a" if i % 9 else "b", 9) for i in range(1800)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[-2:])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    place = {r["position"]: r["doc_id"] for r in out}
    assert sorted(place) == list(range(1800))
    of = {r[0]: r[3] for r in rows}
    share = 200**0.5 / (200**0.5 + 1600**0.5)
    n = seen = 0
    while seen < 200:  # until source b ends
        assert abs(seen - n * share) <= 32, n
        seen += of[place[n]] == "b"
        n += 1


def test_packed_keys_come_back():
    from netweir.llm.common import pack, unpack

    for keys in ([], [0], [5, 6, 1 << 47], list(range(0, 10**6, 7))):
        assert unpack(pack(np.array(keys, np.uint64))).tolist() == keys


def test_pipeline_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    kind = "doc_id long, text string, lang string, source string, n_chars long, id long, label string, position string, `drop` int"
    rows = [(1, None, "en", None, None, 5, "x", "p", 1), (2, "", None, "a", 0, 5, "x", "p", 1), (3, "one two three four five six", "en", "a", 27, 5, "x", "p", 1), (3, "one two three four five six", "en", "a", 27, 5, "x", "p", 1), (4, "you stupid idiot", "en", "b", 16, None, None, None, None), (None, "no id here", "en", "b", 10, 5, "x", "p", 1)]
    d = spark.createDataFrame(rows, kind)
    for name, docs_ in (("full", d), ("empty", d.limit(0))):
        docs_.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(3, 1, 0), (4, 1, 1), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    got = sorted(str(r["doc_id"]) for r in corpus_pipeline.run(spark, f"{tmp_path}/full").collect())
    # the toxic row goes; null and empty texts are one class, repeated rows of a kept id stay
    assert got == ["1", "3", "3", "None"]
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    own = ("doc_id", "id", "label", "position", "drop")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, f"{tmp_path}/full")
        assert out.columns == d.columns, name
        assert {tuple(r[c] for c in own) for r in out.collect()} <= {tuple(r[c] for c in own) for r in d.collect()}, name
    clash = d.withColumnRenamed("drop", corpus_pipeline.PLACE)
    clash.orderBy("doc_id").write.parquet(f"{tmp_path}/placed")
    back = corpus_pipeline.placed(spark, f"{tmp_path}/placed").orderBy(f"_{corpus_pipeline.PLACE}").collect()
    assert [r[f"_{corpus_pipeline.PLACE}"] for r in back] == list(range(d.count())) and {r[corpus_pipeline.PLACE] for r in back} == {1, None}
    assert [r["doc_id"] for r in back] == [r["doc_id"] for r in clash.orderBy("doc_id").collect()]
