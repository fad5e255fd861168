"""Benchmark decontamination: windows of benchmark words are looked up at every place of every document.

The distinct windows are broadcast by hash, once their size has been looked at; documents pass by in one scan that cuts them
into words, hashes each window and compares the words of a hit with those of the benchmark.  Nothing but one narrow row a
document and its hits is shuffled.  Windows too large to broadcast are joined by hash with a shuffle instead, and hits are
compared with the words of their document afterwards.  DataFrame functions only.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Words of a window.
WINDOW = 10
#: Bytes of window words and item ids that are broadcast at most.
BROADCAST_BYTES = 48 << 20
#: What separates words, before and after A-Z are lower-cased; anything else belongs to a word.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CASED_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CASED_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none of a null."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, SEPARATORS), "")


def windows(benchmark: DataFrame, size: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(gram, items): each distinct window with the sorted ids, as strings, of the items that have it.

    A window is ``size`` consecutive words; an item of fewer words, but not none, is one window.  Items that repeat count once;
    an item without an id has windows that hit, and is in no list.
    """
    item = benchmark.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    k = F.least(F.size("w"), F.lit(size))
    each = item.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.slice("w", i, k))).alias("gram"))
    return each.groupBy("gram").agg(F.array_sort(F.collect_set("item")).alias("items"))


def places(own: DataFrame, lengths: list[int]) -> DataFrame:
    """(id, digest, w, m, at, k, h): a row with m = 0 for each document, then one for each place and window length with the hash
    of the window there, null where the text ends before."""
    n, some = len(lengths), F.array(*map(F.lit, lengths))
    each = own.select("id", "digest", "w", F.explode(F.sequence(F.lit(0), F.size("w") * n)).alias("m"))
    at = F.call_function("div", F.greatest(F.col("m") - 1, F.lit(0)), F.lit(n)).cast("int")
    each = each.select("id", "digest", "w", "m", at.alias("at"), F.get(some, F.pmod(F.col("m") - 1, F.lit(n))).alias("k"))
    inside = (F.col("m") > 0) & (F.col("at") + F.col("k") <= F.size("w"))
    return each.withColumn("h", F.when(inside, F.xxhash64(F.slice("w", F.col("at") + 1, F.col("k")))))


def matches(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, doc_id: str = "doc_id", text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, digest, copies, n_words, hit, items) for each distinct pair of an id and a text's hash.

    ``hit`` are the places, from 0 and in order, of the words that lie in an occurrence of a window; ``items`` the ids, as
    strings and sorted, of the items that have such a window; ``copies`` how often the row occurs.  A document is one group of
    rows, whatever else shares its text, so common passages make no large groups.
    """
    own = docs.select(F.col(doc_id).alias("id"), digest(F.col(text)).alias("digest"), words(F.col(text)).alias("w"))
    grams = cut(windows(benchmark, size).withColumn("h", F.xxhash64("gram")))
    bulk = F.octet_length(F.array_join("gram", " ")) + F.octet_length(F.array_join("items", ","))
    seen = grams.agg(F.collect_set(F.size("gram")).alias("lengths"), F.sum(bulk).alias("bytes")).first()
    each = places(own, sorted(seen["lengths"]) or [size])  # ``size`` different lengths at most
    found = scanned(each, grams) if (seen["bytes"] or 0) <= broadcast_bytes else shuffled(own, each, grams)
    g = found.groupBy("id", "digest").agg(
        F.count("n").alias("copies"), F.max("n").alias("n_words"), F.collect_set(F.when(F.col("items").isNotNull(), F.struct("at", "k"))).alias("places"), F.collect_set("items").alias("lists")
    )
    hit = F.array_sort(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p["at"], p["at"] + p["k"] - 1)))))
    return g.select("id", "digest", "copies", "n_words", hit.alias("hit"), F.array_sort(F.array_distinct(F.flatten("lists"))).alias("items"))


def digest(text: Column) -> Column:
    """What tells apart the texts of rows that repeat an id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def scanned(each: DataFrame, grams: DataFrame) -> DataFrame:
    """(id, digest, n, at, k, items): a row with the number of words for each document, and its verified hits; one scan."""
    build = F.broadcast(grams.withColumnRenamed("h", "gram_h"))
    same = (F.col("h") == F.col("gram_h")) & (F.slice("w", F.col("at") + 1, F.col("k")) == F.col("gram"))
    met = each.join(build, same, "left").filter("m = 0 OR items IS NOT NULL")
    return met.select("id", "digest", F.when(F.col("m") == 0, F.size("w")).alias("n"), "at", "k", "items")


def shuffled(own: DataFrame, each: DataFrame, grams: DataFrame) -> DataFrame:
    """The rows of ``scanned`` for windows of any size: hashes meet by a shuffle, hits are verified beside their text."""
    met = each.filter(F.col("h").isNotNull()).select("id", "digest", "at", "k", "h").join(grams.hint("merge"), "h")
    hits = met.groupBy("id", "digest").agg(F.collect_set(F.struct("at", "k", "gram", "items")).alias("met"))  # places of one document
    hits = hits.select(F.col("id").alias("hit_id"), F.col("digest").alias("hit_digest"), "met")
    both = own.dropDuplicates(["id", "digest"]).join(hits, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("digest") == F.col("hit_digest")))
    true = F.filter("met", lambda x: F.slice(F.col("w"), x["at"] + 1, x["k"]) == x["gram"])
    true = both.select("id", "digest", F.explode(true).alias("x")).select("id", "digest", F.lit(None).cast("int").alias("n"), "x.at", "x.k", "x.items")
    none = F.lit(None)
    return own.select("id", "digest", F.size("w").alias("n"), none.cast("int").alias("at"), none.cast("int").alias("k"), none.cast("array<string>").alias("items")).unionByName(true)


def report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **given) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), a row for each row of docs.

    Null and empty texts have no words; null ids are ids like others; rows that repeat an id are judged each by its own text;
    an empty table gives an empty one, an empty benchmark hits nothing; other columns are not looked at.
    """
    m = matches(docs, benchmark, doc_id=doc_id, **given)
    m = m.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return m.select(
        F.col("id").alias(doc_id),
        F.col("n_words").cast("long").alias("n_words"),
        F.size("hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", doc_id: str = "doc_id", text: str = "text", **given) -> DataFrame:
    """docs without the words that are hit, or without the documents that have any (remove="documents").

    A word goes with what separates it from the next; a text without hits stays as it is, null too.  All columns of docs are
    kept, whatever their names.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove is spans or documents, not {remove!r}")
    dirty = matches(docs, benchmark, doc_id=doc_id, text=text, **given).filter(F.size("hit") > 0).select(F.struct("id", "digest", "hit").alias("hit"))
    held = docs.select(F.struct("*").alias("row"))
    same = F.col(f"row.`{doc_id}`").eqNullSafe(F.col("hit.id")) & (digest(F.col(f"row.`{text}`")) == F.col("hit.digest"))
    if remove == "documents":
        return held.join(dirty, same, "left_anti").select("row.*")
    kept = without_words(F.col(f"row.`{text}`"), F.col("hit.hit"))
    both = held.join(dirty, same, "left")
    return both.select(*(F.when(F.col("hit").isNull(), F.col(f"row.`{c}`")).otherwise(kept).alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def without_words(text: Column, hit: Column) -> Column:
    """The text less the words at the places of ``hit`` (sorted) and the separator behind each."""
    between = F.split(text, CASED_WORDS)
    pieces = F.zip_with(F.array_remove(F.split(text, CASED_SEPARATORS), ""), F.slice(between, 2, F.greatest(F.size(between) - 1, F.lit(0))), lambda w, s: F.concat(w, s))
    starts = F.filter(hit, lambda p, i: (i == 0) | (F.get(hit, i - 1) < p - 1))
    ends = F.filter(hit, lambda p, i: (i == F.size(hit) - 1) | (F.get(hit, i + 1) > p + 1))
    # what is kept lies from behind the end of one run of hits to the start of the next
    begins, stops = F.concat(F.array(F.lit(0)), F.transform(ends, lambda e: e + 1)), F.concat(starts, F.array(F.size(pieces)))
    kept = F.zip_with(begins, stops, lambda a, b: F.array_join(F.slice(pieces, a + 1, b - a), ""))
    return F.concat(F.get(between, F.lit(0)), F.array_join(kept, ""))
