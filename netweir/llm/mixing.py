"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

A source of weight w owes its block j (from 0) between slots floor(j/w) and ceil((j+1)/w): its release time and deadline.
Filling each slot with the released block of earliest deadline keeps every source within one block of its share of any
prefix.  When a source runs out, the others go on in a new phase with their weights scaled up; so every row is used once, and
each phase keeps the bound.

A phase is cut into stretches that are scheduled side by side, one row of a table each.  A stretch is at least as long as the
window of any block, so no block is open at both its ends.  What is done at its ends follows from a first run over the
stretch before each end: that run starts where, of the blocks that are open, those of earliest deadline are done, which is a
start from which all deadlines can be met.  Then the stretch itself is filled, with the blocks between what is done at its
begin and what is done at its end.  A set of blocks has a place in a stretch if no interval is due more of them than it has
slots.  Intervals from the begin hold, as the run before went on to meet all deadlines; those up to the end hold, as the
first run placed the same blocks; so the bound holds across stretches as if one schedule had been made from end to end.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The most sources that a mix may have; their totals go to the driver.
MOST_SOURCES = 2000
ROWS_A_BUCKET = 2048
#: Parts that a weight is counted in, if it is no plain fraction: a billion blocks on, the share is off by 0.01 of a block.
PARTS = 1 << 36
#: Slots that are filled before they are put to the stretch's others.
STEP = 256
NO_SOURCE = "\x00none"
NEVER = 1 << 62
PHASE = "start long, length long, stretch long, total long, name array<string>, part array<long>, base array<long>, last array<long>"


def quotas(weights: dict[str, float], cycle: int) -> dict[str, int]:
    """Whole numbers in proportion to the weights that add up to a cycle, by largest remainder, one at least."""
    total = sum(weights.values())
    exact = {s: w / total * cycle for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: max(0, cycle - sum(out.values()))]:
        out[s] += 1
    return out


def exact(weights: dict[str, float]) -> dict[str, int] | None:
    """Whole numbers in the proportion of the weights, if these are plain fractions of their sum."""
    total = sum(weights.values())
    plain = {s: Fraction(w / total).limit_denominator(100_000) for s, w in weights.items()}
    length = math.lcm(*(x.denominator for x in plain.values()))
    fits = length <= PARTS and sum(plain.values()) == 1 and all(x > 0 and abs(float(x) - weights[s] / total) < 1e-14 for s, x in plain.items())
    return {s: int(x * length) for s, x in plain.items()} if fits else None


def phases(blocks: dict[str, int], weights: dict[str, float], least: int) -> list[tuple]:
    """One row of PHASE for each phase, from the sources' numbers of blocks: which blocks each source gives from which slot on.

    A phase ends before the slot at which the first source would be due a block that it has not.  Of the blocks that are open
    then, first those that end their source are done, then those of earliest release; these always have a place.
    """
    left = {s: n for s, n in sorted(blocks.items()) if n > 0}
    given, out, start = dict.fromkeys(left, 0), [], 0
    plain = exact({s: weights[s] for s in left}) if left else None
    while left:
        part = plain or quotas({s: weights[s] for s in left}, PARTS)
        total = sum(part[s] for s in left)
        length = min(n * total // part[s] for s, n in left.items())
        done = {s: part[s] * length // total for s in left}
        open_ = [s for s in left if part[s] * length % total]
        ends = {s for s in open_ if left[s] == done[s] + 1 and left[s] * total // part[s] == length}
        for s in sorted(open_, key=lambda s: (s not in ends, done[s] * total // part[s], s))[: length - sum(done.values())]:
            done[s] += 1
        stretch = max(least, -(-total // min(part[s] for s in left)) + 1)
        out.append((start, length, stretch, total, list(left), [part[s] for s in left], [given[s] for s in left], [done[s] for s in left]))
        start += length
        for s, n in done.items():
            given[s] += n
        left = {s: n - done[s] for s, n in left.items() if n > done[s]}
    return out


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed one time only."""
    return F.get(F.transform(F.array(value), use), 0)


def quotient(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def standing(part: Column, total: Column, slot: Column) -> Column:
    """array<struct<i, part, done, over>>: of each source the blocks due before a slot, and what it is owed beyond, in parts of a block."""
    wide = lambda x: x.cast("decimal(19,0)")
    owed = lambda p: wide(p) * wide(slot)
    return F.transform(part, lambda p, i: F.struct(i.cast("long").alias("i"), p.alias("part"), quotient(owed(p), wide(total)).cast("long").alias("done"), (owed(p) % wide(total)).cast("long").alias("over")))


def deadline(s: Column, total: Column, more: Column) -> Column:
    """When the block after ``more`` others is due, counted from the slot that s stands at."""
    return quotient((more + 1) * total - s["over"] + s["part"] - 1, s["part"])


def job(s: Column, total: Column, more: Column, most: Column) -> Column:
    """A source's next block after ``more``; it is never released if the source is to give ``most`` only."""
    release = F.when(more > 0, quotient(more * total - s["over"], s["part"])).otherwise(-quotient(s["over"] + s["part"] - 1, s["part"]))
    return F.struct(deadline(s, total, more).alias("deadline"), s["i"].alias("i"), F.when(more < most, release).otherwise(NEVER).alias("release"), more.alias("more"))


def early(at: Column, total: Column) -> Column:
    """array<long>: a start from which all deadlines can be met: of the open blocks, those of earliest deadline are done."""
    zero = F.lit(0).cast("long")
    open_ = F.transform(F.filter(at, lambda s: s["over"] > 0), lambda s: F.struct(deadline(s, total, zero).alias("deadline"), s["i"].alias("i")))
    n = quotient(F.aggregate(at, zero, lambda a, s: a + s["over"]), total).cast("int")
    picked = F.transform(F.slice(F.array_sort(open_), F.lit(1), n), lambda x: x["i"])
    return once(picked, lambda p: F.transform(at, lambda s: F.array_contains(p, s["i"]).cast("long")))


def filled(at: Column, total: Column, begin: Column, most: Column, length: Column) -> Column:
    """struct<jobs, slots> after ``length`` slots filled by earliest deadline: each source's next block, and the slots' blocks.

    begin and most are array<long>: how many blocks beyond ``at`` each source has given, and may have given at the end.
    """
    slot = "array<struct<deadline: bigint, i: bigint, release: bigint, more: bigint>>"
    return once(F.struct(at.alias("at"), begin.alias("begin"), most.alias("most")), lambda given: run_of(given["at"], total, given["begin"], given["most"], length, slot))


def run_of(at: Column, total: Column, begin: Column, most: Column, length: Column, slot: str) -> Column:
    """The run of ``filled``, from columns that are there."""
    jobs = F.transform(at, lambda s: job(s, total, F.get(begin, s["i"].cast("int")), F.get(most, s["i"].cast("int"))))

    def fill(state: Column, t: Column) -> Column:
        def put(best: Column) -> Column:
            k = best["i"].cast("int")
            after = job(F.get(at, k), total, best["more"] + 1, F.get(most, k))
            return F.struct(F.transform(state["jobs"], lambda x: F.when(x["i"] == best["i"], after).otherwise(x)).alias("jobs"), F.concat(state["slots"], F.array(best)).alias("slots"))

        return once(F.array_min(F.filter(state["jobs"], lambda x: x["release"] <= t)), put)

    def step(state: Column, first: Column) -> Column:
        begun = F.struct(state["jobs"].alias("jobs"), F.array().cast(slot).alias("slots"))
        run = F.aggregate(F.sequence(first, F.least(first + STEP, length) - 1), begun, fill)
        return once(run, lambda r: F.struct(r["jobs"].alias("jobs"), F.concat(state["slots"], F.array(r["slots"])).alias("slots")))

    start = F.struct(jobs.alias("jobs"), F.array().cast(f"array<{slot}>").alias("slots"))
    return F.aggregate(F.sequence(F.lit(0).cast("long"), length - 1, F.lit(STEP).cast("long")), start, step)


def places(spark: SparkSession, made: list[tuple]) -> DataFrame:
    """(_source, block, slot, release, deadline) of all blocks, from the rows of PHASE; a row of a table for each stretch."""
    total = F.col("total")
    stretches = F.greatest(quotient(F.col("length"), F.col("stretch")), F.lit(1).cast("long"))
    count = sum(max(1, m[1] // m[2]) for m in made)
    d = spark.createDataFrame(made, PHASE).withColumn("n", stretches).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    d = d.repartition(max(1, min(count, int(spark.conf.get("spark.sql.shuffle.partitions")) + count // 1000)), "start", "k")
    d = d.withColumn("t", F.col("k") * F.col("stretch")).withColumn("size", F.when(F.col("k") == F.col("n") - 1, F.col("length") - F.col("t")).otherwise(F.col("stretch")))
    unbound = F.transform("part", lambda _: F.lit(NEVER))

    def reached(at: Column) -> Column:
        """What a first run over a stretch from ``at`` leaves done at its end."""
        run = filled(at, total, early(at, total), unbound, F.col("stretch"))
        return once(run, lambda r: F.transform(r["jobs"], lambda x: x["more"] + F.get(at, x["i"].cast("int"))["done"]))

    def beyond(done: Column, at: Column) -> Column:
        return F.zip_with(done, at, lambda a, s: a - s["done"])

    d = d.withColumn("at", standing(F.col("part"), total, F.col("t")))
    d = d.withColumn("before", standing(F.col("part"), total, F.greatest(F.col("t") - F.col("stretch"), F.lit(0).cast("long"))))
    zeros = F.transform("part", lambda _: F.lit(0).cast("long"))
    d = d.withColumn("begin", F.when(F.col("k") == 0, zeros).otherwise(beyond(reached(F.col("before")), F.col("at"))))
    d = d.withColumn("end", beyond(F.when(F.col("k") == F.col("n") - 1, F.col("last")).otherwise(reached(F.col("at"))), F.col("at")))
    d = d.withColumn("slots", F.flatten(filled(F.col("at"), total, F.col("begin"), F.col("end"), F.col("size"))["slots"]))
    one = d.select("start", "t", "name", "base", "at", F.posexplode("slots").alias("slot", "x")).withColumn("i", F.col("x.i").cast("int"))
    first = F.col("start") + F.col("t")
    block = F.get("base", F.col("i")) + F.get("at", F.col("i"))["done"] + F.col("x.more")
    return one.select(F.get("name", F.col("i")).alias("_source"), block.alias("block"), (first + F.col("slot")).alias("slot"), (first + F.col("x.release")).alias("release"), (first + F.col("x.deadline")).alias("deadline"))


ADDED = ("block", "rank", "slot", "release", "deadline")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, **given) -> DataFrame:
    """docs with block, slot, rank, release and deadline: each row's block within its source, the block's slot, and the row's
    place in the block.  Sorted by (slot, rank) the rows are the mix.

    Columns of docs named as those added are replaced; all others are passed on, whatever their names.  What else holds is said
    at ``scheduled``.
    """
    return scheduled(docs, weights, **given).select(*(F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c not in ADDED), *ADDED)


def scheduled(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = 16, cycle: int = 240, power: float = 0.5, seed: int = 7, source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """(doc, block, rank, slot, release, deadline) with each row of docs as a struct.

    ``weights`` are by source; sources without one, or all if None, weigh their number of rows to the given power.  ``cycle``
    is the least number of slots that are scheduled together.  A null source is a source of its own; rows that repeat an id are
    rows of their own; null ids are ordered like other ids.  An empty table gives an empty mix.

    Rows are numbered within buckets of a hash of their id and moved on by the sizes of the buckets before, so a source of any
    size is spread over all tasks; each bucket gets the places of its blocks, so rows move once.
    """
    spark = docs.sparkSession
    d = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(NO_SOURCE)).alias("_source"), F.col(f"`{id_col}`").alias("_id"))
    found = d.groupBy("_source").agg(F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"{source_col} has more than {MOST_SOURCES} values; group them first")
    full = {r["_source"]: (weights or {}).get(r["_source"], r["n"] ** power) for r in found}
    made = phases({r["_source"]: -(-r["n"] // block_rows) for r in found}, full, cycle)
    bits = max(0, (sum(r["n"] for r in found) // ROWS_A_BUCKET).bit_length())
    h = F.xxhash64(F.lit(seed), F.col("_id"))
    d = d.withColumn("_h", h).withColumn("_bucket", F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long"))
    sizes = d.groupBy("_source", "_bucket").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("_source").orderBy("_bucket")) - F.col("_n"))
    number = lambda row: F.floor(row / block_rows).cast("long")
    held = before.withColumn("block", F.explode(F.sequence(number(F.col("_before")), number(F.col("_before") + F.col("_n") - 1))))
    own = held.join(places(spark, made).hint("merge"), ["_source", "block"]).groupBy("_source", "_bucket", "_before")
    own = own.agg(F.array_sort(F.collect_list(F.struct("block", "slot", "release", "deadline"))).alias("_places"))
    d = d.withColumn("_k", F.row_number().over(Window.partitionBy("_source", "_bucket").orderBy("_h", "_id"))).join(own, ["_source", "_bucket"])
    d = d.withColumn("_row", F.col("_before") + F.col("_k") - 1)
    d = d.withColumn("_place", F.get("_places", (number(F.col("_row")) - number(F.col("_before"))).cast("int")))
    return d.select("doc", "_place.block", (F.col("_row") % block_rows).cast("int").alias("rank"), "_place.slot", "_place.release", "_place.deadline")


def mixed(docs: DataFrame, **given) -> DataFrame:
    """The rows of docs in the order of the mix, with docs' own columns and their values, whatever their names."""
    return scheduled(docs, **given).orderBy("slot", "rank").select(*(F.col(f"doc.`{c}`").alias(c) for c in docs.columns))
