"""Sampling with exact counts: proportional allocations, quotas, splits.  Rows are ordered by md5 of seed and key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import ordered
from ..sources.shared import settled

#: Rows that a task numbers, about.
ROWS = 500_000


def allocations(sizes: DataFrame, group: str, n: int, least: int = 0) -> DataFrame:
    """(group, size, take): n rows dealt out over groups of known size in proportion, by largest remainder, capped by size.

    Each group that has rows gets ``least`` at least.  Remainders that are equal go to the larger group, then by name.
    """
    every, w = Window.partitionBy(), Window.partitionBy()
    total = F.sum("size").over(every)
    want = F.least(F.lit(n), total)
    s = sizes.withColumn("_exact", F.col("size") * want / total).withColumn("_floor", F.greatest(F.floor("_exact"), F.least(F.lit(least), F.col("size"))))
    left = want - F.sum("_floor").over(w)
    s = s.withColumn("_left", left).withColumn("_room", F.col("size") - F.col("_floor"))
    by = Window.orderBy(F.desc(F.col("_exact") - F.floor("_exact")), F.desc("size"), group)
    s = s.withColumn("_turn", F.when(F.col("_room") > 0, F.sum((F.col("_room") > 0).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))))
    more = F.when(F.col("_turn") <= F.col("_left"), 1).otherwise(0)
    # a group raised to its least may have taken more than its share: the largest group gives that back
    over = F.when((F.col("_left") < 0) & (F.row_number().over(Window.orderBy(F.desc("size"), group)) == 1), F.col("_left")).otherwise(0)
    return s.select(group, "size", (F.col("_floor") + more + over).cast("long").alias("take"))


def sample_by(df: DataFrame, group: str, n: int, key: list[str], seed: int = 42, least: int = 1) -> DataFrame:
    """n rows of df, every group in proportion and with ``least`` rows at least."""
    sizes = df.groupBy(group).agg(F.count("*").alias("size"))
    take = allocations(sizes, group, n, least).select(group, "take")
    return _first(df, group, F.col("take"), key, seed, take).drop("take")


def quota(df: DataFrame, group: list[str], limit: Column, key: list[str], seed: int = 42) -> DataFrame:
    """At most ``limit`` rows of each group; limit is an expression of the group's columns."""
    return _first(df, group, limit, key, seed)


def numbered_by(df: DataFrame, group: list[str], key: list[str], seed: int, to: str, also: DataFrame | None = None) -> DataFrame:
    """df with the place of each row in its group's order, and ``_size``, the group's rows.

    Places are counted within 4,096 parts of the md5 order, which are alike in size, and moved on by the parts before, so that
    no class, however large, is sorted in one task.  The sizes of the parts are counted at once; by them there are more tasks
    for more rows, about one for ROWS, so that the memory of a task does not grow with the table.  ``also`` has a row a group, whose other columns are added; groups that it
    lacks are left out.  It meets the sizes of the parts, so rows are never dealt out by their group alone.
    """
    # a struct of the group is never null, so rows are dealt out once, for their places and for the sizes
    names = {c: f"k{k}" for k, c in enumerate(group)}
    g = F.struct(*(F.col(c).alias(n) for c, n in names.items()))
    d = df.withColumn("_o", ordered(seed, *map(F.col, key))).withColumn("_part", F.substring("_o", 1, 3)).withColumn("_g", g)
    sizes = settled(d.groupBy("_g", "_part").agg(F.count("*").alias("_n")))
    tasks = -(-(sizes.agg(F.sum("_n")).first()[0] or 0) // ROWS)
    if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        d = d.repartition(tasks, "_g", "_part")
    by = Window.partitionBy("_g")
    sizes = sizes.withColumn("_before", F.sum("_n").over(by.orderBy("_part")) - F.col("_n")).withColumn("_size", F.sum("_n").over(by)).drop("_n")
    more = [] if also is None else [c for c in also.columns if c not in group]
    if also is not None:
        sizes = sizes.select("*", "_g.*").join(also.withColumnsRenamed(names), [*names.values()]).drop(*names.values())
    at = F.row_number().over(Window.partitionBy("_g", "_part").orderBy("_o", *key))
    return d.withColumn("_k", at).join(sizes, ["_g", "_part"]).select(*df.columns, (F.col("_k") + F.col("_before")).alias(to), "_size", *more)


def _first(df: DataFrame, group, limit: Column, key: list[str], seed: int, also: DataFrame | None = None) -> DataFrame:
    n = numbered_by(df, [group] if isinstance(group, str) else list(group), key, seed, "_at", also)
    return n.filter(F.col("_at") <= limit).drop("_at", "_size")


def split(df: DataFrame, label: str, test: float, key: list[str], seed: int = 42) -> DataFrame:
    """df with is_test: of each label's n rows round(n * test) are for testing."""
    n = numbered_by(df, [label], key, seed, "_at")
    return n.withColumn("is_test", F.col("_at") <= F.round(F.col("_size") * test)).drop("_at", "_size")


def frequent_classes(df: DataFrame, label: str, least: int = 2) -> DataFrame:
    """Rows of classes that have ``least`` rows at least.

    The classes, a row each, are broadcast: by a shuffle all rows of a class would meet in one task.
    """
    kept = df.groupBy(label).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select(label)
    return df.join(F.broadcast(kept), label, "left_semi")


def blended(base: DataFrame, reference: DataFrame, share: float, key: list[str], seed: int = 42) -> DataFrame:
    """base and at most share * rows of base of the reference rows."""
    return base.unionByName(uniform(reference, int(base.count() * share), key, seed))


#: Hexadecimal digits of md5 that are looked at in one pass; as many counts as they have values go to the driver.
DIGITS = 4


def uniform(df: DataFrame, n: int, key: list[str], seed: int = 42) -> DataFrame:
    """The first n rows in the order of md5: a filter, without any exchange.

    The md5 of the n-th row is found digit group by digit group, from counts of rows by the next digits: at most 16^DIGITS counts
    a pass, and two or three passes.  Only if rows that repeat a key lie across the cut, these are cut by limit.
    """
    d = df.withColumn("_o", ordered(seed, *map(F.col, key)))
    cut, left = "", n
    if n <= 0:
        return df.limit(0)
    while len(cut) < 32:
        here = d.filter(F.col("_o").startswith(cut)) if cut else d
        step = F.substring("_o", len(cut) + 1, DIGITS)
        counts = sorted((r["h"], r["n"]) for r in here.groupBy(step.alias("h")).agg(F.count("*").alias("n")).collect())
        before = 0
        for h, size in counts:
            if before + size >= left:
                break
            before += size
        else:  # there are no more than n rows
            return df
        cut, left = cut + h, left - before
        if left == size:
            return d.filter(F.substring("_o", 1, len(cut)) <= cut).drop("_o")
    return d.filter(F.col("_o") < cut).unionByName(d.filter(F.col("_o") == cut).limit(left)).drop("_o")


def expected_rate(name: Column) -> Column:
    """The share of attacks that a file's name states: Npct_anomaly or Npct_attack; 0 for benign and normal ones; else null."""
    stated = F.regexp_extract(F.lower(name), r"(\d+)pct_(?:anomaly|attack)", 1)
    return F.when(stated != "", stated.cast("double") / 100).when(F.lower(name).rlike("benign|normal"), F.lit(0.0))


# Parts of file names that tell what a reference file holds.
ATTACK_NAMES = ("synflood", "ddos", "dos", "portscan", "probe", "anomaly", "attack", "flood")
BENIGN_NAMES = ("benign", "normal", "clean", "baseline", "monday", "workinghours")
FAMILIES = (("webattack", "bruteforce", "ftp", "ssh"), ("synflood", "ddos", "dos"), ("portscan", "probe"), ("anomaly", "attack", "flood"))


def file_name(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"([^/]*)$", 1))


def is_holdout(path: Column) -> Column:
    """Whether a file is kept for testing: by a folder test_data, or by its name."""
    return F.lower(path).rlike("(^|/)test_data(/|$)") | file_name(path).rlike("benchmark_mix_|_pct_anomaly|_pct_attack")


def reference_kind(path: Column) -> Column:
    """attack or benign by a file's name, attack first; null for others."""
    name = file_name(path)
    return F.when(name.rlike("|".join(ATTACK_NAMES)), "attack").when(name.rlike("|".join(BENIGN_NAMES)), "benign")


def references(files: DataFrame, path: str, per: str, attacks: int, selected: DataFrame | None = None) -> DataFrame:
    """The attack files of each group to take as references, with their ``turn``: at most ``attacks``, hold-outs and the files of
    ``selected`` aside.

    By family, then CSV before captures, then name: at first up to two CSV files, then captures, then the other CSV files.
    """
    f = files.filter(~is_holdout(F.col(path)) & (reference_kind(F.col(path)) == "attack"))
    if selected is not None:
        f = f.join(selected.select(path), path, "left_anti")
    name = file_name(F.col(path))
    family = F
    for k, words in enumerate(FAMILIES):
        family = family.when(name.rlike("|".join(words)), k)
    f = f.withColumn("_csv", name.endswith(".csv")).withColumn("_order", F.struct(family.otherwise(len(FAMILIES)).alias("a"), name.alias("b"), F.col(path).alias("c")))
    f = f.filter(F.col("_csv") | name.rlike(r"\.(pcap|pcapng|cap)$"))
    at = F.row_number().over(Window.partitionBy(per, "_csv").orderBy("_order"))
    step = F.when(F.col("_csv") & (F.col("_at") <= min(2, attacks)), 0).when(~F.col("_csv"), 1).otherwise(2)
    turn = F.row_number().over(Window.partitionBy(per).orderBy("_step", "_order"))
    return f.withColumn("_at", at).withColumn("_step", step).withColumn("turn", turn).filter(F.col("turn") <= attacks).drop("_csv", "_order", "_at", "_step")


def with_attacks(df: DataFrame, source: str, label: str, attack_rows: int, benign_rows: int, key: list[str], excluded: Column | None = None, seed: int = 42) -> DataFrame:
    """Of the sources that have attacks, and are not excluded, at most so many attack and benign rows each."""
    from ..functions.expressions import is_benign

    d = df if excluded is None else df.filter(~excluded)
    benign = is_benign(F.col(label))
    have = d.groupBy(source).agg(F.count_if(~benign).alias("_n")).filter("_n > 0").select(source)
    d = d.join(F.broadcast(have), source, "left_semi").withColumn("_benign", benign)
    return quota(d, [source, "_benign"], F.when(F.col("_benign"), benign_rows).otherwise(attack_rows), key, seed).drop("_benign")


def preferred(df: DataFrame, per: str, kind: str, first: str = "csv") -> DataFrame:
    """Rows of the first kind in groups that have any, else all rows."""
    has = df.groupBy(per).agg(F.bool_or(F.col(kind) == first).alias("_has"))
    return df.join(F.broadcast(has), per).filter(~F.col("_has") | (F.col(kind) == first)).drop("_has")


def block_sample(df: DataFrame, position: str, block_rows: int, n: int, label: str, key: list[str], seed: int = 42) -> DataFrame:
    """About n rows in proportion from every block of ``block_rows`` positions, then of these the class-guard sample of n."""
    d = df.withColumn("_block", F.floor(F.col(position) / block_rows))
    return sample_by(sample_by(d, "_block", n, key, seed, least=0).drop("_block"), label, n, key, seed)


def rescued(limited: DataFrame, full: DataFrame, label: str, n: int, key: list[str], seed: int = 42) -> DataFrame:
    """``limited`` if it has both normal rows and attacks; else all rows of ``full`` if these are of one class, or no more than n;
    else n of them, each class by its rounded share and with one row at least."""
    from ..functions.expressions import binary_label

    two = lambda d: d.select(binary_label(F.col(label)).alias("c")).distinct().count() > 1
    if two(limited):
        return limited
    d = full.withColumn("_c", binary_label(F.col(label)))
    sizes = {r["_c"]: r["n"] for r in d.groupBy("_c").agg(F.count("*").alias("n")).collect()}  # two rows at most
    total = sum(sizes.values())
    if len(sizes) < 2 or n <= 0 or n >= total:
        return full
    large, small = sorted(sizes, key=lambda c: (-sizes[c], c))
    take = {c: max(1, round(n * sizes[c] / total)) for c in sizes}
    take[large] = max(1, take[large] + n - sum(take.values()))
    return _first(d, "_c", F.when(F.col("_c") == large, take[large]).otherwise(take[small]), key, seed).drop("_c")
