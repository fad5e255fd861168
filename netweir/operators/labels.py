"""Labels and text columns: domain labels, coercion of unknown ones, cleaning, informative columns."""

from __future__ import annotations

import unicodedata
from functools import reduce
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import EMPTY, binary_label, folded, is_benign
from ..sources.shared import settled

#: Characters that are not seen in a header: byte order mark, no-break and zero-width spaces, tab, carriage return.
INVISIBLE = "﻿ ​‌‍\t\r"
# What stands for no value, in any column and in that of services.
UNINFORMATIVE = ("", "nan", "n/a")
UNLABELLED = ("", "-", "nan", "none", "null", "unknown", "n/a", "other")


def resolved(domain: str, *label: Column) -> Column:
    """The label of a row in its domain's own terms.

    CIC-IDS: benign spellings become BENIGN.  NSL-KDD: trailing dots go, benign spellings become normal.  UNSW-NB15: with a
    category and a 0/1 flag, the category, unless it is blank or benign or the flag is 0; with a flag alone, 0 is Normal and
    all else Attack.
    """
    first = F.trim(label[0])
    if domain == "CIC-IDS":
        return F.when(is_benign(first), "BENIGN").otherwise(first)
    if domain == "NSL-KDD":
        bare = F.regexp_replace(first, r"\.+$", "")
        return F.when(is_benign(bare), "normal").otherwise(bare)
    if domain != "UNSW-NB15":
        raise ValueError(f"no domain {domain!r}")
    if len(label) == 1:
        return F.when(is_benign(first), "Normal").otherwise("Attack")
    flag = folded(label[1].cast("string"))
    none = folded(first).isin("", "nan", "none", "normal") | first.isNull() | flag.isin("0", "0.0")
    return F.when(none, "Normal").otherwise(first)


def collapsed(df: DataFrame, label: str, to: str = "binary_label") -> DataFrame:
    return df.withColumn(to, binary_label(F.col(label)))


def coerced(c: Column, attack: bool) -> Column:
    """Labels that say nothing become Attack or BENIGN."""
    return F.when(F.coalesce(folded(c).isin(*EMPTY), F.lit(True)), "Attack" if attack else "BENIGN").otherwise(c)


def mostly_labelled(df: DataFrame, source: str, label: str, most: float = 0.80) -> DataFrame:
    """Rows of sources whose share of labels that say nothing is under ``most``."""
    unknown = F.coalesce(folded(F.col(label)).isin(*EMPTY), F.lit(True)).cast("double")
    good = df.groupBy(source).agg(F.avg(unknown).alias("_u")).filter(F.col("_u") < most).select(source)
    return df.join(good, source, "left_semi")


def without_repeated_headers(df: DataFrame) -> DataFrame:
    """Rows whose first column does not repeat its own name."""
    c = df.columns[0]
    return df.filter(~folded(F.col(f"`{c}`")).eqNullSafe(F.lit(c.strip().lower())))


def service_label(c: Column) -> Column:
    """A service's name, or unlabeled where it has none."""
    return F.when(F.coalesce(folded(c).isin(*UNLABELLED), F.lit(True)), "unlabeled").otherwise(F.trim(c))


def informative(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: whether any of its values says something; one pass for all columns."""
    says = lambda c: F.coalesce(F.bool_or(~folded(F.col(c).cast("string")).isin(*UNINFORMATIVE)), F.lit(False))
    one = df.agg(*(says(c).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("informative")) for c in columns))).alias("x")).select("x.*")


def cleaned(df: DataFrame, column: str, to: str | None = None) -> DataFrame:
    """NFKC; dashes and replacement characters become " - ", control characters go, blanks at the ends go.

    Only values that are not plain ASCII need normal forms; these are made in Arrow batches, without any exchange.
    """

    @F.pandas_udf("string")
    def nfkc(values: pd.Series) -> pd.Series:
        return values.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))

    n = F.regexp_replace(nfkc(F.col(column)), "[\\x{FFFD}\\x{2010}-\\x{2015}\\x{2212}]", " - ")
    return df.withColumn(to or column, F.trim(F.regexp_replace(F.regexp_replace(n, r"[\p{C}&&[^\t\n\r]]", ""), " {2,}", " ")))


def numbered(df: DataFrame, *order: Column, name: str = "row_number") -> DataFrame:
    """Rows numbered from 1 in an order, under a name that no column has.

    Rows are sorted in ranges of the order, one a partition, and numbered within each; a range's number goes on from the sizes of
    the ranges before, of which the driver takes one a partition.  Rows that are alike in the order are told apart by a hash
    of the row, so that many of them are no single range.
    """
    while name in df.columns:
        name = f"_{name}"
    by = [F.xxhash64(*(F.col(f"`{c}`") for c in df.columns if not isinstance(df.schema[c].dataType, T.MapType)))]
    held = settled(df.repartitionByRange(*order, *by).sortWithinPartitions(*order, *by)).withColumn("_id", F.monotonically_increasing_id())
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r["p"], r["n"]) for r in held.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    ends = accumulate(n for _, n in sizes)
    starts = df.sparkSession.createDataFrame([(p, end - n) for (p, n), end in zip(sizes, ends)], "_p long, _start long")
    both = held.withColumn("_p", part).join(F.broadcast(starts), "_p")  # a row a partition
    return both.select(*(F.col(f"`{c}`") for c in df.columns), (F.col("_start") + place + 1).alias(name))


def header_names(headers: DataFrame) -> DataFrame:
    """(file, position, name) with names normalised: invisible characters gone, synonyms, snake case; repeated names of a file
    get __0, __1 ... in the order of position."""
    from pyspark.sql.window import Window

    from ..domains import SYNONYMS

    spark = headers.sparkSession
    synonyms = spark.createDataFrame(list(SYNONYMS.items()), "_k string, _to string")  # a few dozen rows
    bare = F.trim(F.lower(F.translate("name", INVISIBLE, "")))
    snake = F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    h = headers.withColumn("_k", bare).withColumn("_snake", snake).join(synonyms, "_k", "left").withColumn("_n", F.coalesce("_to", "_snake"))
    w = Window.partitionBy("file", "_n")
    at = F.row_number().over(w.orderBy("position")) - 1
    name = F.when(F.count("*").over(w) > 1, F.concat("_n", F.lit("__"), at.cast("string"))).otherwise(F.col("_n"))
    return h.select("file", "position", name.alias("name"))


def detected(headers: DataFrame, least: float = 0.6) -> DataFrame:
    """(file, domain, confidence, scores): the domain of most markers among a file's names, the first of equal ones; Unknown below
    ``least``."""
    from ..domains import DOMAINS

    spark = headers.sparkSession
    marks = spark.createDataFrame([(k, d.name, m) for k, d in enumerate(DOMAINS.values()) for m in d.markers], "rank int, domain string, name string")
    files = headers.select("file").distinct().crossJoin(F.broadcast(marks.select("rank", "domain").distinct()))  # three rows a file
    hits = headers.select("file", "name").distinct().join(F.broadcast(marks), "name").groupBy("file", "domain").agg((F.count("*") / 5).alias("score"))
    s = files.join(hits, ["file", "domain"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    best = F.max(F.struct(F.col("score"), (-F.col("rank")).alias("r"), F.col("domain")))
    g = s.groupBy("file").agg(best.alias("b"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("domain", "score")))).alias("scores"))
    return g.select("file", F.when(F.col("b.score") >= least, F.col("b.domain")).otherwise("Unknown").alias("domain"), F.col("b.score").alias("confidence"), "scores")


def natures(detections: DataFrame) -> DataFrame:
    """detections with the nature of the domain, null for Unknown, and the algorithms that it allows."""
    from ..domains import DOMAINS, NATURES

    d, nature, algorithms = F.col("domain"), F, F
    for name, n in NATURES.items():
        nature, algorithms = nature.when(d == name, n), algorithms.when(d == name, ",".join(DOMAINS[name].algorithms))
    return detections.withColumn("nature", nature).withColumn("algorithms", algorithms)


def compatible(model: Column, file: Column) -> Column:
    """Whether a model's nature is known and that of a file."""
    return F.coalesce((model == file) & (model != ""), F.lit(False))


def training_sets(files: DataFrame, per: str, nature: Column) -> DataFrame:
    """(per, domain, error) of sets of files with their domains: the one domain to train on, or why there is none."""
    from ..domains import NATURES

    allowed = F.array_compact(F.array(*(F.when(nature == n, d) for d, n in NATURES.items())))
    g = files.groupBy(per).agg(F.sort_array(F.collect_set("domain")).alias("d"), F.bool_or(F.col("domain") == "Unknown").alias("u"), F.bool_and(F.array_contains(allowed, F.col("domain"))).alias("ok"))
    error = F.when(F.col("u"), "unknown_schema").when(~F.col("ok"), "other_nature").when(F.size("d") > 1, "several_domains")
    return g.select(per, F.when(error.isNull(), F.get("d", F.lit(0))).alias("domain"), error.alias("error"))


def against_model(files: DataFrame, models: DataFrame) -> DataFrame:
    """(file, model, missing, extra, fits) for files with their ``names`` and models with their ``features`` of the same domain:
    missing features are an error, others are only noted."""
    both = files.join(models, "domain")
    missing = F.array_except("features", "names")
    return both.select("file", "model", F.sort_array(missing).alias("missing"), F.sort_array(F.array_except("names", "features")).alias("extra"), (F.size(missing) == 0).alias("fits"))


def missing_features(headers: DataFrame, domain: str, allowed: tuple[str, ...] = ()) -> DataFrame:
    """(file, missing, unexpected): how a file's names differ from a domain's features."""
    from ..domains import domain as of

    want, other = list(of(domain).features), [*of(domain).targets, *allowed, "target_label", "src_ip", "dst_ip", "src_port", "dst_port"]
    arr = lambda x: F.array(*map(F.lit, x))
    names = headers.groupBy("file").agg(F.sort_array(F.collect_set("name")).alias("n"))
    return names.select("file", F.array_except(arr(want), "n").alias("missing"), F.array_except("n", arr(want + other)).alias("unexpected"))


def require(df: DataFrame, features: list[str]) -> None:
    """Raise for a table without some of the features."""
    gone = [f for f in features if f not in df.columns]
    if gone:
        raise ValueError(f"{len(gone)} features are missing, among them {', '.join(gone[:8])}")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
