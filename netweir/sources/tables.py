"""Flow tables in CSV and Parquet, catalogues of files, and sinks."""

from __future__ import annotations

import csv
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import labels

EXTENSIONS = ("csv", "nf", "parquet", "pcap", "pcapng", "cap")
CONTEXT = ("src_ip", "dst_ip", "src_port", "destination_port", "protocol")
EXTRA = "_extra"


def names_of(line: str) -> list[str]:
    """The column names of a CSV file's first line."""
    return [x.strip() for x in next(csv.reader([line.lstrip("\ufeff")], skipinitialspace=True), [])]


def first_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line): the first line of every text file of some paths, in one job over any number of files."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"), "value")
    # the first line of a file is the first row of its first block
    return lines.filter("at = 0").groupBy("file").agg(F.min_by("value", "n").alias("line"))


def header_groups(spark: SparkSession, paths: str | list[str]) -> list[tuple[list[str], list[str], list[str]]]:
    """(names, normalised names, files) for each different first line among the files; the driver takes a path a file, as any scan
    does."""
    groups = first_lines(spark, paths).groupBy("line").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("line").collect()
    found = [(names_of(r["line"]), r["files"]) for r in groups]
    h = spark.createDataFrame([(str(g), k, n) for g, (names, _) in enumerate(found) for k, n in enumerate(names)], "file string, position int, name string")
    to: dict[int, list[str]] = {}
    for r in labels.header_names(h).orderBy("file", "position").collect():  # the names of different headers
        to.setdefault(int(r["file"]), []).append(r["name"])
    return [(names, to.get(g, []), [unquote(f) for f in files]) for g, (names, files) in enumerate(found)]


def raw_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All columns of CSV files, or folders of them, as text under normalised names.

    Files are read by groups of equal headers, each by its own, and united by name; what a file has no column for is null.  Rows
    with too many fields are dropped, short ones are filled with nulls, bad UTF-8 is replaced, repeated header lines go.
    """
    out = None
    for names, to, files in header_groups(spark, path):
        if not to:
            continue
        one = one_header(spark, files, names, to)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out if out is not None else spark.createDataFrame([], T.StructType([]))


def one_header(spark: SparkSession, files: list[str], names: list[str], to: list[str]) -> DataFrame:
    """The rows of CSV files that share a header, under the names ``to``."""
    extra = EXTRA
    while extra in to:
        extra = f"_{extra}"
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*to, extra]])
    # the extra column takes what is too much; a file whose lines all fit leaves it null
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("ignoreLeadingWhiteSpace", True).option("mode", "PERMISSIVE").csv(files)
    df = df.filter(F.col(extra).isNull()).drop(extra)
    return df.filter(~F.lower(F.trim(F.col(f"`{to[0]}`"))).eqNullSafe(F.lit(names[0].strip().lower())))


def flow_table(spark: SparkSession, path: str, domain: str, context: bool = True) -> DataFrame:
    """Features of a domain in their order and types, target_label, and context columns that are there; raises for a table
    that lacks a feature."""
    from ..domains import domain as of

    d = of(domain)
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else raw_csv(spark, path)
    labels.require(df, list(d.features))
    cast = [F.trim(F.col(f).cast("string")).alias(f) if f in d.categorical else F.col(f).try_cast("double").alias(f) for f in d.features]
    targets = [c for c in ("label", "label__0", "label__1") if c in df.columns]
    label = labels.resolved(domain, *(F.col(c) for c in targets[-2:] or targets)) if targets else F.lit("Unknown")
    if domain != "UNSW-NB15" and targets:
        label = labels.resolved(domain, F.col(targets[0]))
    more = [F.col(c) for c in CONTEXT if context and c in df.columns and c not in d.features]
    return df.select(*cast, label.alias("target_label"), *more)


def training_tables(spark: SparkSession, paths: list[str], domain: str) -> DataFrame:
    """The rows of several files of one domain, with the file each came from; raises for a file of another domain."""
    others = [r["file"] for r in inspected(spark, paths).filter(F.col("dataset_type") != domain).collect()]  # a row a file
    if others:
        raise ValueError(f"not of domain {domain}: {', '.join(others[:8])}")
    out = None
    for p in paths:
        one = flow_table(spark, p, domain, context=False).withColumn("source", F.lit(p))
        out = one if out is None else out.unionByName(one)
    if out is None or out.isEmpty():
        raise ValueError("there are no rows to train on")
    return out


def catalogue(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, extension, length, modified) of readable files below a folder, each path once."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.withColumn("name", name).withColumn("extension", F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))).filter(F.col("extension").isin(*EXTENSIONS)).dropDuplicates(["path"])


def headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, position, name) of all CSV files of some paths, from their first lines, read in one job."""
    found = [(f, k, n) for names, _, files in header_groups(spark, path) for f in files for k, n in enumerate(names)]
    return spark.createDataFrame(found, "file string, position int, name string")


def inspected(spark: SparkSession, paths: list[str], least: float = 0.6) -> DataFrame:
    """(file, input_type, dataset_type, mode, confidence, length, modified) of files and of all files below folders.

    The domain goes by the header: first lines of all CSV files are read in one job, columns of a Parquet file come from its footer;
    captures are of flows by their kind.  Sizes and dates come from the listing.  Empty and other files are left out; a path
    without any of these kinds raises.
    """
    from ..domains import DOMAINS

    listed = None
    for p in paths:
        one = catalogue(spark, p).withColumn("asked", F.lit(p))
        listed = one if listed is None else listed.unionByName(one)
    found = listed.groupBy("path", "extension", "length", "modified").agg(F.collect_set("asked").alias("asked")).collect()  # a row a file
    if gone := sorted(set(paths) - {a for r in found for a in r["asked"]}):
        raise ValueError(f"no CSV, NF, Parquet or capture files: {', '.join(gone[:8])}")
    files = [{"file": r["path"], "extension": r["extension"], "length": r["length"], "modified": r["modified"]} for r in found]
    of = lambda *kinds: [r["file"] for r in files if r["extension"] in kinds]
    rows = [(r["file"], k, n) for r in files if r["extension"] == "parquet" for k, n in enumerate(spark.read.parquet(r["file"]).columns)]
    texts = of("csv", "nf")
    if texts:
        rows += [(f, k, n) for names, _, group in header_groups(spark, texts) for f in group for k, n in enumerate(names)]
    h = spark.createDataFrame(rows, "file string, position int, name string")
    d = labels.detected(labels.header_names(h).withColumn("name", F.regexp_replace("name", "__[0-9]+$", "")), least)
    d = d.select(F.regexp_replace("file", "^file:/+", "/").alias("_p"), F.col("domain").alias("found"), "confidence")
    known = spark.createDataFrame([tuple(r.values()) for r in files], "file string, extension string, length long, modified timestamp").withColumn("_p", F.regexp_replace("file", "^file:/+", "/"))
    capture = F.col("extension").isin("pcap", "pcapng", "cap")
    kind = F.when(capture, "pcap").when(F.col("extension") == "parquet", "parquet").otherwise("csv")
    both = known.join(d, "_p", "left").withColumn("input_type", kind)
    both = both.withColumn("dataset_type", F.when(capture, "CIC-IDS").otherwise(F.coalesce("found", F.lit("Unknown")))).withColumn("confidence", F.when(capture, 1.0).otherwise(F.coalesce("confidence", F.lit(0.0))))
    mode = F.create_map(*(F.lit(x) for name, x_ in DOMAINS.items() for x in (name, x_.mode)))
    return both.select(F.regexp_replace("file", "^file:/+", "/").alias("file"), "input_type", "dataset_type", F.coalesce(F.try_element_at(mode, F.col("dataset_type")), F.lit("Unknown")).alias("mode"), "confidence", "length", "modified")


def write_alerts(alerts: DataFrame, path: str) -> None:
    """Alerts as CSV with a header behind a byte order mark; helper columns, which begin with _, stay out."""
    own = [c for c in alerts.columns if not c.startswith("_")]
    marked = alerts.select(F.col(own[0]).alias("\ufeff" + own[0]), *own[1:])
    marked.write.mode("overwrite").option("header", True).csv(path)


def scan_report(summary: DataFrame, top: DataFrame, diagnostics: DataFrame | None = None) -> DataFrame:
    """One row for a JSON report: totals, risk, the map of the most frequent attacks, and a scan's diagnostics."""
    parts = [F.struct("total", "anomalies", "risk_score", "risk_level").alias("summary"), F.col("top").alias("top_anomalies")]
    both = summary.crossJoin(F.broadcast(top))
    if diagnostics is not None:
        both = both.crossJoin(F.broadcast(diagnostics.select(F.struct("*").alias("_d"))))
        parts.append(F.col("_d").alias("diagnostics"))
    return both.select(*parts)


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)  # one row


def write_benchmark(scans: DataFrame, trainings: DataFrame, summary: DataFrame, path: str) -> None:
    """The scans and the trainings of a benchmark as CSV, its summary as JSON, under one folder."""
    for name, table in (("scans", scans), ("training", trainings)):
        table.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
    write_report(summary, f"{path}/summary")


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Model manifests as JSON lines, newest first; only of supported versions, domains and algorithms."""
    from ..domains import DOMAINS

    schema = "name string, algorithm string, dataset_type string, analysis_mode string, manifest_version int, compatible_input_types array<string>, saved_at string, metrics map<string,double>, recommended_threshold double"
    m = spark.read.schema(schema).json(path)
    known = sorted({a for d in DOMAINS.values() for a in d.algorithms})
    return m.filter((F.col("manifest_version") >= 2) & F.col("dataset_type").isin(*DOMAINS) & F.col("algorithm").isin(*known)).orderBy(F.desc("saved_at"), F.desc("name"))
