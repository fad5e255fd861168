"""A corpus pipeline: toxicity, line dedup, near-dedup, mixing, tokens; each stage reads what its predecessor wrote.

All stages take null and empty texts for texts without words or lines, which stay (of equal ones, one); rows without an id
stay; rows that repeat an id are judged alike, and those of a kept id stay; extra columns are passed on whatever their names;
an empty table gives an empty table.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweir.llm import bpe, linededup, minhash, mixing, toxicity
from netweir.llm.common import shared_dir
from netweir.llm.queries import table, vocabulary_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under one half."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out()))
    return toxicity.without_toxic(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least five of them hold, but for the largest holder; n_chars follows the text."""
    keep = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    out = linededup.dedup_lines(docs, keep=keep)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of least id."""
    return minhash.kept(docs, similar=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of a mix in which sources weigh the root of their size."""
    return mixing.mixed(docs, block_rows=16, cycle=240)


#: The column of a document's place in the mix, with as many _ before it as tell it apart from the documents' own columns.
PLACE = "mix_position"


def placed(spark: SparkSession, path: str) -> DataFrame:
    """The rows that a sorted write left in ``path``, with their place from 0 in their order as the last column: files by number,
    rows by index."""
    docs = spark.read.parquet(path)
    name = PLACE
    while name in docs.columns:
        name = f"_{name}"
    held = docs.select(F.struct("*").alias("doc"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("index"))
    number = lambda file: (int(re.sub(r"^part-(\d+).*$", r"\1", file)), file)
    sizes = sorted(((r["file"], r["count"]) for r in held.groupBy("file").count().collect()), key=lambda x: number(x[0]))  # one row a file
    ends = accumulate(n for _, n in sizes)
    starts = spark.createDataFrame([(f, end - n) for (f, n), end in zip(sizes, ends)], "file string, start long")
    own = [F.col(f"doc.`{c}`").alias(c) for c in docs.columns]
    return held.join(F.broadcast(starts), "file").select(*own, (F.col("start") + F.col("index")).alias(name))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their number and, as ``position``, the document's place in the mix, if it has one."""
    last = docs.columns[-1]
    if last.lstrip("_") != PLACE:
        return bpe.encode(docs, vocabulary_path())
    # the key of a row is its id and place together, which the encoder passes on as it is
    keyed = docs.select(F.struct("doc_id", F.col(last).alias("position")).alias("key"), "text")
    return bpe.encode(keyed, vocabulary_path(), id_col="key").select("key.doc_id", "key.position", "n_tokens", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_copies),
    ("source_mix", mix_sources),
    ("bpe", encode),
]

#: The stages learn, sample and schedule; SQL cannot express them.  tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again.

    Rows come with their ``position`` in the mix: those under n, for any n, hold the sources in the shares of their weights.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        path = f"{folder}/{k}-{name}"
        docs = placed(spark, path) if name == "source_mix" else spark.read.parquet(path)
    raise ValueError("no stages")
