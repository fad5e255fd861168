"""The queries that apply this subpackage's operators to the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, fingerprint, html, linededup, media, minhash, mixing, search, suffix, toxicity, warc, whiten
from .sql import ORACLE

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path() -> str:
    """Where the public vocabulary file lies; the same on every worker."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive_pages(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary_path())


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.visible_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", F.length("text").cast("long").alias("n_chars"), "text")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out()), most=12_000)
    out = toxicity.scores(docs, model)
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.copies(media.media_of_vectors(table(spark, sf_dir, "embeddings")))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents"), least=40, min_docs=5)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, block_rows=16, cycle=240).select("doc_id", "source", "block", "rank", "slot", "release", "deadline")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), similar=0.8)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_copies(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.components(table(spark, sf_dir, "embeddings"), most=32)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)


def op13_reversed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_bpe": op2_bpe,
    "op3_html_text": op3_html_text,
    "op4_toxicity": op4_toxicity,
    "op5_image_copies": op5_image_copies,
    "op6_line_dedup": op6_line_dedup,
    "op7_source_mix": op7_source_mix,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_near_dups": op9_near_dups,
    "op10_fingerprints": op10_fingerprints,
    "op11_whitening": op11_whitening,
    "op12_decontamination": op12_decontamination,
    "op13_reversed_search": op13_reversed_search,
}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLE.items() if k in QUERIES}
