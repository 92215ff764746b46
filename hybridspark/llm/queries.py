"""One query for each corpus operator over its whole table, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, license_scan, line_dedup, media, mixing, packing, quality, secrets, simhash_dedup, toxicity
from .common import read


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weak labels, score and verdict of every document."""
    return quality.scored(read(spark, sf_dir, "documents"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest size and best match of every document."""
    return fingerprints.matches(read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score and verdict of every document."""
    docs = read(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.lexicon(docs, read(spark, sf_dir, "labels")))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The real type of every payload of a media column made from the pages, with a row for each structure embedded in it, or one without."""
    found = media.sniffed(media.media_column(read(spark, sf_dir, "pages")))
    each = found.select("*", F.posexplode_outer("embedded").alias("part", "e"))
    inner = (F.col("e.offset").alias("embedded_at"), F.col("e.length").alias("embedded_length"), F.col("e.type").alias("embedded_type"), F.col("e.md5").alias("embedded_md5"))
    return each.select(F.col("media_id").alias("page_id"), "declared", "detected", "corrected", "n_bytes", "length", "part", *inner)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is in the mixture."""
    return mixing.sample(read(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bin and place of every piece of every document."""
    return packing.packed(read(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that repeats an earlier one, and the occurrence that stays."""
    return line_dedup.repeats(read(spark, sf_dir, "documents")).drop("rev")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate with its calibrated score and verdict."""
    return secrets.scanned(read(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, group_id): the near-duplicate group of every document."""
    return simhash_dedup.groups(read(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that contains a license template."""
    return license_scan.scan(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_classifier, op2_document_fingerprints, op3_toxicity, op4_media_columns, op5_source_mixing, op6_best_fit_packing, op7_line_dedup, op8_secret_scan, op9_simhash_near_dedup, op10_license_scan, pipeline)
}
ORACLES: dict[str, str] = {"op4_media_columns": media.ORACLE, "op5_source_mixing": mixing.ORACLE, "op10_license_scan": license_scan.oracle()}
