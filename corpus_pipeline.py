"""A training-data pipeline over the documents: each stage works on all that the one before it kept.

All stages but the last return the columns of the documents, whatever others there are beside doc_id, text, source and n_chars; names can't
clash.  Each takes null values in any column, empty and very long texts, repeated rows and an empty table as stated below."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hybridspark.llm import line_dedup, mixing, packing, simhash_dedup, toxicity
from hybridspark.llm.common import Shared, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon doesn't reject; null and empty texts stay, repeated rows stay or go together; no labels: the fixed lexicon alone."""
    return toxicity.clean(docs, toxicity.lexicon(docs, read(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones; a document that loses all of its lines goes.  Null texts stay; of repeated rows one stays
    where only it would be left without its lines; ties go to the least doc_id, null ids first, then the least line."""
    return line_dedup.deduplicated(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, its least doc_id.  Rows with a null doc_id all stay, and so do documents without words; of
    rows that repeat doc_id and text one stays."""
    return simhash_dedup.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: exactly as many rows as ``docs``, documents of small sources repeated.  A null source is a source, a null or negative n_chars
    counts as 0; ties at the cut, of repeated or null ids, go by a hash of all columns."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins: where every piece of every document lies.  Null and blank texts have no piece; each repeated row is packed; ties go by doc_id and piece."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("source mixing", mix_sources),
    ("best-fit packing", pack),
]
#: The stages fold characters, cluster by edit distance and search hashes: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; between stages the rows go through a Parquet table in the shared folder, which goes when the next one is written."""
    docs, last = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        made = Shared(stage(spark, docs, sf_dir), shuffled=True)
        if last:
            last.drop()
        docs, last = made.df, made
    return STAGES[-1][1](spark, docs, sf_dir)
