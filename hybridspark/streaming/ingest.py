"""Streaming ingest: a file stream of documents, each micro-batch one commit of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X
from ..operators.pipeline import Ingest


def document_stream(spark: SparkSession, path: str, schema: str = "path string, text string, content_type string", fmt: str = "json", files_per_batch: int = 100) -> DataFrame:
    """Documents as they arrive as JSON lines or Parquet files under ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def start(documents: DataFrame, ingest: Ingest, checkpoint: str, **trigger) -> StreamingQuery:
    """Ingests a stream.  A batch that is run again after a failure finds its content stored, so each is stored once."""

    def batch(docs: DataFrame, _: int) -> None:
        kind = F.coalesce(F.col("content_type"), X.content_type(F.coalesce("path", F.lit(""))))
        ingest.ingest_documents(docs.filter(X.not_blank(F.col("text"))).select("path", "text", kind.alias("content_type"), X.content_hash(F.col("text")).alias("content_hash")), skip_seen=True)

    return documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
