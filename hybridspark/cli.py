"""Command line: info, ingest text|file|dir, search."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from . import __version__, config
from .operators import formatting
from .operators.embedding import Embedder, HashingBackend, RemoteBackend
from .operators.pipeline import Ingest
from .operators.search import Search
from .operators.store import Store
from .types import Fusion, RetrievalError, SearchFilters, SearchMode


def embedder(c: config.EmbedderConfig) -> Embedder:
    backend = RemoteBackend(c.remote_url, c.embedding_dimension, c.model_name, c.remote_timeout, c.batch_size) if c.mode == "remote" else HashingBackend(c.embedding_dimension, c.model_name)
    return Embedder(backend, c.embedding_dimension, c.normalize, c.query_instruction, c.document_instruction, c.lru_cache_size)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="hybridspark")
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("-c", "--config")
    p.add_argument("--store")
    p.add_argument("--collection")
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("info")
    kinds = sub.add_parser("ingest").add_subparsers(dest="kind", required=True)
    text = kinds.add_parser("text")
    text.add_argument("text")
    text.add_argument("--source")
    text.add_argument("--content-type", default="generic")
    kinds.add_parser("file").add_argument("path")
    folder = kinds.add_parser("dir")
    folder.add_argument("path")
    folder.add_argument("--include", action="append", default=[])
    folder.add_argument("--exclude", action="append", default=[])
    folder.add_argument("--flat", action="store_true")
    search = sub.add_parser("search")
    search.add_argument("query")
    search.add_argument("-k", "--top-k", type=int, default=10)
    search.add_argument("--mode", choices=[str(m) for m in SearchMode], default="hybrid")
    search.add_argument("--fusion", choices=[str(f) for f in Fusion], default="rrf")
    search.add_argument("--min-score", type=float)
    search.add_argument("--content-type", action="append", default=[])
    search.add_argument("--source-prefix")
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        c = config.load(a.config)
        spark = spark or SparkSession.builder.appName("hybridspark").getOrCreate()
        store, name, model = Store(spark, a.store or c.store.path).initialize(), a.collection or c.pipeline.collection, embedder(c.embedder)
        if a.command == "info":
            print(f"hybridspark {__version__}\nstore: {store.path}, version {store.version()}")
            for found in store.list_collections():
                print(f"{found.name}: {store.count(found.name)} chunks, {found.dimension} dimensions, {found.model_name}")
        elif a.command == "ingest":
            run = Ingest(store, model, name, c.chunk)
            if a.kind == "text":
                out = run.ingest_text(a.text, a.content_type, a.source)
            elif a.kind == "file":
                out = run.ingest_file(a.path)
            else:
                out = run.ingest_directory(a.path, a.include or c.pipeline.include_patterns, a.exclude or c.pipeline.exclude_patterns, not a.flat)
            print(formatting.stats_json(out) if a.json else formatting.stats_text(out))
        else:
            service = Search.over(store, name, model.query_vector)
            hits = service.search(a.query, a.top_k, a.mode, SearchFilters(tuple(a.content_type), a.source_prefix) if a.content_type or a.source_prefix else None, a.min_score, fusion=a.fusion)
            for row in (formatting.as_json if a.json else formatting.preview)(hits).collect():  # at most top_k
                print(row[0])
    except RetrievalError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
