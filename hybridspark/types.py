"""Schemas, value sets, filters, results and errors of the retrieval engine."""

from __future__ import annotations

import enum
import math
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class RetrievalError(Exception):
    """Base of the engine's errors."""


class ConfigError(RetrievalError):
    """A setting is missing or out of range."""


class EncodeError(RetrievalError):
    """An embedding could not be computed."""


class ModelLoadError(RetrievalError):
    """An embedding model could not be loaded."""


class QueryError(RetrievalError):
    """A search request is malformed."""


class SourceError(RetrievalError):
    """A source could not be read."""


class SplitError(RetrievalError):
    """A document could not be split into chunks."""


class StoreError(RetrievalError):
    """A collection or chunk operation failed."""


class InputError(RetrievalError):
    """An argument has no valid value."""


class _Names(str, enum.Enum):
    def __str__(self) -> str:
        return self.value


ContentType = _Names("ContentType", {n.upper(): n for n in "python javascript typescript rust go c cpp java ruby shell markdown rst generic docling".split()}, module=__name__)
SearchMode = _Names("SearchMode", {n.upper(): n for n in ("vector", "fulltext", "hybrid")}, module=__name__)
Fusion = _Names("Fusion", {n.upper(): n for n in ("rrf", "weighted")}, module=__name__)
Metric = _Names("Metric", {n.upper(): n for n in ("l2", "cosine", "dot")}, module=__name__)

_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "array<float>": T.ArrayType(T.FloatType())}


def _struct(ddl: str) -> T.StructType:
    """A flat schema; unlike Spark's own parser this needs no session, so executors can import the module."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (field.split() for field in ddl.split(","))])


VECTOR = T.ArrayType(T.FloatType(), containsNull=False)
EMBED_INPUT = _struct("text string, image string, video string, instruction string")
EMBEDDING = _struct("vector array<float>, model_name string, normalized boolean, input_type string")
SOURCE = _struct("file_path string, url string, size_bytes bigint, modified_at timestamp, content_hash string")
DOCUMENT = _struct("path string, text string, content_type string, size_bytes bigint, modified_at timestamp, content_hash string")
READ_ERROR = _struct("file_path string, error string, error_type string")
CHUNK = _struct("chunk_id string, collection_id string, content string, content_type string, chunk_type string, source_path string, start_line int, end_line int, name string, parent string, metadata string, content_hash string, created_at timestamp, embedding array<float>")
HIT_COLUMNS = ("chunk_id", "content", "score", "source_path", "content_type", "chunk_type", "start_line", "end_line", "name", "metadata")


Text = str | None


@dataclass(frozen=True)
class EmbedInput:
    """One thing to embed: at least one of text, image, video."""

    text: Text = None
    image: Text = None
    video: Text = None
    instruction: Text = None

    def __post_init__(self) -> None:
        if all(x is None for x in (self.text, self.image, self.video)):
            raise InputError("text, image or video is required")


@dataclass(frozen=True)
class Embedding:
    vector: tuple[float, ...]
    model_name: str
    normalized: bool = True
    input_type: str = "text"

    def __post_init__(self) -> None:
        object.__setattr__(self, "vector", tuple(float(x) for x in self.vector))
        if not self.vector:
            raise InputError("a vector has at least one component")

    def to_list(self) -> list[float]:
        return [*self.vector]

    @property
    def dimension(self) -> int:
        """How many components it has."""
        return len(self.vector)


@dataclass(frozen=True, order=True)
class SimilarityScore:
    """A score, ordered among scores and plain numbers."""

    score: float
    metric: str = field(default="cosine", compare=False)

    def __float__(self) -> float:
        return self.score


@dataclass(frozen=True)
class SearchFilters:
    """Conditions on hits; an empty list or string is no condition."""

    content_types: tuple[str, ...] = ()
    source_path_prefix: Text = None
    chunk_types: tuple[str, ...] = ()
    metadata_match: tuple[tuple[str, Any], ...] = ()

    def predicate(self) -> Column:
        """As one Column: nulls fail; metadata values compare as text."""
        made = F.lit(True)
        if self.content_types:
            made &= F.col("content_type").isin([str(x) for x in self.content_types])
        if self.source_path_prefix:
            made &= F.col("source_path").startswith(self.source_path_prefix)
        if self.chunk_types:
            made &= F.col("chunk_type").isin(list(self.chunk_types))
        for key, value in dict(self.metadata_match).items():
            wanted = str(value).lower() if isinstance(value, bool) else str(value)
            made &= F.coalesce(F.try_variant_get(F.try_parse_json(F.coalesce(F.col("metadata"), F.lit("{}"))), f"$['{key}']", "string") == wanted, F.lit(False))
        return F.coalesce(made, F.lit(False))


@dataclass
class SearchResults:
    """Hits in descending order of score, collected, with what was asked."""

    results: list[dict[str, Any]]
    query: str
    collection: str
    mode: str
    elapsed_ms: float = 0

    def __post_init__(self) -> None:
        scores = [r["score"] for r in self.results]
        if any(not math.isfinite(s) for s in scores):
            raise InputError("scores must be finite")
        if any(a < b for a, b in zip(scores, scores[1:])):
            raise InputError("hits must be in descending order of score")

    @property
    def total_results(self) -> int:
        return len(self.results)

    @classmethod
    def of(cls, hits: DataFrame, query: str, collection: str, mode: str, elapsed_ms: float = 0.0) -> SearchResults:
        return cls([r.asDict(True) for r in hits.collect()], query, collection, str(mode), elapsed_ms)  # at most top_k rows
