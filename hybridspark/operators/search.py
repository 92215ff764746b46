"""The search service: vector, full-text and hybrid search and search by example over one collection."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..types import HIT_COLUMNS, QueryError, SearchFilters, SearchResults
from . import fulltext, fusion, knn
from .store import Store

HYBRID_FETCH, TOP_K = 3, 10
Filters, Least = SearchFilters | None, float | None


class Search:
    """Searches a DataFrame of chunks.  ``embed`` turns a query text into a vector; every method gives a lazy DataFrame of hits."""

    def __init__(self, chunks: DataFrame, embed: Callable[[str], Sequence[float]] | None = None, index: fulltext.Index | None = None, metric: str = "l2", filter_mode: str = "post", syntax: str = "fts5"):
        self.chunks, self.embed, self.metric, self.filter_mode, self.syntax = chunks, embed, metric, filter_mode, syntax
        self._index = index

    @classmethod
    def over(cls, store: Store, collection: str = "default", embed: Callable[[str], Sequence[float]] | None = None, version: int | None = None, **how) -> Search:
        """Search over a stored collection, with the full-text index that the store keeps of it."""
        how.setdefault("metric", store.get_collection(collection).distance_metric if store.get_collection(collection) else "l2")
        return cls(store.chunks(collection, version), embed, store.index(collection, version), **how)

    @property
    def index(self) -> fulltext.Index:
        if self._index is None:
            self._index = fulltext.index(self.chunks)
        return self._index

    def _none(self) -> DataFrame:
        return self._shown(self.chunks.filter(F.lit(False)).withColumn("score", F.lit(0.0)))

    def _shown(self, hits: DataFrame) -> DataFrame:
        return hits.select(*(c for c in HIT_COLUMNS if c in hits.columns))

    def _vector_hits(self, query: str, top_k: int, filters: Filters) -> DataFrame:
        if self.embed is None:
            raise QueryError("vector search needs an embedder")
        return knn.nearest(self.chunks, self.embed(query), top_k, filters, self.metric, self.filter_mode)

    def _final(self, hits: DataFrame, top_k: int, min_score: Least) -> DataFrame:
        if min_score is not None:
            hits = hits.filter(F.col("score") >= min_score)
        return self._shown(hits).orderBy(F.desc("score"), "chunk_id").limit(top_k)

    def vector(self, query: str, top_k: int = TOP_K, filters: Filters = None, min_score: Least = None) -> DataFrame:
        return self._final(self._vector_hits(query, top_k, filters), top_k, min_score)

    def fulltext(self, query: str, top_k: int = TOP_K, filters: Filters = None, min_score: Least = None) -> DataFrame:
        return self._final(fulltext.search(self.index, self.chunks, query, top_k, filters, self.syntax, self.filter_mode), top_k, min_score)

    def hybrid(self, query: str, top_k: int = TOP_K, filters: Filters = None, min_score: Least = None, alpha: float = 0.7, how: str = "rrf") -> DataFrame:
        """Both lists of 3 * top_k, fused; ``min_score`` applies to fused scores (those of rrf are at most 2 / 61)."""
        v = self._vector_hits(query, HYBRID_FETCH * top_k, filters)
        t = fulltext.search(self.index, self.chunks, query, HYBRID_FETCH * top_k, filters, self.syntax, self.filter_mode)
        made = fusion.rrf(v, t) if str(how) == "rrf" else fusion.weighted(v, t, alpha)
        return self._final(made, top_k, min_score)

    def similar(self, chunk_id: str, top_k: int = TOP_K, exclude_self: bool = True, reembed: bool = False) -> DataFrame:
        """Neighbours of a stored chunk, by its stored vector, or with ``reembed`` by embedding its text as a query."""
        if not reembed:
            return self._shown(knn.similar(self.chunks, chunk_id, top_k, exclude_self, self.metric))
        row = self.chunks.filter(F.col("chunk_id") == chunk_id).select("content").first()
        if row is None:
            return self._none()
        hits = self._vector_hits(row["content"], top_k + bool(exclude_self), None)
        return self._final(hits.filter(F.col("chunk_id") != chunk_id) if exclude_self else hits, top_k, None)

    def search(self, query: str, top_k: int = TOP_K, mode: str = "hybrid", filters: Filters = None, min_score: Least = None, fusion: str = "rrf", hybrid_alpha: float = 0.7) -> DataFrame:
        """Dispatch by mode; a blank query has no hits."""
        if not query or not query.strip():
            return self._none()
        if str(mode) == "vector":
            return self.vector(query, top_k, filters, min_score)
        if str(mode) == "fulltext":
            return self.fulltext(query, top_k, filters, min_score)
        if str(mode) == "hybrid":
            return self.hybrid(query, top_k, filters, min_score, hybrid_alpha, fusion)
        raise QueryError(f"no such mode: {mode}")

    def results(self, query: str, collection: str = "default", mode: str = "hybrid", **how) -> SearchResults:
        """``search``, collected."""
        began = time.perf_counter()
        return SearchResults.of(self.search(query, mode=mode, **how), query, collection, mode, 1000 * (time.perf_counter() - began))
