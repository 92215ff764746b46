"""Exact nearest neighbours: for one vector by JVM expressions, for many by blocks of a matrix product."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..types import QueryError, SearchFilters

OVERFETCH = 5


def nearest(
    chunks: DataFrame,
    query: Sequence[float],
    top_k: int = 10,
    filters: SearchFilters | Column | None = None,
    metric: str = "l2",
    filter_mode: str = "post",
    key: str = "chunk_id",
    vector: str = "embedding",
) -> DataFrame:
    """The ``top_k`` rows of ``chunks`` nearest to ``query`` with their ``score``, best first, ties by ``key``.

    ``filter_mode="post"`` drops rows from the 5 * top_k nearest, so that fewer than ``top_k`` may be left; ``"pre"`` looks only at rows that
    pass.  A top-k of each task is merged: the scan is the only full pass and nothing but k rows a task is moved."""
    if top_k < 1:
        raise QueryError("top_k is at least 1")
    passes = filters.predicate() if isinstance(filters, SearchFilters) else filters
    rows = chunks.filter(passes) if passes is not None and filter_mode == "pre" else chunks
    rows = rows.filter(F.col(vector).isNotNull() & (F.size(vector) == len(query)))
    found = rows.withColumn("score", V.score(metric, F.col(vector), F.array(*(F.lit(float(x)) for x in query)))).drop(vector)
    order = (F.desc("score"), F.col(key))
    if passes is None or filter_mode == "pre":
        return found.orderBy(*order).limit(top_k)
    return found.orderBy(*order).limit(OVERFETCH * top_k).filter(passes).orderBy(*order).limit(top_k)


def nearest_batch(
    chunks: DataFrame, queries: Sequence[tuple[object, Sequence[float]]], top_k: int = 10, metric: str = "l2", key: str = "chunk_id", vector: str = "embedding", key_type: str = "string"
) -> DataFrame:
    """(query_id, chunk_id, score, rank) for many queries given on the driver.

    Each task multiplies its Arrow batches with the query matrix and keeps its own ``top_k`` for each query; only those are shuffled."""
    ids = np.arange(len(queries))
    matrix = np.array([q for _, q in queries], np.float64)
    names = [q for q, _ in queries]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def cut(parts):
            k, q, s = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((k, -s, q))
            k, q, s = k[order], q[order], s[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            keep = place < top_k
            return k[keep], q[keep], s[keep]

        for pdf in batches:
            pdf = pdf[[v is not None and len(v) == matrix.shape[1] for v in pdf[vector]]]
            if not len(pdf):
                continue
            x = np.stack(pdf[vector].to_numpy()).astype(np.float64)
            keys = pdf[key].to_numpy()
            if metric == "l2":
                s = 1.0 - np.sqrt(np.maximum((x * x).sum(1)[None, :] + (matrix * matrix).sum(1)[:, None] - 2 * matrix @ x.T, 0))
            else:
                s = matrix @ x.T
                if metric == "cosine":
                    size = np.linalg.norm(matrix, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
                    s = np.divide(s, size, out=np.zeros_like(s), where=size > 0)
            # what ties with the k-th best stays: the order of keys decides later
            edge = np.partition(-s, min(top_k, s.shape[1]) - 1, axis=1)[:, min(top_k, s.shape[1]) - 1]
            q, at = np.nonzero(-s <= edge[:, None])
            held.append((keys[at], q, s[q, at]))
            held = [cut(held)]
        if held:
            k, q, s = held[0]
            yield pd.DataFrame({"q": ids[q], key: k, "score": s})

    partial = chunks.select(key, vector).mapInPandas(run, f"q bigint, {key} {key_type}, score double")
    ranked = partial.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col(key)))).filter(F.col("rank") <= top_k)
    table = chunks.sparkSession.createDataFrame([(i, str(n)) for i, n in enumerate(names)], "q bigint, query_id string")
    return ranked.join(F.broadcast(table), "q").select("query_id", key, "score", "rank")


def similar(chunks: DataFrame, chunk_id: object, top_k: int = 10, exclude_self: bool = True, metric: str = "l2", key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """The rows nearest to a stored one, by its stored vector; none if there is no such row.

    One more than ``top_k`` is fetched before the row itself is dropped."""
    anchor = chunks.filter(F.col(key) == chunk_id).select(F.col(vector).alias("_anchor")).limit(1)
    order = (F.desc("score"), F.col(key))
    found = chunks.crossJoin(F.broadcast(anchor)).filter(F.size(vector) == F.size("_anchor")).withColumn("score", V.score(metric, F.col(vector), F.col("_anchor"))).drop(vector, "_anchor")
    found = found.orderBy(*order).limit(top_k + bool(exclude_self))
    return found.filter(F.col(key) != chunk_id).orderBy(*order).limit(top_k) if exclude_self else found
