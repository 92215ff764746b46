"""Nearest neighbours, fusion, the search service, filters and results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hybridspark.operators import fusion, knn
from hybridspark.operators.embedding import Embedder, HashingBackend
from hybridspark.operators.search import Search
from hybridspark.types import EmbedInput, Embedding, InputError, QueryError, SearchFilters, SearchResults, SimilarityScore

TEXTS = {"a": "the quick brown fox jumps", "b": "the lazy dog sleeps", "c": "quick dogs and quick foxes", "d": "databases store rows", "e": "columns of vectors in databases"}
EMBED = Embedder(HashingBackend(32))


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(k, t, "python" if k < "c" else "markdown", f"/src/{k}.py" if k != "d" else None, "function", 1, 2, None, '{"n": 1, "tag": "x"}' if k in "ab" else None, EMBED.encode_document(t).to_list()) for k, t in TEXTS.items()]
    return spark.createDataFrame(rows, "chunk_id string, content string, content_type string, source_path string, chunk_type string, start_line int, end_line int, name string, metadata string, embedding array<float>").cache()


def vectors():
    return {k: np.float32(EMBED.encode_document(t).to_list()).astype(float) for k, t in TEXTS.items()}


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_nearest_and_batch_agree_with_numpy(chunks, metric):
    q, v = np.array(EMBED.query_vector("quick fox")), vectors()
    score = {k: 1 - np.linalg.norm(x - q) if metric == "l2" else x @ q / (1 if metric == "dot" else np.linalg.norm(x) * np.linalg.norm(q)) for k, x in v.items()}
    want = sorted(score, key=lambda k: (-round(score[k], 9), k))[:3]
    got = knn.nearest(chunks, q, 3, metric=metric).collect()
    assert [r["chunk_id"] for r in got] == want
    assert [r["score"] for r in got] == pytest.approx([score[k] for k in want], abs=1e-9)
    batch = knn.nearest_batch(chunks, [("q", q), ("r", -q)], 3, metric).filter("query_id = 'q'").orderBy("rank").collect()
    assert [r["chunk_id"] for r in batch] == want


def test_post_filter_may_return_fewer(spark):
    rows = spark.createDataFrame([(f"{i:02}", "x" if i >= 10 else "y", [float(i), 0.0]) for i in range(20)], "chunk_id string, content_type string, embedding array<float>")
    only = F.col("content_type") == "x"
    assert knn.nearest(rows, [0.0, 0.0], 2, only).count() == 0
    assert [r["chunk_id"] for r in knn.nearest(rows, [0.0, 0.0], 2, only, filter_mode="pre").collect()] == ["10", "11"]
    with pytest.raises(QueryError):
        knn.nearest(rows, [0.0], 0)


def test_similar(chunks):
    ids = [r["chunk_id"] for r in knn.similar(chunks, "a", 2).collect()]
    assert len(ids) == 2 and "a" not in ids
    assert knn.similar(chunks, "a", 2, exclude_self=False).first()["chunk_id"] == "a"
    assert knn.similar(chunks, "nope", 2).collect() == []


def lists(spark):
    v = spark.createDataFrame([("a", 0.9, "v"), ("b", 0.5, "v"), ("c", 0.1, "v")], "chunk_id string, score double, content string")
    t = spark.createDataFrame([("c", 7.0, "t"), ("d", 3.0, "t")], "chunk_id string, score double, content string")
    return v, t


def test_rrf(spark):
    got = {r["chunk_id"]: (r["score"], r["content"]) for r in fusion.rrf(*lists(spark)).collect()}
    assert got == {"a": (1 / 61, "v"), "b": (1 / 62, "v"), "c": (pytest.approx(1 / 63 + 1 / 61), "v"), "d": (1 / 62, "t")}


def test_weighted(spark):
    v, t = lists(spark)
    got = {r["chunk_id"]: r["score"] for r in fusion.weighted(v, t, 0.7).collect()}
    assert got == {"a": pytest.approx(0.7), "b": pytest.approx(0.35), "c": pytest.approx(0.3), "d": 0.0}
    assert {r["score"] for r in fusion.weighted(v, t.limit(1), 0.0).collect()} == {0.0}


def test_service(chunks):
    s = Search(chunks, EMBED.query_vector)
    assert s.search("  ").collect() == []
    assert s.search("quick", mode="fulltext").first()["chunk_id"] == "c"
    hybrid = s.search("quick", top_k=3).collect()
    assert hybrid[0]["score"] <= 2 / 61 and len(hybrid) == 3
    assert s.search("quick", min_score=0.5).collect() == []
    assert s.search("quick", mode="hybrid", fusion="weighted").first()["chunk_id"] in TEXTS
    only = SearchFilters(content_types=("markdown",))
    assert {r["content_type"] for r in s.search("quick", filters=only).collect()} == {"markdown"}
    assert s.similar("a", 2).count() == 2 and s.similar("a", 2, reembed=True).count() == 2 and s.similar("zz", reembed=True).count() == 0
    assert s.results("what is quick?", mode="fulltext").results == []
    with pytest.raises(QueryError):
        s.search("x", mode="other")


def test_filters(chunks):
    ids = lambda f: {r[0] for r in chunks.filter(f.predicate()).select("chunk_id").collect()}
    assert ids(SearchFilters()) == set(TEXTS)
    assert ids(SearchFilters(source_path_prefix="/src/")) == {"a", "b", "c", "e"}
    assert ids(SearchFilters(metadata_match=(("n", 1), ("tag", "x")))) == {"a", "b"}
    assert ids(SearchFilters(chunk_types=("class",))) == set()


def test_models():
    with pytest.raises(InputError):
        EmbedInput()
    with pytest.raises(InputError):
        Embedding((), "m")
    assert Embedding([1, 2], "m").dimension == 2 and SimilarityScore(0.5) < SimilarityScore(0.6)
    with pytest.raises(InputError):
        SearchResults([{"score": 0.1}, {"score": 0.2}], "q", "c", "vector")
    with pytest.raises(InputError):
        SearchResults([{"score": math.nan}], "q", "c", "vector")
    assert SearchResults([{"score": 0.1}], "q", "c", "vector").total_results == 1
