"""Every query of the registry that has SQL gives DuckDB's rows at the smallest scale."""

from pathlib import Path

import pytest

from hybridspark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 6) if isinstance(v, float) else tuple(plain(x) for x in v) if isinstance(v, list | tuple) else v


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    import duckdb

    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    if name not in registry.ORACLES:
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(registry.ORACLES[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())


def test_entry_without_the_corpus_subpackage(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "_llm", lambda: None)
    assert set(entry.queries()) == set(registry.QUERIES) and set(entry.oracle_sql()) == set(registry.ORACLES)


def test_a_missing_library_is_an_error(monkeypatch):
    import importlib

    import __spark_entry__ as entry

    def missing(name):
        raise ModuleNotFoundError("no", name=missing.name)

    monkeypatch.setattr(importlib, "import_module", missing)
    missing.name = "hybridspark.llm"
    assert entry._llm() is None
    missing.name = "ahocorasick"
    with pytest.raises(ModuleNotFoundError):
        entry._llm()


def test_hashing_embedder_equals_brute_force(spark):
    """embed_hashing has no SQL: every document's vector, token by token."""
    import hashlib
    import math
    import re

    texts = {r["doc_id"]: r["text"] for r in registry.read(spark, SF, "documents").collect()}
    for r in registry.QUERIES["embed_hashing"](spark, SF).collect():
        tokens = re.findall(r"\w+", " " + texts[r["doc_id"]].lower())
        want = [0.0] * 64
        for t in tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])]:
            h = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little")
            want[(h >> 1) % 64] += 1 if h & 1 else -1
        size = math.sqrt(sum(x * x for x in want)) or 1.0
        assert r["embedding"] == pytest.approx([x / size for x in want], abs=1e-6)


def test_html_text_equals_brute_force(spark):
    """html_text and chunk_rich have no SQL: pages of the tables by regular expressions."""
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in registry.read(spark, SF, "pages").collect()}
    want = {}
    for k, page in pages.items():
        t = re.sub(r"(?is)<head>.*?</head>|<script.*?</script>|<style.*?</style>|<!--.*?-->|<!doctype[^>]*>", "", page)
        t = re.sub(r"(?i)<br\s*/?>", "\n", t)
        t = re.sub(r"(?i)<h([1-6])[^>]*>", lambda m: "\n\n" + "#" * int(m[1]) + " ", t)
        t = re.sub(r"(?i)</?(?:p|div|li|ul|ol|tr|table|section|article|header|footer|nav|aside|blockquote|pre|h[1-6])(?:\s[^>]*)?>", "\n\n", t)
        t = html.unescape(re.sub(r"<[^>]+>", "", t))
        want[k] = re.sub(r"\s+", " ", t).strip()
    for r in registry.QUERIES["html_text"](spark, SF).collect():
        assert re.sub(r"\s+", " ", r["text"]).strip() == want[r["page_id"]]
    chunks = {}
    for r in registry.QUERIES["chunk_rich"](spark, SF).collect():
        chunks.setdefault(r["page_id"], []).append(r["content"])
    for k, parts in chunks.items():
        words = " ".join(re.sub(r"\s+", " ", p) for p in parts)
        assert all(w in want[k] for w in words.split()) and len(words) <= len(want[k])


def test_stemmed_postings_equal_brute_force(spark):
    """fts_postings_stemmed has no SQL: tokens and stems one by one; the stemmer itself is held against FTS5 elsewhere."""
    import re

    from hybridspark.functions.text import stem

    texts = {r["doc_id"]: r["text"] for r in registry.read(spark, SF, "documents").collect()}
    want = {}
    for k, t in texts.items():
        for i, w in enumerate(x for x in re.split(r"[^\w]|_", t.lower()) if x):
            want.setdefault((k, stem(w)), []).append(i)
    got = {(r["doc_id"], r["term"]): r["positions"] for r in registry.QUERIES["fts_postings_stemmed"](spark, SF).collect()}
    assert got == want


def exactly(spark, name, folder, tables):
    """Rows of a query and of its SQL over ``tables`` of DuckDB, by every bit of their numbers."""
    import duckdb

    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = registry.QUERIES[name](spark, str(folder))
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({registry.ORACLES[name]})").fetchall()
    whole = lambda rows: sorted(repr(tuple(list(v) if isinstance(v, list | tuple) else v for v in r)) for r in rows)
    return whole(df.collect()), whole(want)


def test_what_is_rounded_to_zero_keeps_its_sign(spark, tmp_path):
    tiny = [1.0, -1e-7, 1e-7, -0.0, 0.1234565, -0.5] + [0.25] * 58
    spark.createDataFrame([(0, tiny, 1), (1, [0.0] * 64, 1), (2, [-x for x in tiny], 2)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("mrl_truncate_normalize", "knn_dot"):
        got, want = exactly(spark, name, tmp_path, ["embeddings"])
        assert got == want
    assert any("-0.0," in r for r in exactly(spark, "mrl_truncate_normalize", tmp_path, ["embeddings"])[0])


#: Forms whose stem or unmarked letters are a word that is asked for, blank and missing texts.
ODD = [(1, "und von", "en", "src1", 7), (2, "unde so", "de", "src0", 7), (3, "und\u0308 was vons", "de", "src0", 9), (4, " \n", "de", "src1", 2), (5, "", "de", "src2", 0), (6, None, "de", "src2", 0), (7, "ja ja und", "de", "src0", 9), (8, "nichts", "de", "src1", 6), (9, "gar nichts", "de", "src1", 9), (10, " \n", "fr", "src0", 2), (11, "nichts", "de", "src2", 6), (12, None, "en", "src1", 0)]


def odd_documents(spark, folder):
    spark.createDataFrame(ODD, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{folder}/documents.parquet")


def test_the_service_finds_words_not_stems(spark, tmp_path):
    odd_documents(spark, tmp_path)
    got, want = exactly(spark, "service_fulltext", tmp_path, ["documents"])
    assert got == want and len(got) == 2


def test_repeated_words_are_hashed_once(monkeypatch):
    import hashlib

    from hybridspark.operators.embedding import HashingBackend
    from hybridspark.types import EmbedInput

    calls, real = [], hashlib.blake2b
    monkeypatch.setattr(hashlib, "blake2b", lambda *a, **how: calls.append(a) or real(*a, **how))
    HashingBackend(8).encode([EmbedInput(text="a b " * 1000)] * 20)
    assert len(calls) == 4


def test_postings_go_through_python_once_in_bounded_batches(spark):
    from hybridspark.functions import batches
    from hybridspark.operators import fulltext

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(1 << 30))
    try:
        docs = spark.createDataFrame([(i, f"w{i} runs running " * 3, f"n {i}" if i else None) for i in range(3)], "chunk_id bigint, content string, name string")
        ix = fulltext.index(docs)
        assert int(spark.conf.get(name)) <= batches.BATCH_BYTES
        made = ix.postings
        assert made._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
        assert {(r["chunk_id"], r["term"], r["col"]): r["positions"] for r in made.collect()}[(1, "run", "content")] == [1, 2, 4, 5, 7, 8]
        assert {r["chunk_id"]: r["dl"] for r in ix.lengths.collect()} == {0: 9, 1: 11, 2: 11}
    finally:
        spark.conf.set(name, before)
    assert list(batches.slices(["a" * batches.SLICE, "b", "c", "d" * batches.SLICE])) == [(0, 1), (1, 3), (3, 4)] and not list(batches.slices([]))


def test_rich_chunks_take_bounded_batches(spark):
    from hybridspark.functions import batches

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(1 << 30))
    try:
        registry.QUERIES["chunk_rich"](spark, SF)
        assert int(spark.conf.get(name)) <= batches.BATCH_BYTES
    finally:
        spark.conf.set(name, before)


def test_ingest_of_blank_and_missing_texts(spark, tmp_path):
    odd_documents(spark, tmp_path)
    for name in ("ingest_rollup", "ingest_chunks"):
        got, want = exactly(spark, name, tmp_path, ["documents"])
        assert got == want


def test_hybrid_search_computes_chunks_once(spark):
    made = registry.QUERIES["search_hybrid_rrf"](spark, SF)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "Generate posexplode" not in plan
