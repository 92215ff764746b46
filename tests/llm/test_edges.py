"""Every operator and pipeline stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hybridspark.llm import fingerprints, license_scan, line_dedup, media, mixing, packing, quality, secrets, simhash_dedup, toxicity

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, count int, `_source` string, node string, fp string, `a.b` string, `row` string, `_d` int"
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards brew potions near the quiet river bank"
LONG = " ".join(f"word{i % 5003} and" for i in range(60_000)) + "\n" + PROSE
ROWS = [
    (1, PROSE, "en", "s1", 100), (1, PROSE, "en", "s1", 100), (2, PROSE, None, "s2", 100), (3, None, "en", "s1", None), (4, "", "en", None, 0),
    (None, PROSE, "en", "s1", 100), (None, None, None, None, None), (5, "   \n\n ", "en", "s1", 6), (6, LONG, "en", "s1", len(LONG)), (7, "x", "en", "s3", -5), (8, "ßüé 漢字 \U0001f600", "de", "s3", 10),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 9, "c", "n", "f", "d", "r", 1) for r in ROWS], DDL).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(1, 1, 0), (None, None, None), (3, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    return f"file://{path}"


OPERATORS = {
    "quality": quality.scored,
    "fingerprints": lambda d: fingerprints.matches(d, every=1),
    "toxicity": lambda d: toxicity.scored(d, toxicity.LEXICON),
    "mixing": mixing.sample,
    "packing": packing.packed,
    "line_dedup": line_dedup.repeats,
    "secrets": secrets.scanned,
    "simhash": simhash_dedup.groups,
    "license": license_scan.scan,
    "media": lambda d: media.sniffed(d.select(F.col("doc_id").alias("media_id"), F.col("text").cast("binary").alias("payload"), F.col("lang").alias("declared"), "count", "`a.b`", F.lit(1).alias("offset"), F.lit(1).alias("embedded"))),
    "carving": lambda d: media.carved(d.select(F.col("doc_id").alias("media_id"), F.col("text").cast("binary").alias("payload"), "count", F.lit(1).alias("offset"), F.lit(1).alias("type"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, name):
    assert OPERATORS[name](empty).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(docs, name):
    rows = OPERATORS[name](docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    if name in ("quality", "toxicity", "media"):  # one row for each
        assert len(rows) == len(ROWS) and len(by[1]) == 2
    if name == "quality":
        assert by[3][0]["score"] == 0 and not by[3][0]["keep"] and not by[4][0]["keep"] and by[1][0] == by[1][1]
    if name == "toxicity":
        assert not any(r["toxic"] for r in rows)
    if name == "fingerprints":
        assert set(by) == {1, 2, 3, 4, 5, 6, 7, 8} and by[2][0]["match_id"] == 1 and by[2][0]["score"] == 100 and by[3][0]["match_id"] is None
    if name == "simhash":
        assert {r["doc_id"]: r["group_id"] for r in rows} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8}
    if name == "packing":
        total = sum(len(t.split()) for _, t, *_ in ROWS if t)
        assert sum(r["tokens"] for r in rows) == total and max(r["bin_tokens"] for r in rows) <= packing.CAPACITY
    if name == "line_dedup":
        # a null id counts as the least, so its copy stays; the repeated row of 1 is one document
        assert sorted((r["doc_id"], r["line"], r["kept_doc_id"]) for r in rows) == [(1, 0, None), (2, 0, None), (6, 1, None)]
    if name == "secrets":
        assert not any(r["secret"] for r in rows)
    if name == "license":
        assert rows == []
    if name == "mixing":
        assert all(r["copies"] > 0 for r in rows) and sum(r["copies"] for r in rows) == len(ROWS)
    if name == "carving":
        assert rows == []


def test_long_texts_are_read_in_blocks(spark):
    """One text of 24 MB, most of it in one line: no operator holds more than a few copies of it in a worker."""
    words = " ".join(f"w{i % 70_001:x} of" for i in range(2_400_000))
    text = "\n".join([PROSE, words, PROSE, "idiot moron scum", 'password = "p@ss!w0rd#x9$Q"', "Licensed under the Apache License, Version 2.0."])
    docs = spark.createDataFrame([(1, text, "s", len(text)), (20, PROSE, "s", 90)], "doc_id bigint, text string, source string, n_chars bigint")
    assert len(text) > 20_000_000
    assert sorted((r["doc_id"], r["line"]) for r in line_dedup.repeats(docs).collect()) == [(1, 2), (20, 0)]
    assert [r["group_id"] for r in simhash_dedup.groups(docs).orderBy("doc_id").collect()] == [1, 20]
    assert toxicity.scored(docs, toxicity.LEXICON).filter("doc_id = 1").first()["hits"] == 3
    assert {r["line"] for r in license_scan.scan(docs).collect()} == {5}
    assert secrets.scanned(docs).filter("doc_id = 1 and length = 14").count() == 1
    assert sum(r["tokens"] for r in packing.packed(docs).filter("doc_id = 1").collect()) == len(text.split())
    assert fingerprints.matches(docs, every=1).filter("doc_id = 1").first()["filters"] > 100
    assert quality.scored(docs).count() == 2


def test_an_empty_pipeline(spark, tmp_path):
    spark.createDataFrame([], DDL).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").collect() == []


def test_the_pipeline_on_odd_rows(spark, docs, sf, tmp_path):
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"file://{tmp_path}/labels.parquet")
    rows = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert max(r["bin_tokens"] for r in rows) <= packing.CAPACITY and {r["doc_id"] for r in rows} <= {None, 6, 7, 8}


def test_a_shared_folder_is_needed_off_local_masters():
    from types import SimpleNamespace

    from hybridspark.llm import common

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError):
        common.shared_dir(far)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, empty, sf, name, stage):
    out = stage(spark, docs, sf)
    rows = out.collect()
    nothing = stage(spark, empty, sf)
    assert nothing.collect() == []
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns and nothing.columns == docs.columns
        assert all(r["a.b"] == "d" and r["count"] == 9 for r in rows)
    if name == "toxicity":
        assert len(rows) == len(ROWS)
    if name == "line dedup":
        kept = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is None) for r in rows)
        assert kept == [(False, 0, False), (False, 0, True), (True, 3, True), (True, 4, False), (True, 5, False), (True, 6, False), (True, 7, False), (True, 8, False)]
        assert next(r for r in rows if r["doc_id"] == 6)["text"] == LONG.split("\n")[0]
    if name == "SimHash near-dedup":
        assert sorted(r["doc_id"] for r in rows if r["doc_id"]) == [1, 3, 4, 5, 6, 7, 8] and sum(r["doc_id"] is None for r in rows) == 2
