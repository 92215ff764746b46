"""Tokens, stems, grammar and scores against FTS5 of the standard library's SQLite."""

import re
import sqlite3

import pytest

from hybridspark.functions.text import stem
from hybridspark.operators import fulltext, ftsquery

ROWS = [
    ("a", "The runner runs in the park with a running dog and another dog", "runner"),
    ("b", "A dog ran. The dogs are running with the cat; dog runs fast", "pets dog"),
    ("c", "Nothing here about animals, only calculate_total and relational databases", None),
    ("d", "Crème brûlée and the naïve café of Zürich, happily generalised", "food"),
    ("e", "the the the dog dog of the park", "the end"),
    ("f", "", "empty"),
    ("g", "conditional national rationally electricity hopefulness goodness controlling rolled", "words"),
]
QUERIES = [
    "dog", "run dog", "run OR dog", "run NOT dog", '"dog runs"', "ru*", "name:runner", "^the", "NEAR(dog run)", "NEAR(the park, 1)", "run run", "dog AND (park OR cat)",
    "content:dog NOT name:pets", "{name content}:dog", "-name:dog", "creme", "brûlée", "calculate_total", '"the dog" + of', "the dog park", "dog + runs", "happy", "electric", "control* OR nation*",
]
ERRORS = ["what is run?", "it's", "a.b", "foo-bar", "(run", "AND", "error: x", "run +", "dog OR", "NEAR(dog run, x)"]


@pytest.fixture(scope="module")
def fts():
    con = sqlite3.connect(":memory:")
    shown = ", ".join(("content", "name", "chunk_id UNINDEXED"))
    con.execute(f"CREATE VIRTUAL TABLE t USING fts5({shown}, tokenize='porter unicode61')")
    con.executemany("INSERT INTO t(chunk_id, content, name) VALUES (?, ?, ?)", ROWS)
    return con


@pytest.fixture(scope="module")
def index(spark):
    return fulltext.index(spark.createDataFrame(ROWS, "chunk_id string, content string, name string"))


@pytest.mark.parametrize("query", QUERIES)
def test_matches_and_scores(fts, index, query):
    want = dict(fts.execute("SELECT chunk_id, -bm25(t) FROM t WHERE t MATCH ?", (query,)).fetchall())
    got = {r["chunk_id"]: r["score"] for r in index_rows(index, query)}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-9, abs=1e-12)


def index_rows(index, query):
    found = fulltext.matches(index, query)
    return found.collect() if found is not None else []


@pytest.mark.parametrize("query", ERRORS)
def test_syntax_errors_match_nothing(fts, index, query):
    with pytest.raises(sqlite3.OperationalError):
        fts.execute("SELECT * FROM t WHERE t MATCH ?", (query,)).fetchall()
    assert fulltext.matches(index, query) is None


def test_plain_syntax(index):
    assert {r["chunk_id"] for r in fulltext.matches(index, "what's the dog?", syntax="plain").collect()} == set()
    assert {r["chunk_id"] for r in fulltext.matches(index, "dog, park!", syntax="plain").collect()} == {"a", "e"}


def test_stems_equal_those_of_fts5():
    words = re.findall(r"[a-z]+", " ".join(str(r[1]).lower() for r in ROWS)) + "caresses ponies ties cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll yes by ion onion archaeologi".split()
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE w USING fts5(x, tokenize='porter unicode61')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(w, instance)")
    con.executemany("INSERT INTO w(rowid, x) VALUES (?, ?)", list(enumerate(words)))
    want = dict(con.execute("SELECT doc, term FROM v").fetchall())
    assert {w: stem(w) for w in words} == {w: want[i] for i, w in enumerate(words)}


def test_search_filters_and_empty(spark, index):
    chunks = spark.createDataFrame(ROWS, "chunk_id string, content string, name string")
    hits = fulltext.search(index, chunks, "dog", 2, filters=chunks.chunk_id != "e").collect()
    assert len(hits) == 2 and all(h["chunk_id"] != "e" for h in hits)
    assert hits[0]["score"] >= hits[1]["score"]
    assert fulltext.search(index, chunks, "(dog", 2).collect() == []
    empty = fulltext.index(spark.createDataFrame([], "chunk_id string, content string, name string"))
    assert fulltext.matches(empty, "dog").collect() == []


def test_parser_precedence():
    tree = ftsquery.parse("a b OR c NOT d AND e", str.split)
    assert tree.kind == "OR" and tree.left.kind == "AND" and tree.right.kind == "AND" and tree.right.left.kind == "NOT"


def test_written_index(tmp_path, index):
    stored = index.write(str(tmp_path))
    assert {r["chunk_id"] for r in fulltext.matches(stored, "dog").collect()} == {r["chunk_id"] for r in fulltext.matches(index, "dog").collect()}
