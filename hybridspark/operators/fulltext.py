"""Full-text search: positional postings, boolean, phrase and proximity matching, BM25.

An index is either over the token lists of the chunks themselves (``index``), in which a query finds the positions of its terms row by
row without any shuffle and once, or stored (``Index.write``), in which postings are sorted by term so that a query reads only its terms."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import batches as A
from ..functions import shared
from ..functions import text as X
from ..types import QueryError, SearchFilters
from . import ftsquery as Q
from .ftsquery import COLUMNS, Near, Op, Phrase

K1, B, FLOOR, OVERFETCH = 1.2, 0.75, 1e-6, 5


@dataclass
class Index:
    """Either ``tokens`` (key, a list of tokens for each of COLUMNS), one row for each chunk, with ``texts`` (key, the text of each of COLUMNS
    in lower case), or what is stored of it: ``stored_postings`` (key, term, col, positions) and ``stored_lengths`` (key, dl), one row for
    each (term, chunk, column) and each chunk."""

    key: str
    stemmed: bool
    tokens: DataFrame | None = None
    stored_postings: DataFrame | None = None
    stored_lengths: DataFrame | None = None
    texts: DataFrame | None = None

    @property
    def postings(self) -> DataFrame:
        return self.stored_postings if self.stored_postings is not None else _postings(self.texts, self.key, self.stemmed)

    @property
    def lengths(self) -> DataFrame:
        if self.stored_lengths is not None:
            return self.stored_lengths
        return _lengths(self.texts, self.key)

    def write(self, path: str) -> Index:
        """Stored, postings ranged and sorted by term and key: a query reads only the row groups of its terms, and a frequent term is spread over files."""
        self.postings.repartitionByRange("term", self.key).sortWithinPartitions("term", self.key).write.mode("overwrite").parquet(f"{path}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
        spark = self.postings.sparkSession
        return Index(self.key, self.stemmed, None, spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"))

    def tokenize(self, text: str) -> list[str]:
        found = [t for t in re.split(r"[^\w]|_", text.lower()) if t]
        return [X.stem(t) for t in found] if self.stemmed else found


def index(chunks: DataFrame, key: str = "chunk_id", content: str = "content", name: str | None = "name", stemmed: bool = True) -> Index:
    """The index of the texts of ``chunks``; nulls have no tokens."""
    empty = F.array().cast("array<string>")
    of = {"content": F.coalesce(X.search_tokens(F.col(content)), empty), "name": F.coalesce(X.search_tokens(F.col(name)), empty) if name else empty}
    base = chunks.select(F.col(key), *(of[c].alias(c) for c in COLUMNS))
    text = {"content": content, "name": name}
    A.bounded(chunks.sparkSession)
    texts = chunks.select(F.col(key), *((F.lower(text[c]) if text[c] else F.lit(None).cast("string")).alias(c) for c in COLUMNS))
    return Index(key, stemmed, _stemmed(base) if stemmed else base, texts=texts)


def _stemmed(tokens: DataFrame) -> DataFrame:
    """Token lists with each token stemmed; an Arrow batch's distinct tokens are stemmed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(0)]
            for i in range(1, batch.num_columns):
                lists = batch.column(i)
                coded = lists.flatten().dictionary_encode()
                stems = pa.array([X.stem(t) for t in coded.dictionary.to_pylist()], pa.string())
                columns.append(pa.ListArray.from_arrays(pa.compute.subtract(lists.offsets, lists.offsets[0]), stems.take(coded.indices)))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return tokens.mapInArrow(run, tokens.schema)


def _sliced(texts: DataFrame, run, ddl: str) -> DataFrame:
    """``run(keys, column's name, tokens, number of each token's key)`` of each slice of each text column, in one task without a shuffle."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for i in range(1, batch.num_columns):
                    column = batch.column(i).fill_null("").to_pylist()
                    for a, b in A.slices(column):
                        yield from run(batch.column(0).slice(a, b - a), batch.schema.names[i], *A.runs(column[a:b], A.search_points()))
        finally:
            A.tidy()

    return texts.mapInArrow(task, ddl)


def _postings(texts: DataFrame, key: str, stemmed: bool) -> DataFrame:
    """(key, term, col, positions), grouped within each row; a slice's distinct tokens are stemmed once."""

    def run(keys: pa.Array, name: str, tokens: pa.StringArray, row: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(tokens):
            return
        coded = tokens.dictionary_encode()
        code, terms = coded.indices.to_numpy(), coded.dictionary
        if stemmed:
            stems = pa.array([X.stem(t) for t in terms.to_pylist()], pa.string()).dictionary_encode()
            code, terms = stems.indices.to_numpy()[code], stems.dictionary
        place = np.arange(len(row)) - np.searchsorted(row, row)
        both = row * len(terms) + code
        order = np.argsort(both, kind="stable")
        both, place = both[order], place[order]
        start = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(both)).astype(np.int32)), pa.array(place.astype(np.int32)))
        at, term = np.divmod(both[start], len(terms))
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), terms.take(pa.array(term)), pa.array([name] * len(start)), lists], names=[key, "term", "col", "positions"])

    return _sliced(texts, run, f"`{key}` {texts.schema[key].dataType.simpleString()}, term string, col string, positions array<int>")


def _lengths(texts: DataFrame, key: str) -> DataFrame:
    """(key, dl): the tokens of all columns of each row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                dl = np.zeros(len(batch), np.int32)
                for i in range(1, batch.num_columns):
                    column = batch.column(i).fill_null("").to_pylist()
                    for a, b in A.slices(column):
                        dl[a:b] += np.bincount(A.runs(column[a:b], A.search_points())[1], minlength=b - a).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dl)], names=[key, "dl"])
        finally:
            A.tidy()

    return texts.mapInArrow(task, f"`{key}` {texts.schema[key].dataType.simpleString()}, dl int")


def _term_column(i: int, c: str) -> str:
    return f"_t{i}_{c}"


def _followed(starts: Column, then: Column, k: int) -> Column:
    return F.array_intersect(starts, F.transform(then, lambda x: x - k))


#: Widths up to which windows are laid out position by position, to be met by hash; wider ones are compared pair by pair.
LAID_OUT = 64


def _within(ends: Column, starts: Column, width: int) -> Column:
    """Those of ``ends`` that are at most ``width`` behind one of ``starts``."""
    if width <= LAID_OUT:
        return F.array_intersect(ends, F.flatten(F.transform(starts, lambda y: F.sequence(y, y + width))))
    return F.filter(ends, lambda m: F.exists(starts, lambda y: (y <= m) & (y >= m - width)))


def _taking_part(starts: Column, ends: Column, width: int) -> Column:
    if width <= LAID_OUT:
        return F.array_intersect(starts, F.flatten(F.transform(ends, lambda m: F.sequence(m - width, m))))
    return F.filter(starts, lambda x: F.exists(ends, lambda m: (x <= m) & (x >= m - width)))


def _starts(p: Phrase, c: str, ids: dict[tuple[str, bool], int]) -> Column:
    """Positions in column c at which the phrase begins."""
    if c not in p.columns:
        return F.array().cast("array<int>")
    at = [F.col(_term_column(ids[(t, p.prefix and k == len(p.terms) - 1)], c)) for k, t in enumerate(p.terms)]
    found = at[0]
    for k in range(1, len(at)):
        found = _followed(found, at[k], k)
    return F.filter(found, lambda x: x == 0) if p.initial else found


def _near(n: Near, c: str, starts: list[Column]) -> list[Column]:
    """The starts of each phrase of a NEAR group that take part in a match: all within ``distance`` tokens of the last."""
    low = [n.distance + len(p.terms) for p in n.phrases]
    ends = F.array_distinct(F.flatten(F.array(*starts)))
    for s, w in zip(starts, low, strict=True):
        ends = _within(ends, s, w)
    return [_taking_part(s, ends, w) for s, w in zip(starts, low, strict=True)]


def _size(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, (F.size(x) for x in cols))


def _nears(node: Q.Node) -> list[Near]:
    if isinstance(node, Op):
        return _nears(node.left) + _nears(node.right)
    return [node] if isinstance(node, Near) else []


def _plan(node: Q.Node, phrase: dict[Phrase, int], near: dict[Near, int]) -> tuple[Column, list[tuple[Phrase, Column]]]:
    """(whether a row matches, occurrences of each phrase in it), by the columns of starts that ``matches`` has laid out."""
    if isinstance(node, Phrase):
        n = _size([F.col(f"_s{phrase[node]}_{c}") for c in COLUMNS])
        return n > 0, [(node, n)]
    if isinstance(node, Near):
        counts = [_size([F.col(f"_r{near[node]}_{c}")[i] for c in COLUMNS]) for i in range(len(node.phrases))]
        return counts[0] > 0, list(zip(node.phrases, counts, strict=True))
    a, pa = _plan(node.left, phrase, near)
    b, pb = _plan(node.right, phrase, near)

    def only(where: Column, found: list[tuple[Phrase, Column]]) -> list[tuple[Phrase, Column]]:
        return [(p, F.when(where, n).otherwise(F.lit(0))) for p, n in found]

    if node.kind == "AND":
        return a & b, pa + pb
    return (a | b, only(a, pa) + only(b, pb)) if node.kind == "OR" else (a & ~b, pa + only(b, pb))


def _once(df: DataFrame) -> DataFrame:
    """The same rows, computed before what is selected of them: Catalyst would copy a column's expression into the lambdas that read it."""
    return df.select(F.inline(F.array(F.struct("*"))))


def _held(ix: Index, ids: dict[tuple[str, bool], int]) -> DataFrame:
    """(key, _dl, positions of each term in each column) of each chunk, of a stored index only of those that hold a term (_dl is null there)."""
    none = F.array().cast("array<int>")

    def is_term(x: Column, t: str, prefix: bool) -> Column:
        return x.startswith(t) if prefix else x == t

    if ix.tokens is not None:
        made = ix.tokens.select(ix.key, reduce(lambda a, b: a + b, (F.size(c) for c in COLUMNS)).alias("_dl"), *COLUMNS)

        def positions(c: str, t: str, prefix: bool) -> Column:
            at = F.transform(F.col(c), lambda x, i: F.when(is_term(x, t, prefix), i))
            return F.filter(at, lambda x: x.isNotNull())

        return made.select(ix.key, "_dl", *(positions(c, t, prefix).alias(_term_column(i, c)) for (t, prefix), i in ids.items() for c in COLUMNS))
    term = F.col("term")
    wanted = reduce(lambda a, b: a | b, (is_term(term, t, prefix) for t, prefix in ids))
    cols = [
        F.sort_array(F.flatten(F.collect_list(F.when(is_term(term, t, prefix) & (F.col("col") == c), F.col("positions")).otherwise(none)))).alias(_term_column(i, c))
        for (t, prefix), i in ids.items()
        for c in COLUMNS
    ]
    return ix.postings.filter(wanted).groupBy(ix.key).agg(*cols).withColumn("_dl", F.lit(None).cast("int"))


def matches(ix: Index, query: str, syntax: str = "fts5") -> DataFrame | None:
    """(key, score) of every chunk that matches, unordered; None for a query that is malformed or empty.  An index that isn't stored is read when this is called.

    ``syntax="plain"`` takes the text as words that must all occur.  A score is BM25 with k1 = 1.2, b = 0.75; a phrase's
    idf is taken over all chunks and is at least 1e-6; a phrase that is written twice counts twice."""
    if syntax == "plain":
        terms = ix.tokenize(query)
        tree = reduce(lambda a, b: Op("AND", a, b), (Phrase((t,)) for t in terms)) if terms else None
    else:
        try:
            tree = Q.parse(query, ix.tokenize)
        except Q.QuerySyntaxError:
            return None
    if tree is None:
        return None
    listed = Q.phrases(tree)
    ids: dict[tuple[str, bool], int] = {}
    for p in listed:
        for k, t in enumerate(p.terms):
            ids.setdefault((t, p.prefix and k == len(p.terms) - 1), len(ids))
    held = _once(_held(ix, ids))
    phrase = {p: i for i, p in enumerate(dict.fromkeys(listed))}
    near = {n: i for i, n in enumerate(dict.fromkeys(_nears(tree)))}
    # starts, then those that take part in a NEAR: each is computed once, in a projection of its own
    laid = held.select(ix.key, "_dl", *(_starts(p, c, ids).alias(f"_s{i}_{c}") for p, i in phrase.items() for c in COLUMNS))
    laid = _once(laid) if near else laid
    laid = laid.select("*", *(F.array(*_near(n, c, [F.col(f"_s{phrase[p]}_{c}") for p in n.phrases])).alias(f"_r{i}_{c}") for n, i in near.items() for c in COLUMNS))
    laid = _once(laid)
    matched, counts = _plan(tree, phrase, near)
    rows = laid.select(ix.key, "_dl", matched.alias("_m"), *(n.alias(f"_f{i}") for i, (_, n) in enumerate(counts)), *((_size([F.col(f"_s{i}_{c}") for c in COLUMNS]) > 0).cast("long").alias(f"_h{i}") for i in phrase.values()))
    if ix.tokens is not None:
        rows = shared.table(rows)  # a few numbers for each chunk, instead of all tokens for the counts and again for the hits
    found = (F.coalesce(F.sum(f"_h{i}"), F.lit(0)).alias(f"_d{i}") for i in phrase.values())
    if ix.tokens is not None:  # every chunk has a row
        hits = rows.filter("_m").crossJoin(F.broadcast(rows.agg(F.count("*").alias("_n"), F.avg("_dl").alias("_avg"), *found)))  # one row
    else:
        corpus = ix.lengths.agg(F.count("*").alias("_n"), F.avg("dl").alias("_avg"))
        hits = rows.filter("_m").crossJoin(F.broadcast(corpus)).crossJoin(F.broadcast(rows.agg(*found)))  # one row each
        hits = hits.drop("_dl").join(ix.lengths.withColumnRenamed("dl", "_dl"), ix.key)
    total = F.lit(0.0)
    for i, (p, _) in enumerate(counts):
        d, f = F.col(f"_d{phrase[p]}"), F.col(f"_f{i}").cast("double")
        idf = F.ln((F.col("_n") - d + 0.5) / (d + 0.5))
        idf = F.when(idf > 0, idf).otherwise(F.lit(FLOOR))
        total = total + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_dl") / F.col("_avg")))
    return hits.select(ix.key, total.alias("score"))


def search(
    ix: Index, chunks: DataFrame, query: str, top_k: int = 10, filters: SearchFilters | Column | None = None, syntax: str = "fts5", filter_mode: str = "post"
) -> DataFrame:
    """The ``top_k`` best matches with the columns of ``chunks`` and ``score``; a malformed query has none."""
    if top_k < 1:
        raise QueryError("top_k is at least 1")
    shown = chunks.drop("embedding")
    found = matches(ix, query, syntax)
    if found is None:
        return shown.filter(F.lit(False)).withColumn("score", F.lit(0.0))
    passes = filters.predicate() if isinstance(filters, SearchFilters) else filters
    order = (F.desc("score"), F.col(ix.key))
    if passes is not None and filter_mode == "pre":
        found = found.join(chunks.filter(passes).select(ix.key), ix.key, "left_semi")
    fetch = top_k * OVERFETCH if passes is not None and filter_mode == "post" else top_k
    hits = shown.join(F.broadcast(found.orderBy(*order).limit(fetch)), ix.key)  # bounded by fetch
    if passes is not None and filter_mode == "post":
        hits = hits.filter(passes)
    return hits.orderBy(*order).limit(top_k)
