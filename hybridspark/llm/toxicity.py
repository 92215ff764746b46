"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding disguised letters.

Signs without width and loose accents are dropped from a text, then it is folded one character to one: lower case, letters without
their accents, homoglyphs of other scripts, mathematical and full-width forms to Latin letters, digits and signs that stand for
letters to these; i, l, 1, ! and | fall together.  Terms match whole words (judged on the unfolded text, so that a sign behind a
word doesn't hide it); terms that were learnt must have their accents too.  Letters that stand alone with separators between them ("i.d.i.o.t") are read as one word, in which a term of
SPELT letters or more may stand anywhere.  Hits inside an exception phrase don't count.  ``rate`` is the weight of all hits for
every thousand words; a document is toxic if its hits weigh at least MIN_WEIGHT and its rate is at least MIN_RATE.

The lexicon has a fixed part and a part learnt from labelled documents: words whose distinct left neighbours
in toxic documents outnumber, at equal numbers of words, those in others by RATIO.  Their weight grows with the logarithm of
how often they do so, from 1 to HEAVIEST.  Neighbours, not documents, are counted so that copies of a toxic document don't turn
its every word into a term.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, arrow

MIN_WEIGHT, MIN_RATE = 2.0, 2.0
#: Labelled documents that the learnt part is fitted on, at most; least left neighbours and over-representation of a term; greatest weight.
SAMPLE, SUPPORT, RATIO, HEAVIEST = 10_000, 5, 12.0, 1.5
#: Letters of a spelt term; characters of a text that are folded at once.
SPELT, BLOCK = 4, 1 << 18
LEXICON = {
    **dict.fromkeys("idiot idiots moron morons scum imbecile cretin retard bastard bitch asshole fuck fucking whore slut cunt faggot nigger kike".split(), 2.0),
    **dict.fromkeys("trash clown worthless pathetic loser losers disgusting stupid dumb vermin filth crap shit".split(), 1.0),
    **dict.fromkeys("arschloch hurensohn wichser missgeburt abschaum trottel schlampe connard salope enculé pute abruti idiota imbécil gilipollas cabrón puta pendejo escoria".split(), 2.0),
    "piece of shit": 3.0, "kill yourself": 3.0, "son of a bitch": 3.0, "waste of space": 2.0,
}
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash collection", "clown fish", "clown nose", "circus clown", "sore loser", "pathetic fallacy", "idiot proof", "idiot-proof", "scum of the pond", "pond scum", "soap scum", "shit happens", "stupid question")
SCHEMA = "doc_id bigint, words bigint, hits bigint, weight double, rate double, toxic boolean"

_FOLD: dict[int, str] = {}
_ACCENTS: set[int] = set()
for _o in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0x2100, 0x2150), *range(0x24B6, 0x24EA), *range(0x1D400, 0x1D800), *range(0x1F130, 0x1F150)):
    _c = unicodedata.normalize("NFKD", chr(_o))
    if len(_c) and _c[0].isascii() and _c[0].isalnum() and all(unicodedata.combining(x) for x in _c[1:]):  # an accented or styled letter
        _FOLD[_o] = _c[0].lower()
        if _o < 0x2100:
            _ACCENTS.add(_o)
for _a, _b in {"0": "o", "1": "i", "!": "i", "|": "i", "l": "i", "3": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t", "8": "b", "9": "g"}.items():
    _FOLD[ord(_a)] = _b
for _latin, _others in {
    "a": "аαɑ", "b": "ƅЬь", "c": "сϲⅽ", "d": "ԁⅾ", "e": "еεҽ", "g": "ɡց", "h": "һհ", "i": "іιıӏⅰⅼɩ", "j": "јϳ", "k": "кκ", "m": "мⅿ", "n": "ոп", "o": "оοօσ",
    "p": "рρ", "q": "ԛ", "r": "гᴦ", "s": "ѕꜱ", "t": "тτ", "u": "υսʋ", "v": "νѵⅴ", "w": "ѡԝω", "x": "хχⅹ", "y": "уγүʏ", "z": "ᴢ",
}.items():
    for _c in _others:
        _FOLD[ord(_c)] = _latin
for _o in range(0xFF01, 0xFF5F):  # full-width forms
    _c = unicodedata.normalize("NFKC", chr(_o)).lower()
    _FOLD[_o] = _FOLD.get(ord(_c), _c)
for _o, _c in list(_FOLD.items()):  # styled digits and l too
    _FOLD[_o] = _FOLD.get(ord(_c), _c)
_TABLE = np.arange(max(_FOLD) + 1, dtype=np.uint32)
for _o, _c in _FOLD.items():
    _TABLE[_o] = ord(_c)
_KEPT = {_o: _c for _o, _c in _FOLD.items() if _o not in _ACCENTS}
_HIDDEN = re.compile("[\u00ad\u034f\u0300-\u036f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufe00-\ufe0f\ufeff\U000e0000-\U000e01ef]+")
_SPELT = re.compile(r"(?<!\w)\w(?:[ .\-_*·]\w){%d,}(?!\w)" % (SPELT - 1))


def fold(text: str) -> str:
    """The folded text, as long as ``text``."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    if low.isascii():
        return low.translate(_FOLD)
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < len(_TABLE), _TABLE[np.minimum(codes, len(_TABLE) - 1)], codes).astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")


def accented(text: str) -> str:
    """As ``fold``, but accents stay."""
    return text.lower().translate(_KEPT)


def automaton(lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS) -> ahocorasick.Automaton:
    """Folded term -> (length, weight under any accents or None, weights by accented form)."""
    found: dict[str, tuple[float | None, dict[str, float]]] = {}
    for term, weight in lexicon.items():
        bare = _HIDDEN.sub("", term).strip()
        if key := fold(bare):
            loose, exact = found.setdefault(key, (None, {}))
            if term in LEXICON:
                found[key] = (weight if loose is None else max(weight, loose), exact)
            else:
                exact[accented(bare)] = max(weight, exact.get(accented(bare), 0.0))
    for x in exceptions:
        found[fold(x.strip())] = (0.0, {})
    made = ahocorasick.Automaton()
    for key, (loose, exact) in found.items():
        made.add_word(key, (len(key), loose, exact))
    if found:
        made.make_automaton()
    return made


def _weight(written: str, loose: float | None, exact: dict[str, float]) -> float | None:
    own = exact.get(accented(written)) if exact else None
    return own if loose is None else loose if own is None else max(own, loose)


def _spans(text: str, made: ahocorasick.Automaton, longest: int) -> list[tuple[int, int, float]]:
    """(start, -length, weight) of each term, exception and spelt word that stands in the text; folded in blocks that overlap by the longest term."""
    n, spans = len(text), []
    for base in range(0, n, BLOCK):
        piece = text[base : base + BLOCK + longest + 1]
        for end, (size, loose, exact) in made.iter(fold(piece)):
            start, stop = base + end + 1 - size, base + end + 1
            if start < base + BLOCK and stop <= n and (start == 0 or not text[start - 1].isalnum()) and (stop == n or not text[stop].isalnum()):
                if (weight := _weight(text[start:stop], loose, exact)) is not None:
                    spans.append((start, -size, weight))
    for m in _SPELT.finditer(text):
        letters = m[0][::2]
        for end, (size, loose, exact) in made.iter(fold(letters)):
            weight = _weight(letters[end + 1 - size : end + 1], loose, exact)
            if size >= SPELT and weight:
                spans.append((m.start() + 2 * (end + 1 - size), 1 - 2 * size, weight))
    spans.sort()
    return spans


def _words(text: str) -> int:
    """Runs of characters other than white space."""
    if len(text) <= BLOCK:
        return len(text.split())
    total = 0
    for base in range(0, len(text), BLOCK):
        total += len(text[base : base + BLOCK].split())
        total -= base > 0 and not text[base - 1].isspace() and not text[base].isspace()  # one that the block's edge cuts
    return total


def score(text: str | None, made: ahocorasick.Automaton, longest: int = 64) -> tuple[int, int, float, float, bool]:
    """(words, hits, weight, rate, toxic) of a text; all nothing for a null or blank one.  ``longest``: at least the length of the longest term."""
    words = _words(text) if text else 0
    if not words or not len(made):
        return words, 0, 0.0, 0.0, False
    if not text.isascii() and _HIDDEN.search(text):
        text = _HIDDEN.sub("", text)
    hits, total, to = 0, 0.0, 0
    # the longest of those that begin together; what begins inside an earlier one is dropped
    for start, size, weight in _spans(text, made, longest):
        if start >= to:
            to = start - size
            hits += weight > 0
            total += weight
    rate = 1000 * total / words
    return words, hits, total, rate, total >= MIN_WEIGHT and rate >= MIN_RATE


def learnt(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Terms and their weights from at most ``sample`` labelled documents (those with the least hash of their id).

    Labels with a null id or class are left out; of labels that repeat an id toxic wins; documents that repeat an id all count, but equal
    neighbours once; a null text has no words.  Without toxic or without other documents, and for empty ``docs``, nothing is learnt."""
    chosen = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    w = F.split(F.lower(F.col("text").cast("string")), r"[^\p{L}\p{N}]+")
    pairs = docs.select(F.col("doc_id"), F.col("text")).join(F.broadcast(chosen), "doc_id").select("toxic", F.filter(w, lambda x: x != "").alias("w"))
    pairs = pairs.select("toxic", F.explode(F.arrays_zip(F.col("w").alias("t"), F.concat(F.array(F.lit("")), F.col("w")).alias("p"))).alias("x")).select("toxic", F.col("x.t").alias("term"), F.xxhash64("x.p").alias("prev")).filter("term is not null")
    seen = pairs.distinct().groupBy("term").agg(F.sum((F.col("toxic") == 1).cast("long")).alias("n1"), F.sum((F.col("toxic") != 1).cast("long")).alias("n0"))
    seen = Shared(seen)
    total = seen.df.agg(F.sum("n1").alias("all1"), F.sum("n0").alias("all0"))
    ratio = (F.col("n1") / F.col("all1")) / ((F.col("n0") + 1) / (F.col("all0") + 1))
    best = seen.df.filter(F.col("n1") >= SUPPORT).crossJoin(F.broadcast(total)).filter("all1 > 0 and all0 > 0").withColumn("ratio", ratio).filter(F.col("ratio") >= RATIO)
    out = {r["term"]: min(HEAVIEST, math.log(r["ratio"]) / math.log(RATIO)) for r in best.select("term", "ratio").collect()}  # bounded by the words of the sample
    seen.drop()
    return out


def lexicon(docs: DataFrame, labels: DataFrame | None) -> dict[str, float]:
    """The fixed lexicon, with what is learnt from ``labels`` where there are any; see ``learnt`` for odd rows."""
    return (learnt(docs, labels) if labels is not None else {}) | LEXICON


def _longest(terms: dict[str, float]) -> int:
    return max(len(x) for x in (*terms, *EXCEPTIONS, ""))


def scored(docs: DataFrame, terms: dict[str, float]) -> DataFrame:
    """The score of every row of ``docs``, in its order.  A null or blank text scores nothing and is not toxic; a null
    doc_id stays null; repeated rows are scored alike.  A text of any length is folded in blocks.  An empty table gives an empty
    result; other columns are not looked at, so their names can't clash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, longest = automaton(terms), _longest(terms)
        for batch in batches:
            found = [score(x.as_py(), made, longest) for x in batch.column(1)]
            cols = list(zip(*found, strict=True)) if found else [[]] * 5
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "words", "hits", "weight", "rate", "toxic"])

    return arrow(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), run, SCHEMA)


def clean(docs: DataFrame, terms: dict[str, float]) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with all their columns; null and blank texts are not toxic, repeated rows stay or go together, an empty table stays empty."""
    at = docs.columns.index("text")
    named = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # any name may stand in ``docs``, dots too

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, longest = automaton(terms), _longest(terms)
        for batch in batches:
            yield batch.filter(pa.array([not score(x.as_py(), made, longest)[4] for x in batch.column(at)], pa.bool_()))

    return arrow(named, run, named.schema).toDF(*docs.columns)
