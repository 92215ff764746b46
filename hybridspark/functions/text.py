"""Text expressions: whitespace, word counts, hashes, file types, search tokens and stems."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACE = "[\\s\\x1c-\\x1f]"
SUFFIXES = {
    "python": ".py .pyi",
    "javascript": ".js .jsx .mjs .cjs",
    "typescript": ".ts .tsx",
    "rust": ".rs",
    "go": ".go",
    "c": ".c .h",
    "cpp": ".cpp .cc .cxx .hpp .hxx",
    "java": ".java",
    "ruby": ".rb",
    "shell": ".sh .bash .zsh",
    "markdown": ".md .markdown",
    "rst": ".rst",
    "docling": ".pdf .docx .pptx .xlsx .html .htm .png .jpg .jpeg .tiff .tif .bmp .webp .tex .latex",
}
TYPE_OF = {suffix: kind for kind, names in SUFFIXES.items() for suffix in names.split()}


def stripped(c: Column) -> Column:
    """Without white space at either end, of every kind that Unicode knows."""
    return F.regexp_replace(c, f"(?U)(?:\\A{_SPACE}+|{_SPACE}+\\z)", "")


def not_blank(c: Column) -> Column:
    return F.coalesce(stripped(c) != "", F.lit(False))


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"(?U){_SPACE}+"), lambda x: x != "")


def token_count(c: Column) -> Column:
    return F.size(words(c))


def content_hash(c: Column) -> Column:
    return F.sha2(c.cast("string"), 256)


def newlines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def unix_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-cased, with its dot; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(base_name(path), "(?s)^.+(\\.[^.]+)$", 1))


def content_type(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in TYPE_OF.items() for x in pair))
    return F.coalesce(F.try_element_at(table, suffix(path)), F.lit("generic"))


def is_rich(path: Column) -> Column:
    return suffix(path).isin(SUFFIXES["docling"].split())


def search_tokens(c: Column) -> Column:
    """Runs of letters and digits, in lower case; marks stay until ``stems`` folds them."""
    return F.filter(F.split(F.lower(c), "[^\\p{L}\\p{N}\\p{M}\\p{Co}]+"), lambda x: x != "")


def deterministic_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\0", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


# -- the stemmer of M. F. Porter, "An algorithm for suffix stripping" (1980)

_VOWELS = set("aeiou")
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou"]
for _table in (_STEP2, _STEP3):
    _table.sort(key=lambda x: -len(x[0]))
_ENDS2, _ENDS3, _ENDS4 = tuple(x for x, _ in _STEP2), tuple(x for x, _ in _STEP3), (*_STEP4, "ion")


#: Letters as v or c, but for y, which is a vowel behind a consonant.
_KINDS = bytes(ord("v") if chr(c) in _VOWELS else ord("c") for c in range(256))


def _kinds(w: str) -> str:
    """A v for each vowel of ``w``, a c for each other letter."""
    made = w.encode("latin-1", "replace").translate(_KINDS).decode("latin-1")
    at = w.find("y", 1)
    while at > 0:
        if made[at - 1] == "c":
            made = made[:at] + "v" + made[at + 1 :]
        at = w.find("y", at + 1)
    return made


def _consonant(w: str, i: int) -> bool:
    return _kinds(w)[i] == "c"


def _measure(w: str) -> int:
    return _kinds(w).count("vc")


def _has_vowel(w: str) -> bool:
    return "v" in _kinds(w)


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    return w[-1:] not in "wxy" and _kinds(w)[-3:] == "cvc"


def _replaced(w: str, table: list[tuple[str, str]]) -> str:
    for end, to in table:
        if w.endswith(end):
            return w[: -len(end)] + to if _measure(w[: -len(end)]) > 0 else w
    return w


@functools.lru_cache(maxsize=1 << 16)
def porter(w: str) -> str:
    """The stem of a lower-case word; words under 3 or over 64 bytes and such with other than ASCII letters and digits in their rules stay."""
    if not 3 <= len(w.encode()) <= 64:
        return w
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = w[:-2] if w.endswith("ed") and _has_vowel(w[:-2]) else w[:-3] if w.endswith("ing") and _has_vowel(w[:-3]) else None
        if cut is not None:
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _replaced(w, _STEP2) if w.endswith(_ENDS2) else w
    w = _replaced(w, _STEP3) if w.endswith(_ENDS3) else w
    for end in _ENDS4 if w.endswith(_ENDS4) else ():
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        base = w[:-1]
        if _measure(base) > 1 or _measure(base) == 1 and not _cvc(base):
            w = base
    return w[:-1] if _measure(w) > 1 and _double(w) and w.endswith("l") else w


@functools.lru_cache(maxsize=1 << 14)
def folded(term: str) -> str:
    """Without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFD", term) if unicodedata.category(c) != "Mn") if not term.isascii() else term


def stem(term: str) -> str:
    return porter(term if term.isascii() else folded(term))


@F.pandas_udf(T.StringType())
def stems(terms: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``stem`` of a column of terms; give it distinct terms of a document, not texts."""
    for batch in terms:
        yield batch.map(stem, na_action="ignore")
