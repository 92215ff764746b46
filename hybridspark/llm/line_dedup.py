"""Fuzzy line deduplication: an exact join by word edit similarity, connected groups.

A line is normalised to its lower-cased words; of scripts written without spaces each character is a word.  Lines without a
word are left alone.  Short lines are near only if equal: up to six words, an edit is more than SIMILARITY allows.  Two lines are near if the
edit similarity of their word sequences, 1 - distance / longer length, is at least SIMILARITY.  Lines that chains of near lines
connect form a group, of which the first occurrence (by doc_id, then line number) stays.

Search.  k edits break at most 2k of a line's pairs of adjacent words, fewer if the other line is longer (``most_broken``), so two
near lines share one of the first pairs of each, one more than may be broken, in any one order of all pairs.  The order puts pairs
last that are frequent in the corpus (all are counted, in SLOTS slots), and of the others pairs of long words first, as these are
rare in any language; it only keeps the lists of lines with a common pair short, which a passage that many lines share would make
long: they grow with the corpus, up to about the mean of a slot.  Lines of a list are linked if the places of
the pair, their lengths and the numbers of their words in BUCKETS buckets allow a distance within k; lines that links connect are a
cell.  (The first pair of all that no edit breaks is among the first ones of both lines and is at such places.)  No near pair is lost by
any of these steps.  One pass over the texts sends both a hash of each line and its pairs, in packed blocks, to the tasks in which
equal ones meet.  Only lines of cells are read again and compared word by word: first each with the first line of its cells, to
which it is sent as it is read, then the lines of a cell that are not in one component yet with each other.  So a cell of n near
lines costs n comparisons, and the components of all near pairs are the groups.

SimHash and pigeonhole blocks, which this operator was meant to use, can't give these results: at a similarity of 0.85 the
fingerprints of two lines differ in about a sixth of their bits, for which blocks of 64 bits have hardly any selectivity, and
within 6 bits, where they have, more than half of the near pairs are lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import Shared, arrow, components, labels, sized

MIN_WORDS, SIMILARITY = 1, 0.85
BUCKETS, BAG, SLOTS = 16, 128, 1 << 22
#: Bytes of lines and entries that a task gathers before it packs and sends them.
HELD = 8 << 20
ENTRY = np.dtype([("pair", np.uint64), ("h", np.uint64), ("sketch", np.uint64), ("words", np.uint16), ("place", np.uint16)])
#: A line's occurrence; ``null`` marks a null doc_id, which counts as the least.
LINE = np.dtype([("h", np.uint64), ("doc", np.int64), ("rev", np.int64), ("line", np.int32), ("live", np.uint8)])
#: A count of words from which on lengths and buckets aren't held against each other.
MANY = 65_535
#: The place of a pair that a line holds more than once, or of one in a line of MANY words.
ANY = 65_535
MET = "h bigint, doc_id bigint, rev bigint, line int, f_doc bigint, f_rev bigint, f_line int, n bigint, cell bigint, lead bigint, words int, sketch bigint"


def split_lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line offsets, row of each line): rows cut at newlines; a row of k newlines has k + 1 lines."""
    nl = np.flatnonzero(data == 10) + 1
    cuts = np.sort(np.concatenate([nl, off[:-1]]), kind="stable")
    # a newline that ends a row opens an empty last line of that row, not of the next
    row = np.searchsorted(off[:-1], cuts, "right") - 1
    at_start = np.flatnonzero(np.isin(nl, off))
    if len(at_start):
        row = np.concatenate([np.searchsorted(off, nl - 1, "right") - 1, np.arange(len(off) - 1)])
        start = np.concatenate([nl, off[:-1]])
        order = np.lexsort((start, row))
        row, cuts = row[order], start[order]
    return np.append(cuts, off[-1]), row


#: First and last two leading bytes of characters of scripts without spaces: Thai and Lao, Burmese, Khmer, kana and Chinese characters.
UNSPACED = (0xE0B8, 0xE0BB), (0xE180, 0xE182), (0xE19E, 0xE19F), (0xE381, 0xE9BF), (0xEFA4, 0xEFAB), (0xF0A0, 0xF0B2)


def line_words(data: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, line, bytes) of each lower-cased word, and of each character of a script without spaces."""
    start, end, row = K.words(data, lines)
    lead = np.flatnonzero(data[:-1] >= 0xE0)
    if len(lead):
        code = data[lead].astype(np.int32) << 8 | data[lead + 1]
        at = lead[np.any([(code >= lo) & (code <= hi) for lo, hi in UNSPACED], axis=0)]
        cut = np.unique(np.concatenate([at, at + 3 + (data[at] >= 0xF0)]))
        word = np.searchsorted(start, cut, "right") - 1
        cut = cut[(word >= 0) & (cut > start[word]) & (cut < end[word])]
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
        row = np.searchsorted(lines, start, "right") - 1
    return K.span_hashes(K.lower(data), start, end), row, end - start


def line_hashes(h: np.ndarray, woff: np.ndarray) -> np.ndarray:
    """A hash of the word sequence of each line."""
    size = np.diff(woff)
    place = (np.arange(len(h)) - np.repeat(woff[:-1], size)).astype(np.uint64)
    acc = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(K.mix(h + place * K.U64(0x9E3779B97F4A7C15)), out=acc[1:])
    return K.mix(acc[woff[1:]] - acc[woff[:-1]] + size.astype(np.uint64))


def most_edits(words: np.ndarray) -> np.ndarray:
    """The most edits between lines of so many words and any line that is near them."""
    return (np.floor(words / SIMILARITY + 1e-9) * (1 - SIMILARITY) + 1e-9).astype(np.int64)


def most_broken(words: np.ndarray) -> np.ndarray:
    """The most pairs of adjacent words of a line of so many words that edits break, which lead to any line near it.

    An edit breaks two at most, an insertion one.  A line that is j words longer takes j insertions, so of k edits 2k - j are
    broken; as k grows by at most one in six words, more than a few j never give the most."""
    upto = np.floor(words / SIMILARITY + 1e-9).astype(np.int64)
    most = np.zeros(len(words), np.int64)
    for j in range(8):
        broken = 2 * ((words + j) * (1 - SIMILARITY) + 1e-9).astype(np.int64) - j
        most = np.where(words + j <= upto, np.maximum(most, broken), most)
    return most


def word_pairs(h: np.ndarray, at: np.ndarray, size: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, line, place of the first word) of the adjacent words of each line.  A pair's number orders all pairs: by how frequent its slot is, the longer its words the less, then by hash."""
    inside = np.flatnonzero(at[1:] == at[:-1])
    mixed = K.mix(h[inside] * K.U64(0x9FB21C651E98DF25) + K.mix(h[inside + 1]))
    length = np.minimum(size[inside], 31) + np.minimum(size[inside + 1], 31)
    return often[(mixed % K.U64(SLOTS)).astype(np.int64)].astype(np.uint64) << K.U64(42) | (63 - length).astype(np.uint64) << K.U64(36) | mixed >> K.U64(28), at[inside], inside - np.searchsorted(at, at)[inside]


def frequency(docs: DataFrame) -> np.ndarray:
    """For each of SLOTS slots of pairs 0 if it holds at most 1.4 times as many as the mean, else one more for each factor of 1.4, 15 at most; over all texts.

    A task gives its counts as packed blocks, their bytes by significance, most of which are 0 or few; a task for each of ``chunks`` ranges of slots adds
    them and holds them against its own mean.  So what is shuffled is bounded by the tasks, and the driver gets a byte for each slot."""
    chunks = 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            data, off = K.buffers(batch.column(0))
            for lo, hi in K.slices(off):
                whole = data[off[lo] : off[hi]]
                lines, _ = split_lines(whole, off[lo : hi + 1] - off[lo])
                for a, b in K.slices(lines):
                    h, at, _ = line_words(whole[lines[a] : lines[b]], lines[a : b + 1] - lines[a])
                    inside = np.flatnonzero(at[1:] == at[:-1])
                    mixed = K.mix(h[inside] * K.U64(0x9FB21C651E98DF25) + K.mix(h[inside + 1]))
                    np.add.at(total, (mixed % K.U64(SLOTS)).astype(np.int64), 1)
        packed = [pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T), codec="zstd", asbytes=True) for x in total.reshape(chunks, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(chunks), pa.int32()), pa.array(packed, pa.binary())], names=["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                bytes_ = np.frombuffer(pa.decompress(x.as_buffer(), SLOTS // chunks * 8, codec="zstd"), np.uint8).reshape(8, -1)
                made[c] = made.get(c, 0) + np.ascontiguousarray(bytes_.T).view(np.int64)[:, 0]
        level = [np.clip(2 * np.log2(np.maximum(x / max(x.mean(), 1.0), 1.0) / 1.4) + 1, 0, 15).astype(np.uint8) for x in made.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int32()), pa.array([x.tobytes() for x in level], pa.binary())], names=["chunk", "level"])

    text = docs.filter("text is not null").select(F.col("text").cast("string"))
    found = arrow(arrow(text, run, "chunk int, counts binary").repartition(chunks, "chunk"), add, "chunk int, level binary").toArrow()  # 4 MB
    often = np.zeros((chunks, SLOTS // chunks), np.uint8)
    for c, x in zip(found["chunk"].to_pylist(), found["level"].to_pylist(), strict=True):
        often[c] = np.frombuffer(x, np.uint8)
    return often.ravel()


def pack(e: np.ndarray) -> bytes:
    """Entries, sorted by pair, as their number and compressed columns: differences of pairs by bytes of like significance, lines, sketches, lengths, places."""
    step = np.diff(e["pair"], prepend=K.U64(0))
    by_byte = [np.ascontiguousarray(x).view(np.uint8).reshape(len(e), x.itemsize).T for x in (step, e["words"], e["place"])]
    made = [by_byte[0][:6].tobytes(), e["h"].tobytes(), e["sketch"].tobytes(), by_byte[1].tobytes(), by_byte[2].tobytes()]
    return np.uint32(len(e)).tobytes() + pa.compress(b"".join(made), codec="zstd", asbytes=True)


def unpack(block: pa.Buffer) -> np.ndarray:
    n = int(np.frombuffer(block, np.uint32, 1)[0])
    if not n:
        return np.zeros(0, ENTRY)
    flat = np.frombuffer(pa.decompress(block.slice(4), (ENTRY.itemsize - 2) * n, codec="zstd"), np.uint8)
    step, e = np.zeros((n, 8), np.uint8), np.empty(n, ENTRY)
    step[:, :6] = flat[: 6 * n].reshape(6, n).T
    e["pair"] = np.cumsum(step.view(np.uint64)[:, 0])
    e["h"], e["sketch"] = flat[6 * n : 14 * n].view(np.uint64), flat[14 * n : 22 * n].view(np.uint64)
    e["words"], e["place"] = (np.ascontiguousarray(flat[at * n : (at + 2) * n].reshape(2, n).T).view(np.uint16)[:, 0] for at in (22, 24))
    return e


def first_pairs(pair: np.ndarray, line: np.ndarray, place: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, line, place) of the ``most[line]`` first distinct pairs of each line, lines in order; ANY for the place of a pair that repeats."""
    out_pair, out_line, out_place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    lo = 0
    while lo < len(line):  # a line takes 18 bits of a sort key, a pair 46
        base = line[lo]
        hi = int(np.searchsorted(line, base + (1 << 18)))
        key = (line[lo:hi] - base).astype(np.uint64) << K.U64(46) | pair[lo:hi]
        order = np.argsort(key)
        key = key[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(fresh)
        once = np.diff(np.append(first, len(key))) == 1
        key = key[first]
        own = (key >> K.U64(46)).astype(np.int64) + base
        take = np.arange(len(own)) - np.searchsorted(own, own) < most[own]
        out_pair.append(key[take] & K.U64((1 << 46) - 1))
        out_line.append(own[take])
        out_place.append(np.where(once, np.minimum(place[lo:hi][order[first]], ANY), ANY)[take])
        lo = hi
    return np.concatenate(out_pair), np.concatenate(out_line), np.concatenate(out_place)


def sketches(h: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
    """How many words of each of ``n`` lines fall into each of BUCKETS buckets, modulo 16, as one number."""
    many = np.bincount(line * BUCKETS + (h >> K.U64(7)).astype(np.int64) % BUCKETS, minlength=n * BUCKETS).reshape(n, BUCKETS)
    half = (many[:, ::2] & 15 | (many[:, 1::2] & 15) << 4).astype(np.uint8)
    return np.ascontiguousarray(half).view(np.uint64)[:, 0]


_DIFFER = np.zeros(65536, np.uint8)  # of two bytes of sketches: by how much their buckets differ at least
for _a in range(256):
    _x = np.arange(256)
    _low, _high = (_a - _x) & 15, ((_a >> 4) - (_x >> 4)) & 15
    _DIFFER[_a << 8 | _x] = np.minimum(_low, 16 - _low) + np.minimum(_high, 16 - _high)


def may_be_near(n: np.ndarray, x: np.ndarray, m: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether lines of n and m words with the sketches x and y can be near: an edit changes at most two buckets by one."""
    k = (np.maximum(n, m) * (1 - SIMILARITY) + 1e-9).astype(np.int64)
    long = (n >= MANY) | (m >= MANY)
    ok = (np.abs(n - m) <= k) | long
    at = np.flatnonzero(ok)
    a, b = (v[at].view(np.uint8).astype(np.uint16) for v in (x, y))
    apart = _DIFFER[a << 8 | b].reshape(-1, 8).sum(1, dtype=np.int64)
    ok[at] = (apart <= 2 * k[at]) | long[at]
    return ok


def may_be_aligned(n: np.ndarray, p: np.ndarray, m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether a pair at the places p and q of lines of n and m words can be the same one before and after the edits between near lines:
    words before it and behind it take at least as many edits as their numbers differ."""
    k = (np.maximum(n, m) * (1 - SIMILARITY) + 1e-9).astype(np.int64)
    return (np.abs(p - q) + np.abs((n - p) - (m - q)) <= k) | (p == ANY) | (q == ANY) | (n >= MANY) | (m >= MANY)


def bags(h: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
    """How many words of each of ``n`` lines fall into each of BAG buckets, 255 at most: a wider sketch."""
    many = np.bincount(line * BAG + (h >> K.U64(3)).astype(np.int64) % BAG, minlength=n * BAG)
    return np.minimum(many, 255).astype(np.uint8).reshape(n, BAG)


def bags_allow(n: np.ndarray, x: np.ndarray, m: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether lines of n and m words with the bags x and y can be near: an edit changes at most two buckets by one."""
    out = np.empty(len(n), bool)
    for lo in range(0, len(n), 1 << 14):
        s = slice(lo, lo + (1 << 14))
        a, b = x[s], y[s]
        apart = (np.maximum(a, b) - np.minimum(a, b)).sum(1, dtype=np.int64)
        out[s] = apart <= 2 * (np.maximum(n[s], m[s]) * (1 - SIMILARITY) + 1e-9).astype(np.int64)
    return out


def met(docs: DataFrame) -> DataFrame:
    """Rows of MET: every occurrence of a line that has words, with the first one of the same h and how many there are; and the lines h of
    each cell, with the least of them that it may be near (else itself), its number of words and sketch.  Any two near lines are in one cell."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    often = frequency(docs)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = [], []
        size = 0

        def cut(rows: list[np.ndarray], kind: np.dtype, by: str) -> list[np.ndarray]:
            all_ = np.concatenate(rows) if rows else np.zeros(0, kind)
            part = (K.mix(all_[by]) % K.U64(parts)).astype(np.int32)
            order = np.lexsort((all_[by], part)) if kind is ENTRY else np.argsort(part, kind="stable")
            sent, edge = all_[order], np.searchsorted(part[order], np.arange(parts + 1))
            return [sent[edge[p] : edge[p + 1]] for p in range(parts)]

        def out() -> pa.RecordBatch:
            lines, entries = cut(held[0], LINE, "h"), cut(held[1], ENTRY, "pair")
            live = [p for p in range(parts) if len(lines[p]) or len(entries[p])]
            packed = [pa.array([x.tobytes() for x in (lines[p] for p in live)], pa.binary()), pa.array([pack(entries[p]) for p in live], pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), *packed], names=["part", "lines", "entries"])

        for batch in batches:
            data, off = K.buffers(batch.column(2))
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            doc, rev = batch.column(0).fill_null(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi in K.slices(off):
                whole = data[off[lo] : off[hi]]
                all_lines, all_rows = split_lines(whole, off[lo : hi + 1] - off[lo])
                number = np.arange(len(all_rows)) - np.searchsorted(all_rows, all_rows)
                for a, b in K.slices(all_lines):
                    part, lines, row = whole[all_lines[a] : all_lines[b]], all_lines[a : b + 1] - all_lines[a], all_rows[a:b] + lo
                    h, at, length = line_words(part, lines)
                    woff = K.bounds(at, len(row))
                    count = np.diff(woff)
                    name = line_hashes(h, woff)
                    keep = np.flatnonzero(count >= MIN_WORDS)
                    seen = np.empty(len(keep), LINE)
                    seen["h"], seen["doc"], seen["rev"], seen["line"], seen["live"] = name[keep], doc[row[keep]], rev[row[keep]], number[a:b][keep], known[row[keep]]
                    k = most_edits(count)
                    k[count < MIN_WORDS] = 0
                    once = np.zeros(len(row), bool)
                    once[np.unique(name, return_index=True)[1]] = True  # equal lines of a slice: once
                    live = ((k > 0) & once)[at]
                    pair, line, place = first_pairs(*word_pairs(h[live], at[live], length[live], often), most_broken(count) + 1)
                    entry = np.empty(len(pair), ENTRY)
                    entry["pair"], entry["h"], entry["words"], entry["sketch"] = pair, name[line], np.minimum(count[line], MANY), sketches(h, at, len(row))[line]
                    entry["place"] = place
                    held[0].append(seen)
                    held[1].append(entry)
                    size += seen.nbytes + entry.nbytes
                    if size >= HELD:
                        yield out()
                        held, size = ([], []), 0
        if size:
            yield out()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for p, *blocks in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                lines, entries = by.setdefault(p, ([], []))
                lines.append(np.frombuffer(blocks[0].as_buffer(), LINE))
                entries.append(unpack(blocks[1].as_buffer()))
        for p in sorted(by):
            lines, entries = by.pop(p)
            yield from _first_occurrences(np.concatenate(lines))
            del lines
            yield from _edges(np.concatenate(entries))
            del entries

    text = F.col("text").cast("string")
    rows = docs.filter("text is not null").select(F.col("doc_id").cast("bigint"), F.xxhash64(text).alias("rev"), text.alias("text"))
    return arrow(arrow(rows, spread, "part int, lines binary, entries binary").repartition(parts, "part"), meet, MET)


def _met(rows: int, **given: pa.Array) -> pa.RecordBatch:
    kinds = {"line": pa.int32(), "f_line": pa.int32(), "words": pa.int32()}
    names = [x.split()[0] for x in MET.split(", ")]
    return pa.RecordBatch.from_arrays([given[c].cast(kinds.get(c, pa.int64())) if c in given else pa.nulls(rows, kinds.get(c, pa.int64())) for c in names], names=names)


def _first_occurrences(e: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(e):
        return
    h, doc, rev, line, live = (e[c].copy() for c in ("h", "doc", "rev", "line", "live"))
    order = np.lexsort((line, rev, doc, live, h))
    h, doc, rev, line, live = (x[order] for x in (h, doc, rev, line, live))
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    size = np.diff(np.append(start, len(h)))
    first = np.repeat(start, size)
    for lo in range(0, len(h), 1 << 16):
        s = slice(lo, lo + (1 << 16))
        f = first[s]
        yield _met(
            len(f), h=pa.array(h[s].view(np.int64)), doc_id=pa.array(doc[s], mask=live[s] == 0), rev=pa.array(rev[s]), line=pa.array(line[s]),
            f_doc=pa.array(doc[f], mask=live[f] == 0), f_rev=pa.array(rev[f]), f_line=pa.array(line[f]), n=pa.array(np.repeat(size, size)[s]),
        )


def _edges(e: np.ndarray) -> Iterator[pa.RecordBatch]:
    pair = e["pair"].copy()
    order = np.argsort(pair)
    pair = pair[order]
    more = np.zeros(len(pair), bool)  # only pairs that several entries hold
    same = pair[1:] == pair[:-1]
    more[1:] |= same
    more[:-1] |= same
    e, pair = e[order[more]], pair[more]
    if not len(e):
        return
    h = e["h"].copy()
    order = np.lexsort((h, pair))
    same = (pair[order][1:] == pair[order][:-1]) & (h[order][1:] == h[order][:-1])
    order = order[np.concatenate([[True], ~same])]
    e, pair, h = e[order], pair[order], h[order]
    start = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    size = np.diff(np.append(start, len(pair)))
    words, sketch = e["words"].astype(np.int64), e["sketch"].copy()
    root = labels(*linked(start, size, words, sketch, e["place"].astype(np.int64)), len(pair))
    inside = np.flatnonzero(np.bincount(root, minlength=len(root))[root] > 1)
    if len(inside):
        inside = inside[np.argsort(root[inside], kind="stable")]
        root, h = root[inside], h[inside]
        edge = np.flatnonzero(np.concatenate([[True], root[1:] != root[:-1]]))
        many = np.diff(np.append(edge, len(root)))
        cell = np.repeat(K.mix(np.add.reduceat(K.mix(h), edge) + many.astype(np.uint64)), many).view(np.int64)  # the same for cells of the same lines
        h = h.view(np.int64)
        order = np.lexsort((h, cell))
        cell, h, inside = cell[order], h[order], inside[order]
        fresh = np.concatenate([[True], (cell[1:] != cell[:-1]) | (h[1:] != h[:-1])])
        cell, h, inside = cell[fresh], h[fresh], inside[fresh]
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        at = np.repeat(first, np.diff(np.append(first, len(cell))))
        words, sketch = words[inside], sketch[inside]
        lead = np.where(may_be_near(words, sketch, words[at], sketch[at]), h[at], h)
        yield _met(len(cell), h=pa.array(h), cell=pa.array(cell), lead=pa.array(lead), words=pa.array(words), sketch=pa.array(sketch.view(np.int64)))


def linked(start: np.ndarray, size: np.ndarray, words: np.ndarray, sketch: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs: all pairs of small runs that may be near, a walk through those of a large run."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for m in np.unique(size[(size > 1) & (size <= 512)]):
        i, j = np.triu_indices(m, 1)
        first = start[size == m]
        step = max(1, (1 << 17) // len(i))
        for lo in range(0, len(first), step):
            x, y = ((first[lo : lo + step, None] + z).ravel() for z in (i, j))
            hit = may_be_aligned(words[x], place[x], words[y], place[y])
            x, y = x[hit], y[hit]
            hit = may_be_near(words[x], sketch[x], words[y], sketch[y])
            a.append(x[hit])
            b.append(y[hit])
    for s, m in zip(start[size > 512], size[size > 512], strict=True):
        left = np.arange(s, s + m)
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                at = queue.pop()
                near = may_be_aligned(words[at], place[at], words[left], place[left])
                some = left[near]
                near[near] = may_be_near(np.full(len(some), words[at]), np.full(len(some), sketch[at]), words[some], sketch[some])
                if near.any():
                    hit, left = left[near], left[~near]
                    a.append(np.full(len(hit), at))
                    b.append(hit)
                    queue += hit.tolist()
    return np.concatenate(a), np.concatenate(b)


def distance_within(masks: dict[int, int], m: int, b: list[int], most: int) -> bool:
    """Whether the edit distance of word sequences is at most ``most``; Myers' bit vectors, pattern given as masks."""
    if abs(m - len(b)) > most:
        return False
    ones, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, left = ones, 0, m, len(b)
    for word in b:
        eq = masks.get(word, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & ones), pv & xh
        score += (1 if ph & top else 0) - (1 if mh & top else 0)
        left -= 1
        if score - left > most:
            return False
        ph, mh = (ph << 1 | 1) & ones, mh << 1 & ones
        pv, mv = mh | (~(xv | ph) & ones), ph & xv
    return score <= most


def similar(a: list[int], b: list[int], least: float = SIMILARITY, masks: dict[int, int] | None = None) -> bool:
    if masks is None:
        masks = word_masks(a)
    return distance_within(masks, len(a), b, int((1 - least) * max(len(a), len(b)) + 1e-9))


def word_masks(a: list[int]) -> dict[int, int]:
    masks: dict[int, int] = {}
    for i, word in enumerate(a):
        masks[word] = masks.get(word, 0) | 1 << i
    return masks


def _padded(flat: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, fill: int) -> np.ndarray:
    col = np.arange(width)[None, :]
    at = start[:, None] + col
    return np.where(col < size[:, None], flat[np.minimum(at, len(flat) - 1)], fill)


def close(flat: np.ndarray, off: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether lines x[i] and y[i] of the words ``flat`` (numbers of 32 bits, in int64) are near; many pairs at once.

    What both begin and end with is left out; the rest goes through Myers' bit vectors, a column of all pairs at a time."""
    out = np.zeros(len(x), bool)
    size = np.diff(off)
    longest = np.maximum(size[x], size[y])
    by_length = np.argsort(longest, kind="stable")
    lo = 0
    while lo < len(x):
        some = longest[by_length[lo : lo + 4096]]
        ids = by_length[lo : lo + max(1, int(np.searchsorted(some * np.arange(1, len(some) + 1), 1 << 18)))]  # pairs times the longest line
        lo += len(ids)
        p, q = x[ids], y[ids]
        sa, na, sb, nb = off[p], size[p].copy(), off[q], size[q].copy()
        k = ((1 - SIMILARITY) * np.maximum(na, nb) + 1e-9).astype(np.int64)
        width = int(max(na.max(), nb.max()))
        least = np.minimum(na, nb)
        same = _padded(flat, sa, na, width, -1) == _padded(flat, sb, nb, width, -2)
        head = np.where(same.all(1), width, same.argmin(1))
        head = np.minimum(head, least)
        sa, sb, na, nb = sa + head, sb + head, na - head, nb - head
        least = np.minimum(na, nb)
        width = int(max(least.max(), 1))
        col = np.arange(width)[None, :]
        ends = (flat[np.clip((sa + na)[:, None] - 1 - col, 0, len(flat) - 1)] == flat[np.clip((sb + nb)[:, None] - 1 - col, 0, len(flat) - 1)]) & (col < least[:, None])
        tail = np.where(ends.all(1), width, ends.argmin(1))
        na, nb = na - tail, nb - tail
        swap = na > nb  # the shorter rest is the pattern
        sa, sb = np.where(swap, sb, sa), np.where(swap, sa, sb)
        na, nb = np.where(swap, nb, na), np.where(swap, na, nb)
        found = np.zeros(len(ids), bool)
        found[na == 0] = (nb <= k)[na == 0]
        live = np.flatnonzero((na > 0) & (nb - na <= k))
        short = live[na[live] <= 64]
        if len(short):
            found[short] = _myers(flat, sa[short], na[short], sb[short], nb[short]) <= k[short]
        for i in live[na[live] > 64]:
            found[i] = distance_within(word_masks(flat[sa[i] : sa[i] + na[i]].tolist()), int(na[i]), flat[sb[i] : sb[i] + nb[i]].tolist(), int(k[i]))
        out[ids] = found
    return out


def _myers(flat: np.ndarray, sa: np.ndarray, na: np.ndarray, sb: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Edit distances of patterns of 1 to 64 words and texts."""
    pattern = _padded(flat, sa, na, 64, -1)
    one, top = K.U64(1), K.U64(1) << (na - 1).astype(np.uint64)
    pv, mv, score = np.full(len(na), 0xFFFFFFFFFFFFFFFF, np.uint64), np.zeros(len(na), np.uint64), na.copy()
    for j in range(int(nb.max())):
        eq = np.packbits(pattern == flat[np.minimum(sb + j, len(flat) - 1)][:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        on = j < nb
        score += np.where(on, ((ph & top) != 0).astype(np.int64) - ((mh & top) != 0), 0)
        ph, mh = ph << one | one, mh << one
        pv, mv = mh | ~(xv | ph), ph & xv
    return score


def sequences(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """(h, seq, bag, leads, leading): the words of ``lines`` (h, doc_id, rev, line, leads, leading), as numbers of 32 bits, and their bag."""
    text = F.col("text").cast("string")
    asked = Shared(lines.groupBy("doc_id", "rev").agg(F.sort_array(F.collect_list(F.struct("line", "h", "leads", "leading"))).alias("asked")))
    given = docs.filter("text is not null").select(F.col("doc_id").cast("bigint").alias("d"), F.xxhash64(text).alias("r"), text.alias("text"))
    found = given.join(sized(asked.df), F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("r") == F.col("rev"))).select("text", "asked")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.buffers(batch.column(0))
            asked = batch.column(1)
            bound = asked.offsets.to_numpy() - asked.offsets[0].as_py()
            line, h, leads, leading = (asked.flatten().field(i) for i in range(4))
            line = line.to_numpy()
            for lo, hi in K.slices(off):
                whole = data[off[lo] : off[hi]]
                cuts, row = split_lines(whole, off[lo : hi + 1] - off[lo])
                own = slice(bound[lo], bound[hi])
                at = np.searchsorted(row, np.repeat(np.arange(hi - lo), np.diff(bound[lo : hi + 1]))) + line[own]
                for a, b in K.slices(np.concatenate([[0], np.cumsum(cuts[at + 1] - cuts[at])])):
                    some = at[a:b]
                    length = cuts[some + 1] - cuts[some]
                    edge = np.concatenate([[0], np.cumsum(length)])
                    pick = np.arange(edge[-1]) - np.repeat(edge[:-1] - cuts[some], length)
                    hashes, where, _ = line_words(whole[pick], edge)
                    raw = (4 * K.bounds(where, len(some))).astype(np.int32)
                    seq = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(raw), pa.py_buffer(np.ascontiguousarray(hashes.astype(np.uint32)))])
                    bag = pa.array([x.tobytes() for x in bags(hashes, where, len(some))], pa.binary())
                    name, to, first = (x.slice(own.start + a, b - a) for x in (h, leads, leading))
                    yield pa.RecordBatch.from_arrays([name, seq, bag, to, first], names=["h", "seq", "bag", "leads", "leading"])

    made = Shared(arrow(found, read, "h bigint, seq binary, bag binary, leads array<bigint>, leading boolean"))
    asked.drop()
    if made.df.count() > lines.count():  # rows that repeat give a line more than once
        once = Shared(made.df.dropDuplicates(["h"]))
        made.drop()
        return once
    return made


def near_pairs(both: DataFrame) -> DataFrame:
    """(a, b): those of the pairs ``both`` (a, b, sa, sb) of lines that are near, by their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (one, off), (two, more) = K.buffers(batch.column(2)), K.buffers(batch.column(3))
            flat = np.concatenate([one, two]).view(np.uint32).astype(np.int64)
            n, off = len(batch), np.concatenate([off // 4, off[-1] // 4 + more[1:] // 4])
            size = np.diff(off)
            bag = bags(flat.astype(np.uint64), np.repeat(np.arange(2 * n), size), 2 * n)
            ok = np.flatnonzero(bags_allow(size[:n], bag[:n], size[n:], bag[n:]))
            made = np.zeros(n, bool)
            made[ok] = close(flat, off, ok, ok + n)
            hit = pa.array(made)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(hit), batch.column(1).filter(hit)], names=["a", "b"])

    return arrow(both.select("a", "b", "sa", "sb"), run, "a bigint, b bigint")


def grouped(cells: DataFrame, seqs: DataFrame) -> DataFrame:
    """(node, root): the components of the near lines of each of ``cells`` (cell, h, words, sketch); their words and first lines are in ``seqs``."""

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        cell, h, root, words, sketch = (table[c].to_numpy() for c in ("cell", "h", "root", "words", "sketch"))
        bag = K.buffers(table["bag"])[0].reshape(-1, BAG)
        order = np.lexsort((words, cell))
        cell, h, root, words, sketch, bag = cell[order], h[order], root[order], words[order].astype(np.int64), sketch[order].view(np.uint64), bag[order]
        start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        for s, m in zip(start, np.diff(np.append(start, len(cell))), strict=True):
            n = words[s : s + m]
            upto = s + np.searchsorted(n, np.floor(n / SIMILARITY + 1e-9), "right")  # lines are in the order of length: those behind that are short enough
            upto[n >= MANY] = s + m
            many = np.maximum(upto - np.arange(s, s + m) - 1, 0)
            total, lo = np.cumsum(many), 0
            while lo < m:
                hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + (1 << 18), "right")))
                size = many[lo:hi]
                x = np.repeat(np.arange(s + lo, s + hi), size)
                y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)
                lo = hi
                other = root[x] != root[y]
                x, y = x[other], y[other]
                near = may_be_near(words[x], sketch[x], words[y], sketch[y])
                x, y = x[near], y[near]
                near = bags_allow(words[x], bag[x], words[y], bag[y]) | (words[x] >= MANY) | (words[y] >= MANY)
                if near.any():
                    yield pa.RecordBatch.from_arrays([pa.array(h[x[near]]), pa.array(h[y[near]])], names=["a", "b"])

    to_lead = seqs.select(F.explode("leads").alias("a"), F.col("h").alias("b"), F.col("seq").alias("sb"))
    first = Shared(near_pairs(to_lead.join(seqs.filter("leading").select(F.col("h").alias("a"), F.col("seq").alias("sa")), "a")), shuffled=True)
    root = Shared(components(first.df))
    named = cells.join(sized(root.df.toDF("h", "root")), "h", "left").select("cell", "h", F.coalesce("root", "h").alias("root"), "words", "sketch")
    torn = Shared(named.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("cell"))
    left = Shared(named.join(sized(torn.df), "cell").join(seqs.select("h", "bag"), "h"))
    # lines that may be near, but not by the first ones of their cells
    rest = Shared(arrow(left.df.repartition("cell"), cross, "a bigint, b bigint").distinct(), shuffled=True)
    asked = Shared(rest.df.select(F.explode(F.array("a", "b")).alias("h")).distinct())
    held = seqs.select("h", "seq").join(sized(asked.df), "h", "left_semi")
    second = Shared(near_pairs(rest.df.join(held.toDF("b", "sb"), "b").join(held.toDF("a", "sa"), "a")), shuffled=True)
    out = components(first.df.unionByName(second.df))
    for done in (first, root, torn, left, rest, asked, second):
        done.drop()
    return out


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, rev, line, kept_doc_id, kept_line): every line that repeats an earlier one, and the occurrence that stays.

    A null text has no lines, an empty one a single line without words.  A null doc_id counts as the least id.  Rows that repeat
    doc_id and text are one document.  Of occurrences in texts of one doc_id that of the text with the lesser hash comes first.  Texts of any
    length are read in blocks of lines.  An empty table gives an empty result; columns other than doc_id and text are not looked at."""
    out = Shared(met(docs), shuffled=True)
    seen = out.df.filter("cell is null").drop("cell", "lead", "words", "sketch")
    cells = Shared(out.df.filter("cell is not null").select("cell", "lead", "h", "words", "sketch").dropDuplicates(["cell", "h"]))
    first = F.col("doc_id").eqNullSafe(F.col("f_doc")) & (F.col("rev") == F.col("f_rev")) & (F.col("line") == F.col("f_line"))
    # each line with the first lines that it is held against, and whether others are held against it
    led = cells.df.filter("lead <> h")
    sides = cells.df.select("h", F.when(F.col("lead") != F.col("h"), F.col("lead")).alias("lead"), F.lit(False).alias("leading"))
    sides = sides.unionByName(led.select(F.col("lead").alias("h"), F.lit(None).cast("bigint").alias("lead"), F.lit(True).alias("leading"))).distinct()
    asked = Shared(sides.groupBy("h").agg(F.sort_array(F.collect_set("lead")).alias("leads"), F.max("leading").alias("leading")))
    tied = Shared(seen.filter(first).join(sized(asked.df), "h").select("h", "doc_id", "rev", "line", "leads", "leading").distinct())
    seqs = sequences(tied.df, docs)
    group = grouped(cells.df.drop("lead"), seqs.df)
    member = tied.df.join(sized(group.withColumnRenamed("node", "h")), "h").select("h", F.col("root").alias("member_of"), F.struct("doc_id", "rev", "line").alias("at"))
    kept = member.groupBy("member_of").agg(F.min("at").alias("kept"))
    fuzzy = Shared(member.select("h", "member_of").join(kept, "member_of").select("h", "kept"))
    for done in (cells, asked, tied, seqs):
        done.drop()
    # a group's first occurrence is no later than that of any of its lines
    both = seen.join(sized(fuzzy.df), "h", "left").filter("n > 1 or kept is not null")
    stays = F.coalesce(F.col("kept"), F.struct(F.col("f_doc").alias("doc_id"), F.col("f_rev").alias("rev"), F.col("f_line").alias("line")))
    both = both.withColumn("kept", stays).filter(~F.struct("doc_id", "rev", "line").eqNullSafe(F.col("kept")))
    return both.select("doc_id", "rev", "line", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.line").alias("kept_line")).distinct()


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated lines, all columns; a text that loses all its lines goes, with its row.

    n_chars, where there is such a column, is set to the new length of a text that lost lines.  Everything else is as for ``repeats``;
    helper columns are joined under names that no column of ``docs`` has."""
    tag = "_"
    while any(c.lower().startswith(tag) for c in docs.columns):
        tag += "_"
    lost = Shared(repeats(docs).groupBy("doc_id", "rev").agg(F.sort_array(F.collect_list("line")).alias("lines")))
    drop = lost.df.select(F.col("doc_id").alias(tag + "d"), F.col("rev").alias(tag + "r"), F.col("lines").alias(tag + "l"))
    rev = F.xxhash64(docs["text"].cast("string"))
    both = docs.join(sized(drop), docs["doc_id"].cast("bigint").eqNullSafe(F.col(tag + "d")) & (rev == F.col(tag + "r")) & docs["text"].isNotNull(), "left")
    parts = F.split(F.col("text"), "\n", -1)
    left = F.filter(parts, lambda x, i: ~F.array_contains(F.col(tag + "l"), i))
    rest = F.when(F.col(tag + "l").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    out = both.withColumn("text", rest).filter(F.col(tag + "l").isNull() | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(tag + "l").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
