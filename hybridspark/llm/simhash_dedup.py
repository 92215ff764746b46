"""Near-duplicate documents by SimHash, searched with May-Ozerov style nested filters.

A document's fingerprint has 256 bits, voted by its adjacent word pairs (lower-cased words, with marks
at both ends).  Two documents are near duplicates if at most ``max_bits`` bits differ.

Search.  In each repetition a random choice of coordinates is cut into strips.  A strip has random centres,
and a fingerprint passes the filter of a centre if its partial weight there (the bits in which it differs from
the centre on that strip) is at most ``weight``.  What passes forms a list, which the next strip's centres
filter again, and so on until lists are expected to be small; these are compared by brute force.  Repetitions
continue until a pair at ``max_bits`` differing bits, the farthest that counts, has met in a list with probability
``recall``; nearer pairs meet with a higher one.  Depth and repetitions follow from the number of fingerprints alone.

Repetitions run in waves of WAVE, so that what a wave shuffles is bounded by a multiple of the fingerprints; a wave
leaves only edges behind.  Fingerprints move to the tasks of their lists in packed blocks, not as rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import Shared, arrow, components, forest, parallel, sized

LANES, BITS = 4, 256
MAX_BITS, RECALL, WAVE = 60, 0.95, 24
#: Relative costs of an entry of a list, of a comparison in a list and of a look at a centre.
ENTRY_COST, PAIR_COST, CENTRE_COST = 1500.0, 12.0, 1.0
FP_SCHEMA = "doc_id bigint, fp binary, features bigint"
ENTRY = np.dtype([("list", np.uint64), ("fp", np.uint64, LANES)])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, features) of every row with a doc_id; a null or wordless text has no features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.buffers(batch.column(1))
            for lo, hi in K.slices(off):
                h, row = K.word_hashes(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                p, poff = K.pairs_with_edges(h, K.bounds(row, hi - lo))
                fp = K.simhash(p, poff, LANES)
                col = pa.Array.from_buffers(pa.binary(32), hi - lo, [None, pa.py_buffer(np.ascontiguousarray(fp))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).cast(pa.int64()), col, pa.array(np.diff(poff))], names=["doc_id", "fp", "features"])

    return arrow(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).filter(F.col("doc_id").isNotNull()), run, FP_SCHEMA)


@functools.cache
def _shared(strip: int, weight: int) -> tuple[int, ...]:
    """For k differing bits: how many centres of a strip have two fingerprints within ``weight``."""
    return tuple(sum(math.comb(k, i) * math.comb(strip - k, j) for i in range(k + 1) for j in range(strip - k + 1) if i + j <= weight and k - i + j <= weight) for k in range(strip + 1))


def chance(strip: int, weight: int, centres: int, d: float) -> float:
    """Chance that two fingerprints, each bit of which differs with probability d, both lie in the ball of a centre of a strip."""
    return sum(math.comb(strip, k) * d**k * (1 - d) ** (strip - k) * (1 - (1 - hit / 2**strip) ** centres) for k, hit in enumerate(_shared(strip, weight)))


@functools.cache
def plan(n: int, max_bits: int = MAX_BITS, recall: float = RECALL) -> tuple[int, int, int, int, int]:
    """(bits of a strip, weight, centres of a strip, strips, repetitions) for n fingerprints: of all choices the one of least cost."""
    best = None
    for strip in range(8, 23):
        for weight in range(1, strip // 3 + 1):
            ball = sum(math.comb(strip, k) for k in range(weight + 1)) / 2**strip
            centres = max(1, round(1 / ball))
            if centres > 2048:
                continue
            once = chance(strip, weight, centres, max_bits / BITS)
            for strips in range(1, BITS // strip + 1):
                members = n * ball**strips
                if members > 1024 and n > 1024:
                    continue
                reps = max(1, math.ceil(math.log(1 - recall) / math.log1p(-min(once**strips, 1 - 1e-9))))
                cost = reps * ((centres * ball) ** strips * (ENTRY_COST + PAIR_COST * members / 2) + strips * centres * CENTRE_COST)
                if best is None or cost < best[0]:
                    best = cost, (strip, weight, centres, strips, reps)
                if members < 4:
                    break
    return best[1]


def names(fp: np.ndarray) -> np.ndarray:
    """A 64-bit name of each fingerprint, given as rows of LANES."""
    h = np.full(len(fp), 0x9FB21C651E98DF25, np.uint64)
    for lane in range(fp.shape[1]):
        h = K.mix(h * K.U64(0xC2B2AE3D27D4EB4F) + fp[:, lane])
    return h.view(np.int64)


def _prints(column: pa.Array) -> np.ndarray:
    fixed = column.cast(pa.binary(8 * LANES))
    return np.frombuffer(fixed.buffers()[1], np.uint64)[fixed.offset * LANES : (fixed.offset + len(fixed)) * LANES].reshape(-1, LANES)


def lists(fps: DataFrame, chosen: tuple[int, int, int, int, int], first: int, last: int, parts: int, seed: int = 9) -> DataFrame:
    """(part, entries): each fingerprint in every list of the repetitions first .. last - 1 whose filters it passes, packed by the task of the list."""
    strip, weight, centres, strips, _ = chosen

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = []
        for r in range(first, last):
            rng = np.random.default_rng((seed, r))
            made.append((r, rng.permutation(BITS)[: strips * strip].reshape(strips, strip), rng.integers(0, 2**strip, (strips, centres), dtype=np.uint32)))
        powers = (1 << np.arange(strip)).astype(np.float32)
        held, size = [], 0

        def out() -> pa.RecordBatch:
            all_ = np.concatenate(held)
            part = (all_["list"] % K.U64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            packed, cut = all_[order], np.searchsorted(part[order], np.arange(parts + 1))
            live = np.flatnonzero(np.diff(cut))
            return pa.RecordBatch.from_arrays([pa.array(live.astype(np.int32)), pa.array([packed[cut[p] : cut[p + 1]].tobytes() for p in live], pa.binary())], names=["part", "entries"])

        for whole in batches:
            for lo in range(0, len(whole), 1024):
                fp = _prints(whole.column(0).slice(lo, 1024))
                bits = np.unpackbits(fp.view(np.uint8), axis=1, bitorder="little").astype(np.float32)
                for r, coords, balls in made:
                    who, path = np.arange(len(fp)), np.full(len(fp), r + 1, np.uint64)
                    for s in range(strips):
                        value = (bits[:, coords[s]] @ powers).astype(np.uint32)
                        at, number = np.nonzero(np.bitwise_count(value[who][:, None] ^ balls[s][None, :]) <= weight)
                        who, path = who[at], K.mix(path[at] * K.U64(1_000_003) + number.astype(np.uint64) + K.U64(s + 1))
                    entry = np.empty(len(who), ENTRY)
                    entry["list"], entry["fp"] = path, fp[who]
                    held.append(entry)
                    size += len(who)
                if size >= 1 << 17:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    return arrow(fps.select("fp"), run, "part int, entries binary")


def near_edges(fp: np.ndarray, start: np.ndarray, size: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b) that join all fingerprints of each run which chains of near pairs connect.

    A small run is compared all with all; a larger one is walked breadth first, so that a run of n copies costs n comparisons."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for m in np.unique(size[(size > 1) & (size <= 32)]):  # runs of one small size at once: all pairs
        first = start[size == m]
        i, j = np.triu_indices(m, 1)
        step = max(1, (1 << 16) // len(i))
        for lo in range(0, len(first), step):
            x, y = (first[lo : lo + step, None] + i).ravel(), (first[lo : lo + step, None] + j).ravel()
            d = np.zeros(len(x), np.uint16)
            for lane in range(LANES):
                d += np.bitwise_count(fp[x, lane] ^ fp[y, lane])
            near = d <= max_bits
            a.append(x[near])
            b.append(y[near])
    for s, m in zip(start[size > 32], size[size > 32], strict=True):
        if m <= 2048:
            own = fp[s : s + m]
            for lo in range(0, m, 256):  # all pairs, by blocks of rows
                d = np.zeros((min(256, m - lo), m), np.uint16)
                for lane in range(LANES):
                    d += np.bitwise_count(own[lo : lo + 256, lane, None] ^ own[None, :, lane])
                x, y = np.nonzero(d <= max_bits)
                keep = x + lo < y
                a.append(s + lo + x[keep])
                b.append(s + y[keep])
            continue
        left = np.arange(s, s + m)
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                at = queue.pop()
                near = K.hamming(fp[left], fp[at]) <= max_bits
                hit = left[near]
                left = left[~near]
                a.append(np.full(len(hit), at))
                b.append(hit)
                queue += hit.tolist()
    return np.concatenate(a), np.concatenate(b)


def links(listed: DataFrame, parts: int, max_bits: int = MAX_BITS) -> DataFrame:
    """Brute force in each list: edges (a, b) between names of fingerprints; their chains connect what chains of near pairs in a list do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for p, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                by.setdefault(p, []).append(np.frombuffer(x.as_buffer(), ENTRY))
        for p in sorted(by):
            all_ = np.concatenate(by.pop(p))
            key, fp = all_["list"].copy(), all_["fp"].copy()
            del all_
            order = np.argsort(key, kind="stable")
            key, fp = key[order], fp[order]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            a, b = near_edges(fp, start, np.diff(np.append(start, len(key))), max_bits)
            if len(a):
                name = names(fp)
                yield forest(name[a], name[b])

    return arrow(listed.repartition(parts, "part"), run, "a bigint, b bigint")


def groups(docs: DataFrame, max_bits: int = MAX_BITS, recall: float = RECALL) -> DataFrame:
    """(doc_id, group_id): every doc_id of ``docs`` with the least doc_id of its group of near duplicates.

    Documents without words (null or empty texts) are near no other, rows that repeat a doc_id count as one document, and rows whose
    doc_id is null are left out.  A text of any length is read in blocks.  Ties between ids can't arise: a group's id is its least
    doc_id.  An empty table gives an empty result; other columns are not looked at, so their names can't clash."""
    prints = Shared(fingerprints(docs))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(names(_prints(batch.column(0)))), batch.column(1)], names=["name", "node"])

    one = Shared(prints.df.filter("features > 0").groupBy("fp").agg(F.min("doc_id").alias("node")))  # equal fingerprints: once
    n = one.df.count()
    chosen = plan(n, max_bits, recall)
    found, waves = None, []
    for first in range(0, chosen[-1], WAVE):
        last = min(chosen[-1], first + WAVE)
        parts = parallel(docs.sparkSession, n * (last - first) * ENTRY.itemsize)
        wave = Shared(links(lists(one.df, chosen, first, last, parts), parts, max_bits), shuffled=True)
        waves.append(wave)
        found = wave.df if found is None else found.unionByName(wave.df)
    name = Shared(arrow(one.df.select("fp", "node"), named, "name bigint, node bigint"))
    edges = Shared(found.distinct())
    a, b = (sized(name.df).toDF(x, f"{x}_node") for x in ("a", "b"))
    near = edges.df.join(a, "a").join(b, "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    same = prints.df.filter("features > 0").join(one.df, "fp").filter("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    root = components(near.unionByName(same))
    for done in (*waves, one, name, edges):
        done.drop()
    return prints.df.select("doc_id").distinct().join(root.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("group_id"))


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` of which each group of near duplicates keeps one: its least doc_id.

    Rows that repeat both doc_id and text of a kept document are given once; rows with a null doc_id all stay."""
    lost = Shared(groups(docs, **how).filter("doc_id <> group_id").select("doc_id"))
    twice = Shared(docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id"))
    kept = docs.join(sized(lost.df), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
    if twice.df.isEmpty():
        return kept
    again = sized(twice.df)
    return kept.join(again, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(kept.join(again, "doc_id", "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns)).dropDuplicates(["doc_id", "text"]))
