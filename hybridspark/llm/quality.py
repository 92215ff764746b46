"""Quality classifier from weak labels: EM over overlapping heuristic labellers, then a hashed linear scorer.

Every document gets a vote of each labeller: bad (0), good (1) or none (2).  The counts of all vote patterns over the
whole corpus (at most 3 to the number of labellers) go to the driver, where expectation-maximisation estimates each
labeller's accuracy on good and on bad documents, the share of good ones, and each pattern's posterior.  The posteriors
label a sample of documents, on which a logistic model over hashed features is trained in one task: words, the
signs between words, and the shape of words.  The model scores every document; ``keep`` is score >= KEEP.

``sample`` bounds the documents that the scorer is trained on; nothing else is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import arrow

SAMPLE, SLOTS, KEEP, EPOCHS, SEED = 6_000, 1 << 16, 0.5, 12, 1
LABELLERS = ("symbols", "capitals", "shouting", "odd gaps", "function words", "repeated pairs", "variety", "sentences", "prose")
SCHEMA = "doc_id bigint, votes string, posterior double, score double, keep boolean"
#: Marks the pattern of a text of fewer than 8 words, on which only the labellers of SHORT_TOO can vote.
SHORT, SHORT_TOO = 3 ** len(LABELLERS), (0, 3)
_CLASSES = {"sym": b"#$%&*|<>{}[]\\^~=_@+", "up": bytes(range(65, 91)), "let": bytes([*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)]), "bang": b"!?", "dot": b".", "digit": b"0123456789", "vis": bytes([*range(33, 128), *range(0xC2, 0xF5)])}
_TABLES = {k: np.isin(np.arange(256), list(v)) for k, v in _CLASSES.items()}
_FUNCTION = "the of and to in is it that was for on with as are be by at or an a this from have not he you der die das und ist ein eine von zu mit den dem nicht auf für im le la les de des et est un une que en dans il du pour par el los las del y es por con se no una".split()


def _hashes(raw: list[bytes]) -> np.ndarray:
    end = np.cumsum([len(x) for x in raw])
    return np.sort(K.span_hashes(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], end[:-1]]), end))


_KNOWN = _hashes([w.encode() for w in sorted(set(_FUNCTION))])
#: What stands between the words of prose.
_USUAL = _hashes([b"", b" ", b"\n", b".", b". ", b".\n", b", ", b",\n", b"; ", b": ", b"? ", b"! ", b"-", b"'", b"\n\n", b" - "])


def _sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    acc = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=acc[1:])
    return acc[off[1:]] - acc[off[:-1]]


def analyse(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vote pattern of each row, feature slots, offsets of each row's slots)."""
    n = len(off) - 1
    start, end, row = K.words(data, off)
    low = K.lower(data)
    h, woff = K.span_hashes(low, start, end), K.bounds(row, n)
    words = np.diff(woff)
    count = {k: _sums(t[data], off) for k, t in _TABLES.items()}
    some, letters, visible = np.maximum(words, 1), np.maximum(count["let"], 1), np.maximum(count["vis"], 1)
    place = np.minimum(np.searchsorted(_KNOWN, h), len(_KNOWN) - 1)
    known = _sums(_KNOWN[place] == h, woff) / some
    after = np.append(start[1:], len(data))
    after = np.minimum(after, off[row + 1]) if len(row) else after[:0]
    again, distinct, twice = np.zeros(n), np.ones(n), np.zeros(len(h), np.int64)
    if len(h):
        key = np.lexsort((h, row))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[key][1:] != h[key][:-1]) | (row[key][1:] != row[key][:-1])
        # words of a long text repeat in the nature of things: distinct ones are held against the root of the length
        distinct = np.bincount(row[key][fresh], minlength=n) / np.minimum(some, 8 * np.sqrt(some))
        pair = K.mix(h[:-1] * K.U64(0x9FB21C651E98DF25) + h[1:])
        inner = np.flatnonzero(row[:-1] == row[1:])
        key = np.lexsort((pair[inner], row[inner]))
        p, r = pair[inner][key], row[inner][key]
        same = np.zeros(len(p), bool)
        same[1:] = (p[1:] == p[:-1]) & (r[1:] == r[:-1])
        again = np.bincount(r[same], minlength=n) / np.maximum(words - 1, 1)
        follows = inner + 1
        twice[follows] += h[follows] == h[inner]
        twice[follows[key[same]]] += 2
    votes = np.full((n, len(LABELLERS)), 2, np.int8)

    def vote(i: int, good: np.ndarray, bad: np.ndarray) -> None:
        votes[good, i] = 1
        votes[bad, i] = 0

    live, none = words > 0, np.zeros(n, bool)
    gaps = K.span_hashes(data, end, after)
    usual = _sums(np.isin(gaps, _USUAL), woff) / some
    odd, enough = 1 - usual, words >= 8
    ratio, caps_share, bangs, stops = count["sym"] / visible, count["up"] / letters, count["bang"] / some, count["dot"] / some
    vote(0, none, live & (ratio > 0.02))
    vote(1, none, enough & (caps_share > 0.3))
    vote(2, none, enough & (bangs > 0.15))
    vote(3, live & (odd < 0.2), enough & (odd > 0.35))
    vote(4, enough & (known > 0.1), enough & (known < 0.03))
    vote(5, none, enough & (again > 0.25))
    vote(6, enough & (distinct > 0.35), enough & (distinct < 0.2))
    vote(7, enough & (stops > 0.02) & (stops < 0.4), enough & ((stops < 0.005) | (stops > 0.5)))
    vote(8, enough & (odd < 0.2) & (again < 0.1) & (caps_share < 0.2), none)
    pattern = votes.astype(np.int64) @ (3 ** np.arange(len(LABELLERS), dtype=np.int64)) + np.where(enough, 0, SHORT)

    # features: word, signs up to the next word, shape of the word, whether it or its pair was there before
    capital = _TABLES["up"][data]
    acc = np.concatenate([[0], np.cumsum(capital)])
    caps = acc[end] - acc[start]
    shape = np.where(caps == 0, 0, np.where(caps == 1, 1, np.where(caps >= end - start, 3, 2)))
    kind = K.mix((shape * 32 + np.minimum(end - start, 24)).astype(np.uint64) + K.U64(77))
    slots = np.empty(4 * len(h), np.int64)
    for i, x in enumerate((h, K.mix(gaps + K.U64(5)), kind, K.mix(twice.astype(np.uint64) + K.U64(99)))):
        slots[i::4] = (x % K.U64(SLOTS)).astype(np.int64)
    return pattern, slots, 4 * woff


def digits_of(pattern: np.ndarray) -> np.ndarray:
    return (np.asarray(pattern, np.int64)[:, None] // 3 ** np.arange(len(LABELLERS))) % 3


def estimate(patterns: np.ndarray, times: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """EM: (posterior of each pattern, table[labeller, class, vote] of vote chances, share of good documents).

    Begins with the majority of votes; every count is smoothed by half a document."""
    votes, short = digits_of(patterns), np.asarray(patterns) >= SHORT
    can = np.array([~short if j not in SHORT_TOO else np.ones(len(short), bool) for j in range(votes.shape[1])])
    good, bad = (votes == 1).sum(1), (votes == 0).sum(1)
    q = np.clip((good + 0.5) / (good + bad + 1.0), 0.05, 0.95)
    q[bad == 0] = np.maximum(q[bad == 0], 0.9)
    table, share = np.zeros((votes.shape[1], 2, 3)), 0.5
    for _ in range(rounds):
        weight = np.stack([times * (1 - q), times * q])
        for j in range(votes.shape[1]):
            for v in range(3):
                table[j, :, v] = weight[:, (votes[:, j] == v) & can[j]].sum(1) + 0.5
        table /= table.sum(2, keepdims=True)
        share = float((weight[1].sum() + 1) / (weight.sum() + 2))
        log = np.log(np.array([1 - share, share]))[None, :] + sum(np.log(table[j][:, votes[:, j]]).T * can[j][:, None] for j in range(votes.shape[1]))
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        done = np.abs(new - q).max() < 1e-6
        q = new
        if done:
            break
    return q, table, share


def train(slots: np.ndarray, off: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Weights (SLOTS, then the bias) of a logistic model over mean hashed features; soft targets, Adam with weight decay."""
    rng = np.random.default_rng(SEED)
    w, m, v = (np.zeros(SLOTS + 1) for _ in range(3))
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(target))
        for lo in range(0, len(order), 64):
            ids = order[lo : lo + 64]
            size = off[ids + 1] - off[ids]
            which = np.repeat(np.arange(len(ids)), size)
            at = np.concatenate([slots[off[i] : off[i + 1]] for i in ids]) if size.sum() else np.zeros(0, np.int64)
            per = 1.0 / np.maximum(size, 1)[which]
            z = np.bincount(which, w[at] * per, len(ids)) + w[-1]
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[ids]) / len(ids)
            g = np.bincount(at, err[which] * per, SLOTS + 1)
            g[-1] = err.sum()
            step += 1
            live = np.flatnonzero(g)
            m *= 0.9
            m[live] += 0.1 * g[live]
            v *= 0.999
            v[live] += 0.001 * g[live] ** 2
            w[:-1] *= 0.9995
            w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def score(slots: np.ndarray, off: np.ndarray, w: np.ndarray) -> np.ndarray:
    acc = np.concatenate([[0.0], np.cumsum(w[slots])])
    size = np.diff(off)
    z = (acc[off[1:]] - acc[off[:-1]]) / np.maximum(size, 1) + w[-1]
    return np.where(size > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)


def scored(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, votes, posterior, score, keep) of every row; votes has a letter for each labeller: g, b or -.

    A null, empty or wordless text has posterior and score 0 and isn't kept.  A null doc_id stays null, rows that repeat are scored alike.  An
    empty table gives an empty result.  Columns other than doc_id and text are not looked at."""
    narrow = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))

    def pattern(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * SHORT, np.int64)
        for batch in batches:
            data, off = K.buffers(batch.column(0))
            for lo, hi in K.slices(off):
                total += np.bincount(analyse(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])[0], minlength=len(total))
        live = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(live), pa.array(total[live])], names=["pattern", "n"])

    seen = arrow(narrow.select("text"), pattern, "pattern bigint, n bigint").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    if not seen:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    known, times = np.array([r["pattern"] for r in seen]), np.array([r["n"] for r in seen])
    posterior = np.zeros(2 * SHORT)
    posterior[known] = estimate(known, times)[0]

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, size, target = [], [], []
        for batch in batches:
            data, off = K.buffers(batch.column(0))
            for lo, hi in K.slices(off):
                p, s, o = analyse(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                slots.append(s.astype(np.int32))
                size.append(np.diff(o))
                target.append(posterior[p])
        if slots:
            off = np.concatenate([[0], np.cumsum(np.concatenate(size))])
            w = train(np.concatenate(slots), off, np.concatenate(target))
            yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float64).tobytes()], pa.binary())], names=["w"])

    part = min(1.0, sample / max(int(times.sum()), 1))
    drawn = narrow.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000_007)) < F.lit(int(part * 1_000_000_007) + 1)).select("text")
    rows = arrow(drawn.repartition(1).sortWithinPartitions(F.xxhash64("text")), fit, "w binary").collect()
    weights = np.frombuffer(rows[0]["w"]) if rows else np.zeros(SLOTS + 1)
    letters = np.array(["b", "g", "-"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.buffers(batch.column(1))
            for lo, hi in K.slices(off):
                p, s, o = analyse(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                q = score(s, o, weights)
                names = ["".join(x) for x in letters[digits_of(p)]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(names), pa.array(np.where(np.diff(o) > 0, posterior[p], 0.0)), pa.array(q), pa.array(q >= KEEP)], names=["doc_id", "votes", "posterior", "score", "keep"])

    return arrow(narrow, run, SCHEMA)
