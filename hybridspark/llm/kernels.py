"""Vectorised byte kernels shared by the corpus operators.

Everything here works on the flat buffers of an Arrow string column, so a batch of
documents is hashed without creating one Python string per document or word.  Texts are
taken in slices of bounded size; a single long document is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 20
_MUL = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MUL, -1, 1 << 64)
_pow_cache: dict[int, np.ndarray] = {}

WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LANES = np.zeros(256, U64)
for _v in range(256):
    _LANES[_v] = sum(1 << (8 * _j) for _j in range(8) if _v >> _j & 1)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    n = len(column)
    if n == 0 or pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a larger row comes alone."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers, SLICE_BYTES + 1 at most."""
    have = _pow_cache.get(base)
    if have is None:
        a = np.full(SLICE_BYTES + 1, base, U64)
        a[0] = 1
        have = _pow_cache[base] = np.multiply.accumulate(a)
    return have[:n]


def lower(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals of UTF-8 bytes in lower case; the length stays."""
    low = LOWER[data]
    if len(low) > 1:
        lead = np.flatnonzero(data[:-1] == 0xC3) + 1
        lead = lead[(data[lead] >= 0x80) & (data[lead] <= 0x9E) & (data[lead] != 0x97)]
        low[lead] += 0x20
    return low


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, by prefix sums of a polynomial; spans in the order of their starts and ends.

    Spans are taken in blocks of at most SLICE_BYTES, so that memory beside the result is bounded; a longer span is summed in pieces."""
    out = np.zeros(len(starts), U64)
    lo = 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
        last = int(ends[hi - 1])
        if last - base <= SLICE_BYTES:
            n = last - base
            acc = np.zeros(n + 1, U64)
            np.cumsum((data[base:last].astype(U64) + U64(1)) * powers(_MUL, n), out=acc[1:])
            s = starts[lo:hi] - base
            out[lo:hi] = (acc[ends[lo:hi] - base] - acc[s]) * powers(_INV, SLICE_BYTES + 1)[s]
        else:
            total, far = 0, 1
            for at in range(base, last, SLICE_BYTES):
                piece = data[at : min(at + SLICE_BYTES, last)]
                total = total + far * int(((piece.astype(U64) + U64(1)) * powers(_MUL, len(piece))).sum(dtype=U64)) & (1 << 64) - 1
                far = far * pow(_MUL, SLICE_BYTES, 1 << 64) & (1 << 64) - 1
            out[lo] = total
        lo = hi
    return mix(out + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run of ``table`` bytes; rows are bounded by ``offsets``."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    m = table[data]
    first = np.empty(n, bool)
    first[0] = m[0]
    np.logical_and(m[1:], ~m[:-1], out=first[1:])
    last = np.empty(n, bool)
    last[-1] = m[-1]
    np.logical_and(m[:-1], ~m[1:], out=last[:-1])
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = m[cut]
    last[cut - 1] = m[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each lower-cased word."""
    start, end, row = words(data, offsets)
    return span_hashes(lower(data), start, end), row


def bounds(row: np.ndarray, n: int) -> np.ndarray:
    """Offsets of n rows in a sorted array of row numbers."""
    return np.searchsorted(row, np.arange(n + 1))


def pairs_with_edges(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the adjacent word pairs of each row, with a mark before its first and after its last word.

    A row of c words has c + 1 pairs, an empty row none.  Returns (hash, offsets)."""
    count = np.diff(off)
    size = np.where(count > 0, count + 1, 0)
    out_off = np.concatenate([[0], np.cumsum(size)])
    live = np.flatnonzero(count > 0)
    out = np.zeros(int(out_off[-1]), U64)
    left = np.ones(len(out), bool)
    left[out_off[live]] = False
    right = np.ones(len(out), bool)
    right[out_off[live + 1] - 1] = False
    a, b = np.full(len(out), 0x51ED270B, U64), np.full(len(out), 0x2545F491, U64)
    a[left] = h
    b[right] = h
    return mix(a * U64(0x9FB21C651E98DF25) + (b ^ (b >> U64(29))) * U64(0xC2B2AE3D27D4EB4F)), out_off


def simhash(feats: np.ndarray, off: np.ndarray, lanes: int) -> np.ndarray:
    """Charikar fingerprints of 64 * ``lanes`` bits, as (rows, lanes) uint64.

    Row i votes with feats[off[i]:off[i+1]]; a tie gives 0, and so does a row without features.
    Votes are summed in byte lanes of 64-bit words over at most 255 features at a time."""
    rows = len(off) - 1
    out = np.zeros((rows, lanes), U64)
    count = np.diff(off)
    live = np.flatnonzero(count > 0)
    if len(live) == 0:
        return out
    per = -(-count[live] // 255)
    first = np.concatenate([[0], np.cumsum(per)])
    seg = np.repeat(off[live], per) + 255 * (np.arange(first[-1]) - np.repeat(first[:-1], per))
    edge = np.append(seg, off[-1])
    for lane in range(lanes):
        sums = np.empty((len(seg), 64), np.uint8)
        lo = 0
        while lo < len(seg):
            hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + 16384, "right")) - 1)
            hi = min(hi, len(seg))
            h = mix(feats[edge[lo] : edge[hi]] + U64((lane * 0xA24BAED4963EE407 + 1) & (2**64 - 1)))
            votes = _LANES[h.view(np.uint8)].reshape(-1, 8)
            sums[lo:hi] = np.add.reduceat(votes, edge[lo:hi] - edge[lo], axis=0).view(np.uint8)
            lo = hi
        ones = np.add.reduceat(sums, first[:-1], axis=0, dtype=np.int32) if len(seg) > len(live) else sums.astype(np.int32)
        bits = 2 * ones > count[live][:, None]
        out[live, lane] = np.packbits(bits, axis=1, bitorder="little").view(U64)[:, 0]
    return out


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, over the last axis."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int32)
