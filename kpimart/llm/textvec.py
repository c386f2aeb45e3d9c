"""Whole columns of text as NumPy arrays inside Spark's Python tasks.

Texts arrive as Arrow string columns. Their UTF-8 bytes are one array, words
are found and hashed for all texts of a batch at once, and no Python object
is made per word. Long buffers are worked through in blocks that end between
two words, so memory does not depend on the length of a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer (wraps modulo 2**64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values(lower: bool = True) -> np.ndarray:
    """A 64-bit value for each byte; with ``lower``, A-Z count as a-z."""
    values = mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _STEP)
    if lower:
        values[65:91] = values[97:123]
    return values


def word_bytes(separators: bytes) -> np.ndarray:
    """Which of the 256 bytes belong to words."""
    keep = np.ones(256, dtype=bool)
    keep[list(separators)] = False
    return keep


#: White space of [\x20\x09-\x0D], and ASCII outside 0-9A-Za-z.
SPACE = bytes([32, 9, 10, 11, 12, 13])
NOT_ALNUM = bytes(b for b in range(128) if not chr(b).isalnum())


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    size = 1 << max(10, int(n - 1).bit_length())
    if size not in _POWERS:
        base = 0xD6E8FEB86659FD93
        inverse = pow(base, -1, 1 << 64)
        both = []
        for b in (base, inverse):
            steps = np.full(size, np.uint64(b))
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _POWERS.clear()
        _POWERS[size] = tuple(both)
    return _POWERS[size]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(bytes, offsets, valid)`` of a string column; a null text is empty."""
    n = len(column)
    valid = np.asarray(column.is_valid()) if n else np.zeros(0, bool)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), valid
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    offsets = offsets.astype(np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0], valid


def _blocks(data: np.ndarray, keep: np.ndarray, block: int):
    """Cuts of the buffer, each at a byte that is in no word."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + block)
        if end < n:
            inside = keep[data[at:end]]
            gaps = np.flatnonzero(~inside)
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # one word longer than a block: go on to its end
                while end < n and keep[data[end]]:
                    end += 1
        yield at, end
        at = end


def words(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray, values: np.ndarray, block: int = BLOCK):
    """``(hashes, counts)``: a 64-bit hash of every word in order, and the
    number of words of every text."""
    edges = np.zeros(len(data) + 1, dtype=bool)
    edges[offsets] = True
    hashes, places = [], []
    for at, end in _blocks(data, keep, block):
        piece = data[at:end]
        inside = keep[piece]
        edge = edges[at:end]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | edge[1:]
        after = np.empty(len(piece), dtype=bool)
        after[:-1] = ~inside[1:] | edge[1:]
        after[-1] = True
        first = np.flatnonzero(starts)
        last = np.flatnonzero(inside & after)
        if not len(first):
            continue
        power, inverse = _powers(len(piece))
        sums = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(values[piece] * power[: len(piece)], out=sums[1:])
        hashes.append(mix64((sums[last + 1] - sums[first]) * inverse[first] + (last - first).astype(np.uint64)))
        places.append(first + at)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    upto = np.searchsorted(np.concatenate(places), offsets)
    return np.concatenate(hashes), np.diff(upto)


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, counts)`` of each text's distinct ``k``-word shingles, sorted
    within the text. A text of fewer words is one shingle; one of none has none."""
    ends = np.cumsum(counts)
    out_counts = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out = np.zeros(int(out_counts.sum()), dtype=np.uint64)
    at = np.concatenate(([0], np.cumsum(out_counts)))
    n = len(hashes)
    if n >= k:
        combined = np.zeros(n - k + 1, dtype=np.uint64)
        for j in range(k):
            combined = combined * _STEP + hashes[j : n - k + 1 + j]
        combined = mix64(combined + np.uint64(k))
        owner = np.repeat(np.arange(len(counts)), counts)[: n - k + 1]
        whole = np.arange(n - k + 1) + k <= ends[owner]
        long_text = np.repeat(counts >= k, out_counts)
        out[long_text] = combined[whole]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for w in hashes[ends[i] - counts[i] : ends[i]]:
                h = h * _STEP + w
            out[at[i]] = mix64(np.array([h + np.uint64(counts[i])]))[0]
    for i in np.flatnonzero(out_counts > 1):
        out[at[i] : at[i + 1]].sort()
    if not len(out):
        return out, out_counts
    fresh = np.ones(len(out), dtype=bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[at[:-1][out_counts > 0]] = True
    return out[fresh], np.add.reduceat(fresh, np.minimum(at[:-1], len(out) - 1)).astype(np.int64) * (out_counts > 0)


def segment_sum(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments of the given lengths (0 for empty ones)."""
    if not len(values):
        return np.zeros(len(counts), dtype=values.dtype)
    at = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else np.zeros(0, np.int64)
    sums = np.add.reduceat(values, np.minimum(at, len(values) - 1)) if len(counts) else values[:0]
    return np.where(counts > 0, sums, values.dtype.type(0))
