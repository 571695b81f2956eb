"""Vectorised text kernels: words and 64-bit XXH64 over Arrow string buffers.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; as every such byte is
ASCII, splitting UTF-8 bytes and splitting code points give the same words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)

_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_FLAT = np.where(_WORD, np.arange(256), 0x20).astype(np.uint8)
_FLAT_LOWER = _FLAT.copy()
_FLAT_LOWER[65:91] += 32

_U = np.uint64
# Fixed values of XXH64.
_P1, _P2, _P3, _P4, _P5 = (
    _U(11400714785074694791), _U(14029467366897019727), _U(1609587929392839161),
    _U(9650029242287828579), _U(2870177450012600261),
)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def normalised_words(raw: np.ndarray, off: np.ndarray, lower: bool):
    """Words of all texts in one buffer, a text's words one space apart.

    Returns (buffer, start, end, first): word i is buffer[start[i]:end[i]], and text t
    has the words first[t] up to first[t + 1].  So words i to j of one text, joined by
    single spaces, are buffer[start[i]:end[j]].
    """
    word = _WORD[raw]
    heads, tails = off[:-1][off[:-1] < off[1:]], off[1:][off[:-1] < off[1:]] - 1
    begins, ends = word.copy(), word.copy()
    if len(raw):
        begins[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
    begins[heads] = word[heads]  # a text's first byte may follow the last byte of another's word
    ends[tails] = word[tails]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, off)
    buffer = (_FLAT_LOWER if lower else _FLAT)[raw]
    gaps = start[1:] - end[:-1]
    gaps[first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(start))] - 1] = 1  # between two texts
    if len(gaps) and gaps.max() > 1:
        # Runs of white space inside a text: rewrite with one space after each word.
        kept = np.flatnonzero(word)
        rank = np.cumsum(begins[kept]) - 1
        tight = np.full(len(kept) + len(start), 0x20, dtype=np.uint8)
        tight[np.arange(len(kept)) + rank] = buffer[kept]
        size = end - start
        end = np.cumsum(size + 1) - 1
        start, buffer = end - size, tight
    return buffer, start, end, first


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U(r)) | (x >> _U(64 - r))


def xxh64(buffer: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of buffer[start:start+length] for every slice, as uint64."""
    n = len(start)
    out = np.empty(n, dtype=np.uint64)
    if not n:
        return out
    # Slices of like length go together, so that each step runs on whole arrays.
    padded = np.concatenate([buffer, np.zeros(40, np.uint8)])
    lanes8 = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    lanes4 = np.ndarray((len(padded) - 3,), dtype="<u4", buffer=padded, strides=(1,))
    order = np.argsort(np.minimum(length, 65535).astype(np.uint16), kind="stable")
    ordered, start = length[order], start[order]
    with np.errstate(over="ignore"):
        low = 0
        while low < n:
            size = int(ordered[low])
            high = int(np.searchsorted(ordered[low:], size, side="right")) + low if size < 65535 else low + 1
            out[order[low:high]] = _same_length(lanes8, lanes4, padded, start[low:high], size, _U(seed))
            low = high
    return out


def _same_length(lanes8, lanes4, raw, at, size: int, seed) -> np.ndarray:
    p = 0
    if size >= 32:
        v = [np.full(len(at), x, np.uint64) for x in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
        while p + 32 <= size:
            for k in range(4):
                v[k] = _rotl(v[k] + lanes8[at + (p + 8 * k)] * _P2, 31) * _P1
            p += 32
        h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
        for k in range(4):
            h = (h ^ (_rotl(v[k] * _P2, 31) * _P1)) * _P1 + _P4
    else:
        h = np.full(len(at), seed + _P5, np.uint64)
    h += _U(size)
    while p + 8 <= size:
        h = _rotl(h ^ (_rotl(lanes8[at + p] * _P2, 31) * _P1), 27) * _P1 + _P4
        p += 8
    if p + 4 <= size:
        h = _rotl(h ^ (lanes4[at + p].astype(np.uint64) * _P1), 23) * _P2 + _P3
        p += 4
    while p < size:
        h = _rotl(h ^ (raw[at + p].astype(np.uint64) * _P5), 11) * _P1
        p += 1
    h ^= h >> _U(33)
    h *= _P2
    h ^= h >> _U(29)
    h *= _P3
    h ^= h >> _U(32)
    return h


def small_batches(batches, limit: int = 1 << 20, text: str = "text"):
    """Record batches cut so that ``text`` has about ``limit`` bytes in each (one row at least)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0)).astype(np.int64)
        total = np.cumsum(sizes)
        low = 0
        while low < batch.num_rows:
            before = total[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield batch.slice(low, high - low)
            low = high
