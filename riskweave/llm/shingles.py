"""Vectorised words and word shingles of Arrow text columns.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``. Words get a
64-bit hash, a sum of random numbers drawn by byte and place in the word, so
that no regular structure of words makes them collide; the sums of a whole
block of texts are one ``reduceat``. Shingle hashes combine the word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_JOIN = 0xD6E8FEB86659FD93
_BLOCK_BYTES = 1 << 21
_HASH_BYTES = 1 << 17  # hashed at once: what fits a core's cache

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer with full avalanche (the public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PLACES = 64
_DRAWN = mix64(np.arange(1, _PLACES * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))  # by place and byte


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind, len(column) + 1 + column.offset)[column.offset:].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def text_groups(offsets: np.ndarray, most: int = _BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive texts (lo, hi) of at most ``most`` bytes together, or one longer text."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_spans(data: np.ndarray, offsets: np.ndarray,
               gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text index) of every maximal run of bytes not in ``gaps``; runs never cross texts."""
    solid = ~gaps[data]
    first, last = solid.copy(), solid.copy()
    if len(data):
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        bounds = offsets[offsets < len(data)]
        first[bounds[solid[bounds]]] = True
        ends = offsets[offsets > 0] - 1
        last[ends[solid[ends]]] = True
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the byte spans, which are in order and don't overlap."""
    out = np.empty(len(start), np.uint64)
    cuts = np.unique(np.searchsorted(start, np.arange(0, len(data) + 1, _HASH_BYTES)))
    for a, b in zip(cuts, [*cuts[1:], len(start)]):
        if a == b:
            continue
        size = end[a:b] - start[a:b]
        first = np.cumsum(size) - size
        place = np.arange(first[-1] + size[-1], dtype=np.int32)
        byte = data[start[a]:end[b - 1]][place + np.repeat((start[a:b] - start[a] - first).astype(np.int32), size)]
        place -= np.repeat(first.astype(np.int32), size)
        code = (place << 8) | (_LOWER[byte] if lower else byte)
        if size.max() <= _PLACES:
            drawn = _DRAWN[code]
        else:  # places beyond the table are drawn one by one
            far = place >= _PLACES
            drawn = _DRAWN[np.where(far, 0, code)]
            drawn[far] = mix64((code[far].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        out[a:b] = np.add.reduceat(drawn, first)
    return mix64(out + (end - start).astype(np.uint64) * np.uint64(_JOIN))


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int,
                   lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of every ``size``-word shingle, in order, repeats included.

    A text with fewer words yields its whole sequence as one shingle; a text
    without words yields none.
    """
    start, end, doc = word_spans(data, offsets)
    words = span_hashes(data, start, end, lower)
    n = len(words)
    if not n:
        return words, doc
    counts = np.bincount(doc, minlength=len(offsets) - 1)
    out, whose = [], []
    if n >= size:
        whole = doc[:n - size + 1] == doc[size - 1:]
        acc = np.zeros(n - size + 1, np.uint64)
        for j in range(size):
            acc = acc * np.uint64(_JOIN) + words[j:n - size + 1 + j]
        out.append(mix64(acc[whole]))
        whose.append(doc[:n - size + 1][whole])
    begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
    for m in range(1, size):
        short = np.flatnonzero(counts == m)
        if len(short):
            acc = np.full(len(short), m, np.uint64)
            for j in range(m):
                acc = acc * np.uint64(_JOIN) + words[begin[short] + j]
            out.append(mix64(acc))
            whose.append(short)
    h, d = np.concatenate(out), np.concatenate(whose)
    if len(out) > 1:
        order = np.argsort(d, kind="stable")
        h, d = h[order], d[order]
    return h, d


def shingle_sets(column: pa.Array, size: int, lower: bool = True) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order."""
    data, offsets = text_buffers(column)
    for lo, hi in text_groups(offsets):
        own = offsets[lo:hi + 1]
        h, d = shingle_hashes(data[own[0]:own[-1]], own - own[0], size, lower)
        cut = np.searchsorted(d, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            part = np.sort(h[cut[i]:cut[i + 1]])
            if len(part) > 1:
                part = part[np.concatenate([[True], part[1:] != part[:-1]])]
            yield part
