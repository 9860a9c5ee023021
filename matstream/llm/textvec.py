"""Words of many texts at once: numpy passes over the UTF-8 buffer of an Arrow column.

A column is walked in chunks of whole texts (``CHUNK_BYTES``; a longer text is
a chunk of its own), so memory is bounded by the chunk and the longest text.
Word hashes are 64-bit polynomial hashes (prefix sums of ``byte * P**i``)
passed through a mixing step; equal words hash equally in every task.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_P_INV = pow(_P, -1, 1 << 64)

#: words are runs of bytes other than space and \x09-\x0D
SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: lower-cases A-Z only
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        p = np.full(n, _P, dtype=np.uint64)
        q = np.full(n, _P_INV, dtype=np.uint64)
        p[0] = q[0] = 1
        return np.cumprod(p), np.cumprod(q)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    col = col.fill_null("").cast(pa.large_string())
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset:col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of at most ``limit`` bytes together (or one text)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


@dataclass
class Words:
    """Words of the texts ``lo..hi-1``: hash, text index within the chunk, and per text the first word."""

    lo: int
    hi: int
    hashes: np.ndarray  # uint64 per word
    doc: np.ndarray  # int64 per word
    first: np.ndarray  # int64, len hi-lo+1: offsets of each text's words
    starts: np.ndarray  # byte offsets within the chunk
    ends: np.ndarray


def words(raw: np.ndarray, offsets: np.ndarray, lo: int, hi: int, is_word: np.ndarray = SPACE_WORDS,
          lower: bool = True) -> Words:
    b = raw[offsets[lo]:offsets[hi]]
    off = offsets[lo:hi + 1] - offsets[lo]
    n = len(b)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(lo, hi, np.zeros(0, np.uint64), z, np.zeros(hi - lo + 1, np.int64), z, z)
    m = is_word[b]
    edge = np.ones(n + 1, dtype=bool)  # a text boundary or a change of class
    edge[1:n] = m[1:] != m[:-1]
    edge[off[off < n]] = True
    edges = np.flatnonzero(edge)
    inside = m[edges[:-1]]
    starts, ends = edges[:-1][inside], edges[1:][inside]
    size = 1 << max(12, (n - 1).bit_length())
    p, q = _powers(size)
    with np.errstate(over="ignore"):
        v = ((LOWER[b] if lower else b).astype(np.uint64) + np.uint64(1)) * p[:n]
        cs = np.zeros(n + 1, np.uint64)
        np.cumsum(v, out=cs[1:])
        h = mix((cs[ends] - cs[starts]) * q[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, off, side="left")
    doc = np.repeat(np.arange(hi - lo), np.diff(first))
    return Words(lo, hi, h, doc, first, starts, ends)


_SHINGLE_KEYS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3,
                          0x589965CC75374CC3], dtype=np.uint64)  # odd multipliers, one per position


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``k``-word shingles and their text index; a text of 1..k-1 words is one shingle."""
    h, doc = w.hashes, w.doc
    n = len(h)
    out_h, out_d = [], []
    with np.errstate(over="ignore"):
        if n >= k:
            acc = np.zeros(n - k + 1, np.uint64)
            for i in range(k):
                acc += h[i:n - k + 1 + i] * _SHINGLE_KEYS[i % 5] + np.uint64(i)
            full = doc[:n - k + 1] == doc[k - 1:]
            out_h.append(mix(acc[full]))
            out_d.append(doc[:n - k + 1][full])
        count = np.diff(w.first)
        short = np.flatnonzero((count > 0) & (count < k))
        if len(short):
            acc = np.zeros(len(short), np.uint64)
            for i in range(k - 1):
                has = count[short] > i
                at = np.minimum(w.first[short] + i, n - 1)
                acc += np.where(has, h[at] * _SHINGLE_KEYS[i % 5] + np.uint64(i), np.uint64(0))
            out_h.append(mix(acc ^ (count[short].astype(np.uint64) << np.uint64(56))))
            out_d.append(short)
    if not out_h:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hh, dd = np.concatenate(out_h), np.concatenate(out_d)
    return hh, dd


def distinct_per_doc(h: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, hash) pairs sorted by text then hash: hashes and text index."""
    if len(doc) and (doc[1:] < doc[:-1]).any():
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
    else:
        h = h.copy()
    bounds = np.searchsorted(doc, np.arange(n_docs + 1))
    for i in range(n_docs):
        h[bounds[i]:bounds[i + 1]].sort()
    if len(h):
        keep = np.ones(len(h), dtype=bool)
        keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[keep], doc[keep]
    return h, doc
