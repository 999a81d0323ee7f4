"""Words, shingles and packed blobs over whole batches of texts, in numpy.

A batch of texts is one byte buffer in which every text is followed by a blank, so
words never cross texts and one pass handles all of them.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15
PIECE_BYTES = 1 << 18
_powers = [np.ones(1, U), np.ones(1, U)]


def mix(h):
    """Finaliser of a 64-bit hash."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def powers(n):
    """BASE ** i and its inverse, modulo 2 ** 64, for i < n at least."""
    if len(_powers[0]) < n:
        n = max(n, PIECE_BYTES)
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(n, base, U)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=U)
    return _powers


def as_bytes(column):
    """List of the texts of an Arrow column as bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def pieces(texts, limit=PIECE_BYTES):
    """Ranges of texts of about ``limit`` bytes each; a longer text is one range."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= limit:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def joined(texts):
    """The buffer of texts and the offset of each, one more for the end."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    return data, np.concatenate([[0], np.cumsum(sizes + 1)])


def word_spans(data):
    """Start and end of every word."""
    gap = IS_SPACE[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(data) and not gap[0]:
        edge = np.concatenate([[0], edge])
    return edge[0::2], edge[1::2]


def span_hashes(data, starts, ends):
    """64-bit hash of each span of bytes."""
    power, inverse = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * power[:len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U))


def word_hashes(texts):
    """Hashes of the lower-cased words of all texts, and how many words each text has."""
    data, offsets = joined(texts)
    data = LOWER[data]
    starts, ends = word_spans(data)
    counts = np.diff(np.searchsorted(starts, offsets))
    return span_hashes(data, starts, ends), counts, (data, starts, ends)


def shingle_sets(texts, width=5):
    """Sorted distinct shingle hashes of every text, one array a text.

    A text of fewer words has its whole sequence as one shingle, one without words none.
    """
    out = []
    for a, b in pieces(texts):
        hashes, counts, _ = word_hashes(texts[a:b])
        acc = hashes * U(0)
        for k in range(width):
            acc[:len(hashes) - k] += mix(hashes[k:] + U(k + 1)) * U(2 * k + 3)
        acc = mix(acc)
        at = 0
        for n in counts.tolist():
            if n >= width:
                out.append(np.unique(acc[at:at + n - width + 1]))
            elif n:
                short = U(n) + np.sum(mix(hashes[at:at + n] + np.arange(1, n + 1, dtype=U)) * U(0xD6E8FEB86659FD93), dtype=U)
                out.append(mix(np.array([short], U)))
            else:
                out.append(np.zeros(0, U))
            at += n
    return out


def pack(*arrays):
    """Arrays as one binary value: the number of bytes of each, then the bytes."""
    parts = [np.ascontiguousarray(a).tobytes() for a in arrays]
    return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts)


def unpack(blob, *dtypes):
    """The arrays of ``pack``, given their types."""
    sizes = np.frombuffer(blob, np.int64, len(dtypes))
    at, out = 8 * len(dtypes), []
    for n, kind in zip(sizes.tolist(), dtypes):
        out.append(np.frombuffer(blob, kind, n // np.dtype(kind).itemsize, at))
        at += n
    return out
