"""Vectorised word and word-n-gram hashing over Arrow string columns.

A word is a maximal run of ASCII letters and digits or of bytes above 0x7F
(callers lower-case on the JVM side), so no Python loop runs per word: one
rolling hash over the whole byte buffer yields all word hashes of a chunk.
Null texts count as empty; an empty text has no words and no grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
GRAM_BITS = 48
MAX_DOCS = 1 << 15
CHUNK_BYTES = 400_000

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_STEP = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)
_IS_WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _IS_WORD[_a:_b] = True
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if size <= 2 * CHUNK_BYTES:
            _powers[name] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (first 0) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8)
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    return np.frombuffer(data, np.uint8)[lo:hi], offsets - lo


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer row is a range of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        end = min(max(end, at + 1), at + MAX_DOCS, n)
        yield at, end
        at = end


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; rows never share a word."""
    n = len(data)
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = _IS_WORD[data]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    cuts = np.unique(cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]) if len(cuts) else cuts
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power("up", _BASE, n), out=total[1:])
    inverse = _power("down", _INVERSE, n + 1)
    raw = (total[ends] - total[starts]) * inverse[starts]
    return mix(raw ^ ((ends - starts).astype(np.uint64) * U64(0xD6E8FEB86659FD93)))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word, in text order."""
    starts, ends, rows = spans(data, offsets)
    return span_hashes(data, starts, ends), rows


def ngrams(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and row of every word n-gram.

    A text of fewer than n words, but at least one, has one gram: all its words.
    """
    m = len(hashes)
    if m == 0:
        return hashes, rows
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    counts = np.diff(np.append(first, m))
    total = np.zeros(m, np.uint64)
    for j in range(min(n, m)):
        total[: m - j] += hashes[j:] * _STEP[j]
    keep = np.zeros(m, bool)
    if m >= n:
        keep[: m - n + 1] = rows[: m - n + 1] == rows[n - 1 :]
    grams, at = mix(total[keep]), rows[keep]
    short = counts < n
    if short.any():
        extra = np.zeros(int(short.sum()), np.uint64)
        f, c = first[short], counts[short]
        for j in range(n - 1):
            ok = c > j
            extra[ok] += hashes[f[ok] + j] * _STEP[j]
        extra = mix(extra + c.astype(np.uint64))
        grams, at = np.concatenate([grams, extra]), np.concatenate([at, rows[f]])
    return grams, at


def gram_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 48-bit n-grams of each row, ascending, and their row offsets."""
    grams, rows = ngrams(*words(data, offsets), n)
    key = (rows.astype(np.uint64) << U64(GRAM_BITS)) | (grams >> U64(64 - GRAM_BITS))
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    bounds = np.searchsorted(key, np.arange(len(offsets), dtype=np.uint64) << U64(GRAM_BITS))
    return key & U64((1 << GRAM_BITS) - 1), bounds.astype(np.int64)


def text_chunks(batch: pa.RecordBatch, name: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) over one record batch."""
    data, offsets = utf8(batch.column(batch.schema.get_field_index(name)))
    for a, b in chunks(offsets):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
