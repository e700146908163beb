"""Vectorised scans over the bytes of many texts at once: rolling fingerprints, minimizers, words.

Texts lie back to back in one uint8 array with offsets (n + 1 of them), as in an Arrow string column. Tables of
powers are kept for one segment only, so memory doesn't grow with the length of a text.
"""

from __future__ import annotations

import ctypes
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute is used below

SEGMENT = 1 << 16
#: Bytes of text at once, or one text, where a scan holds many numbers for each byte or word: two workers and a full JVM
#: heap have to fit an executor together.
NARROW = 1 << 19
#: Multipliers of the quick fingerprints of short windows, modulo 2**64, by `which`.
QUICK = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Which of two independent fingerprints.
BASES = (0, 1)
#: A range's fingerprint is the polynomial of its bytes modulo PRIME at two multipliers, 62 bits together. Modulo a power
#: of two, strings of a simple pattern, from 1,024 bytes on, would collide under every multiplier.
PRIME, MULTIPLIERS = (1 << 31) - 1, ((1103515245, 1299709571), (1664525893, 1812433253))
_U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    """base**i modulo PRIME for i < n."""
    out = np.ones(1, _U)
    while len(out) < n:
        out = np.concatenate([out, out * _U(pow(base, len(out), PRIME)) % _U(PRIME)])
    return out[:n]


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of a multiplier and of its inverse; tables of up to 8 segments are kept."""
    if base in _TABLES and len(_TABLES[base][0]) >= n:
        return _TABLES[base]
    n = max(n, 2 * SEGMENT)
    made = _powers(base, n), _powers(pow(base, -1, PRIME), n)
    if n <= 8 * SEGMENT:
        _TABLES[base] = made
    return made


def _fold(x: np.ndarray) -> np.ndarray:
    """x, under 2**62, to an equal value modulo PRIME under 2**32, in place."""
    high = x >> _U(31)
    x &= _U(PRIME)
    x += high
    return x


def _times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x * y modulo PRIME, the least such value; x is used up. x under 2**62, y under 2**31."""
    x = _fold(x)
    x *= y
    x = _fold(_fold(x))
    return np.minimum(x, x - _U(PRIME), out=x)  # below PRIME the difference wraps around and is the larger


def _sums(buf: np.ndarray, pw: np.ndarray) -> np.ndarray:
    """Prefix sums, from 0, of the bytes' terms: under 2**62 also for long stretches."""
    out = np.zeros(len(buf) + 1, _U)
    terms = out[1:]
    terms[:] = buf
    terms += _U(1)
    terms *= pw[: len(buf)]
    if len(buf) > 1 << 22:
        _fold(terms)
    np.cumsum(terms, out=terms)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, in place."""
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    x *= _U(0xA0761D6478BD642F)
    x ^= x >> _U(32)
    return x


@lru_cache
def _quick_powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        x = np.full(n, b, _U)
        x[0] = 1
        out.append(np.cumprod(x))
    return out[0], out[1]


def window_hashes(buf: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """The quick fingerprint of each k-byte window of buf; k is at most 512."""
    if k > 512:
        raise ValueError("windows are of 512 bytes at most")
    n = len(buf) - k + 1
    out = np.empty(max(0, n), _U)
    pw, inv = _quick_powers(QUICK[which], SEGMENT + k)
    for lo in range(0, n, SEGMENT):
        m = min(SEGMENT, n - lo)
        p = np.zeros(m + k, _U)
        np.cumsum((buf[lo : lo + m + k - 1].astype(_U) + _U(1)) * pw[: m + k - 1], out=p[1:])
        part = out[lo : lo + m]
        np.multiply(p[k:] - p[:m], inv[:m], out=part)
        mix(part)
    return out


def hashes_at(buf: np.ndarray, start: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """window_hashes(buf, k, which)[start] for ascending starts, at the cost of prefix sums and these alone."""
    if k > 512:
        raise ValueError("windows are of 512 bytes at most")
    out = np.empty(len(start), _U)
    pw, inv = _quick_powers(QUICK[which], SEGMENT + k)
    lo = 0
    while lo < len(start):
        at = int(start[lo]) // SEGMENT * SEGMENT
        hi = int(np.searchsorted(start, at + SEGMENT))
        j = start[lo:hi] - at
        m = int(j[-1]) + k
        p = np.zeros(m + 1, _U)
        np.cumsum((buf[at : at + m].astype(_U) + _U(1)) * pw[:m], out=p[1:])
        np.multiply(p[j + k] - p[j], inv[j], out=out[lo:hi])
        lo = hi
    return mix(out)


def range_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """The fingerprint of each range [start, end) of buf, start ascending; ranges of any length."""
    out = np.zeros(len(start), _U)
    lo = 0
    while lo < len(start):
        at = int(start[lo])
        hi = max(int(np.searchsorted(start, at + SEGMENT)), lo + 1)
        far = int(end[lo:hi].max())
        s, e = start[lo:hi] - at, end[lo:hi] - at
        part = out[lo:hi]
        for b in MULTIPLIERS[which]:
            pw, inv = powers(b, far - at + 1)
            p = _sums(buf[at:far], pw)
            part <<= _U(32)
            part |= _times(p[e] - p[s], inv[s])
        lo = hi
    return mix(out)


def minimizers(keys: np.ndarray, w: int) -> np.ndarray:
    """For each window of w consecutive keys the index of its least key, the leftmost among equals."""
    n = len(keys) - w + 1
    if n <= 0:
        return np.empty(0, np.int64)
    out = np.empty(n, np.int64)
    step = 1 << 18
    low = _U((1 << 20) - 1)
    for lo in range(0, n, step):
        m = min(step, n - lo)
        x = (keys[lo : lo + m + w - 1] & ~low) | np.arange(m + w - 1, dtype=_U)
        size = 1
        while 2 * size <= w:
            x = np.minimum(x[: len(x) - size], x[size:])
            size *= 2
        if size < w:
            x = np.minimum(x[:m], x[w - size : w - size + m])
        out[lo : lo + m] = (x[:m] & low).astype(np.int64) + lo
    return out


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


@lru_cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return None


def give_back() -> None:
    """Return freed memory to the system: a worker stays between tasks, next to others on its executor."""
    pa.default_memory_pool().release_unused()
    if trim := _libc():
        trim(0)


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 22):
    """The batch in runs of rows whose texts have at most so many bytes together, or one row."""
    lengths = np.array(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), np.int64)
    ends = np.cumsum(lengths)
    lo = 0
    while lo < batch.num_rows:
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi
    give_back()


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(buf: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return _LOWER[buf]


def words_of(buf: np.ndarray, off: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word: a maximal run of bytes within a text that letter[byte] admits."""
    if not len(buf):
        return (np.empty(0, np.int64),) * 3
    inside = letter[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(off, s, "right") - 1


#: Bytes that aren't ASCII white space or control characters.
NOT_SPACE = np.arange(256) > 32
