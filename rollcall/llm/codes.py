"""Vectorised hashing of the words and bytes of whole Arrow batches.

Two kinds of hashes serve two purposes. What decides that things are equal (word_codes, tuples, digests) is not linear in
its input: words and word tuples go through two-lane mixing rounds, long words and blocks through BLAKE2. What only finds
candidates (prefix, spans, windows) is a polynomial over the ring of 64-bit integers, taken from prefix sums. Texts can be
made whose polynomials collide (Thue-Morse sequences do for any base), so equality is never read off these.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 16
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)
_KEYS = [np.uint64(int(x) | 1) for x in mix(np.arange(300, 304, dtype=np.uint64) * np.uint64(BASE))]
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
#: Longer words are hashed by BLAKE2, one by one.
LONG_WORD = 64


def join(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each pair, order kept."""
    return mix((mix(x + _KEYS[0]) ^ y) + ((y << np.uint64(32)) | (y >> np.uint64(32))) * _KEYS[1])


def tuples(values: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive values, joined from tuples of powers of two."""
    m = len(values) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, at, size = None, 0, 1
    while True:
        if n & size:
            out = values[at : at + m] if out is None else join(out, values[at : at + m])
            at += size
        size *= 2
        if size > n:
            return out
        values = join(values[: -size // 2], values[size // 2 :])


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128 bits of BLAKE2 of the bytes of data[start:end] for each pair, as two columns."""
    width, raw = data.itemsize, memoryview(np.ascontiguousarray(data)).cast("B")
    of = hashlib.blake2b
    out = b"".join([of(raw[a:b], digest_size=16).digest() for a, b in zip((starts * width).tolist(), (ends * width).tolist(), strict=True)])
    return np.frombuffer(out, dtype=np.uint64).reshape(-1, 2)


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK + 4096), base, dtype=np.uint64)
        steps[0] = 1
        _powers[base] = have = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(len(values)), out=out[1:])
    return out


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rabin-Karp hash of the values [start, end) for each pair, from prefix(); it finds candidates."""
    back = powers(len(sums), _INVERSE)
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, one after another, and where each begins; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return (raw[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(column) else (raw[:0], np.zeros(1, dtype=np.int64))


def blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts with about size bytes each; a longer text has a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, j
        i = j


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word (a run of bytes other than ASCII white space), and each text's first word."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offsets] = True
    starts, ends = word.copy(), word.copy()
    starts[1:] &= ~word[:-1] | edge[1:-1]
    ends[:-1] &= ~word[1:] | edge[1:-1]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_codes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word, of its A-Z lower-cased if asked: eight bytes a round in two lanes."""
    size = ends - starts
    if not len(size):
        return np.zeros(0, dtype=np.uint64)
    padded = np.zeros(len(raw) + 8, dtype=np.uint8)
    padded[: len(raw)] = LOWER[raw] if lower else raw
    eight = np.ndarray((len(raw) + 1,), dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from every place on
    x = eight[starts] & _MASKS[np.minimum(size, 8)]
    a = mix(x ^ _KEYS[0])
    b = mix((a ^ _KEYS[2]) + x * _KEYS[1])
    more = np.flatnonzero((size > 8) & (size <= LONG_WORD))
    k = 8
    while len(more):
        x = eight[starts[more] + k] & _MASKS[np.minimum(size[more] - k, 8)]
        a[more] = high = mix(a[more] ^ x)
        b[more] = mix((b[more] ^ high) + x * _KEYS[1])
        k += 8
        more = more[size[more] > k]
    out = mix(a + b * _KEYS[3] + size.astype(np.uint64))
    more = np.flatnonzero(size > LONG_WORD)
    if len(more):
        out[more] = digests(padded, starts[more], ends[more])[:, 0]
    return out


def windows(values: np.ndarray, n: int) -> np.ndarray:
    """Rabin-Karp hash of every n consecutive values; it finds candidates."""
    m = len(values) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    at = np.arange(m)
    return spans(prefix(values), at, at + n)


def sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """For each window of w values, the place of its smallest, the leftmost of equals; x uses its upper 40 bits only."""
    n = len(x) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    low = np.uint64((1 << 24) - 1)
    assert len(x) <= 1 << 24
    size = -(-len(x) // w) * w
    y = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
    y[: len(x)] = (x & ~low) | np.arange(len(x), dtype=np.uint64)
    y = y.reshape(-1, w)
    left = np.minimum.accumulate(y, axis=1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(right[:n], left[w - 1 : w - 1 + n]) & low).astype(np.int64)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start .. start + count - 1 of each pair, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    at = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - at, counts)
