"""Vectorised text kernels shared by the operators of this subpackage.

They work on the raw UTF-8 buffer of an Arrow string array: no Python string is
made for a word.  A word's hash takes eight bytes at a time through a keyed bijection
with avalanche (words over LONG bytes: XXH3), so no family of words collides for its
algebra alone; two different words share a value with a chance of about 2**-63.  Hashes of
short windows chain the words' hashes alike; long windows take a polynomial of them, which two
different windows of fewer than 1,000 words share with a chance of about 2**-54.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
#: Odd base of the word polynomials, and of a second one that is independent of it.
WORD_BASE, OTHER_BASE = 0xD6E8FEB86659FD93, 0xA3C59AC2F1039B6D
#: Keys of the byte and the window hashes.
BYTE_KEY, WINDOW_KEY, OTHER_KEY = 0x9E3779B97F4A7C15, 0x2545F4914F6CDD1D, 0x71D67FFFEDA60000
#: Bytes of a word above which it is hashed alone, and words of a window up to which they are chained.
LONG, CHAINED = 256, 8
#: Keeps the first k bytes of eight.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
#: Bytes that part words: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Lower-cases A-Z alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that one call handles; a longer text is handled alone.
BLOCK_BYTES = 1 << 18

_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call if it is small."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1024, 1 << int(n - 1).bit_length()) if n else 1024
        have = np.full(size, base, U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 22:
            _POWERS[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values with good avalanche."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def blocks(offs: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `most` bytes together, or of one row."""
    at, n = 0, len(offs) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield at, to
        at = to


def word_bounds(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and n + 1 offsets of rows into them."""
    if not len(buf):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offs), np.int64)
    word = ~WHITE[buf]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = offs[:-1][offs[:-1] < offs[1:]]
    begins[inner] = word[inner]
    starts = np.flatnonzero(begins)
    stops = word.copy()
    stops[:-1] &= ~word[1:]
    last = inner[1:] - 1
    stops[last] = word[last]
    stops[-1] = word[-1]
    ends = np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes."""
    sizes = ends - starts
    out = mix(sizes.astype(U64) * U64(BYTE_KEY) + U64(BYTE_KEY))
    eights = np.ndarray((len(buf) + 1,), "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))
    live = np.flatnonzero(sizes <= LONG) if len(sizes) and sizes.max() > LONG else slice(None)
    at, left, state = starts[live], sizes[live], out[live]
    while len(at):
        state = mix((state ^ (eights[at] & MASKS[np.minimum(left, 8)])) + U64(BYTE_KEY))
        out[live] = state
        more = np.flatnonzero(left > 8)
        live = more if isinstance(live, slice) else live[more]
        at, left, state = at[more] + 8, left[more] - 8, state[more]
    for k in np.flatnonzero(sizes > LONG).tolist():
        out[k] = xxhash.xxh3_64_intdigest(buf[starts[k] : ends[k]].tobytes(), BYTE_KEY)
    return out


def word_hashes(buf: np.ndarray, offs: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all rows in order, and n + 1 offsets of rows into them."""
    out, counts = [], [np.zeros(1, np.int64)]
    for a, b in blocks(offs):
        part, own = buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        if lower:
            part = LOWER[part]
        starts, ends, rows = word_bounds(part, own)
        out.append(span_hashes(part, starts, ends))
        counts.append(np.diff(rows))
    return np.concatenate(out) if out else np.zeros(0, U64), np.cumsum(np.concatenate(counts))


def window_hashes(words: np.ndarray, width: int, base: int = WORD_BASE) -> np.ndarray:
    """A hash of each `width` consecutive words, by its first word; rows are not parted here."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    if width <= CHAINED:
        out = mix(words[:n] + U64(WINDOW_KEY))
        for k in range(1, width):
            out = mix((out ^ words[k : k + n]) + U64(WINDOW_KEY))
        return out
    out, step = np.empty(n, U64), 1 << 20
    for at in range(0, n, step):
        part = words[at : at + step + width - 1]
        total = np.zeros(len(part) + 1, U64)
        np.cumsum(part * powers(base, len(part)), out=total[1:])
        m = len(part) - width + 1
        out[at : at + m] = mix((total[width:] - total[:m]) * powers(inverse(base), m))
    return out


def other_window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A second hash of the same windows, independent of the first: both together are 128 bits."""
    return window_hashes(mix(words ^ U64(OTHER_KEY)), width, OTHER_BASE)


def shingles(words: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, ascending within it, and n + 1 offsets.  A row
    of fewer words has one shingle, the whole; a row of none has none."""
    counts = np.diff(rows)
    full, sizes = window_hashes(words, width), []
    for a, n in zip(rows[:-1].tolist(), counts.tolist(), strict=True):
        if n >= width:
            own = np.sort(full[a : a + n - width + 1])
            keep = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            sizes.append(own[keep])
        elif n:
            sizes.append(mix(window_hashes(words[a : a + n], n) + U64(n)))
        else:
            sizes.append(full[:0])
    return np.concatenate([full[:0], *sizes]), np.cumsum([0, *map(len, sizes)])
