"""Words of UTF-8 texts as NumPy arrays: byte classes, 64-bit word hashes, hashes of word runs.

All word definitions used here end words at ASCII bytes only, so they hold on UTF-8 bytes as on code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_RUN = np.uint64(0xD1342543DE82EF95)
#: Masks of the first 0 to 8 bytes of a little-endian integer; words of more bytes are hashed one by one.
_FIRST, LONG = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64), 128
#: Bytes of text handled at a time; a longer text is a piece of its own.
PIECE = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SPACES = bytes([32, *range(9, 14)])
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[list(SPACES)] = False

LETTERS = np.zeros(256, bool)
LETTERS[48:58] = LETTERS[65:91] = LETTERS[97:123] = True
LETTERS[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, A-Z as a-z.  Each eight bytes are mixed in turn, so no structure of a word carries over
    to its hash as it would with sums of powers; words over LONG bytes have a BLAKE2b digest."""
    low = np.zeros(len(raw) + 8, np.uint8)
    low[:len(raw)] = LOWER[raw]
    eight = np.ndarray((len(raw) + 1,), "<u8", low, 0, (1,))  # the eight bytes from each place on
    length = ends - starts
    out = mix(length.astype(np.uint64) + _MULT)
    own, at = np.flatnonzero(length <= LONG), 0
    while len(own):
        left = length[own] - at
        out[own] = mix((out[own] ^ (eight[starts[own] + at] & _FIRST[np.minimum(left, 8)])) * _MULT)
        own, at = own[left > 8], at + 8
    for k in np.flatnonzero(length > LONG).tolist():
        out[k] = int.from_bytes(blake2b(low[starts[k]:ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def pieces(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows) for runs of rows of about PIECE bytes."""
    texts = texts.cast(pa.large_utf8())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
        yield at, raw[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
        at = end


def words(raw: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends, hashes (A-Z as a-z) and the first word of each row, with one more at the end."""
    inside = kind[raw]
    before, after = np.empty_like(inside), np.empty_like(inside)
    if len(raw):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(raw))]
        before[edges] = False
        after[edges - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, word_hashes(raw, starts, ends), np.searchsorted(starts, offsets)


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, size):
        out = out * _RUN + hashes[j:j + n]
    return mix(out + np.uint64(size))
