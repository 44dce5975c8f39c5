"""Vectorised word and shingle hashing over Arrow string columns.

A word is a run of bytes other than 0x20 and 0x09-0x0D.  Texts are handled as
UTF-8 in blocks of about a megabyte, so memory follows the block (or the longest
single text), not the partition.  Hashes of words and shingles are 64 bits wide;
whole texts are told apart by 128 bits.
"""

from __future__ import annotations

import ctypes
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK_BYTES = 1 << 20

_U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.Generator(np.random.PCG64(20240917))
_SLOT = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k bytes of eight


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> _U(31))
    h *= _U(0x7FB5D329728EA185)
    h ^= h >> _U(27)
    h *= _U(0x81DADEF4BC2DD44D)
    h ^= h >> _U(33)
    return h


@dataclass
class Block:
    """Some whole texts: bytes, text bounds, and the words in them."""

    buf: np.ndarray
    offs: np.ndarray
    first: int
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # the words of text i are bounds[i]:bounds[i + 1]

    def __len__(self) -> int:
        return len(self.offs) - 1

    def span_hashes(self, a: np.ndarray, b: np.ndarray, lower: bool = False) -> np.ndarray:
        """Hashes of the byte spans a[i]:b[i]: up to 16 bytes by two mixed lanes, longer ones by XXH3."""
        if not len(a):
            return np.empty(0, np.uint64)
        padded = np.zeros(len(self.buf) + 24, np.uint8)
        padded[: len(self.buf)] = _LOWER[self.buf] if lower else self.buf
        lanes = np.ndarray((len(self.buf) + 17,), "<u8", padded.data, strides=(1,))
        size = b - a
        h = mix((lanes[a] & _KEEP[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * _U(0xA0761D6478BD642F)))
        more = np.flatnonzero(size > 8)
        if len(more):
            high = lanes[a[more] + 8] & _KEEP[np.minimum(size[more] - 8, 8)]
            h[more] = mix(h[more] * _U(0xE7037ED1A0B428DB) + mix(high ^ _U(0x8EBC6AF09C88C6E3)))
        long = np.flatnonzero(size > 16)
        if len(long):
            view = memoryview(padded)
            h[long] = [xxhash.xxh3_64_intdigest(view[i:j]) for i, j in zip(a[long].tolist(), b[long].tolist(), strict=True)]
        return h

    def word_hashes(self, lower: bool = False) -> np.ndarray:
        return self.span_hashes(self.starts, self.ends, lower)

    def text(self, i: int) -> bytes:
        return self.buf[self.offs[i] : self.offs[i + 1]].tobytes()


def _as_strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    n = len(column)
    offs = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), offs


def find_words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and where each text's words begin."""
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    space = SPACE[buf]
    before = np.empty(len(buf) + 1, bool)
    before[0] = before[-1] = True
    before[1:-1] = space[:-1]
    before[offs[offs < len(buf)]] = True
    starts = np.flatnonzero(~space & before[:-1])
    after = np.empty(len(buf), bool)
    after[-1] = True
    after[:-1] = space[1:]
    inner = offs[(offs > 0) & (offs <= len(buf))] - 1
    after[inner] = True
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """A string column as blocks of whole texts; nulls are empty texts."""
    data, offs = _as_strings(column)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, n)
        buf, own = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        yield Block(buf, own, i, *find_words(buf, own))
        i = j


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch in parts of a few rows, for work that makes Python objects of them."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def lean_memory() -> None:
    """Arrow takes its memory from the C library, so `give_back` can return it."""
    pa.set_memory_pool(pa.system_memory_pool())


def give_back() -> None:
    """Return free memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def one_block(text: str | None) -> Block:
    return next(blocks(pa.array([text or ""], pa.large_string()), 1 << 62))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows of one text; of all its words where it has fewer."""
    m = min(n, len(words))
    if not m:
        return np.empty(0, np.uint64)
    count = len(words) - m + 1
    h = np.full(count, (0xA0761D6478BD642F * m) & (2**64 - 1), np.uint64)
    for k in range(m):
        h += words[k : k + count] * _SLOT[k]
    return mix(h)


def signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64, copy=False).view(np.int64)


def key_of(values: np.ndarray) -> tuple[int, int]:
    """A 128-bit XXH3 hash of an array of hashes (a word sequence, or a sorted set), as two signed integers."""
    return struct.unpack("<qq", xxhash.xxh3_128_digest(np.ascontiguousarray(values))) if len(values) else (0, 0)


def node_of(values: np.ndarray, clashing: frozenset[int] = frozenset()) -> int:
    """The half of `key_of` that stands for values: the first, unless other values share it."""
    first, second = key_of(values)
    return second if first in clashing else first
