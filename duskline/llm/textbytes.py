"""Vectorised tokenisation of Arrow string batches, straight on their UTF-8 bytes.

A batch is cut into chunks of bounded size (whole documents, a longer one alone), and a chunk is
described by flat numpy arrays: the bytes, where each word starts and ends, which document it is
in, and a 64-bit hash of it. No Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_RNG = np.random.default_rng(20240229)
_ODD = np.uint64(int(_RNG.integers(1 << 62)) * 2 + 1)
_ODD_INV = np.uint64(pow(int(_ODD), -1, 1 << 64))
_BYTE_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_FOLDED_VALUE = _BYTE_VALUE.copy()
_FOLDED_VALUE[65:91] = _BYTE_VALUE[97:123]

#: `[^\x20\x09-\x0D]+`
SPACE_SPLIT = np.zeros(256, bool)
SPACE_SPLIT[[0x20, 9, 10, 11, 12, 13]] = True
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z are folded to a-z
ALNUM_SPLIT = np.ones(256, bool)
ALNUM_SPLIT[0x30:0x3A] = ALNUM_SPLIT[0x61:0x7B] = ALNUM_SPLIT[0x41:0x5B] = False
ALNUM_SPLIT[0x80:] = False

_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the hash base (or of its inverse) modulo 2**64."""
    key = "inv" if inverse else "fwd"
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.full(size, _ODD_INV if inverse else _ODD, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have, out=have)
        if size <= 4 * CHUNK_BYTES:
            _powers[key] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Chunk:
    """Some consecutive documents of a batch.

    first: index of the first document in the batch. data: their bytes. offsets: where each document
    starts, and the end. null: which texts are null (they count as empty).
    """

    first: int
    data: np.ndarray
    offsets: np.ndarray
    null: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The documents of a string array in pieces of at most `limit` bytes, or one document each."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks)
    n = len(texts)
    if not n:
        return
    null = np.asarray(texts.is_null())
    if texts.type != pa.large_string():
        texts = texts.cast(pa.large_string())
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    if null.any() and (np.diff(offsets)[null] > 0).any():
        yield from chunks(texts.fill_null(""), limit)  # never seen from Spark: hidden bytes below a null
        return
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, n)
        own = offsets[at : end + 1]
        yield Chunk(at, data[own[0] : own[-1]], own - own[0], null[at:end])
        at = end


@dataclass
class Words:
    """Words of a chunk: byte ranges, their document's index in the chunk, and a range of words by document."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def spans(chunk: Chunk, is_gap: np.ndarray) -> Words:
    """Maximal runs of bytes that are no gaps; a run never crosses documents."""
    size = len(chunk.data)
    if not size:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(len(chunk) + 1, np.int64))
    inside = ~is_gap[chunk.data]
    begins = np.empty(size, bool)
    begins[0] = True
    np.logical_not(inside[:-1], out=begins[1:])
    heads = chunk.offsets[:-1]
    heads = heads[heads < size]
    begins[heads] = True
    begins &= inside
    ends = np.empty(size, bool)
    ends[-1] = True
    np.logical_not(inside[1:], out=ends[:-1])
    ends[heads[heads > 0] - 1] = True
    ends &= inside
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, chunk.offsets)
    doc = np.repeat(np.arange(len(chunk)), np.diff(first))
    return Words(start, end, doc, first)


def prefix_hash(chunk: Chunk, fold: bool) -> np.ndarray:
    """Prefix sums of value(byte) * base**position; any byte range's hash follows from two of them."""
    value = (_FOLDED_VALUE if fold else _BYTE_VALUE)[chunk.data]
    value *= powers(len(value))
    out = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(value, out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, equal for equal bytes wherever they stand."""
    h = (prefix[end] - prefix[start]) * powers(len(prefix), inverse=True)[start]
    h += (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(h)


def hash_bytes(text: bytes, fold: bool = False) -> int:
    """The hash that `range_hash` gives these bytes."""
    data = np.frombuffer(text, np.uint8)
    prefix = prefix_hash(Chunk(0, data, np.array([0, len(data)]), np.zeros(1, bool)), fold)
    return int(range_hash(prefix, np.array([0]), np.array([len(data)]))[0])


def word_hashes(chunk: Chunk, words: Words, fold: bool) -> np.ndarray:
    return range_hash(prefix_hash(chunk, fold), words.start, words.end)


def windows(hashes: np.ndarray, words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of `width` consecutive words of one document, and the first word of each."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = hashes * powers(n)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(value, out=prefix[1:])
    at = np.flatnonzero(words.doc[: n - width + 1] == words.doc[width - 1 :])
    h = (prefix[at + width] - prefix[at]) * powers(n + 1, inverse=True)[at]
    return mix(h), at


def covered(n: int, at: np.ndarray, width: int) -> np.ndarray:
    """Which of n words a window starting at one of `at` covers."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + width, -1)
    return np.cumsum(step[:-1]) > 0


def sums(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many flags are set in each range first[i]:first[i + 1]."""
    prefix = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=prefix[1:])
    return prefix[first[1:]] - prefix[first[:-1]]
