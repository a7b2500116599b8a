"""Numpy kernels over Arrow string columns, used inside Spark tasks.

Texts of a record batch lie end to end in one byte buffer.  The kernels work on
slices of a few megabytes of it, so that a task's memory does not depend on the
length of its partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

#: Bytes of text that the kernels look at together.  A longer text is a slice of its own.
SLICE_BYTES = 2 << 20

_U64 = np.uint64
_PRIME = 0x9E3779B97F4A7C15
_ASCII_SPACES = (9, 10, 11, 12, 13, 32)

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(_ASCII_SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass(frozen=True)
class Texts:
    """Consecutive texts of a batch: rows ``first`` to ``first + len(bounds) - 2``."""

    first: int
    data: np.ndarray  # uint8
    bounds: np.ndarray  # int64, text i is data[bounds[i]:bounds[i + 1]]

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()


def texts_of(column: pa.Array | pa.ChunkedArray, slice_bytes: int = SLICE_BYTES) -> Iterator[Texts]:
    """The texts of a string column in slices; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(bounds, bounds[at] + slice_bytes, "right")) - 1
        end = min(max(end, at + 1), len(column))
        yield Texts(at, data[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at])
        at = end


@dataclass(frozen=True)
class Words:
    """Words (runs without ASCII white space) of some texts."""

    starts: np.ndarray
    ends: np.ndarray
    per_text: np.ndarray  # how many words each text has

    @property
    def bounds(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.per_text)))


def words_of(texts: Texts) -> Words:
    inside = ~IS_SPACE[texts.data]
    n = len(inside)
    if not n:
        nothing = np.zeros(0, np.int64)
        return Words(nothing, nothing, np.zeros(len(texts), np.int64))
    edge = np.zeros(n + 1, bool)
    edge[texts.bounds] = True
    edge[0] = edge[n] = True
    first = inside & edge[:n]
    first[1:] |= inside[1:] & ~inside[:-1]
    last = inside & edge[1:]
    last[:-1] |= inside[:-1] & ~inside[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    per_text = np.diff(np.searchsorted(starts, texts.bounds, "left"))
    return Words(starts, ends, per_text)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values over all bits."""
    x = x ^ (x >> _U64(30))
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _U64(_PRIME))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_PRIME, -1, 1 << 64)
    one = np.ones(1, np.uint64)
    return tuple(np.concatenate((one, np.cumprod(np.full(n, p, np.uint64)))) for p in (_PRIME, inverse))


def _running_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the polynomial up to each byte, and the powers that bring them back to a span's own start."""
    up, down = _powers(max(SLICE_BYTES, 1 << int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_values()[data] * up[: len(data)], out=sums[1:])
    return sums, down


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, alike wherever the span stands.

    A polynomial modulo 2 ** 64: some different spans of 1,024 bytes and more share it
    whatever its base, so it only deals out work; where a result depends on equality,
    contents are compared (:func:`equal_spans`, :func:`value_digests`)."""
    sums, down = _running_sums(data)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """:func:`span_hashes` of the spans of ``width`` bytes at all places of ``data``, in order."""
    sums, down = _running_sums(data)
    hashes = sums[width:] - sums[: len(sums) - width]
    hashes *= down[: len(hashes)]
    hashes += _U64(width)
    return mix(hashes)


def equal_spans(packed: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """For spans that lie end to end: which are equal, as numbers, and the value of each number.

    Contents are compared, not hashes."""
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    column = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(packed))])
    encoded = column.dictionary_encode()
    return encoded.indices.to_numpy().astype(np.int64), encoded.dictionary


def word_numbers(data: np.ndarray, words: Words) -> tuple[np.ndarray, pa.Array]:
    """The number of each word among the distinct ones of the slice, and these."""
    return equal_spans(data[~IS_SPACE[data]], words.ends - words.starts)


def value_hashes(values: pa.Array) -> np.ndarray:
    """64-bit hashes, no polynomials: different values share one by chance only."""
    return np.array([xxh3_64_intdigest(v) for v in values.to_pylist()], np.uint64)


def value_digests(values: pa.Array) -> np.ndarray:
    """BLAKE2 digests of 16 bytes, as rows of two numbers."""
    made = b"".join([blake2b(v, digest_size=16).digest() for v in values.to_pylist()])
    return np.frombuffer(made, "<u8").reshape(-1, 2)


def run_numbers(numbers: np.ndarray, per_text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all runs of ``width`` words from the numbers of the words, equal where all words are.

    As in :func:`shingle_hashes` a text with fewer words is one run; returns also how many each text has."""
    first, length, counts = _runs(per_text, width)
    out = length.copy()
    for k in range(width):
        nth = np.where(length > k, numbers[np.minimum(first + k, max(0, len(numbers) - 1))] + 1, 0) if len(first) else out
        # two numbers below the count of words and runs fit in one
        out = np.unique(out * (len(numbers) + 2) + nth, return_inverse=True)[1]
    return out, counts


def _runs(per_text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and length of each run, and how many runs each text has."""
    bounds = np.concatenate(([0], np.cumsum(per_text)))
    counts = np.where(per_text >= width, per_text - width + 1, (per_text > 0).astype(np.int64))
    first = np.repeat(bounds[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(int(counts.sum()))
    return first, np.repeat(np.minimum(per_text, width), counts), counts


def shingle_hashes(word_hashes: np.ndarray, per_text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words; a text with fewer words (but some) is one run.

    Returns the hashes, in order of texts, and how many each text has.
    """
    first, length, counts = _runs(per_text, width)
    out = length.astype(np.uint64)
    for k in range(width):
        nth = np.where(length > k, word_hashes[np.minimum(first + k, max(0, len(word_hashes) - 1))], _U64(0)) if len(first) else out
        out = mix(out * _U64(_PRIME) + nth + _U64(k + 1))
    return out, counts
