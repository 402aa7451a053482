"""Words of Arrow text columns as numpy arrays.

Spark hands each task Arrow batches; the helpers here cut a batch into slices
of a few megabytes and find every word of a slice at once. All work is on
UTF-8 bytes: the separators of every word rule used here are ASCII, so a byte
test equals a code point test.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 3 << 20
#: For jobs that leave little of a worker's memory, such as the stages of a pipeline.
LEAN_SLICE_BYTES = 1 << 20

_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of a word `[^\x20\x09-\x0D]+`.
SPACED = ~_SEPARATORS
#: Bytes of a word `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after lower-casing.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (two multiply and xor-shift rounds)."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_P = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_P))
_POWERS = powers(0xD6E8FEB86659FD93, 4096)


def _powers(n: int) -> np.ndarray:
    return _POWERS if n <= len(_POWERS) else powers(0xD6E8FEB86659FD93, n)


@dataclass
class Text:
    """The texts of some rows: bytes, and where each row's bytes start (one more at the end)."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def text_of(column: pa.Array) -> Text:
    """A string column's bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return Text(np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64))
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Text(data[offsets[0] : offsets[-1]], offsets - offsets[0])


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Text]]:
    """The batch in runs of rows of about `most` text bytes; a longer row makes a run alone."""
    whole = text_of(batch.column(column))
    first = 0
    while first < len(whole):
        last = int(np.searchsorted(whole.offsets, whole.offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), len(whole))
        a, b = whole.offsets[first], whole.offsets[last]
        yield batch.slice(first, last - first), Text(whole.data[a:b], whole.offsets[first : last + 1] - a)
        first = last


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after whose last batch the worker gives freed memory back: Spark keeps idle workers for later tasks."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return tidied


@dataclass
class Words:
    """Words of a Text in order: byte bounds, 64-bit hashes, and each row's first word (one more at the end)."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words_of(text: Text, kind: np.ndarray = SPACED, lower: bool = False) -> Words:
    """All words; `kind` says which bytes belong to one."""
    data = LOWER[text.data] if lower else text.data
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, U64), np.zeros(len(text) + 1, np.int64))
    inside = kind[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = False
    before[1:], after[:-1] = inside[:-1], inside[1:]
    bounds = text.offsets[(text.offsets > 0) & (text.offsets < n)]
    before[bounds] = False
    after[bounds - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(starts, text.offsets)
    if len(starts) == 0:
        return Words(starts, ends, np.zeros(0, U64), first)
    return Words(starts, ends, hash_spans(np.where(inside, _BYTE[data], U64(0)), starts, ends), first)


def hash_spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the values in each span; spans are in order and apart, values between them are 0."""
    lo = int(starts[0])
    values = values[lo:]
    steps = np.diff(starts, append=len(values) + lo)
    longest = int(steps.max())
    place = np.arange(len(values)) - np.repeat(starts - lo, steps)
    sums = np.add.reduceat(values * _powers(longest)[place], starts - lo)
    return mix(sums + (ends - starts).astype(U64) * U64(_P))


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` values in a row; the last size-1 places are left out."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for k, p in enumerate(powers(0xA24BAED4963EE407, size)):
        out += hashes[k : k + n] * p
    return mix(out + U64(size * _P % 2**64))


def shingle_sets(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingles, sorted, and where each row's set starts.

    A row with fewer than `size` words, but some, has its whole sequence as one shingle.
    """
    counts = words.counts
    out, sizes = [], np.zeros(len(counts), np.int64)
    all_grams = grams(words.hashes, size)
    for i, (a, n) in enumerate(zip(words.first[:-1].tolist(), counts.tolist(), strict=True)):
        if n >= size:
            s = np.sort(all_grams[a : a + n - size + 1])
            s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif n:
            s = grams(words.hashes[a : a + n], n)
        else:
            continue
        out.append(s)
        sizes[i] = len(s)
    return np.concatenate(out) if out else np.zeros(0, U64), np.concatenate(([0], np.cumsum(sizes)))


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, .. (counts[0] of them), then those of starts[1], and so on."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)
