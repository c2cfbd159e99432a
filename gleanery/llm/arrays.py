"""Vectorised hashing of bytes and words for Arrow batches.

Hashes are 64-bit polynomials over random byte values, taken for any stretch of bytes
from one running sum, and mixed at the end. Texts are handled in chunks of whole
documents, so that the temporaries stay small however many rows a batch has.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_rng = np.random.Generator(np.random.PCG64(20240521))
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
#: A second table of byte values, for a second hash that is independent of the first.
CHECK = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACE_BITS = np.uint64(26)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _libc = None
_powers: dict[str, np.ndarray] = {"n": np.zeros(0)}


def trim() -> None:
    """Gives freed memory back, as workers stay for later stages and the allocators would keep it."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["n"]) < n:
        size = max(n, CHUNK)
        with np.errstate(over="ignore"):
            for name, base in (("n", BASE), ("inverse", INVERSE)):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                _powers[name] = np.cumprod(x)
    return _powers["n"], _powers["inverse"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each starts (one more than texts); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(data: np.ndarray, at: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, past, bytes, starts) of runs of whole documents of about ``size`` bytes."""
    first, n = 0, len(at) - 1
    while first < n:
        past = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        yield first, past, data[at[first] : at[past]], at[first : past + 1] - at[first]
        first = past


def slices(batch: pa.RecordBatch, column: str, size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows with about ``size`` bytes in ``column``, so that what is derived from them stays small, too."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    first, n = 0, batch.num_rows
    while first < n:
        past = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + size, "right")))
        yield batch.slice(first, past - first)
        first = past
    trim()


def summed(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``stretch`` takes the hash of any stretch; one longer than ``values``."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def running(data: np.ndarray, values: np.ndarray = BYTE) -> np.ndarray:
    """``summed`` of the bytes' values."""
    return summed(values[data])


def stretch(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unmixed hashes of bytes [start, end)."""
    return (sums[end] - sums[start]) * powers(len(sums))[1][start]


def smallest(x: np.ndarray, size: int) -> np.ndarray:
    """The minimum of each run of ``size`` values."""
    n = len(x) - size + 1
    padded = np.concatenate((x, np.full(-len(x) % size, ~np.uint64(0)))).reshape(-1, size)
    left = np.minimum.accumulate(padded, axis=1).reshape(-1)
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[size - 1 : size - 1 + n])


def smallest_at(hashes: np.ndarray, size: int) -> np.ndarray:
    """Where the smallest of each run of ``size`` hashes stands (by their high bits; the first of equal ones)."""
    best = np.empty(len(hashes) - size + 1, np.int64)
    step = 1 << 20
    for s in range(0, len(best), step):  # places are counted from s, so that they fit however long a document is
        own = hashes[s : s + step + size - 1]
        key = (own >> PLACE_BITS) << PLACE_BITS | np.arange(len(own)).astype(np.uint64)
        best[s : s + step] = s + (smallest(key, size) & np.uint64((1 << 26) - 1)).astype(np.int64)
    return best


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs free of ASCII white space), and each document's first word (one more than documents)."""
    full = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.concatenate(([False], full[:-1])) if len(data) else full
    after = np.concatenate((full[1:], [False])) if len(data) else full
    starts = np.flatnonzero(full & (~before | edge[:-1]))
    ends = np.flatnonzero(full & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a chunk, lower-casing A-Z: mixed hashes of the words, and each document's first word."""
    low = LOWER[data]
    starts, ends, first = word_bounds(low, at)
    # the length goes in, so that no two words of different length share a sum
    return mix(stretch(running(low), starts, ends) + (ends - starts).astype(np.uint64)), first


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Mixed hashes of all runs of n words, whatever documents they stand in."""
    k = len(hashes) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(k, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(3) + hashes[i : i + k])
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return np.arange(total, dtype=np.int64) + shift
