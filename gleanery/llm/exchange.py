"""Ascending 64-bit hashes dealt to buckets, as blocks send them and get answers back.

A hash's bucket is its share of the whole range, so hashes in order are in order of
their buckets, and the answers of all buckets, one after the other, are in the order of
the hashes asked.
"""

from __future__ import annotations

import numpy as np


def edges(ascending: np.ndarray, n_buckets: int) -> np.ndarray:
    """Where each bucket's hashes start in ``ascending`` (one more than buckets)."""
    starts = np.array([((b << 64) + n_buckets - 1) // n_buckets for b in range(n_buckets)], np.uint64)
    return np.append(np.searchsorted(ascending, starts), len(ascending))


def pack_ascending(hashes: np.ndarray) -> bytes:
    """Differences, by byte plane: the high planes are all zero where hashes stand close."""
    steps = np.diff(hashes, prepend=np.uint64(0))
    return np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_ascending(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1).astype(np.uint64), dtype=np.uint64)


def bucket(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    n, low = np.uint64(n_buckets), np.uint64(32)
    return (((hashes >> low) * n + ((hashes & np.uint64(0xFFFFFFFF)) * n >> low)) >> low).astype(np.int64)


def named(hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """A number for each pair of hash and second hash, from 0 in the order of the hashes."""
    order = np.lexsort((checks, hashes))
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (checks[order][1:] != checks[order][:-1])
    out = np.empty(len(hashes), np.int64)
    out[order] = np.cumsum(new) - 1
    return out
