"""Suffix arrays by induced sorting, and permuted common prefixes."""

from __future__ import annotations

import numpy as np


def suffix_array(s: list[int], size: int) -> list[int]:
    """Of ``s`` over 0 .. size - 1, whose last symbol is the only 0.

    Suffixes are S-type if smaller than the next one, else L-type; those of S-type after
    an L-type start the leftmost-smaller substrings. These are sorted by inducing from
    their last symbols, named, and if names repeat the string of names is sorted first;
    their order then induces all others' in two linear passes.
    """
    n = len(s)
    if n == 1:
        return [0]
    a = np.array(s)
    small = np.zeros(n, bool)
    small[-1] = True
    # where neighbours are equal the type is that of the next place where they differ
    differs = np.flatnonzero(a[:-1] != a[1:])
    at = np.searchsorted(differs, np.arange(n - 1))
    small[:-1] = (a[:-1] < a[1:])[differs[at]]
    starts = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    kind, lms = small.tolist(), starts.tolist()
    counts = np.bincount(a, minlength=size)
    past = np.cumsum(counts)
    heads, tails = (past - counts).tolist(), past.tolist()

    def induce(seeds: list[int]) -> list[int]:
        out = [-1] * n
        at = tails[:]
        for i in reversed(seeds):
            c = s[i]
            at[c] -= 1
            out[at[c]] = i
        at = heads[:]
        for i in out:  # reads what it writes ahead
            if i > 0 and not kind[i - 1]:
                i -= 1
                c = s[i]
                out[at[c]] = i
                at[c] += 1
        at = tails[:]
        for k in range(n - 1, -1, -1):
            i = out[k] - 1
            if i >= 0 and kind[i]:
                c = s[i]
                at[c] -= 1
                out[at[c]] = i
        return out

    order = induce(lms)
    if len(lms) > 1:
        end = dict(zip(lms, [*lms[1:], n - 1], strict=True))
        name, last, names = -1, None, {}
        for i in order:
            if i in end:
                own = s[i : end[i] + 1]
                if own != last:
                    name, last = name + 1, own
                names[i] = name
        if name + 1 < len(lms):
            ranked = suffix_array([names[i] for i in lms], name + 1)
            order = induce([lms[k] for k in ranked])
        else:
            order = induce([i for i in order if i in end])
    return order


def common_prefixes(s: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """By position in ``s``: the length, up to ``most``, of what its suffix shares with the one before it in ``order``."""
    padded = np.concatenate((s, np.full(most, -1, s.dtype)))
    out, alive = np.zeros(len(s), np.int64), np.arange(1, len(s))
    for d in range(most):
        here, there = order[alive] + d, order[alive - 1] + d
        # two suffixes that both ran out at different places differ there
        alive = alive[(padded[here] == padded[there]) & (padded[here] >= 0)]
        out[order[alive]] += 1
    return out


def repeated(s: list[int], size: int, length: int) -> np.ndarray:
    """By position: whether the ``length`` symbols from there on also start elsewhere. The last symbol is the only 0."""
    order, a = np.array(suffix_array(s, size)), np.array(s)
    prefix = common_prefixes(a, order, length)[order] >= length
    out = np.zeros(len(s), bool)
    out[order] = prefix | np.append(prefix[1:], False)
    return out
