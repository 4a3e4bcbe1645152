"""Suffix arrays of byte texts in numpy: Larsson-Sadakane refinement and Kasai's common prefixes, over many texts at once."""

from __future__ import annotations

import numpy as np


def suffix_array(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order; the suffix at i reaches to ends[i] (exclusive), and a shorter one comes before what it begins.

    Suffixes are first ranked by 7 bytes.  Each round then sorts, within the groups that are still tied only, by the rank of what stands h
    bytes further on, and doubles h.  Suffixes of different texts that are equal to their ends stay tied, in order of place.
    """
    n, h = len(data), 7
    place = np.arange(n)
    left = ends - place
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.ndarray((n,), "<u8", padded.data, strides=(1,)).byteswap()  # the first byte counts most
    kept = np.minimum(left, h).astype(np.uint64)
    cut = np.uint64(64) - np.uint64(8) * kept
    key = ((key >> cut) << cut) | kept
    order = np.argsort(key)
    sorted_key = key[order]
    starts = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(starts, place, 0))  # a group's rank: the place of its first member
    tied = _tied(starts)
    tied = tied[left[order[tied]] >= h]
    while len(tied):
        suffixes = order[tied]
        second = np.where(left[suffixes] <= h, 0, rank[np.minimum(suffixes + h, n - 1)] + 1)
        key = (rank[suffixes] << 32) | second
        by = np.argsort(key)
        suffixes, key = suffixes[by], key[by]
        order[tied] = suffixes
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[suffixes] = np.maximum.accumulate(np.where(new, tied, 0))
        last = np.concatenate([new[1:], [True]])
        tied = tied[~(new & last)]
        h *= 2
        tied = tied[left[order[tied]] >= h]
    groups = rank[order]
    tied = _tied(np.concatenate([[True], groups[1:] != groups[:-1]]))
    order[tied] = order[tied][np.argsort((groups[tied] << 32) | order[tied])]
    return order


def _tied(starts: np.ndarray) -> np.ndarray:
    """Places in groups of two or more."""
    last = np.concatenate([starts[1:], [True]])
    return np.flatnonzero(~(starts & last))


def common_prefixes(data: np.ndarray, ends: np.ndarray, order: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """For each place in the order, the bytes that its suffix shares with the one before it (0 for the first).

    Kasai's rule: the suffix that starts one byte later shares at most one byte less with the one before it, so each comparison goes on
    from there.  All texts (their starts in `texts`) take the step together.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int64)
    at, stop = texts.copy(), ends[texts]
    length = np.zeros(len(texts), np.int64)
    while len(at):
        other = before[at]
        length[other < 0] = 0
        limit = np.where(other < 0, 0, np.minimum(stop - at, ends[other] - other))
        length = np.minimum(length, limit)
        active = np.flatnonzero(length < limit)
        while len(active):
            same = data[at[active] + length[active]] == data[other[active] + length[active]]
            active = active[same]
            length[active] += 1
            active = active[length[active] < limit[active]]
        shared[at] = length
        at, length = at + 1, np.maximum(length - 1, 0)
        going = at < stop
        at, stop, length = at[going], stop[going], length[going]
    return shared[order]
