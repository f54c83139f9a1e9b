"""Suffix sorting by prefix doubling, in numpy."""

from __future__ import annotations

import numpy as np


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks by ``keys`` (a rank is the number of smaller keys), and the places whose rank is shared."""
    n = len(keys)
    order = np.argsort(keys)
    sorted_ = keys[order]
    change = np.ones(n, bool)
    change[1:] = sorted_[1:] != sorted_[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(change, np.arange(n), 0))
    sizes = np.diff(np.append(np.flatnonzero(change), n))
    return rank, order[np.repeat(sizes > 1, sizes)]


def refine(rank: np.ndarray, step: int, todo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks by twice the prefix length, and the places whose rank is still shared.

    Unique ranks never change, so only the shared ones are sorted again.
    """
    n = len(rank)
    after = todo + step
    second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
    order = np.argsort(rank[todo] * (n + 1) + second)
    at, first, second = todo[order], rank[todo][order], second[order]
    new_group = np.ones(len(at), bool)
    new_group[1:] = first[1:] != first[:-1]
    change = new_group.copy()
    change[1:] |= second[1:] != second[:-1]
    place = np.arange(len(at))
    group_start = np.maximum.accumulate(np.where(new_group, place, 0))
    part_start = np.maximum.accumulate(np.where(change, place, 0))
    out = rank.copy()
    out[at] = first + (part_start - group_start)
    sizes = np.diff(np.append(np.flatnonzero(change), len(at)))
    return out, at[np.repeat(sizes > 1, sizes)]
