"""Suffix sorting by prefix doubling over integer symbols."""

from __future__ import annotations

import numpy as np


def suffix_ranks(text: np.ndarray) -> np.ndarray:
    """The rank of each suffix; symbol 0 separates, and each separator is a symbol of its own.

    Separators are smaller than all else and ordered by place, so no
    comparison goes past one. The last symbol must be a separator. Groups that
    are told apart leave the sort, so repetitive texts cost log2 of their
    longest repeat in rounds.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    if text[-1] != 0:
        raise ValueError("the text must end with a separator")
    separators = text == 0
    n_sep = int(separators.sum())
    counts = np.bincount(text)
    counts[0] = 0
    rank = (n_sep + np.concatenate([[0], np.cumsum(counts)])[:-1])[text]
    rank[separators] = np.arange(n_sep)
    live = np.flatnonzero((counts[text] > 1) & ~separators)
    small = n < 1 << 20
    reach = 1
    while len(live):
        here, there = rank[live], rank[np.minimum(live + reach, n - 1)]
        if small:
            key = np.sort((here << 40) | (there << 20) | live)
            live, pair = key & 0xFFFFF, key >> 20
            here = key >> 40
        else:
            pair = here * n + there
            order = np.argsort(pair, kind="stable")
            live, pair, here = live[order], pair[order], here[order]
        at = np.arange(len(live))
        new_group = np.concatenate([[True], here[1:] != here[:-1]])
        new_pair = np.concatenate([[True], pair[1:] != pair[:-1]])
        group = np.maximum.accumulate(np.where(new_group, at, 0))
        part = np.maximum.accumulate(np.where(new_pair, at, 0))
        rank[live] = here + part - group
        alone = new_pair & np.concatenate([new_pair[1:], [True]])
        live = live[~alone]
        reach *= 2
    return rank
