"""Repeated n-grams of many token lists at once, by rolling hashes in numpy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_BASE = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def first_repeats(lists: Sequence[Sequence[str]], lengths: Sequence[int], places: int) -> list[tuple[int, int] | None]:
    """For each list the first of ``lengths`` with an n-gram said again without overlap, and where that n-gram first
    stands: (n, start), or None. Only the first ``places`` places of an n-gram count, two of them in a row at least n apart.
    All lists are hashed and sorted together; equal hashes are compared word by word."""
    known: dict[str, int] = {}
    numbers = np.array([known.setdefault(w, len(known) + 1) for words in lists for w in words], np.uint64)
    sizes = np.array([len(x) for x in lists], np.int64)
    docs = np.repeat(np.arange(len(lists)), sizes)
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(numbers))
    out: list[tuple[int, int] | None] = [None] * len(lists)
    begins = np.cumsum(sizes) - sizes
    open_docs = np.ones(len(lists), bool)
    for n in lengths:
        starts = np.flatnonzero((room >= n) & open_docs[docs]) if len(numbers) else np.zeros(0, np.int64)
        if not len(starts):
            continue
        h = np.zeros(len(starts), np.uint64)
        for j in range(n):
            h = h * _BASE + numbers[starts + j]
        h = _mixed(h ^ _mixed(docs[starts].astype(np.uint64) + np.uint64(n)))
        order = np.argsort(h, kind="stable")  # places of an n-gram stay in order
        at, key = starts[order], h[order]
        same = np.concatenate([[False], (key[1:] == key[:-1]) & (docs[at[1:]] == docs[at[:-1]])])
        for j in range(n):  # a hash is no proof
            same[1:] &= numbers[at[1:] + j] == numbers[at[:-1] + j]
        place = np.arange(len(at))
        first = np.maximum.accumulate(np.where(same, 0, place))
        hit = np.flatnonzero(same & (place - first < places) & (at - np.concatenate([[0], at[:-1]]) >= n))
        least = np.full(len(lists), np.iinfo(np.int64).max)
        np.minimum.at(least, docs[at[hit]], at[first[hit]])
        for d in np.flatnonzero(least != np.iinfo(np.int64).max):
            out[d] = n, int(least[d] - begins[d])
            open_docs[d] = False
    return out
