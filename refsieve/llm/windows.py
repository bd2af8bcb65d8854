"""Hashes of runs of words, and the runs of windows that share an anchor."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import xxhash

from refsieve.llm.common import Words

_U = np.uint64
_A, _B = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)


def word_hashes(words: Words, seed: int) -> np.ndarray:
    """A 64-bit hash of each word; words of a batch are hashed once."""
    code, distinct = words.encoded()
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w, seed) for w in distinct.to_pylist()), np.uint64, len(distinct))[code]


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _A + (b ^ (b >> _U(29))) * _B
    x ^= x >> _U(32)
    x *= _A
    return x ^ (x >> _U(29))


def run_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of ``width`` words from each word on; ``width`` is a power of two."""
    size = 1
    while size < width:
        hashes = mixed(hashes[:-size], hashes[size:]) if len(hashes) > size else hashes[:0]
        size *= 2
    return hashes


def spans_hash(wide: np.ndarray, width: int, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of ``size`` words from ``start`` on, for ``width <= size <= 2 * width``."""
    return mixed(mixed(wide[start], wide[start + size - width]), size.astype(np.uint64))


class Paths(NamedTuple):
    """Runs of successive windows that have one anchor: a path of edges each.

    ``first`` is the word that the first window begins with, ``count`` the number of windows,
    ``anchor`` the hash of the anchor and ``offset`` its place after ``first``.
    """

    first: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    offset: np.ndarray


def anchored_paths(hashes: np.ndarray, words: Words, window: int, gram: int) -> Paths:
    """Windows by the least hash of ``gram`` words in each, ties to the first place.

    Windows of equal words have the same anchor at the same place, so equal windows are always
    found under one anchor.
    """
    nothing = np.zeros(0, np.int64)
    n = len(hashes) - window + 1
    if n <= 0:
        return Paths(nothing, nothing, np.zeros(0, np.uint64), nothing)
    text = words.documents()
    inside = text[:n] == text[window - 1:]
    grams = run_hashes(hashes, gram)
    width = window - gram + 1
    least = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(1) + np.arange(n)
    begin = inside.copy()
    begin[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
    first = np.flatnonzero(begin)
    stop = np.flatnonzero(inside & np.append(begin[1:] | ~inside[1:], True)) + 1
    return Paths(first, stop - first, grams[least[first]], least[first] - first)
