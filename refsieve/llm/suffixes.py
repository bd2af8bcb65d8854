"""A suffix array in two stages, and common prefixes of neighbours, over bytes in numpy.

A suffix is *rising* if it is smaller than the one after it, else *falling*. Only rising suffixes are
compared; each falling one follows from its successor by scans over buckets of the first byte.
Suffixes need their order only as far as ``depth`` bytes, and only those in a given mask: what the
scans need besides, the successors of falling suffixes up to the next rising one, is added here.
"""

from __future__ import annotations

import numpy as np

_U8 = np.dtype(">u8")


def rising(data: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last is not."""
    n = len(data)
    if not n:
        return np.zeros(0, bool)
    differs = np.flatnonzero(data[:-1] != data[1:])
    # Equal bytes take the answer of the next difference, at the end that of the last suffix.
    up = np.append(data[differs] < data[differs + 1], False)
    return up[np.searchsorted(differs, np.arange(n))]


def padded(data: np.ndarray, depth: int) -> np.ndarray:
    return np.concatenate([data, np.zeros(depth + 16, np.uint8)])


def _eight(pad: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number that sorts like them."""
    every = np.lib.stride_tricks.sliding_window_view(pad, 8)
    return every[at].view(_U8).ravel().astype(np.uint64)


def sorted_directly(pad: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` by ``depth`` bytes from there on, eight at a time; only ties are looked at again."""
    key = _eight(pad, places)
    order = np.argsort(key, kind="stable")
    places, key = places[order], key[order]
    new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
    for at in range(8, depth, 8):
        group = np.cumsum(new) - 1
        tied = np.flatnonzero((np.bincount(group) > 1)[group]) if len(group) else group
        if not len(tied):
            break
        key, of = _eight(pad, places[tied] + at), group[tied]
        order = np.lexsort((key, of))
        places[tied] = places[tied][order]
        key = key[order]
        differs = np.append(True, (key[1:] != key[:-1]) | (of[1:] != of[:-1]))
        new[tied] = differs
    return places


def suffix_order(data: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``wanted`` in the order of their first ``depth`` bytes (ends sort first)."""
    n = len(data)
    up = rising(data)
    # Chains of falling suffixes end at the next rising one, or at the end of all.
    ends = np.append(np.flatnonzero(up), n)
    last = ends[np.searchsorted(ends, np.arange(n))]
    at = np.flatnonzero(wanted)
    depth_of = np.zeros(n + 2, np.int64)
    np.add.at(depth_of, at, 1)
    np.add.at(depth_of, last[at] + 1, -1)
    held = np.cumsum(depth_of[: n + 1]) > 0
    pad = padded(data, depth)
    stars = np.flatnonzero(up & held[:n])
    stars = sorted_directly(pad, stars, depth)
    falling = ~up & held[:n]
    begins = np.searchsorted(data[stars], np.arange(257))
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []

    def scan(places: np.ndarray) -> None:
        """Hand the falling predecessors of sorted suffixes to their buckets, in that order."""
        before = places[places > 0] - 1
        before = before[falling[before]]
        if len(before):
            byte = data[before]
            order = np.argsort(byte, kind="stable")
            before, byte = before[order], byte[order]
            cuts = np.flatnonzero(np.append(True, byte[1:] != byte[:-1]))
            for part, b in zip(np.split(before, cuts[1:]), byte[cuts].tolist()):
                pending[b].append(part)

    if n and falling[n - 1]:
        # The last suffix is followed by nothing, the least suffix of all.
        pending[data[n - 1]].append(np.array([n - 1]))
    for b in range(256):
        done = 0
        while done < len(pending[b]):
            run = np.concatenate(pending[b][done:])
            done = len(pending[b])
            out.append(run)
            scan(run)
        part = stars[begins[b]: begins[b + 1]]
        if len(part):
            out.append(part)
            scan(part)
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[wanted[order]]


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes, up to ``most``, that each suffix of ``order`` shares with the one before it."""
    pad = padded(data, most)
    shared = np.zeros(max(len(order) - 1, 0), np.int64)
    open_ = np.arange(len(shared))
    for at in range(0, most, 8):
        differs = _eight(pad, order[open_] + at) ^ _eight(pad, order[open_ + 1] + at)
        equal = differs == 0
        part = open_[~equal]
        # Leading zero bits of the difference; floats hold the place of the highest bit.
        high = np.frexp((differs[~equal] >> np.uint64(8)).astype(np.float64))[1]
        shared[part] = at + np.where(high > 0, 7 - (high + 7) // 8, 7)
        open_ = open_[equal]
        if not len(open_):
            break
    shared[open_] = most
    return np.minimum(shared, most)
