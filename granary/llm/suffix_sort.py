"""Deep-shallow sorting of many suffixes at once, over numpy arrays.

Each suffix ends at a stop of its own. Multikey quicksort orders suffixes to a shallow depth: every
open group takes a pivot symbol (a word of eight bytes) and splits into the suffixes whose symbol at
the group's depth is less, equal or greater; the equal part moves on to the next symbol. All groups
split in one pass. What remains at that depth are groups with long common prefixes. Blind tries order
those: in every group one suffix is the path of a trie, the first differing byte against it gives each
other suffix its branch (depth and byte), and the branches are tries of their own.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 16
EDGE = 8  # bytes of a symbol


def words_at(padded: np.ndarray, at: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Eight bytes from each ``at`` as a big-endian number; bytes at its stop and beyond count as zero."""
    view = np.ndarray(shape=(len(padded) - EDGE + 1,), dtype=">u8", buffer=padded, strides=(1,))
    out = view[np.minimum(at, len(view) - 1)].astype(np.uint64)
    short = np.flatnonzero(stops - at < EDGE)
    if len(short):
        room = np.clip(stops[short] - at[short], 0, EDGE)
        shift = (8 * (EDGE - room)).astype(np.uint64)
        out[short] = np.where(room > 0, (out[short] >> np.minimum(shift, 63)) << np.minimum(shift, 63), 0)
    return out


def dense(first: np.ndarray) -> np.ndarray:
    """A group's number for each place, from marks at the heads of groups."""
    return np.cumsum(first) - 1


def multikey(padded: np.ndarray, starts: np.ndarray, stops: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by the first ``shallow`` bytes, and the group of each place: suffixes that are equal that far."""
    n = len(starts)
    order, first, depth = np.arange(n), np.zeros(n, bool), np.zeros(n, np.int64)
    first[:1] = True
    key = words_at(padded, starts, stops)
    head, size = np.array([0]), np.array([n])
    while True:
        live = (size > 1) & (depth[head] < shallow)
        head, size = head[live], size[live]
        if not len(head):
            return order, dense(first)
        at = np.cumsum(size) - size
        group = np.repeat(np.arange(len(head)), size)
        place = np.repeat(head - at, size) + np.arange(len(group))
        k = key[place]
        a, b, c = k[at], k[at + size // 2], k[at + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[group]
        side = (k >= pivot).astype(np.int8) + (k > pivot)
        part = group * 3 + side
        counts = np.bincount(part, minlength=3 * len(head))
        offset = np.cumsum(counts) - counts
        to = np.empty(len(part), np.int64)
        for s in range(3):
            own = np.flatnonzero(side == s)
            each = counts[s::3]
            to[own] = np.arange(len(own)) + np.repeat(offset[s::3] - (np.cumsum(each) - each), each)
        moved = np.empty(len(part), np.int64)
        moved[to] = order[place]
        order[place] = moved
        sorted_key = np.empty(len(part), np.uint64)
        sorted_key[to] = k
        key[place] = sorted_key
        some = np.flatnonzero(counts)
        first[place[offset[some]]] = True
        equal = place[to[side == 1]]
        depth[equal] += EDGE
        key[equal] = words_at(padded, starts[order[equal]] + depth[equal], stops[order[equal]])
        head, size = place[offset[some]], counts[some]


def common_prefix(padded: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of pairs of suffixes that agree on ``depth`` bytes, ``length`` at most."""
    out = length.copy()
    open_ = np.flatnonzero(length > depth)
    at = depth
    while len(open_):
        stop = length[open_]
        x = words_at(padded, a[open_] + at, a[open_] + stop) ^ words_at(padded, b[open_] + at, b[open_] + stop)
        hit = np.flatnonzero(x)
        if len(hit):
            out[open_[hit]] = at + np.argmax(x[hit].astype(">u8").view(np.uint8).reshape(-1, EDGE) != 0, axis=1)
        at += EDGE
        open_ = open_[(x == 0) & (stop > at)]
    return out


def blind_tries(padded: np.ndarray, starts: np.ndarray, stops: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Orders suffixes within groups that share ``depth`` bytes; equal suffixes get one group.

    ``group`` is sorted. Returns the order and the new groups in that order.
    """
    n = len(starts)
    order, rank, leaf = np.arange(n), group.astype(np.int64), np.zeros(n, bool)
    length = stops - starts
    while True:
        first = np.ones(n, bool)
        first[1:] = rank[1:] != rank[:-1]
        head = np.flatnonzero(first)
        size = np.diff(np.append(head, n))
        open_ = np.flatnonzero(np.repeat((size > 1) & ~leaf[head], size))
        if not len(open_):
            return order, dense(first)
        path = order[np.repeat(head, size)[open_]]
        own = order[open_]
        least = np.minimum(length[own], length[path])
        lcp = common_prefix(padded, starts[own], starts[path], least, min(depth, int(least.min())))
        here = np.where(lcp < length[own], padded[starts[own] + lcp].astype(np.int64), -1)  # an end comes before every byte
        there = np.where(lcp < length[path], padded[starts[path] + lcp].astype(np.int64), -1)
        same = here == there
        side = np.where(same, 0, np.where(here < there, -1, 1))
        along = np.where(same, 0, np.where(side < 0, lcp, -lcp))
        edge = np.where(same, 0, here)
        by = np.lexsort((edge, along, side, rank[open_]))
        keys = [k[by] for k in (rank[open_], side, along, edge)]
        differs = np.ones(len(by), bool)
        differs[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        order[open_] = order[open_][by]
        leaf[open_] = same[by]
        first[open_] |= differs
        rank = dense(first)


def deep_shallow(buffer: bytes | np.ndarray, starts: np.ndarray, stops: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the suffixes buffer[start:stop].

    Returns their order (indexes into ``starts``) and, along it, a number that equal suffixes share.
    """
    raw = np.frombuffer(buffer, np.uint8) if isinstance(buffer, bytes) else buffer
    padded = np.concatenate([raw, np.zeros(EDGE, np.uint8)])
    starts, stops = np.asarray(starts, np.int64), np.asarray(stops, np.int64)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order, group = multikey(padded, starts, stops, shallow)
    size = np.bincount(group, minlength=len(starts))
    deep = np.flatnonzero(size[group] > 1)
    if len(deep):
        sub, new = blind_tries(padded, starts[order[deep]], stops[order[deep]], group[deep], shallow)
        changed = np.ones(len(starts), bool)
        changed[1:] = group[1:] != group[:-1]
        order[deep] = order[deep][sub]
        differs = np.ones(len(deep), bool)
        differs[1:] = new[1:] != new[:-1]
        changed[deep] |= differs
        group = dense(changed)
    return order, group
