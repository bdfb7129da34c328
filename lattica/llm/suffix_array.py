"""Suffix arrays by two-stage sorting, vectorised.

Stage one sorts only the suffixes that are smaller than their successors
(type S). A text is read as symbols 2 * byte + type; the symbols from one
type-S place to the next, both included, are a block, and no block is a proper
prefix of another. Blocks are ranked, and ranks of runs of blocks by prefix
doubling. Stage two induces the order of all others (type L): buckets of first
bytes are scanned in order, and each suffix met puts its predecessor, if that
is of type L, at the end of its bucket's L part.

Sorting stops when every suffix is ordered by its first ``depth`` bytes; those
that agree on them stand together, in any order.
"""

from __future__ import annotations

import numpy as np

#: Ranks, second ranks and places are packed in one 63-bit key, so that a text has fewer bytes than this.
MOST = 1 << 21
_PLACE = np.int64(MOST - 1)


def types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor. The empty suffix is the smallest."""
    n = len(text)
    step = np.zeros(n, dtype=np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
    step[n - 1] = -1
    at = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of non-negative keys under 2^42 and their dense ranks, by one sort of packed integers."""
    packed = np.sort((keys << np.int64(21)) | np.arange(len(keys), dtype=np.int64))
    order = packed & _PLACE
    high = packed >> np.int64(21)
    rank = np.empty(len(keys), dtype=np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(high[1:] != high[:-1])])
    return order, rank


def _block_ranks(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Dense ranks (from 1) of the blocks; the last block ends with the text."""
    lengths = np.diff(np.append(starts, len(symbols))) + 1
    padded = np.concatenate([symbols.astype(np.int64) + 1, np.zeros(8, dtype=np.int64)])

    def key(at: np.ndarray, left: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(len(at), dtype=np.int64)
        for j in range(k):
            out = out * 514 + np.where(j < left, padded[np.minimum(at + j, len(padded) - 1)], 0)
        return out

    rank = _dense(key(starts, lengths, 4))[1]  # 514^4 < 2^42
    long, done = np.flatnonzero(lengths > 4), 4
    if not len(long):
        return rank + 1
    # a longer block shares its rank only with longer blocks, so these are ranked among themselves
    own, live = rank[long], np.arange(len(long))
    while len(live):
        at = long[live]
        more = np.zeros(len(long), dtype=np.int64)
        more[live] = key(starts[at] + done, lengths[at] - done, 2)
        own = _dense(own * 514**2 + more)[1]  # ranks have 21 bits
        done += 2
        live = live[lengths[at] > done]
    spread = np.zeros(len(starts), dtype=np.int64)
    spread[long] = own
    return _dense((rank << np.int64(21)) | spread)[1] + 1


def sort_smaller(text: np.ndarray, small: np.ndarray, depth: int) -> np.ndarray:
    """Stage one: the places of type S in the order of their suffixes' first ``depth`` bytes."""
    starts = np.flatnonzero(small)
    m = len(starts)
    if not m:
        return starts
    rank = _block_ranks(2 * text.astype(np.int16) + small, starts)
    order = _dense(rank)[0]
    run = 1
    ends = np.append(starts, np.full(1, len(text)))
    while run < m:
        reach = ends[np.minimum(np.arange(m) + run, m)] - starts
        if rank.max() == m or (reach >= np.minimum(depth, len(text) - starts)).all():
            break
        second = np.zeros(m, dtype=np.int64)
        second[:-run] = rank[run:]
        order, rank = _dense((rank << np.int64(21)) | second)
        rank += 1
        run *= 2
    return starts[order]


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """All places, in the order of the first ``depth`` bytes of their suffixes. ``text``: unsigned bytes, fewer than MOST."""
    n = len(text)
    if n >= MOST:
        raise ValueError("too long a text for one suffix array")
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    small = types(text)
    direct = sort_smaller(text, small, depth)
    chars = np.unique(text).tolist()
    bounds = np.searchsorted(text[direct], np.arange(257))  # direct is sorted by first byte
    larger: dict[int, list[np.ndarray]] = {c: [] for c in chars}
    larger[int(text[n - 1])].append(np.array([n - 1], dtype=np.int64))  # induced by the empty suffix
    out = []

    def induce(found: np.ndarray, same: int) -> np.ndarray:
        """Put the type-L predecessors of ``found`` into their buckets; those of bucket ``same`` are returned."""
        before = found[found > 0] - 1
        before = before[~small[before]]
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cuts = np.flatnonzero(np.diff(first)) + 1
        again = before[:0]
        for part in np.split(before, cuts) if len(before) else ():
            c = int(text[part[0]])
            if c == same:
                again = part
            else:
                larger[c].append(part)
        return again

    for c in chars:
        part = np.concatenate(larger.pop(c)) if larger[c] else direct[:0]
        while part.size:
            out.append(part)
            part = induce(part, c)
        part = direct[bounds[c] : bounds[c + 1]]
        if part.size:
            out.append(part)
            induce(part, -1)
    return np.concatenate(out)


def adjacent_prefixes(text: np.ndarray, array: np.ndarray, depth: int) -> np.ndarray:
    """For each place of the array the bytes it shares with the one before it, ``depth`` at most (0 for the first)."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(depth + 8, dtype=np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    words = np.ascontiguousarray(eight).view(">u8")[:, 0]
    shared = np.zeros(len(array), dtype=np.int64)
    live = np.arange(1, len(array))
    limit = np.minimum(depth, n - np.maximum(array[1:], array[:-1]))
    for at in range(0, depth, 8):
        a, b = array[live] + at, array[live - 1] + at
        x = words[a] ^ words[b]
        same = x == 0
        stop = live[~same]
        if len(stop):
            lead = np.zeros(len(stop), dtype=np.int64)
            d = x[~same].astype(np.uint64)
            for k in range(1, 8):
                lead += d < (np.uint64(1) << np.uint64(64 - 8 * k))
            shared[stop] = at + lead
        live = live[same]
        shared[live] = at + 8
        if not len(live):
            break
    shared[1:] = np.minimum(shared[1:], limit)
    return shared
