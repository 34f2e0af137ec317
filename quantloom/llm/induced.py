"""Suffix sorting of one shard by external induced sorting.

The sort follows the induced-sorting scheme: suffixes are typed L or S, the
leftmost S suffixes (LMS) are ordered by inducing and naming them and by
recursion on the names, and the order of all others is induced from them by
two sweeps.  A sweep is driven by a monotone priority queue whose key is the
first symbol of a suffix: what is inserted never precedes what is being
extracted, so the queue is one run of positions per symbol.  Runs go to a
scratch file when the queue outgrows its memory budget and come back when
their symbol is due.  Work on a symbol is done on whole runs at a time.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Below this many names the recursion ends and the names are sorted in memory.
BASE_NAMES = 1 << 14


class RunQueue:
    """Monotone priority queue of suffix positions, one first-in-first-out run per symbol.

    ``budget`` bounds the bytes held in memory; further runs are appended to a
    scratch file that vanishes when the queue is closed.
    """

    def __init__(self, symbols: int, budget: int):
        self.runs: list[list] = [[] for _ in range(symbols)]
        self.budget, self.held, self.file, self.spilled = budget, 0, None, 0

    def put(self, symbol: int, positions: np.ndarray) -> None:
        if self.held + positions.nbytes > self.budget:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            at = self.file.seek(0, 2)
            self.file.write(positions.tobytes())
            self.runs[symbol].append((at, len(positions)))
            self.spilled += positions.nbytes
        else:
            self.held += positions.nbytes
            self.runs[symbol].append(positions)

    def take(self, symbol: int) -> np.ndarray:
        """All positions of a symbol in the order in which they came; its run is empty afterwards."""
        out = []
        for x in self.runs[symbol]:
            if isinstance(x, tuple):
                self.file.seek(x[0])
                x = np.frombuffer(self.file.read(x[1] * 4), np.int32)
            else:
                self.held -= x.nbytes
            out.append(x)
        self.runs[symbol] = []
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.int32)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _spread(queue: RunQueue, text: np.ndarray, positions: np.ndarray, here: int) -> np.ndarray:
    """Put positions into the runs of their symbols, in order; returns those of the symbol ``here``."""
    if not len(positions):
        return positions
    symbols = text[positions]
    order = np.argsort(symbols, kind="stable")
    positions, symbols = positions[order], symbols[order]
    cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
    starts = [0, *cuts.tolist(), len(positions)]
    mine = positions[:0]
    for a, b in zip(starts, starts[1:]):
        c = int(symbols[a])
        if c == here:
            mine = positions[a:b]
        else:
            queue.put(c, positions[a:b])
    return mine


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it (S); the last one is L."""
    n = len(text)
    up = text[:-1] < text[1:]
    differs = np.where(text[1:] != text[:-1], np.arange(n - 1, dtype=np.int32), np.int32(n - 1))
    upto = np.minimum.accumulate(differs[::-1])[::-1]
    small = np.zeros(n, bool)
    small[:-1] = np.append(up, False)[upto]
    return small


def _induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, symbols: int, budget: int) -> np.ndarray:
    """Suffix order induced from the order of the LMS suffixes ``seeds``."""
    n = len(text)
    queue = RunQueue(symbols, budget)
    cuts = np.searchsorted(text[seeds], np.arange(symbols + 1))
    large: list[np.ndarray] = []
    queue.put(int(text[n - 1]), np.array([n - 1], np.int32))
    for c in range(symbols):
        rounds, now = [], queue.take(c)
        while len(now):
            rounds.append(now)
            before = now[now > 0] - 1
            now = _spread(queue, text, before[~small[before]], c)
        large.append(rounds[0] if len(rounds) == 1 else np.concatenate(rounds) if rounds else now)
        if cuts[c] < cuts[c + 1]:
            s = seeds[cuts[c] : cuts[c + 1]]
            before = s[s > 0] - 1
            _spread(queue, text, before[~small[before]], -1)
    queue.close()
    queue = RunQueue(symbols, budget)
    out, end = np.empty(n, np.int32), n
    for c in range(symbols - 1, -1, -1):
        now = queue.take(c)
        while len(now):
            out[end - len(now) : end] = now[::-1]
            end -= len(now)
            before = now[now > 0] - 1
            now = _spread(queue, text, before[small[before]], c)
        now = large[c][::-1]
        if len(now):
            out[end - len(now) : end] = now[::-1]
            end -= len(now)
            before = now[now > 0] - 1
            _spread(queue, text, before[small[before]], -1)
        large[c] = now[:0]
    queue.close()
    return out


def _name(text: np.ndarray, order: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Names of sorted LMS substrings: equal substrings get equal names. ends: the last position of each."""
    if not len(order):
        return np.zeros(0, np.int32)
    size = ends - order
    a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
    same = size[1:] == size[:-1]
    left = np.flatnonzero(same)
    step = 0
    while len(left):
        left = left[size[left] >= step]
        bad = text[a[left] + step] != text[b[left] + step]
        same[left[bad]] = False
        left = left[~bad]
        step += 1
    return np.concatenate([[0], np.cumsum(~same)]).astype(np.int32)


def _base(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of names by doubling, in memory."""
    n, h = len(names), 1
    order = np.argsort(names, kind="stable")
    key = names[order]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    slots = np.arange(n)  # of the order that are not settled yet
    while h < depth:
        alone = first & np.append(first[1:], True)
        slots = slots[~alone]
        if not len(slots):
            break
        some = order[slots]
        after = some + h
        key = rank[some] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        some, key = some[by], key[by]
        order[slots] = some
        first = np.concatenate([[True], key[1:] != key[:-1]])
        rank[some] = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))]
        h *= 2
    return order.astype(np.int32)


def suffix_order(text: np.ndarray, symbols: int, depth: int, budget: int = 64 << 20) -> np.ndarray:
    """Positions of all suffixes, ordered by their first ``depth`` symbols at least.

    text: unsigned integers below ``symbols``.  Ties beyond ``depth`` stay in any order.
    """
    n = len(text)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    small = _types(text)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    if not len(lms):
        return _induce(text, small, lms, symbols, budget)
    seeds = lms[np.argsort(text[lms], kind="stable")]
    order = _induce(text, small, seeds, symbols, budget)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = order[is_lms[order]]
    place = np.empty(n, np.int32)
    place[lms] = np.arange(len(lms), dtype=np.int32)
    after = np.append(lms[1:], n - 1)
    names = np.empty(len(lms), np.int32)
    at = place[order]
    names[at] = _name(text, order, after[at])
    del order, is_lms
    count = int(names.max()) + 1
    if count == len(lms):
        by = np.empty(len(lms), np.int32)
        by[names] = np.arange(len(lms), dtype=np.int32)
    elif len(lms) < BASE_NAMES or count * 64 > len(lms):
        by = _base(names, depth)
    else:
        by = suffix_order(names, count, depth, budget)
    return _induce(text, small, lms[by], symbols, budget)


def equal_windows(text: np.ndarray, starts: np.ndarray, width: int, budget: int = 64 << 20) -> np.ndarray:
    """Class of each window text[s:s+width]: windows are equal exactly if their classes are.

    text: bytes plus one, with 0 between pieces, so that no window holds a 0.
    The classes come from the suffix order: neighbours whose common prefix is
    ``width`` or longer fall together.
    """
    if not len(starts):
        return np.zeros(0, np.int64)
    order = suffix_order(text, 257, width, budget)
    slot = np.full(len(text), -1, np.int32)
    slot[starts] = np.arange(len(starts), dtype=np.int32)
    order = order[slot[order] >= 0]
    raw = np.ascontiguousarray(text - 1).astype(np.uint8)
    raw = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw) - 7, np.uint64, raw, strides=(1,))
    a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
    same = np.ones(len(a), bool)
    left = np.arange(len(a))
    for step in [*range(0, width - 7, 8), width - 8]:
        ok = eight[a[left] + step] == eight[b[left] + step]
        same[left[~ok]] = False
        left = left[ok]
    classes = np.empty(len(starts), np.int64)
    classes[slot[order]] = np.concatenate([[0], np.cumsum(~same)])
    return classes
