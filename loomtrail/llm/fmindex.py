"""A compressed full-text index over sequences of integers: the run-length encoded Burrows-Wheeler transform with a
sampled suffix array.

It answers backward search: which suffixes begin with a pattern that is read from its end. All searches of a batch take
their steps together, as arrays. Of the suffix array only every SAMPLE-th text position is kept: others are located by
walking back to one. An index packs into bytes and is read back from them.
"""

from __future__ import annotations

import io

import numpy as np

SAMPLE = 16


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes of s in order, by prefix doubling."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        second = np.full(n, -1, dtype=np.int64)
        second[: n - k] = rank[k:] if k < n else rank[:0]
        key = rank * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        rank = new
        if n == 0 or rank[order[-1]] == n - 1 or k >= n:
            return order
        k *= 2


class RunIndex:
    """Index over one sequence. Symbols are non-negative; symbols that the sequence lacks match nothing.

    For each run of the transform it holds 28 bytes, for each symbol of the alphabet 16, for every SAMPLE-th position 8:
    about 0.5 to 28 bytes a position, the less the more the sequence repeats itself.
    """

    PARTS = ("alphabet", "first", "start", "symbol", "order", "before", "rows", "places")

    def __init__(self, sequence: np.ndarray):
        # an end mark below all symbols makes the order of suffixes that of rotations
        s = np.concatenate((np.asarray(sequence, dtype=np.int64), [-1]))
        self.alphabet, dense = np.unique(s, return_inverse=True)
        suffixes = suffix_array(dense)
        last = dense[suffixes - 1]  # the symbol before each suffix; the text is taken as a ring
        self.first = np.concatenate(([0], np.cumsum(np.bincount(dense, minlength=len(self.alphabet)))))
        self.start = np.nonzero(np.concatenate(([True], last[1:] != last[:-1])))[0]
        self.symbol = last[self.start].astype(np.int32)
        kept = np.nonzero(suffixes % SAMPLE == 0)[0]
        self.rows, self.places = kept.astype(np.int32), suffixes[kept].astype(np.int32)
        self.order = np.lexsort((self.start, self.symbol)).astype(np.int32)
        length = np.diff(np.concatenate((self.start, [len(s)])))[self.order]
        before = np.cumsum(length) - length
        self.before = before - self.first[self.symbol[self.order]]
        self._ready()

    def _ready(self) -> None:
        self.n = int(self.first[-1])
        by_symbol = self.order
        self.run_start, self.run_symbol = self.start[by_symbol], self.symbol[by_symbol]
        self.run_length = np.diff(np.concatenate((self.start, [self.n])))[by_symbol]
        self.run_key = self.run_symbol.astype(np.int64) * (self.n + 1) + self.run_start

    def pack(self) -> bytes:
        """The index as bytes."""
        out = io.BytesIO()
        np.savez(out, **{k: getattr(self, k) for k in self.PARTS})
        return out.getvalue()

    @classmethod
    def unpack(cls, data: bytes) -> RunIndex:
        """The index of pack()."""
        self = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as parts:
            for k in cls.PARTS:
                setattr(self, k, parts[k])
        self._ready()
        return self

    @property
    def runs(self) -> int:
        return len(self.start)

    def dense(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols as the index numbers them, -1 where it has none."""
        at = np.minimum(np.searchsorted(self.alphabet, symbols), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == symbols, at, -1)

    def _rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position of the transform."""
        at = np.searchsorted(self.run_key, symbol * (self.n + 1) + position) - 1
        ok = (at >= 0) & (self.run_symbol[np.maximum(at, 0)] == symbol)
        at = np.maximum(at, 0)
        inside = np.minimum(position - self.run_start[at], self.run_length[at])
        return np.where(ok, self.before[at] + inside, 0)

    def step(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with one more symbol in front; an empty interval has low >= high."""
        known = symbol >= 0
        c = np.where(known, symbol, 0).astype(np.int64)
        base = self.first[c]
        a, b = base + self._rank(c, low), base + self._rank(c, high)
        return np.where(known, a, 0), np.where(known, b, 0)

    def search(self, query: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which, low, high) of the patterns query[end - length : end] that occur: all are read backwards at once."""
        low, high = np.zeros(len(ends), dtype=np.int64), np.full(len(ends), self.n, dtype=np.int64)
        alive = np.arange(len(ends))
        for k in range(1, int(lengths.max(initial=0)) + 1):
            go = alive[lengths[alive] >= k]
            if not len(go):
                break
            a, b = self.step(low[go], high[go], query[ends[go] - k])
            low[go], high[go] = a, b
            alive = alive[high[alive] > low[alive]]
        return alive, low[alive], high[alive]

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which interval, text position) of every suffix of the intervals."""
        size = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(low)), size)
        row = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
        place = np.full(len(row), -1, dtype=np.int64)
        todo = np.arange(len(row))
        for walked in range(SAMPLE + 1):
            at = np.minimum(np.searchsorted(self.rows, row[todo]), len(self.rows) - 1)
            hit = self.rows[at] == row[todo]
            place[todo[hit]] = self.places[at[hit]] + walked
            todo = todo[~hit]
            if not len(todo):
                break
            # the row of the suffix that is one longer
            c = self.symbol[np.searchsorted(self.start, row[todo], side="right") - 1].astype(np.int64)
            row[todo] = self.first[c] + self._rank(c, row[todo])
        return which, place % self.n
