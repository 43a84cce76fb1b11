"""An FM-index over runs of symbols: suffix order, wavelet-tree ranks, backward search, sampled positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 8


class Bits:
    """A bit vector with constant-time rank: packed words and a running count for each."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class Wavelet:
    """A wavelet tree with one bit vector a level, zeros before ones at each."""

    def __init__(self, symbols: np.ndarray, depth: int) -> None:
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(depth - 1, -1, -1):
            bits = (symbols >> shift) & 1
            self.levels.append((shift, Bits(bits), int(len(bits) - bits.sum())))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        low, high = np.zeros_like(at), at
        for shift, bits, zeros in self.levels:
            one = ((symbol >> shift) & 1).astype(bool)
            a, b = bits.rank(low), bits.rank(high)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low

    def get(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for shift, bits, zeros in self.levels:
            one = bits.get(at).astype(bool)
            out |= one.astype(np.int64) << shift
            a = bits.rank(at)
            at = np.where(one, zeros + a, at - a)
        return out


def suffix_order(text: np.ndarray, run_start: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes; a suffix ends with its run, and the end sorts first, by position.

    Prefix doubling in which only suffixes that are still tied are sorted again, so its rounds are the
    logarithm of the longest repeat and all but the first are short.
    """
    n = len(text)
    run_end = np.append(run_start[1:], n)
    left = np.repeat(run_end, run_end - run_start) - np.arange(n)  # symbols up to the end of the run
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    ordered = text[order]
    head = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if n else np.zeros(0, np.int64)
    rank[order] = np.repeat(head, np.diff(np.append(head, n)))
    size = np.diff(np.append(head, n))
    tied = np.repeat(size > 1, size)
    slots = np.flatnonzero(tied)
    step = 1
    while len(slots):
        at = order[slots]
        # a suffix whose run ends within the step is unique: it precedes those that go on, by position
        ended = left[at] <= step
        second = np.where(ended, at - n, rank[np.where(ended, 0, at + step)])
        first = rank[at]
        by = np.lexsort((second, first))
        at, first, second = at[by], first[by], second[by]
        order[slots] = at
        new = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
        group = np.cumsum(new) - 1
        rank[at] = slots[new][group]
        size = np.bincount(group)
        slots = slots[(size > 1)[group]]
        step *= 2
    return order


class FMIndex:
    """Index of ``text``, symbols from 1 up to ``top``, cut into runs that no match crosses."""

    def __init__(self, text: np.ndarray, run_start: np.ndarray, top: int) -> None:
        n, runs = len(text), len(run_start)
        self.rows, order = n + runs, suffix_order(text, run_start)
        starts = np.zeros(n, bool)
        starts[run_start] = True
        # the ends of the runs are rows too, and come first: before each stands its run's last symbol
        before = np.concatenate([text[np.append(run_start[1:], n) - 1], np.where(starts[order], 0, text[order - 1])])
        self.tree = Wavelet(before, max(1, int(top).bit_length()))
        self.first = np.full(top + 2, runs, np.int64)
        self.first[1:] += np.cumsum(np.bincount(text, minlength=top + 1))
        kept = (order % SAMPLE == 0) | starts[order]
        self.sampled, self.places = Bits(np.concatenate([np.zeros(runs, np.uint8), kept.astype(np.uint8)])), order[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all phrases (rows padded at their ends) at once: their ranges of suffixes."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.rows, np.int64)
        live = np.flatnonzero(lengths > 0)
        for back in range(1, phrases.shape[1] + 1 if len(phrases) else 1):
            live = live[(lengths[live] >= back) & (low[live] < high[live])]
            if not len(live):
                break
            symbol = phrases[live, lengths[live] - back]
            low[live] = self.first[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.tree.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, walking back to the next sampled one."""
        out, at, gone, todo = np.empty(len(rows), np.int64), rows.copy(), 0, np.arange(len(rows))
        while len(todo):
            known = self.sampled.get(at).astype(bool)
            out[todo[known]] = self.places[self.sampled.rank(at[known])] + gone
            todo, at = todo[~known], at[~known]
            if len(todo):
                symbol = self.tree.get(at)
                at = self.first[symbol] + self.tree.rank(symbol, at)
                gone += 1
        return out
