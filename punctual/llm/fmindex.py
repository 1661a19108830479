"""A compressed full-text index over word ids: Burrows-Wheeler transform in a wavelet matrix, backward search."""

from __future__ import annotations

import numpy as np

#: Stands for no document, after all others.
NONE = np.iinfo(np.int64).max


class BitVector:
    """Packed bits with counts by word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.packed = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.cumsum(np.bitwise_count(self.packed), dtype=np.int64)
        self.before = np.concatenate([[0], counts[:-1]]).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.packed[word] & low)


class WaveletMatrix:
    """Ranks of symbols in a sequence, a bit vector for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, count: int):
        self.levels, self.zeros = [], []
        self.bits = max(1, int(count - 1).bit_length())
        rest = symbols
        for bit in reversed(range(self.bits)):
            ones = (rest >> bit & 1).astype(bool)
            self.levels.append(BitVector(ones))
            self.zeros.append(int(len(rest) - ones.sum()))
            rest = np.concatenate([rest[~ones], rest[ones]])
        every = np.arange(count)
        self.first = self._down(every, np.zeros(count, np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bit in enumerate(reversed(range(self.bits))):
            ones = self.levels[level].rank(at)
            at = np.where(symbols >> bit & 1, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._down(symbols, at) - self.first[symbols]


class FMIndex:
    """Backward search for windows of ``window`` words in passages, each with the smallest document it stands in.

    Suffixes are sorted by their first words, twice as many as the next power of two below the window: deep
    enough for every pattern that is searched.
    """

    def __init__(self, passages: list[np.ndarray], documents: np.ndarray, window: int):
        self.window = window
        sizes = np.array([len(p) + 1 for p in passages])
        ends = np.cumsum(sizes)
        # 0 ends a passage; it is in no pattern
        self.words, ids = np.unique(np.concatenate(passages), return_inverse=True)
        text = np.zeros(int(ends[-1]), np.int64)
        inside = np.ones(len(text), bool)
        inside[ends - 1] = False
        text[inside] = ids + 1
        n = len(text)
        rank, depth, half = text, 1, None
        while depth <= window:
            shifted = np.zeros(n, np.int64)
            shifted[:-depth] = rank[depth:] + 1
            half, half_depth = rank, depth
            rank = np.unique(rank * (n + 2) + shifted, return_inverse=True)[1]
            depth *= 2
        suffixes = np.argsort(rank, kind="stable")
        before = np.roll(text, 1)[suffixes]
        self.wavelet = WaveletMatrix(before, len(self.words) + 1)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.words) + 1))])
        # suffixes that share their first ``window`` words lie together: two halves decide that
        second = np.zeros(n, np.int64)
        second[: n - (window - half_depth)] = half[window - half_depth :]
        alike = (np.diff(half[suffixes]) == 0) & (np.diff(second[suffixes]) == 0)
        opens = np.flatnonzero(np.r_[True, ~alike])
        group = np.cumsum(np.r_[True, ~alike]) - 1
        self.low, self.high = opens[group], np.r_[opens[1:], n][group]
        self.least = np.minimum.reduceat(np.repeat(documents, sizes)[suffixes], opens)[group]
        self.size = n

    def least_documents(self, passages: list[np.ndarray]) -> list[np.ndarray]:
        """For each window of each streamed passage, the smallest document that holds it; NONE where none does.

        All passages advance together, one word to the left at a time. A match of ``window`` words is kept at
        that length by widening its interval to all suffixes that share it. Passages in which a match broke off
        are searched again window by window, as a broken match may go on with another end.
        """
        sizes = np.array([len(p) for p in passages])
        ends = np.cumsum(sizes)
        flat = np.concatenate(passages)
        at = np.minimum(np.searchsorted(self.words, flat), len(self.words) - 1)
        symbols = np.where(self.words[at] == flat, at + 1, 0)
        found, broken = self._slide(symbols, ends, sizes)
        if broken.any():
            inner = [np.arange(e - s + self.window, e + 1) for e, s in zip(ends[broken], sizes[broken]) if s >= self.window]
            if inner:
                window_ends = np.concatenate(inner)
                again, _ = self._slide(symbols, window_ends, np.full(len(window_ends), self.window))
                found[window_ends - self.window] = again[window_ends - self.window]
        return [found[e - s : max(e - s, e - self.window + 1)] for e, s in zip(ends.tolist(), sizes.tolist())]

    def _slide(self, symbols: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matches by place where they start, for stretches given by end and size; and which stretches broke off."""
        order = np.argsort(-sizes, kind="stable")
        found, broken = np.full(len(symbols), NONE, np.int64), np.zeros(len(order), bool)
        sizes, ends = sizes[order], ends[order]
        low, high = np.zeros(len(order), np.int64), np.full(len(order), self.size, np.int64)
        length = np.zeros(len(order), np.int64)
        for step in range(int(sizes[0])):
            lanes = slice(0, int(np.searchsorted(-sizes, -step, side="left")))
            place = ends[lanes] - 1 - step
            symbol = symbols[place]
            new_low = self.starts[symbol] + self.wavelet.rank(symbol, low[lanes])
            new_high = self.starts[symbol] + self.wavelet.rank(symbol, high[lanes])
            lost = (new_low >= new_high) | (symbol == 0)
            broken[order[lanes][lost]] = True
            low[lanes], high[lanes] = np.where(lost, 0, new_low), np.where(lost, self.size, new_high)
            length[lanes] = np.where(lost, 0, length[lanes] + 1)
            full = np.flatnonzero(length[lanes] >= self.window)
            held = low[full]
            found[place[full]] = self.least[held]
            low[full], high[full] = self.low[held], self.high[held]
            length[full] = self.window
        return found, broken
