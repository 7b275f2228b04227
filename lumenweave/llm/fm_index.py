"""A compressed full-text index (Burrows-Wheeler transform with sampled ranks) searched for many patterns at once.

For each row the number of its text is kept, in as few bytes as the texts need, not
its place in it: the places follow from the length of what was searched.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_BLOCK = 32


def _order(codes: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes in the order of their first ``depth`` symbols or more: enough for patterns of up to ``depth`` symbols."""
    n = len(codes)
    bits = max(1, int(codes.max(initial=1)).bit_length())
    step = 64 // bits
    padded = np.concatenate([codes.astype(np.uint64), np.zeros(step, np.uint64)])
    key = np.zeros(n, np.uint64)
    for i in range(step):
        key = (key << np.uint64(bits)) | padded[i : i + n]
    order = np.argsort(key, kind="stable")
    covered = step
    while True:
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])]) + 1
        if covered >= depth or rank.max() == n:
            return order
        after = np.concatenate([rank[covered:], np.zeros(min(covered, n), np.int64)])[:n]
        key = (rank.astype(np.uint64) << np.uint64(32)) | after.astype(np.uint64)
        order = np.argsort(key, kind="stable")
        covered *= 2


class FMIndex:
    """``codes``: texts of ``length`` symbols each, from 1 upwards, one after the other; a terminator 0 is added. ``depth``: symbols of the longest pattern, if longer."""

    def __init__(self, codes: np.ndarray, length: int = 1, depth: int = 0) -> None:
        text = np.concatenate([codes.astype(np.uint8), np.zeros(1, np.uint8)])
        rows = _order(text, max(length, depth)).astype(np.int32)
        n, sigma = len(text), int(text.max()) + 1
        bwt = text[rows - 1]  # row -1 wraps round to the terminator
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])[:sigma].astype(np.int64)
        blocks = n // _BLOCK + 1
        self.bwt = np.concatenate([bwt, np.full(blocks * _BLOCK - n, 255, np.uint8)]).reshape(blocks, _BLOCK)
        self.sampled = np.zeros((blocks, sigma), np.int32)
        for c in range(sigma):
            self.sampled[1:, c] = np.cumsum((self.bwt == c).sum(1))[:-1]
        self.texts = (rows // length).astype(np.min_scalar_type(n // length))
        self.size, self.sigma = n, sigma

    def ranks(self, symbols: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before each row."""
        block, rest = rows // _BLOCK, rows % _BLOCK
        inside = (self.bwt[block] == symbols[:, None]) & (np.arange(_BLOCK)[None, :] < rest[:, None])
        return self.sampled[block, symbols] + inside.sum(1)

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: the ranges of the patterns with a symbol put before them."""
        known = symbols < self.sigma
        s = np.where(known, symbols, 0)
        a = self.first[s] + self.ranks(s, low)
        b = self.first[s] + self.ranks(s, high)
        return np.where(known, a, 0), np.where(known, b, 0)

    def search(self, patterns: np.ndarray, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(pattern, low, high)`` of the ranges of whole patterns, all of one length, from their last symbol backwards.

        ``other`` holds a second symbol that a place may have, or 0: both are followed.
        """
        q = np.arange(len(patterns))
        return self._go_on(q, np.zeros(len(q), np.int64), np.full(len(q), self.size, np.int64), patterns.shape[1] - 1, patterns, other)

    def _go_on(self, q: np.ndarray, low: np.ndarray, high: np.ndarray, start: int, patterns: np.ndarray, other: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        for j in range(start, -1, -1):
            if not len(q):
                break
            symbols = patterns[q, j].astype(np.int64)
            if other is not None:
                second = other[q, j].astype(np.int64)
                more = np.flatnonzero(second)
                q, low, high = np.concatenate([q, q[more]]), np.concatenate([low, low[more]]), np.concatenate([high, high[more]])
                symbols = np.concatenate([symbols, second[more]])
            low, high = self.extend(symbols, low, high)
            alive = low < high
            q, low, high = q[alive], low[alive], high[alive]
        return q, low, high

    def ending_in(self, mark: int, letters: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of all texts of ``length`` symbols from 1 to ``letters`` before the mark, numbered from their last symbol on."""
        return self.ending_among(mark, [np.arange(1, letters + 1)] * length)

    def ending_among(self, mark: int, symbols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of all texts before the mark that have one of the ``symbols`` of each place, from the last on, and numbered in that order.

        An empty range stands where its text would be, so those of neighbouring last symbols are one range together.
        """
        low, high = self.extend(np.array([mark]), np.array([0]), np.array([self.size]))
        for of_place in symbols:
            low, high = self.extend(np.tile(of_place, len(low)), np.repeat(low, len(of_place)), np.repeat(high, len(of_place)))
        return low, high

    def search_within(self, table: tuple[np.ndarray, np.ndarray], letters: int, length: int, costs: np.ndarray, shares: np.ndarray, narrow: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(pattern, low, high)`` of all texts before a mark whose summed cost stays within the share of each place, from the last backwards.

        ``costs``: pattern, place, letter. ``shares``: the largest sum after each place from the end. ``table``: of ``ending_in``, whose ``length`` symbols are looked up.
        A range of up to ``narrow`` rows is not searched on, so it may hold texts that exceed later shares.
        """
        q, number, spent = np.arange(len(costs), dtype=np.int32), np.zeros(len(costs), np.int32), np.zeros(len(costs), np.int16)
        last, filled = costs.shape[1], table[0] < table[1]
        by_place = np.ascontiguousarray(costs.transpose(1, 2, 0))
        for k in range(length):
            totals = [spent + by_place[last - 1 - k, c][q] for c in range(letters)]
            kept = [np.flatnonzero(t <= shares[k]) for t in totals]
            at, letter = np.concatenate(kept), np.repeat(np.arange(letters, dtype=np.int32), [len(x) for x in kept])
            spent = np.concatenate([t[x] for t, x in zip(totals, kept, strict=True)])
            number = number[at] * letters + letter
            some = np.flatnonzero(filled.reshape(letters ** (k + 1), -1).any(1)[number])
            q, number, spent = q[at[some]], number[some], spent[some]
        return self.search_on((q, table[0][number], table[1][number], spent), range(length, last), lambda k, q, c: by_place[last - 1 - k, c][q], lambda _: letters, shares, narrow)

    def search_on(self, begun: tuple[np.ndarray, ...], places: range, cost: Callable, letters: Callable[[int], int], shares: np.ndarray, narrow: int, together: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(pattern, low, high)`` of the ranges that stay within the shares when ``begun`` (pattern, low, high, sum) is searched on over ``places``, counted from the end.

        ``cost(place, patterns, letter)``; of ``together`` places that follow each other only the largest cost counts. ``letters(place)``: how many there are.
        A range of up to ``narrow`` rows is not searched on, so it may hold texts that exceed later shares.
        """
        q, low, high, spent = begun
        most = np.zeros(len(q), np.int16)
        found = []
        for k in places:
            wide = high - low > narrow
            found.append((q[~wide], low[~wide], high[~wide]))
            q, low, high, spent, most = q[wide], low[wide], high[wide], spent[wide], most[wide]
            if not len(q):
                break
            largest = [np.maximum(most, cost(k, q, c)) for c in range(letters(k))]
            kept = [np.flatnonzero(spent + m <= shares[k]) for m in largest]
            at, letter = np.concatenate(kept), np.repeat(np.arange(len(kept)), [len(x) for x in kept])
            most = np.concatenate([m[x] for m, x in zip(largest, kept, strict=True)])
            q, spent = q[at], spent[at]
            low, high = self.extend(letter + 1, low[at], high[at])
            alive = low < high
            q, low, high, spent, most = q[alive], low[alive], high[alive], spent[alive], most[alive]
            if (k + 1) % together == 0:
                spent, most = spent + most, np.zeros(len(q), np.int16)
        found.append((q, low, high))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def locate(self, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(pattern, number of the text)`` of every occurrence in the ranges."""
        n = high - low
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(q, n), self.texts[np.repeat(low, n) + within].astype(np.int64)
