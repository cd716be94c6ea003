"""A compressed full-text index of word sequences: suffix order, entropy-shaped wavelet matrix of its last column, backward search."""

from __future__ import annotations

import numpy as np

_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


def suffix_array(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Start positions of the suffixes, in the order of their first `depth` symbols (all, if None); ties in any order. text: symbols
    >= 0. Ranks of runs of symbols are put together in threes, and first as many symbols as fit in 63 bits."""
    n = len(text)
    depth = n if depth is None else min(depth, n)
    rank, step, parts = text.astype(np.int64) + 1, 1, 63 // max(1, int(text.max(initial=0) + 1).bit_length())
    while True:
        bits, key, reach = int(rank.max(initial=1)).bit_length(), rank.copy(), 1
        while reach < min(parts, 63 // bits) and reach * step < depth:
            key <<= bits
            if reach * step < n:
                key[: n - reach * step] |= rank[reach * step :]
            reach += 1
        step *= reach
        order = np.argsort(key)
        if step >= depth:
            return order
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        parts = 3
        if rank[order[-1]] == n:
            return order


class BitVector:
    """Bits in 64-bit words with counts before each word: rank in constant time."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.cumsum(counts, dtype=np.int32) - counts

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        return self.before.take(word) + np.bitwise_count(self.words.take(word) & _BELOW.take(at & 63))


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Bits of a prefix code's words for symbols of these frequencies: less than one above the entropy, on average."""
    total = max(1, int(counts.sum()))
    return np.maximum(1, np.ceil(np.log2(total / np.maximum(counts, 1) - 1e-9))).astype(np.int8)


class WaveletMatrix:
    """Occurrences of a symbol before a position. Symbols get codes shaped by their frequency, so that the bits kept are about the
    entropy of the sequence; one bit vector holds the k-th bits of all codes that are so long. Codes that end at a level are the last
    ones in its order, and the others keep their places without them."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray):
        self.length = code_lengths(counts)
        self.code = np.zeros(len(counts), np.int64)
        by_length = np.argsort(self.length, kind="stable")
        need = np.bincount(self.length)
        nodes, used = np.zeros(1, np.int64), 0
        for size in range(1, len(need)):
            nodes = np.concatenate([nodes << 1, nodes << 1 | 1])
            take = len(nodes) - need[size]
            self.code[by_length[used : used + need[size]]] = nodes[take:]
            nodes, used = nodes[:take], used + need[size]
        self.planes, self.zeros = [], []
        row = symbols
        for level in range(len(need) - 1):
            ones = (self.code >> np.maximum(self.length - 1 - level, 0) & 1).astype(bool).take(row)
            self.planes.append(BitVector(ones))
            self.zeros.append(int(len(row) - ones.sum()))
            row = np.concatenate([row[~ones], row[ones]])
            row = row[(self.length > level + 1).take(row)]
        self.code <<= 62 - self.length  # the first bit of each is bit 61
        self.first = self._down(np.arange(len(counts)), np.zeros(len(counts), np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        size = self.length.take(symbols)
        order = np.argsort(-size, kind="stable")  # long codes first: those that go on are a prefix
        at, code = at.take(order), self.code.take(symbols.take(order))
        going = len(size) - np.cumsum(np.bincount(size, minlength=len(self.planes) + 1))
        for level, (plane, zeros) in enumerate(zip(self.planes, self.zeros, strict=True)):
            on = int(going[level])
            if not on:
                break
            here = at[:on]
            ones = plane.rank(here)
            at[:on] = np.where(code[:on] >> (61 - level) & 1, ones + zeros, here - ones)
        out = np.empty_like(at)
        out[order] = at
        return out

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._down(symbols, at) - self.first[symbols]

    def bits(self) -> int:
        return sum(64 * len(p.words) for p in self.planes)


class RangeMin:
    """Least value of any range, from a table of ranges of power-of-two lengths."""

    def __init__(self, values: np.ndarray):
        n, step, rows = len(values), 1, [values.astype(np.int32)]
        while 2 * step <= n:
            last = rows[-1]
            rows.append(np.concatenate([np.minimum(last[: n - step], last[step:]), last[n - step :]]))
            step *= 2
        self.n, self.flat = n, np.concatenate(rows)

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        level = np.frexp((hi - lo).astype(float))[1].astype(np.int64) - 1
        base = level * self.n
        return np.minimum(self.flat.take(base + lo), self.flat.take(base + hi - (np.int64(1) << level)))


class FMIndex:
    """Index of a text of symbols >= 0, for patterns of less than `depth` symbols. `order` ranks its positions, ties allowed. The text
    itself isn't kept."""

    def __init__(self, text: np.ndarray, order: np.ndarray, depth: int):
        suffixes = suffix_array(text, depth)
        counts = np.bincount(text)
        self.size = len(text)
        self.wavelet = WaveletMatrix(text[suffixes - 1], counts)
        self.base = np.cumsum(counts) - counts - self.wavelet.first
        self.earliest = RangeMin(order[suffixes])

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of the patterns with a symbol (one of the text's) put before each."""
        both = self.wavelet._down(np.concatenate([symbols, symbols]), np.concatenate([lo, hi]))
        base = self.base[symbols]
        return both[: len(lo)] + base, both[len(lo) :] + base

    def _earlier(self, symbols, lo, hi, own):
        """Ranges after a step, and which of them hold a place before own."""
        lo, hi = self.extend(symbols, lo, hi)
        some = lo < hi
        good = some & (self.earliest.least(np.where(some, lo, 0), np.where(some, hi, 1)) < own)
        return lo, hi, good

    def occur(self, stream: np.ndarray, order: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which of the pieces [start, end) of the stream occur at a place of smaller order; one that is empty does."""
        found = np.ones(len(start), bool)
        who, at = np.arange(len(start)), end.copy()
        lo, hi = np.zeros(len(start), np.int64), np.full(len(start), self.size)
        while len(who := who[on := at > start[who]]):
            at, lo, hi = at[on] - 1, lo[on], hi[on]
            lo, hi, good = self._earlier(stream[at], lo, hi, order[at])
            found[who[~good]] = False
            who, at, lo, hi = who[good], at[good], lo[good], hi[good]
        return found

    def matches(self, stream: np.ndarray, order: np.ndarray, start: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of stretches [start, end) of the stream, whose positions have an order too: maximal intervals of at
        least `least` symbols that the index has at a smaller place. Returns stretch, first and end position of each interval.

        All stretches advance together, from right to left. A failure at position p means that what reaches from p to the end of
        the interval has no earlier match, so the next interval to try is the last one of `least` symbols that avoids this.
        """
        out: list[list[np.ndarray]] = [[], [], []]
        who = np.flatnonzero(end - start >= least)
        stop, at = end[who].copy(), end[who].copy()
        lo, hi = np.zeros(len(who), np.int64), np.full(len(who), self.size)

        def report(rows, first):
            long = stop[rows] - first >= least
            for k, x in enumerate((who[rows][long], first[long], stop[rows][long])):
                out[k].append(x)

        while len(who):
            lo2, hi2, good = self._earlier(stream[at - 1], lo, hi, order[at - 1])
            at, lo, hi = np.where(good, at - 1, at), np.where(good, lo2, lo), np.where(good, hi2, hi)
            ended = good & (at == start[who])
            failed = np.flatnonzero(~good)
            report(np.flatnonzero(ended), start[who][ended])
            report(failed, at[failed])
            stop[failed] = np.minimum(stop[failed] - 1, at[failed] - 1 + least)
            at[failed], lo[failed], hi[failed] = stop[failed], 0, self.size
            on = ~ended & (stop - start[who] >= least)
            who, stop, at, lo, hi = who[on], stop[on], at[on], lo[on], hi[on]
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
