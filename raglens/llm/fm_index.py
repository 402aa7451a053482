"""Compressed FM-index over sequences of symbols: wavelet matrix, backward search, sampled positions.

One index covers one shard: some sequences, each closed by a terminator that
sorts before all symbols. Building sorts the suffixes; what stays is the
wavelet matrix of the symbols before them, bit vectors, and samples: neither
text nor suffix array. Searches advance many patterns in lockstep, one symbol
a step, so that every rank over the wavelet matrix is one numpy call.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64


class Bits:
    """A bit vector with ranks: 64 bits a word, and the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
        padded[: self.n] = bits
        self.words = np.packbits(padded, bitorder="little").view(U64)
        self.counts = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)[:-1])).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before the place."""
        word, low = at >> 6, (at & 63).astype(U64)
        return self.counts[word] + np.bitwise_count(self.words[word] & ((U64(1) << low) - U64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(U64)) & U64(1)).astype(np.int64)

    def last_one(self, at: np.ndarray) -> np.ndarray:
        """The last one at or before the place; bit 0 has to be one."""
        word = at >> 6
        held = self.words[word] & (~U64(0) >> (U64(63) - (at & 63).astype(U64)))
        empty = np.flatnonzero(held == 0)
        if len(empty):
            word[empty] = np.searchsorted(self.counts, self.counts[word[empty]]) - 1
            held[empty] = self.words[word[empty]]
        high = held >> U64(32)
        top = np.frexp(np.where(high > 0, high, held & U64(0xFFFFFFFF)).astype(np.float64))[1] - 1
        return (word << 6) + top + np.where(high > 0, 32, 0)

    def next_one(self, at: np.ndarray) -> np.ndarray:
        """The first one at or after the place; n if there is none."""
        word = at >> 6
        held = self.words[word] & (~U64(0) << (at & 63).astype(U64))
        empty = np.flatnonzero(held == 0)
        if len(empty):
            word[empty] = np.searchsorted(self.counts, self.counts[np.minimum(word[empty] + 1, len(self.words) - 1)], side="right") - 1
            held[empty] = self.words[word[empty]] & np.where(word[empty] > at[empty] >> 6, ~U64(0), U64(0))
        low = held & (~held + U64(1))
        return np.where(held == 0, self.n, (word << 6) + np.frexp(low.astype(np.float64))[1] - 1)


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector a level, with counts every 64 bits."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.n, self.bits = len(symbols), max(1, int(sigma - 1).bit_length())
        self.levels: list[Bits] = []
        self.zeros: list[int] = []
        now = symbols.astype(np.int64, copy=False)
        for level in range(self.bits - 1, -1, -1):
            bit = ((now >> level) & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(int(self.n - bit.sum()))
            now = np.concatenate((now[~bit], now[bit]))
        start = np.zeros(sigma, np.int64)
        self.start = self._descend(np.arange(sigma), start)

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.bits):
            bit = (symbols >> (self.bits - 1 - k)) & 1
            ones = self.levels[k].rank(at)
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before the place."""
        return self._descend(symbols, at) - self.start[symbols]

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbols at the places."""
        out = np.zeros(len(at), np.int64)
        for k in range(self.bits):
            bit, ones = self.levels[k].get(at), self.levels[k].rank(at)
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
            out = out << 1 | bit
        return out


class FMIndex:
    """An index over sequences laid end to end.

    symbols: 1 .. sigma-1 within sequences; starts: where each sequence starts in them.
    sample: every so many places of the text keep their suffix position (0: none do).
    window, owner: for repeated(), the number of symbols in a row, and each sequence's owner.
    """

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, sigma: int, sample: int = 16, window: int = 0, owner: np.ndarray | None = None):
        lengths = np.diff(np.append(starts, len(symbols)))
        self.first = starts + np.arange(len(starts))  # in the text, where each sequence has a terminator
        last = self.first + lengths
        self.n, self.sigma, self.window = len(symbols) + len(starts), sigma, window
        text = np.zeros(self.n, np.int64)
        text[np.delete(np.arange(self.n), last)] = symbols
        end = np.repeat(last, lengths + 1)
        sa, ranks = _sorted(text, end, int(lengths.max(initial=0)) + 1, window)
        before = text[sa - 1]  # the first suffix's predecessor is the last terminator
        self.wavelet = WaveletMatrix(before, sigma)
        self.c = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))[:-1]))
        if sample:
            kept = (sa % sample == 0) | (text[sa] == 0) | (before == 0)
            self.marked, self.positions = Bits(kept), sa[kept].astype(np.int32)
        if window:
            # where the first window-1 symbols differ from those of the suffix before, and the first window symbols
            self.shorter, full = (_classes(sa, ranks, end, k) for k in (window - 1, window))
            self.owners, rank = np.unique(owner, return_inverse=True)
            self.least = np.minimum.reduceat(np.repeat(rank, lengths + 1)[sa], np.flatnonzero(full)).astype(np.int32)
            self.shorter, self.full = Bits(self.shorter), Bits(full)

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the intervals of patterns with a symbol put before them."""
        return self.c[symbols] + self.wavelet.rank(symbols, lo), self.c[symbols] + self.wavelet.rank(symbols, hi)

    def search(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix interval of each pattern symbols[start : start+length]; empty where it doesn't occur."""
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), self.n, np.int64)
        lo[lengths == 0] = hi[lengths == 0] = 0
        active = np.flatnonzero(lengths > 0)
        step = 0
        while len(active):
            c = symbols[starts[active] + lengths[active] - 1 - step]
            lo[active], hi[active] = self.extend(c, lo[active], hi[active])
            step += 1
            active = active[(lo[active] < hi[active]) & (lengths[active] > step)]
        return lo, hi

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text places of suffixes: steps back through the index until a sampled one."""
        at, steps, out = at.copy(), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        todo = np.arange(len(at))
        while len(todo):
            known = self.marked.get(at[todo]) == 1
            done = todo[known]
            out[done] = self.positions[self.marked.rank(at[done])] + steps[done]
            todo = todo[~known]
            if len(todo):
                c = self.wavelet.access(at[todo])
                at[todo] = self.c[c] + self.wavelet.rank(c, at[todo])
                steps[todo] += 1
        return out

    def repeated(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each place of streamed sequences the smallest owner of an indexed one that holds the `window`
        symbols from there; the largest integer where none does, or fewer symbols are left.

        Walks the streams right to left in lockstep with their matching statistics, cut at the window: the
        interval of the longest run of next symbols that the index holds. A run of full length drops its last
        symbol first, which widens the interval to all suffixes with window-1 symbols in common. Where a
        symbol (0: not in the index) ends all matches, the run is searched anew with its last symbols dropped.
        """
        none = np.iinfo(np.int64).max
        out, ends = np.full(len(symbols), none, np.int64), np.append(starts[1:], len(symbols))
        lo, hi, size = np.zeros(len(starts), np.int64), np.full(len(starts), self.n, np.int64), np.zeros(len(starts), np.int64)
        active, step = np.flatnonzero(ends - starts >= self.window), 1
        while len(active):
            place = ends[active] - step
            a, b, long = lo[active], hi[active], size[active]
            cut = np.flatnonzero(long == self.window)
            if len(cut):
                a[cut], b[cut] = self.shorter.last_one(a[cut]), self.shorter.next_one(b[cut])
                long[cut] -= 1
            a, b = self.extend(symbols[place], a, b)
            long += 1
            lost = np.flatnonzero((a >= b) | (symbols[place] == 0))
            while len(lost):
                long[lost] = np.where(symbols[place[lost]] == 0, 0, long[lost] - 1)
                a[lost], b[lost] = self.search(symbols, place[lost], long[lost])
                b[lost[long[lost] == 0]] = self.n
                lost = lost[a[lost] >= b[lost]]
            whole = np.flatnonzero(long == self.window)
            out[place[whole]] = self.owners[self.least[self.full.rank(a[whole] + 1) - 1]]
            lo[active], hi[active], size[active] = a, b, long
            step += 1
            active = active[ends[active] - starts[active] >= step]
        return out


def _sorted(text: np.ndarray, end: np.ndarray, longest: int, keep: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The suffix array by prefix doubling, and by length 1, 2, 4, .. up to `keep` each place's rank.

    A rank is the sorted place of the first suffix with the same symbols; a step sorts only suffixes that
    still share theirs.
    """
    n, k = len(text), 1
    order = np.argsort(text, kind="stable")
    key, slots = text[order], np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order], tied = _heads(key, slots)
    ranks = [(1, rank.copy())] if keep else []
    slots = slots[tied]
    while k < longest and len(slots):
        at = order[slots]
        to = at + k
        key = rank[at] * (n + 1) + np.where(to <= end[at], rank[np.minimum(to, n - 1)] + 1, 0)
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[slots] = at
        rank[at], tied = _heads(key, slots)
        slots = slots[tied]
        k *= 2
        if k <= keep:
            ranks.append((k, rank.copy()))
    # equal suffixes in order of their places
    left = order[slots]
    order[slots] = left[np.lexsort((left, rank[left]))]
    return order, ranks


def _heads(key: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys in these slots: the slot of the first equal one, and whether there are others equal."""
    new = np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1]))
    return np.maximum.accumulate(np.where(new, slots, 0)), ~(new & np.append(new[1:], True))


def _shifted(rank: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
    """For each place one more than the rank k places on, 0 past its sequence's end."""
    to = np.arange(len(rank)) + k
    return np.where(to <= end, rank[np.minimum(to, len(rank) - 1)] + 1, 0)


def _classes(sa: np.ndarray, ranks: list[tuple[int, np.ndarray]], end: np.ndarray, length: int) -> np.ndarray:
    """In suffix order: do the first `length` symbols differ from those of the suffix before?"""
    if length == 0:
        return np.arange(len(sa)) == 0
    k, rank = [x for x in ranks if x[0] <= length][-1]
    pair = rank[sa] * (len(sa) + 2) + (_shifted(rank, end, length - k)[sa] if length > k else 0)
    return np.concatenate(([True], pair[1:] != pair[:-1]))
