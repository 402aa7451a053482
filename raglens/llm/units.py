"""Encodes texts unit by unit, each different unit once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from raglens.llm.words import U64, Text, ragged, words_of

_ANY = np.ones(256, bool)
#: Units that a worker keeps at most; a full cache is emptied.
MOST_UNITS = 1 << 20


class UnitCache:
    """Ids of units by the units' 64-bit hashes (units of one hash count as equal).

    encode: a Text of units to their ids end to end, and each unit's number of ids.
    """

    def __init__(self, encode: Callable[[Text], tuple[np.ndarray, np.ndarray]], most: int = MOST_UNITS):
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.keys, self.start, self.count, self.ids = np.zeros(0, U64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def rows(self, text: Text, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all rows end to end, and each row's number of ids; units begin at `starts`, among them each row's first byte."""
        n = len(text.data)
        if n == 0:
            return np.zeros(0, np.uint32), np.zeros(len(text), np.int64)
        which = self._look_up(words_of(Text(text.data, np.append(starts, n)), _ANY).hashes, text.data, starts)
        counts = self.count[which]
        row = np.searchsorted(starts, text.offsets)
        return self.ids[ragged(self.start[which], counts)], np.diff(np.concatenate(([0], np.cumsum(counts)))[row])

    def _look_up(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        units, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(units) + len(self.keys) > self.most:
            self._clear()
        at = np.minimum(np.searchsorted(self.keys, units), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[at] != units) if len(self.keys) else np.arange(len(units))
        if len(new):
            begin = starts[first[new]]
            sizes = np.append(starts[1:], len(data))[first[new]] - begin
            ids, counts = self.encode(Text(data[ragged(begin, sizes)], np.concatenate(([0], np.cumsum(sizes)))))
            begin, counts = (len(self.ids) + np.cumsum(counts) - counts).astype(np.int32), counts.astype(np.int32)
            keys = np.concatenate((self.keys, units[new]))
            order = np.argsort(keys)
            self.keys, self.start, self.count = keys[order], np.concatenate((self.start, begin))[order], np.concatenate((self.count, counts))[order]
            self.ids = np.concatenate((self.ids, ids))
            at = np.searchsorted(self.keys, units)
        return at[which.reshape(-1)]
