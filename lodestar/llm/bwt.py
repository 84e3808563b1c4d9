"""Burrows-Wheeler transform and common prefixes of a collection of texts, built column by column.

Each round inserts the next symbol, from the right, of every text of the collection that has one.
Transform and common prefixes are kept as sequential arrays and rewritten by one pass a round; where
an insertion goes follows from the rank of its symbol in the transform so far (LF mapping), and only
the common prefixes at insertions change.  No suffix array is held: positions are read back from the
finished transform by walking the same mapping."""

from __future__ import annotations

import numpy as np


def _ranges_min(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """min(values[start:end]) for each range, none of them empty."""
    order = np.argsort(-start, kind="stable")  # descending, so that reduceat skips what is between
    at = np.stack([start[order], end[order]], axis=1).ravel()
    out = np.empty(len(start), values.dtype)
    out[order] = np.minimum.reduceat(np.append(values, values.dtype.type(0)), at)[::2]
    return out


class Collection:
    """bwt: symbol before each suffix, 0 where a text begins.  lcp: symbols shared with the suffix
    before, at most 2**31 - 1.  The first suffixes are the empty ones, a text's end being its own."""

    def __init__(self, symbols: np.ndarray, ends: np.ndarray):
        """symbols: all texts one behind the other, numbers from 1 on; ends: of each text."""
        self.m = m = len(ends)
        starts = np.concatenate([[0], ends[:-1]])
        self.length = ends - starts
        top = int(symbols.max(initial=0))
        kind = np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32
        text = np.append(symbols.astype(kind), kind(0))
        left = self.length.copy()  # symbols of each text not inserted yet
        bwt = np.where(left > 0, text[starts + np.maximum(left - 1, 0)], 0).astype(kind)
        lcp = np.zeros(m, np.int32)
        place, who = np.arange(m), np.arange(m)  # of the suffixes inserted last
        while True:
            going = left[who] > 0
            place, who = place[going], who[going]
            if not len(who):
                break
            n = len(bwt)
            order = np.argsort(bwt, kind="stable")
            zeros = np.searchsorted(bwt[order], 1) if kind != np.uint8 else int((bwt == 0).sum())
            rank = np.empty(n, np.int64)
            rank[order] = np.arange(n)
            r = rank[place]
            c = bwt[place]
            before, after = order[np.maximum(r - 1, 0)], order[np.minimum(r + 1, n - 1)]
            has_before, has_after = (r > 0) & (bwt[before] == c), (r + 1 < n) & (bwt[after] == c)
            with_before, with_after = np.zeros(len(r), np.int32), np.zeros(len(r), np.int32)
            for has, lo, hi, out in ((has_before, before, place, with_before), (has_after, place, after, with_after)):
                i = np.flatnonzero(has)
                if len(i):
                    # suffixes that begin with different symbols share nothing, however far apart
                    near = self._first(bwt_starts, lo[i]) == self._first(bwt_starts, hi[i]) if len(bwt) > m else np.zeros(len(i), bool)
                    out[i] = 1
                    i = i[near]
                    if len(i):
                        out[i] = _ranges_min(lcp, lo[i] + 1, hi[i] + 1) + 1
            new = m + r - zeros
            size = n + len(who)
            fresh = np.zeros(size, bool)
            fresh[new] = True
            left[who] -= 1
            grown = np.empty(size, kind)
            grown[~fresh] = bwt
            grown[new] = np.where(left[who] > 0, text[starts[who] + np.maximum(left[who] - 1, 0)], 0)
            prefixes = np.empty(size, np.int32)
            prefixes[~fresh] = lcp
            follows = np.flatnonzero(has_after)
            prefixes[new[follows] + 1] = with_after[follows]
            prefixes[new] = with_before
            counts = np.bincount(bwt, minlength=top + 1)
            counts[0] = m  # the empty suffixes
            bwt_starts = np.cumsum(counts) - counts
            bwt, lcp, place = grown, prefixes, new
        self.bwt, self.lcp = bwt, lcp

    @staticmethod
    def _first(starts: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Number of the first symbol of the suffixes at these places (0: empty)."""
        return np.searchsorted(starts, at, side="right") - 1

    def walk(self):
        """For k = 0, 1, ...: texts, and the places of their suffixes of k symbols."""
        n = len(self.bwt)
        rank = np.empty(n, np.int64)
        order = np.argsort(self.bwt, kind="stable")
        rank[order] = np.arange(n)
        zeros = int((self.bwt == 0).sum())
        place, who, k = np.arange(self.m), np.arange(self.m), 0
        while len(who):
            yield k, who, place
            going = self.length[who] > k
            who, place = who[going], place[going]
            place = self.m + rank[place] - zeros
            k += 1

    def repeated(self, symbols: int):
        """For each text the starts of its strings of ``symbols`` symbols that also start elsewhere."""
        long = self.lcp >= symbols
        flag = long.copy()
        flag[:-1] |= long[1:]
        texts, starts = [], []
        for k, who, place in self.walk():
            if k >= symbols:
                hit = flag[place]
                texts.append(who[hit])
                starts.append(self.length[who[hit]] - k)
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(texts), np.concatenate(starts)
