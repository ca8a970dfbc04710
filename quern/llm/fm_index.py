"""A compressed FM-index over sequences of symbols, with a code-shaped wavelet tree for its rank queries.

The index holds many sequences, each ended by a symbol of its own class, below all others.  Suffixes are sorted by
their first symbols, as many as a window has and one more, which is all that backward search up to that length asks.
"""

from __future__ import annotations

import numpy as np


def _dense(key: np.ndarray) -> np.ndarray:
    """Ranks of the values from 0, equal ones alike."""
    order = np.argsort(key)
    v = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(v[1:] != v[:-1])])
    return rank


class Wavelet:
    """A wavelet tree shaped by a prefix code: a symbol that makes up a share p of the sequence has a code of
    ceil(-log2 p) bits, so the levels hold n * (H0 + 1) bits at most, H0 being the entropy of the symbols.

    Codes are dealt in the order of their lengths, so at each level the symbols that have no bits left come first and
    are cut off.  A level is packed bits with a count before every 64 of them, and where each symbol's node begins.
    """

    def __init__(self, symbols: np.ndarray, sigma: int):
        n = len(symbols)
        count = np.bincount(symbols, minlength=sigma)
        length = np.maximum(np.ceil(np.log2(np.maximum(-(-n // np.maximum(count, 1)), 1))).astype(np.int64), 1)
        by = np.argsort(length, kind="stable")
        #: of each symbol, its place in the order of codes
        self.place = np.empty(sigma, np.int64)
        self.place[by] = np.arange(sigma)
        self.length = length[by]
        m = int(self.length[-1]) if sigma else 0
        width = np.where(count[by] > 0, np.int64(1) << (m - self.length), 0)  # a symbol that never occurs needs no code
        code = np.cumsum(width) - width
        total = np.concatenate([[0], np.cumsum(count[by])])
        self.levels = []
        s = self.place[symbols]
        for level in range(m):
            gone = int(np.searchsorted(self.length, level, "right"))  # symbols before it have no bit here
            prefix = code >> (m - level)
            lo = total[np.maximum(np.searchsorted(prefix, prefix, "left"), gone)] - total[gone]
            hi = total[np.maximum(np.searchsorted(prefix, prefix, "right"), gone)] - total[gone]
            size = len(s)
            bit = (code[s] >> (m - 1 - level) & 1).astype(bool)
            padded = np.zeros((size // 64 + 1) * 64, bool)
            padded[:size] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]).astype(np.int32)
            ones = np.concatenate([[0], np.cumsum(bit)])
            lo, hi = np.minimum(lo, size), np.minimum(hi, size)
            self.levels.append((words, counts, lo.astype(np.int32), ones[lo].astype(np.int32), (code >> (m - 1 - level) & 1).astype(bool)))
            # a stable deal of every node to its halves; those whose code ends stand first and go
            left = (hi - lo) - (ones[hi] - ones[lo])
            before = ones[:-1] - ones[lo[s]]
            to = lo[s] + np.where(bit, left[s] + before, np.arange(size) - lo[s] - before)
            out = np.empty(size, s.dtype)
            out[to] = s
            s = out[np.searchsorted(self.length[out], level + 1, "right") :]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before position i."""
        s, r = self.place[symbol], i.astype(np.int64)
        out, who = r.copy(), None
        for level, (words, counts, lo, ones, one) in enumerate(self.levels):
            more = self.length[s] > level
            if not more.all():
                end = ~more
                out[np.flatnonzero(end) if who is None else who[end]] = r[end]
                who = np.flatnonzero(more) if who is None else who[more]
                s, r = s[more], r[more]
                if not len(s):
                    return out
            at = lo[s] + r
            block = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            n = counts[block] + np.bitwise_count(words[block] & below) - ones[s]
            r = np.where(one[s], n, r - n)
        if who is None:
            return r
        out[who] = r
        return out


class FMIndex:
    """Built from sequences laid end to end: `values` (64-bit words) and `first`, where each begins, and the end.

    window: the length of a match that counts.  owner: a number for each sequence; `smallest` gives, for an interval of
    suffixes that share `window` symbols, the smallest owner among them.
    """

    def __init__(self, values: np.ndarray, first: np.ndarray, owner: np.ndarray, window: int):
        m = len(first) - 1
        length = np.diff(first)
        #: each sequence is followed by its end, symbol 0
        self.first = first[:-1] + np.arange(m)
        self.last = self.first + length
        n = len(values) + m
        _, inverse = np.unique(values, return_inverse=True)
        text = np.zeros(n, np.int64)
        text[np.arange(len(values)) + np.repeat(np.arange(m), length)] = inverse + 1
        self.text, self.window = text, window
        sigma = int(text.max(initial=0)) + 1

        rank, depth = text, 1
        while depth <= window + 1:  # one more than a window: that is how far a search goes before it is cut back
            ahead = np.zeros(n, np.int64)
            ahead[: max(0, n - depth)] = rank[depth:] + 1
            key = rank * (n + sigma + 1) + ahead
            if depth * 2 > window + 1:
                break
            rank, depth = _dense(key), depth * 2
        order = np.argsort(key, kind="stable")
        self.order = order
        self.before = Wavelet(text[order - 1], sigma)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])

        # suffixes that share a whole window are adjacent: number these groups
        whole = np.zeros(n, bool)
        whole[np.concatenate([np.arange(a, max(a, b - window + 1)) for a, b in zip(self.first, self.last)] or [np.zeros(0, int)])] = True
        new = np.ones(n, bool)
        a, b = order[:-1], order[1:]
        both = np.flatnonzero(whole[a] & whole[b])
        differ = np.zeros(len(both), bool)
        for k in range(window):
            differ |= text[a[both] + k] != text[b[both] + k]
        new[1:][both] = differ
        self.group = np.cumsum(new) - 1
        self.begins = np.flatnonzero(new)
        self.ends = np.append(self.begins[1:], n)
        by = np.repeat(owner, length + 1)[order]
        self.smallest = np.minimum.reduceat(by, self.begins) if n else by

    def matches(self) -> np.ndarray:
        """For every position of the indexed text at which a window starts, the smallest owner of that window (others:
        the largest long, which is below no owner).

        Streams all sequences backwards together.  The interval of the suffixes that start with the symbols read is
        extended by the next symbol on the left; once it is longer than a window it is cut back to one, the group of
        its suffixes.  Every sequence is itself in the index, so no interval ever runs empty.
        """
        out = np.full(len(self.text), np.iinfo(np.int64).max)
        at = np.argsort(self.first - self.last, kind="stable")  # longest first
        first, pos = self.first[at], self.last[at].copy()
        n = len(self.text)
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), n, np.int64)
        steps, depth = int((self.last - self.first).max(initial=0)), 0
        length = self.last[at] - first
        for t in range(steps):
            live = int(np.searchsorted(-length, -t, "left"))  # sequences longer than t
            lo, hi, pos = lo[:live], hi[:live], pos[:live] - 1
            c = self.text[pos]
            both = self.less[np.concatenate([c, c])] + self.before.rank(np.concatenate([c, c]), np.concatenate([lo, hi]))
            lo, hi = both[:live], both[live:]
            depth += 1
            if depth >= self.window:
                g = self.group[lo]
                out[pos] = self.smallest[g]
                lo, hi, depth = self.begins[g], self.ends[g], self.window
        return out
