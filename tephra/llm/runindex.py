"""Run-length index of short texts: a run-compressed Burrows-Wheeler transform with samples at run ends.

The index answers one question about the texts it was built from: at which starts does a string of `width`
symbols stand that also starts elsewhere in them. Matching statistics are streamed from the samples alone:
inside a run of the transform, the longest match at a start is that of the start before it less one, so only
run ends need a comparison of texts (irreducible values), and repetitive texts have few of them. Once built, an index
holds its runs, the starts at their ends and the matches there; neither texts nor suffix order are kept.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64


class RunIndex:
    """texts: bytes of all texts in one array; off: where each starts, with the end.

    Every start with `width` symbols before its text's end counts; texts have one at least. Matches of `width` symbols
    and more are exact; of a shorter one only that it is shorter.
    """

    def __init__(self, texts: np.ndarray, off: np.ndarray, width: int):
        length = np.diff(off)
        starts, n_texts = length - width + 1, len(length)
        # every text ends with a symbol of its own, so no match runs over an end
        self.off = off[:-1] + np.arange(n_texts)
        n = len(texts) + n_texts
        t = np.empty(n + 4, np.uint32)
        t[n:] = 0
        body = np.ones(n, bool)
        body[self.off + length] = False
        t[:n][body] = texts.astype(np.uint32) + 1
        t[self.off + length] = 257 + np.arange(n_texts)
        self.symbols, self.n, self.width = t, n, width
        if n_texts + 257 >= 1 << 16:
            raise ValueError("too many texts for one index")
        # the starts that count, as positions
        first = np.repeat(self.off, starts)
        within = np.arange(int(starts.sum())) - np.repeat(np.cumsum(starts) - starts, starts)
        self.at, self.head_of_text = first + within, within == 0
        self._compress(self._sort(int(length.max()) + 1))
        del self.symbols, self.ranks

    def _sort(self, longest: int) -> np.ndarray:
        """Suffix order by doubling: all positions up to half the longest text, then the starts that count."""
        t, n = self.symbols, self.n
        key = (t[:n].astype(U64) << U64(48)) | (t[1 : n + 1].astype(U64) << U64(32)) | (t[2 : n + 2].astype(U64) << U64(16)) | t[3 : n + 3].astype(U64)
        self.ranks, h = {}, 4
        while True:
            order = np.argsort(key)
            s = key[order]
            rank = np.zeros(n + 1, np.uint32)  # 0: past the end
            rank[order] = np.cumsum(np.append(1, s[1:] != s[:-1]))
            self.ranks[h] = rank
            if h * 3 >= longest:
                break
            key = (rank[:n].astype(U64) << U64(32)) | self._shifted(rank, h)
            h *= 2
        at = self.at
        wide = rank[at]
        for step in (h, max(h, longest - h)):  # h symbols are known; 3 * h reach the end
            key = (wide.astype(U64) << U64(32)) | rank[np.minimum(at + step, n)].astype(U64)
            order = np.argsort(key)
            s = key[order]
            wide = np.empty(len(at), np.uint32)
            wide[order] = np.cumsum(np.append(1, s[1:] != s[:-1]))
        return order

    def _shifted(self, rank: np.ndarray, h: int) -> np.ndarray:
        out = np.zeros(self.n, U64)
        out[: max(0, self.n - h)] = rank[h : self.n]
        return out

    def _compress(self, order: np.ndarray) -> None:
        """Runs of the transform, the samples at their ends and the match of each run's end with the next run's head.

        A run ends where the symbol before a start changes; a text's first start has none and is a run of its own.
        """
        sa = self.at[order]
        before = np.where(self.head_of_text[order], 0, self.symbols[np.maximum(sa, 1) - 1]).astype(np.int64)
        split = np.ones(len(sa) + 1, bool)
        split[1:-1] = (before[1:] != before[:-1]) | (before[1:] == 0)
        self.run_symbols = before[split[:-1]]
        self.run_lengths = np.diff(np.flatnonzero(split))
        self.run_heads, self.run_tails = sa[split[:-1]], sa[split[1:]]
        self.between = self._common(self.run_tails[:-1], self.run_heads[1:])

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at a and b have in common."""
        out = np.zeros(len(a), np.int64)
        for h in sorted(self.ranks, reverse=True):
            rank = self.ranks[h]
            for _ in range(3 if h == max(self.ranks) else 1):
                out += h * (rank[np.minimum(a + out, self.n)] == rank[np.minimum(b + out, self.n)])
        for _ in range(3):
            out += self.symbols[np.minimum(a + out, self.n)] == self.symbols[np.minimum(b + out, self.n)]
        return out

    def matching_statistics(self) -> np.ndarray:
        """Longest match elsewhere of each start, in the order of texts and starts."""
        best = np.zeros(len(self.at), np.int64)
        if not len(best):
            return best
        heads, tails = self.run_heads, self.run_tails
        zero = np.zeros(1, np.int64)
        # the first head has nothing before it, the last tail nothing after
        for ends, length in ((heads, np.concatenate([zero, self.between])), (tails, np.concatenate([self.between, zero]))):
            where = np.argsort(ends)
            ends, length = ends[where], length[where]
            sample = np.searchsorted(ends, self.at, "right") - 1
            best = np.maximum(best, length[sample] - (self.at - ends[sample]))
        return best

    def repeated(self) -> np.ndarray:
        """Which starts have `width` symbols that also start elsewhere."""
        return self.matching_statistics() >= self.width
