"""A run-length index of short texts: a run-compressed Burrows-Wheeler transform with sampled run ends."""

from __future__ import annotations

import numpy as np

#: Ends each indexed text; no UTF-8 text holds this byte.
END = 0xFF


def _dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


class RunIndex:
    """Index of texts (each followed by END in `data`) for matches of `length` bytes, length from 32 to 64.

    Kept: the runs of the transform with their characters and counts, the text position at each run's first and last
    row, the texts for comparing such positions, and for each block of rows whose suffixes begin with the same `length`
    bytes the smallest of the texts' values. Suffixes are ordered up to their text's END, then by position.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, values: np.ndarray, length: int) -> None:
        n, self.length = len(data), length
        ends = np.append(starts[1:], n) - 1
        owner = np.repeat(np.arange(len(starts)), ends - starts + 1)
        left = ends[owner] - np.arange(n)  # bytes before END
        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        key = np.zeros(n, np.uint64)
        for k in range(8):
            key = (key << np.uint64(8)) | np.where(left >= k, padded[k : n + k], 0).astype(np.uint64)
        rank, depth, at_half = _dense(key), 8, None
        while depth <= int(left.max(initial=0)) + 1 or depth <= 32:
            if depth == 32:
                at_half = rank
            ahead = np.zeros(n, np.int64)
            ahead[: max(n - depth, 0)] = rank[depth:] + 1
            rank = _dense(rank * (n + 2) + np.where(left >= depth, ahead, 0))
            depth *= 2
        order = np.argsort(rank, kind="stable")
        # suffixes share `length` bytes if they share 32 from both ends of them
        later = np.minimum(np.arange(n) + length - 32, n - 1)
        one, two, long = at_half[order], at_half[later[order]], left[order] >= length
        cut = np.ones(n, bool)
        cut[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | ~long[1:] | ~long[:-1]
        self.block = np.flatnonzero(cut)
        self.block_least = np.minimum.reduceat(values[owner][order], self.block)
        last = data[order - 1]
        last[order == 0] = END
        self.run = np.flatnonzero(np.concatenate(([True], last[1:] != last[:-1])))
        self.run_end = np.append(self.run[1:], n) - 1
        self.run_char = last[self.run].astype(np.int64)
        self.first, self.last = order[self.run], order[self.run_end]
        size = self.run_end - self.run + 1
        by_char = np.lexsort((np.arange(len(self.run)), self.run_char))
        running = np.cumsum(size[by_char]) - size[by_char]
        char = self.run_char[by_char]
        self.before = np.zeros(len(self.run), np.int64)  # of the same character in earlier runs
        self.before[by_char] = running - running[np.searchsorted(char, char)]
        self.by_char, self.by_char_key = by_char, (char << 40) | by_char
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(data, minlength=256))))
        self.data = np.concatenate((data, np.zeros(2 * length + 64, np.uint8)))

    def common(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Length of the common beginning of the suffixes at a and b, up to `most`."""
        step = np.arange(most)
        differ = self.data[a[:, None] + step] != self.data[b[:, None] + step]
        return np.where(differ.any(axis=1), differ.argmax(axis=1), most)

    def long_matches(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, offset) of the matches of `length` bytes with an indexed text of a smaller value than the pattern's.

        All patterns stream through the index at once, each from its last byte to its first, with a row, the text
        position there and the matching statistic. Where a row's character isn't the pattern's, the nearest row above
        or below that has it goes on, at a sampled run end, whichever has more in common with the present position.
        """
        by = np.argsort(-sizes, kind="stable")
        starts, sizes, values = starts[by], sizes[by], values[by]
        longest = int(sizes[0]) if len(sizes) else 0
        row, place, match = np.zeros(len(by), np.int64), np.full(len(by), self.first[0]), np.zeros(len(by), np.int64)
        out_pattern, out_offset = [], []
        for step in range(longest):
            m = int(np.searchsorted(-sizes, -step, side="left"))  # patterns of more than `step` bytes
            char = data[starts[:m] + sizes[:m] - 1 - step].astype(np.int64)
            r, s, ell = row[:m], place[:m], match[:m]
            run = np.searchsorted(self.run, r, side="right") - 1
            odd = np.flatnonzero(self.run_char[run] != char)
            lost = np.zeros(m, bool)
            if len(odd):
                c = char[odd]
                below = np.searchsorted(self.by_char_key, (c << 40) | run[odd])
                above = below - 1
                has_below = (below < len(self.by_char)) & (self.run_char[self.by_char[np.minimum(below, len(self.by_char) - 1)]] == c)
                has_above = (above >= 0) & (self.run_char[self.by_char[np.maximum(above, 0)]] == c)
                run_below, run_above = self.by_char[np.minimum(below, len(self.by_char) - 1)], self.by_char[np.maximum(above, 0)]
                most = int(ell[odd].max()) + 1
                far_below = np.where(has_below, self.common(s[odd], self.first[run_below], most), -1)
                far_above = np.where(has_above, self.common(s[odd], self.last[run_above], most), -1)
                down = far_below > far_above
                r[odd] = np.where(down, self.run[run_below], self.run_end[run_above])
                s[odd] = np.where(down, self.first[run_below], self.last[run_above])
                ell[odd] = np.minimum(ell[odd], np.maximum(far_below, far_above))
                gone = odd[~has_below & ~has_above]
                lost[gone] = True
                r[gone], s[gone], ell[gone] = 0, self.first[0], 0
                run = np.searchsorted(self.run, r, side="right") - 1
            go = ~lost
            r[go] = (self.smaller[char] + self.before[run] + r - self.run[run])[go]
            s[go] -= 1
            ell[go] += 1
            hit = np.flatnonzero(ell >= self.length)
            if len(hit):
                block = np.searchsorted(self.block, r[hit], side="right") - 1
                hit = hit[self.block_least[block] < values[hit]]
                out_pattern.append(by[hit])
                out_offset.append(sizes[hit] - 1 - step)
        none = np.zeros(0, np.int64)
        return (np.concatenate(out_pattern), np.concatenate(out_offset)) if out_pattern else (none, none)
