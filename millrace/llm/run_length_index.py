"""A run-length index of a collection of short texts: run-compressed Burrows-Wheeler transform, samples at run ends.

The texts stand one after another, each closed by END, which sorts after every byte of UTF-8.  The transform is kept as
runs; a run knows its head, its size, the suffix positions of its first and last row (the samples), and the run and offset
that a backward step from its first row leads to, so most steps look at one run and search nothing.

Patterns that need not be in the index are streamed from their ends.  The state is a row (run and offset), the position of its suffix
and the length that matches there.  Where the next byte heads the row's run, the step is taken.  Else the row moves to the nearest
run end with that head, above or below, whichever shares more with the row; the sample gives its position, so the
shared length is read off the texts.  That yields the matching statistics: for each place of a pattern the longest
match that begins there, counted up to ``length``.  Where it is ``length``, the row lies in an interval of rows that agree in
``length`` bytes, for which the least owner is kept.
"""

from __future__ import annotations

import numpy as np

END = 255  # not a byte of UTF-8


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, first byte lowest, as a view of a padded copy."""
    padded = np.concatenate([text, np.full(8, END, np.uint8)])
    return np.ndarray(len(text), "<u8", padded.data, strides=(1,))


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array, by doubling: ranks of prefixes, then of pairs of ranks, only where suffixes still tie."""
    n = len(text)
    bits = max(1, n.bit_length())
    mask = np.uint64((1 << bits) - 1)
    used = np.bincount(text, minlength=256) > 0
    wide = max(1, int(used.sum()).bit_length())  # codes from 1, 0 is beyond the end
    code = np.concatenate([np.cumsum(used)[text].astype(np.uint64), np.zeros(64, np.uint64)])
    depth = max(1, (64 - bits) // wide)
    key = np.zeros(n, np.uint64)
    for i in range(depth):
        key <<= np.uint64(wide)
        key |= code[i : i + n]
    key = np.sort(key << np.uint64(bits) | np.arange(n, dtype=np.uint64))
    order = (key & mask).astype(np.int64)
    key >>= np.uint64(bits)
    new = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(tied):
        at = order[tied]
        group, then = rank[at], rank[np.minimum(at + depth, n)] + 1
        if 3 * bits <= 64:
            key = np.sort((group << (2 * bits) | then << bits | at).astype(np.uint64))
            at = (key & mask).astype(np.int64)
            key >>= np.uint64(bits)
            new = np.concatenate([[True], key[1:] != key[:-1]])
        else:  # a text too long for packed keys
            by = np.lexsort((then, group))
            at, group, then = at[by], group[by], then[by]
            new = np.concatenate([[True], (group[1:] != group[:-1]) | (then[1:] != then[:-1])])
        order[tied] = at
        rank[at] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        tied = tied[~(new & np.append(new[1:], True))]
        depth *= 2
    return order


class RunLengthIndex:
    def __init__(self, texts: np.ndarray, lens: np.ndarray, owners: np.ndarray, length: int):
        """``texts``: bytes of all texts, joined, none of them END; ``owners``: the owner of each text."""
        self.length = length
        m, n = len(lens), int(lens.sum()) + len(lens)
        ends = np.cumsum(lens + 1) - 1
        text = np.full(n, END, np.uint8)
        inner = np.ones(n, bool)
        inner[ends] = False
        text[inner] = texts
        self.n, self.words = n, _words(text)
        if not n:
            return
        rows = suffix_order(text)
        heads = text[rows - 1]
        new = np.concatenate([[True], heads[1:] != heads[:-1]])
        small = np.int32 if n < 1 << 31 else np.int64
        self.at = np.flatnonzero(new).astype(small)
        self.size = np.diff(self.at, append=n).astype(small)
        self.head = heads[self.at]
        runs = len(self.at)
        self.first, self.last = rows[self.at].astype(small), rows[self.at + self.size - 1].astype(small)
        self.by_head = np.argsort(self.head, kind="stable")
        self.key = self.head[self.by_head].astype(np.int64) * runs + self.by_head
        self.to_run, self.to_offset = np.empty(runs, small), np.empty(runs, small)
        to = np.cumsum(self.size[self.by_head]) - self.size[self.by_head]
        run = np.searchsorted(self.at, to.astype(small), "right") - 1
        self.to_run[self.by_head], self.to_offset[self.by_head] = run, to - self.at[run]
        # intervals of rows that agree in ``length`` bytes, and their least owners
        of = np.repeat(np.arange(m), lens + 1)
        spare = ends[of] - np.arange(n)
        full = np.flatnonzero(spare[rows] >= length)
        same = np.flatnonzero(full[1:] == full[:-1] + 1) + 1
        for d in [*range(0, length - 7, 8), length - 8]:
            here = rows[full[same]] + d
            above = rows[full[same] - 1] + d
            same = same[self.words[here] == self.words[above]]
        begins = np.ones(len(full), bool)
        begins[same] = False
        self.interval = np.zeros(n, small)
        self.interval[full] = np.cumsum(begins) - 1
        self.interval_owner = np.minimum.reduceat(owners[of[rows[full]]], np.flatnonzero(begins)) if len(full) else np.zeros(0, np.int64)

    @property
    def runs(self) -> int:
        return len(self.at)

    def _shared(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at ``a`` and ``b`` share, ``most`` at most."""
        out = np.zeros(len(a), np.int64)
        left = np.flatnonzero(most > 0)
        top = self.n - 1
        while len(left):
            x = self.words[np.minimum(a[left] + out[left], top)] ^ self.words[np.minimum(b[left] + out[left], top)]
            out[left] += np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3
            left = left[(x == 0) & (out[left] < most[left])]
        return np.minimum(out, most)

    def _jump(self, run: np.ndarray, place: np.ndarray, size: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, ...]:
        """The run, offset, position and shared length of the best row that ``byte`` heads; run -1 where there is none."""
        wanted = byte.astype(np.int64) * self.runs
        i = np.searchsorted(self.key, wanted + run)
        below = self.by_head[np.minimum(i, self.runs - 1)]
        above = self.by_head[i - 1]
        has_below = (i < self.runs) & (self.head[below] == byte)
        has_above = (i > 0) & (self.head[above] == byte)
        down = np.where(has_below, self._shared(place, self.first[below], np.where(has_below, size, 0)), -1)
        up = np.where(has_above, self._shared(place, self.last[above], np.where(has_above, size, 0)), -1)
        use = up > down
        to = np.where(use, above, below)
        return np.where(has_above | has_below, to, -1), np.where(use, self.size[above] - 1, 0), np.where(use, self.last[above], self.first[below]), np.maximum(up, down)

    def matches(self, texts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Streams patterns: number and start of each string of ``length`` bytes that the index has, and its least owner there."""
        none = (np.zeros(0, np.int64),) * 3
        if not self.n or not len(lens) or int(lens.max()) < self.length:
            return none
        by = np.argsort(-lens, kind="stable")
        by = by[: len(by) - int(np.searchsorted(lens[by][::-1], self.length))]
        ends, lens = np.cumsum(lens)[by], lens[by]
        run, offset, size = (np.zeros(len(by), self.at.dtype) for _ in range(3))
        place = np.full(len(by), self.first[0], self.at.dtype)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        lost = none[0]
        for t in range(1, int(lens[0]) + 1):
            m = len(lens) - int(np.searchsorted(lens[::-1], t))  # lengths fall: patterns with a byte left stand first
            byte = texts[ends[:m] - t]
            r, o, p, s = run[:m], offset[:m], place[:m], size[:m]
            bad = np.flatnonzero(self.head[r] != byte)
            if len(bad):
                r[bad], o[bad], p[bad], s[bad] = self._jump(r[bad], p[bad], s[bad], byte[bad])
                lost = bad[r[bad] < 0]
                r[lost] = 0
            o += self.to_offset[r]
            r[:] = self.to_run[r]
            over = np.flatnonzero(o >= self.size[r])  # the step ends in a run further on
            for _ in range(3):
                o[over] -= self.size[r[over]]
                r[over] += 1
                over = over[o[over] >= self.size[r[over]]]
            if len(over):
                row = self.at[r[over]] + o[over]
                to = np.searchsorted(self.at, row, "right") - 1
                r[over], o[over] = to, row - self.at[to]
            p -= 1
            np.minimum(s + 1, self.length, out=s)  # longer matches needn't be told apart: rows that share ``length`` bytes stand together
            if len(bad) and len(lost):  # a byte that the index lacks: begin again
                r[lost], o[lost], s[lost], p[lost] = 0, 0, 0, self.first[0]
            if t >= self.length:
                hit = np.flatnonzero(s >= self.length)
                if len(hit):
                    owner = self.interval_owner[self.interval[self.at[r[hit]] + o[hit]]]
                    out.append((by[hit], lens[hit] - t, owner))
            if len(bad):  # patterns whose bytes left can't make a match of ``length`` any more are done
                able = s + (lens[:m] - t) >= self.length
                if able.sum() < 0.9 * m:
                    kept = np.flatnonzero(able)
                    by, ends, lens, run, offset, place, size = (x[kept] for x in (by, ends, lens, run, offset, place, size))
                    if not len(kept):
                        break
        return tuple(np.concatenate(x) for x in zip(*out)) if out else none
