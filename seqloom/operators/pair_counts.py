"""Equal columns of all pairs of rows of one alignment, or of two parts of it, and what is asked of them.

Rows of one side stand as bits: for each column and letter, which of them have that letter there. For a
row of the other side the bits of its letters are added up by full adders, word by word, so a count of up
to 255 takes eight bits and no byte is ever counted for a single pair. A row's most equal columns are read
from the highest bit down; of the bits' side only those pairs are looked at that exceed what is known.
"""

from __future__ import annotations

import numpy as np

from seqloom.operators.bounds import least_matches

#: Bytes that the bits of one side take at most, rows of it at most, and words of a strip that is added up at once.
TABLE, SIDE, STRIP = 1 << 25, 1 << 14, 1 << 14
#: Rows up to which all of them are compared directly, and pairs from which on bits pay.
LEAF, PAY = 256, 1 << 18
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def pair_matches(a: np.ndarray, b: np.ndarray, gap: int) -> np.ndarray:
    """Equal columns, gaps never counting, of all pairs of rows of two code matrices.

    One side's gaps become a code that no row has. Columns add up in bytes, as many as a byte can
    count, and these sums in 32 bits.
    """
    free = np.iinfo(a.dtype).max
    left, right = np.ascontiguousarray(np.where(a == gap, free, a).T), np.ascontiguousarray(b.T)
    out = np.zeros((len(a), len(b)), dtype=np.int32)
    same = np.empty(out.shape, dtype=bool)
    for start in range(0, len(left), 255):
        some = np.zeros(out.shape, dtype=np.uint8)
        for x, y in zip(left[start : start + 255], right[start : start + 255], strict=True):
            np.equal(x[:, None], y[None, :], out=same)
            some += same.view(np.uint8)
        out += some
    return out


def pair_totals(codes: np.ndarray, copies: np.ndarray, second: np.ndarray | None, gap: int, theta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(neighbors, matches, best) of distinct rows as ``homology.row_statistics`` has them, over all pairs of
    them, or with ``second`` over pairs of rows for which it differs; best is -1 for rows without another one."""
    counted = _Counted(codes, copies, gap, theta)
    order = np.argsort(-counted.letters, kind="stable")  # rows with as many letters, so that columns drop out
    if second is None:
        counted.within(order)
        matches = counted.column_sums(order, order)
        own = counted.letters >= counted.need
        counted.neighbors[own] += copies[own]
        counted.best[copies > 1] = counted.letters[copies > 1]
        return counted.neighbors, matches, counted.best
    a, b = order[~second[order]], order[second[order]]
    counted.meet(a, b)
    matches = np.zeros(len(codes), np.int64)
    for x, y in ((a, b), (b, a)):
        matches[x] = counted.column_sums(x, y)[x]
    return counted.neighbors, matches, counted.best


class _Counted:
    """Rows of a task, as numbers of their letters (the gap's is the last), and what is known of each."""

    def __init__(self, codes: np.ndarray, copies: np.ndarray, gap: int, theta: float):
        present = np.zeros(int(max(codes.max(initial=0), gap)) + 1, bool)
        for at in range(0, len(codes), 4096):
            present[codes[at : at + 4096].ravel()] = True
        present[gap] = False
        self.symbols = int(present.sum()) + 1
        number = np.full(len(present), self.symbols - 1, np.uint8 if self.symbols <= 255 else np.uint32)
        number[present] = np.arange(self.symbols - 1)
        self.rows, self.copies = number[codes], copies
        self.letters = (codes != gap).sum(axis=1).astype(np.int64)
        self.need = least_matches(np.maximum(self.letters, 1), theta)
        self.neighbors, self.best = np.zeros(len(codes), np.int64), np.full(len(codes), -1, np.int64)

    def column_sums(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal columns of each row of a with all copies of all rows of b, from letters of columns."""
        out, weights = np.zeros(len(self.rows), np.int64), self.copies[b].astype(np.float64)
        for k in range(self.rows.shape[1]):
            times = np.bincount(self.rows[b, k], weights=weights, minlength=self.symbols).astype(np.int64)
            times[-1] = 0
            out[a] += times[self.rows[a, k]]
        return out

    def within(self, rows: np.ndarray) -> None:
        """All pairs of some rows."""
        if len(rows) > LEAF:
            half = len(rows) // 2
            self.within(rows[:half])
            self.within(rows[half:])
            self.meet(rows[:half], rows[half:])
        elif len(rows) > 1:
            same = self._direct(rows, rows)
            np.fill_diagonal(same, -1)
            self._take(rows, rows, same)

    def meet(self, a: np.ndarray, b: np.ndarray) -> None:
        """All pairs of a row of a and one of b."""
        if not len(a) or not len(b):
            return
        if len(a) * len(b) < PAY or min(self.need[a].min(), self.need[b].min()) < 1:
            for at in range(0, len(a), LEAF):
                for to in range(0, len(b), 8 * LEAF):
                    x, y = a[at : at + LEAF], b[to : to + 8 * LEAF]
                    same = self._direct(x, y)
                    self._take(x, y, same)
                    self._take(y, x, same.T)
            return
        if len(a) < len(b):
            a, b = b, a  # bits of the smaller side
        for x in (a, b):
            self.best[x] = np.maximum(self.best[x], 0)
        side = min(SIDE, max(64, TABLE * 8 // (self.rows.shape[1] * self.symbols) // 64 * 64))
        for at in range(0, len(b), side):
            self._by_bits(a, b[at : at + side])

    def _direct(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return pair_matches(self.rows[a], self.rows[b], self.symbols - 1)

    def _take(self, a: np.ndarray, b: np.ndarray, same: np.ndarray) -> None:
        """What rows of a learn from their equal columns with rows of b, -1 being no pair."""
        most = same.max(axis=1)
        self.best[a] = np.maximum(self.best[a], most)
        some = np.flatnonzero(most >= self.need[a])
        self.neighbors[a[some]] += ((same[some] >= self.need[a[some], None]) & (same[some] >= 0)) @ self.copies[b]

    def _by_bits(self, a: np.ndarray, b: np.ndarray) -> None:
        words, width = -(-len(b) // 64), self.rows.shape[1]
        table = np.zeros((width * self.symbols, words * 8), np.uint8)
        kinds, letters = np.arange(self.symbols - 1)[:, None], np.ascontiguousarray(self.rows[b].T)
        for k in range(width):  # the gap's line stays zero
            bits = np.packbits(letters[k][None, :] == kinds.astype(letters.dtype), axis=1, bitorder="little")
            table[k * self.symbols : (k + 1) * self.symbols - 1, : bits.shape[1]] = bits
        table, held = table.view(np.uint64), (letters != self.symbols - 1).any(axis=1)
        high, free = max(1, STRIP // words), []
        for at in range(0, len(a), high):
            rows = a[at : at + high]
            strip = self.rows[rows]
            columns = np.flatnonzero(held & (strip != self.symbols - 1).any(axis=0))
            if not len(columns):
                continue
            free = [x for x in free if len(x) == len(rows)]
            lines = np.ascontiguousarray(strip.T[columns].astype(np.intp) + (columns * self.symbols)[:, None])
            slices = _added(table, lines, free)
            self._rows_learn(rows, b, slices)
            self._bits_learn(rows, b, slices)
            free += slices

    def _rows_learn(self, rows: np.ndarray, b: np.ndarray, slices: list[np.ndarray]) -> None:
        most, left = np.zeros(len(rows), np.int64), None
        for bit in reversed(slices):
            here = bit if left is None else bit & left
            some = here.any(axis=1)
            most = 2 * most + some
            left = np.where(some[:, None], here, ALL if left is None else left)
        self.best[rows] = np.maximum(self.best[rows], most)
        near = np.flatnonzero(most >= self.need[rows])
        for i in near:
            same = np.zeros(len(b), np.int64)
            for level, bit in enumerate(slices):
                same += np.unpackbits(bit[i].view(np.uint8), count=len(b), bitorder="little").astype(np.int64) << level
            self.neighbors[rows[i]] += self.copies[b[same >= self.need[rows[i]]]].sum()

    def _bits_learn(self, rows: np.ndarray, b: np.ndarray, slices: list[np.ndarray]) -> None:
        """Pairs that make a row of the bits' side a neighbour or have more equal columns than it had."""
        known = np.minimum(np.minimum(self.best[b], self.need[b] - 1), (1 << len(slices)) - 1)
        more = None
        for level, bit in enumerate(slices):
            line = np.zeros(bit.shape[1] * 8, np.uint8)
            packed = np.packbits((known >> level & 1).astype(bool), bitorder="little")
            line[: len(packed)] = packed
            line = line.view(np.uint64)
            above = bit & ~line
            more = above if more is None else above | (more & ~(bit ^ line))
        flat = more.ravel()
        word = np.flatnonzero(flat)
        if not len(word):
            return
        of, at = np.nonzero(np.unpackbits(flat[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        word = word[of]
        same, shift = np.zeros(len(word), np.int64), at.astype(np.uint64)
        for level, bit in enumerate(slices):
            same += (bit.ravel()[word] >> shift & np.uint64(1)).astype(np.int64) << level
        i, j = rows[word // more.shape[1]], word % more.shape[1] * 64 + at
        np.maximum.at(self.best, b[j], same)
        near = same >= self.need[b[j]]
        np.add.at(self.neighbors, b[j[near]], self.copies[i[near]])


def _added(table: np.ndarray, lines: np.ndarray, free: list[np.ndarray]) -> list[np.ndarray]:
    """The sums of the table's ``lines`` (one of each column, for each row), as bits from the lowest on.

    Three bits of one weight make one of it and one of twice it. ``free`` holds arrays to write to.
    """
    waiting: list[list[np.ndarray]] = [[]]
    new = lambda: free.pop() if free else np.empty((lines.shape[1], table.shape[1]), np.uint64)

    def put(bits: np.ndarray, level: int, enough: int) -> None:
        while True:
            if level == len(waiting):
                waiting.append([])
            at = waiting[level]
            at.append(bits)
            if len(at) < enough:
                return
            x, y, odd = at.pop(), at.pop(), new()
            np.bitwise_xor(x, y, out=odd)
            np.bitwise_and(x, y, out=y)
            if at:
                z = at.pop()
                np.bitwise_and(odd, z, out=x)
                np.bitwise_or(x, y, out=y)
                np.bitwise_xor(odd, z, out=odd)
                free.append(z)
            free.append(x)
            at.append(odd)
            bits, level = y, level + 1

    for line in lines:
        put(np.take(table, line, axis=0, out=new(), mode="clip"), 0, 3)
    level = 0
    while level < len(waiting):
        if len(waiting[level]) == 2:
            put(waiting[level].pop(), level, 2)
        level += 1
    return [at[0] for at in waiting]
