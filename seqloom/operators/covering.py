"""Neighbours among many rows by keys of which every near pair shares one.

Two rows that are neighbours differ in few of the shorter one's columns, its spare ones. Columns are dealt into parts,
so many that in one of them at most a few of these can lie, and a part's columns into keys of which one holds none of
any so few columns. So near pairs agree in all columns of some key, whatever their letters are, and only rows that
agree in one are compared. A part's columns are spread over the width, since letters side by side, or a line that many rows begin
with, say little. The number of keys doesn't grow with the rows.

Rows are taken by classes, by how many of the least gapped columns they have letters in; a class has keys of its
own on columns that all its rows have letters in, and its rows are looked up among all longer ones. A class in
which keys would not pay, and rows of which very many agree in a key, are left to the caller.
"""

from __future__ import annotations

import numpy as np

#: Columns of a key at most, and radii of which the cheapest is taken.
MOST_KEY, RADII = 8, 4
#: A class's shortest run of letters as a share of its longest.
NARROWER = 0.8
#: What a key costs, each row of its class, each row looked up there, a pair that agrees in a key, and a pair of all pairs (ns).
LEAST_COST, KEY_COST, SEEK_COST, PAIR_COST, ALL_COST = 100_000, 40, 20, 150, 100
#: Rows of a class that agree in a key from which on they are left to be compared all with all.
CROWD = 128
#: Columns compared first, pairs compared at a time, pairs from which on repeated ones are dropped, and near pairs held at most.
FIRST, AT_ONCE, REPEATED, MOST_FOUND = 64, 1 << 17, 1 << 22, 1 << 25


def covering_keys(columns: np.ndarray, share: np.ndarray, spare: int, radius: int) -> list[np.ndarray]:
    """Sets of columns of which one holds none of any ``spare`` columns; empty if there are too few columns.

    In one of ``spare // (radius + 1) + 1`` parts are ``radius`` of them at most. Columns of a part stand for the vectors
    of ``radius + 1`` bits but 0, and for each such vector the columns not orthogonal to it are a key: ``radius`` vectors are all
    orthogonal to some other one. Of a key the columns that tell most are kept.
    """
    parts, period = spare // (radius + 1) + 1, (2 << radius) - 1
    if len(columns) < parts * period:
        return []
    out = []
    for p in range(parts):
        own = columns[p::parts]
        vector = np.arange(len(own)) % period + 1
        of_key = (np.bitwise_count(vector & np.arange(1, period + 1)[:, None]) & 1) == 1
        for held in of_key:
            key = own[held]
            out.append(key if len(key) <= MOST_KEY else key[np.argsort(share[key], kind="stable")[:MOST_KEY]])
    return out


def _keys_and_chance(columns: np.ndarray, share: np.ndarray, spare: int, radius: int) -> tuple[int, float]:
    """How many keys these would be, and about how many of them two unlike rows agree in."""
    parts, period = spare // (radius + 1) + 1, (2 << radius) - 1
    if len(columns) < parts * period:
        return 0, 0.0
    size = min(MOST_KEY, len(columns) / parts * (1 << radius) / period)
    return parts * period, parts * period * float(np.exp(np.log(np.maximum(share[columns], 1e-9)).mean() * size))


def letter_shares(codes: np.ndarray, gap: int) -> np.ndarray:
    """For each column about the share of pairs of rows that have one letter there."""
    width, places = codes.shape[1], (codes % 251).astype(np.int64) + 251 * np.arange(codes.shape[1])
    times = np.bincount(places[codes != gap], minlength=251 * width).reshape(width, 251)
    return (times.astype(float) ** 2).sum(axis=1) / max(len(codes), 1) ** 2


def _classes(run: np.ndarray, width: int) -> list[np.ndarray]:
    out, high = [], width
    while high > 0:
        low = high if high == width else max(int(np.ceil(NARROWER * high)), 1)
        rows = np.flatnonzero((run >= low) & (run <= high))
        if len(rows):
            out.append(rows)
        high = low - 1
    return out


def keyed_neighbors(codes: np.ndarray, copies: np.ndarray, side: np.ndarray | None, gap: int, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(copies of neighbours of each row; crowd; rest), without the rows themselves, or None where keys don't pay.

    ``need`` are the equal columns that each row asks for, more for a row of more letters. What is counted are all pairs
    but those of two rows of the crowd and those with a row of the rest; with ``side`` only pairs of both sides.
    """
    n, width = codes.shape
    letters = codes != gap
    lengths = letters.sum(axis=1)
    columns = np.argsort(-letters.sum(axis=0), kind="stable")
    run = np.where(letters.all(axis=1), width, np.argmin(letters[:, columns], axis=1))
    del letters
    spare = lengths - need
    share = letter_shares(codes[:: -(-n // 4096)], gap)

    plans, rest = [], np.ones(n, bool)
    for rows in _classes(run, width):
        longer = lengths >= lengths[rows].min()
        longer[rows] = False
        many, others = len(rows), int(longer.sum())
        pairs = many * (many / 2 + others)
        own, most = columns[: run[rows].min()], int(spare[rows].max())
        least, best = ALL_COST * pairs, None
        for radius in range(RADII):
            count, chance = _keys_and_chance(own, share, most, radius)
            cost = count * (LEAST_COST + KEY_COST * many + (SEEK_COST * n if others else 0)) + chance * pairs * PAIR_COST
            if count and cost < least:
                least, best = cost, radius
        if best is not None:
            plans.append((rows, covering_keys(own, share, most, best), pairs))
            rest[rows] = False
    if rest.sum() > n / 4:
        return None

    small = np.ascontiguousarray((codes % 251).astype(np.uint8, copy=False).T)
    fill = -width % 8
    wide = np.pad(codes, ((0, 0), (0, fill)), constant_values=gap) if fill else codes
    first = np.argsort(share, kind="stable")[:FIRST]
    after = lengths - (codes[:, first] != gap).sum(axis=1)
    head = np.ascontiguousarray(wide[:, np.pad(first, (0, -len(first) % 8), constant_values=width)])  # narrow rows are filled up with gaps

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Pairs of which one row may be the other's neighbour, as one number each."""
        ok = (lengths[y] > lengths[x]) | ((lengths[y] == lengths[x]) & (y > x)) | same_class[y]
        if side is not None:
            ok &= side[x] != side[y]
        x, y = x[ok], y[ok]
        least = np.minimum(need[x], need[y])
        left = head[x]
        ok = _ones((left == head[y]) & (left != gap)) + np.minimum(after[x], after[y]) >= least
        x, y, least = x[ok], y[ok], least[ok]
        left = wide[x]
        ok = _ones((left == wide[y]) & (left != gap)) >= least
        return x[ok] * n + y[ok]

    crowd, found, bits = np.zeros(n, bool), [], np.uint64(max(n - 1, 1).bit_length())
    mask, key = np.uint64((1 << int(bits)) - 1), np.zeros(n, np.uint64)
    for rows, keys, pairs in plans:
        same_class = np.zeros(n, bool)
        same_class[rows] = True
        others = ~same_class & ~rest & (lengths >= lengths[rows].min())
        lone, begun, most, own, in_crowd = not others.any(), 0, max(1 << 20, pairs * ALL_COST / PAIR_COST), [], np.zeros(len(rows), bool)
        size = np.uint64(max(len(rows) - 1, 1).bit_length() + 4)
        for chosen in keys:
            key[:] = 0
            for t, k in enumerate(chosen):
                key.view(np.uint8).reshape(n, 8)[:, t] = small[k]
            mixed = key * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            at = rows
            if not lone:
                place = (mixed >> (np.uint64(64) - size)).astype(np.int64)
                held = np.zeros(1 << int(size), bool)
                held[place[rows]] = True
                at = np.concatenate((rows, np.flatnonzero(held[place] & others)))
            order = np.sort((mixed[at] & ~mask) | np.arange(len(at), dtype=np.uint64))
            if len(order) < 2:
                continue
            same = (order[1:] >> bits) == (order[:-1] >> bits)
            order = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
            if not len(order):
                continue
            # rows that agree are side by side, those of the class first; each of these meets all after it
            value, index = order >> bits, (order & mask).astype(np.int64)
            starts = np.concatenate(([0], np.flatnonzero(value[1:] != value[:-1]) + 1))
            ends = np.concatenate((starts[1:], [len(order)]))
            member = index < len(rows)
            inside = np.add.reduceat(member.astype(np.int64), starts)
            group = np.repeat(np.arange(len(starts)), ends - starts)
            p = np.flatnonzero(member)
            g = group[p]
            many = inside[g] > CROWD
            in_crowd[index[p[many]]] = True
            to = np.where(many, starts[g] + inside[g], p + 1)
            count = ends[g] - to
            p, to, count = p[count > 0], to[count > 0], count[count > 0]
            begun += int(count.sum())
            if begun > most:
                break
            total = np.cumsum(count)
            low = 0
            while low < len(p):
                high = max(int(np.searchsorted(total, (total[low - 1] if low else 0) + AT_ONCE, side="right")), low + 1)
                c = count[low:high]
                upto = np.cumsum(c)
                second = np.arange(upto[-1]) - np.repeat(upto - c - to[low:high], c)
                own.append(near(at[index[np.repeat(p[low:high], c)]], at[index[second]]))
                low = high
            if sum(map(len, own)) > REPEATED:
                own = [np.unique(np.concatenate(own))]
                if len(own[0]) > REPEATED / 2 and len(own[0]) + sum(map(len, found)) > MOST_FOUND:
                    return None
        if begun > most:
            rest[rows] = True
            continue
        crowd[rows[in_crowd]] = True
        if own:
            found.append(np.unique(np.concatenate(own)))
    if rest.sum() > n / 4:
        return None
    crowd &= ~rest

    pairs = np.concatenate(found) if found else np.zeros(0, np.int64)
    x, y = pairs // n, pairs % n
    kept = ~(rest[x] | rest[y] | (crowd[x] & crowd[y]))
    x, y = x[kept], y[kept]
    out = np.zeros(n, np.int64)
    for low in range(0, len(x), 1 << 20):
        i, j = x[low : low + (1 << 20)], y[low : low + (1 << 20)]
        left = codes[i]
        same = ((left == codes[j]) & (left != gap)).sum(axis=1)
        for a, b in ((i, j), (j, i)):
            np.add.at(out, a[same >= need[a]], copies[b[same >= need[a]]])
    return out, crowd, rest


def _ones(equal: np.ndarray) -> np.ndarray:
    """The true ones in each row, of a width that 8 divides."""
    return np.bitwise_count(np.ascontiguousarray(equal).view(np.uint64)).sum(axis=1, dtype=np.int64)
