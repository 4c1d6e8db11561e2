"""Neighbours inside alignments without comparing all pairs of rows.

Row j is a neighbour of row i when their equal columns reach what i's letters ask for. Rows that are
alike are dealt into the same blocks, by the nearest of a few rows of the alignment. A block's summary
bounds from above what any of its rows can share with any row of another block: letter by letter by
how often each occurs, column by column by which letters occur there, and by how far the blocks'
centres are apart and rows from their own centre. Block pairs that can't
reach the least number of equal columns asked for are never formed; of the others, rows that can't
reach any row of the other block drop out, and pairs drop out as soon as the columns compared leave
too few to come. All bounds hold whatever gaps there are, since a gap only ever takes away.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators.covering import keyed_neighbors
from seqloom.plans.lineage import cut, stored
from seqloom.plans.shipping import ship_package

#: Rows of a block at most on average, how many times as many one of the chosen rows draws about, and chosen
#: rows of an alignment at most.
BLOCK, DRAWS, MOST_CHOSEN = 1024, 4, 512
#: Turns in which rows are chosen, from those that none was near to before.
TURNS = 3
#: Rings around a chosen row: shares of a row's letters in which it may differ.
RINGS = (0.15, 0.3, 0.5)
#: Rows that one task assigns to their nearest chosen row.
SLICE = 8192
#: Letters are told apart by their code point modulo this; letters that fall together only loosen a bound.
SYMBOLS = 61
#: Columns that are compared before pairs drop out, rows of one side at a time, and the share of pairs
#: left from which on they are compared one by one.
STEP, TILE, FEW = 24, 256, 1 / 12
#: Summaries of blocks that one side of a task of bounds holds.
SUMMARIES = 512
#: Rows of an alignment that one side of a task holds, and tiles of an alignment that all meet each other at most.
TILE_ROWS, MOST_TILES = 1 << 17, 16
#: Rows from which on a task compares those that agree in keys.
KEYED_ROWS = 512
#: Rows from which on a ball of similar rows is a block of its own inside a task, and letters of a column
#: on average up to which a block's letters are held against single rows of another one.
LEAST_BALL, TIGHT = 32, 8


def code_matrix(rows: list[str], gap: str) -> tuple[np.ndarray, int]:
    """Rows of one width as a matrix of small codes, and the gap's code; any characters are told apart."""
    points = np.frombuffer("".join(rows).encode("utf-32-le"), dtype="<u4")
    symbols, codes = np.unique(np.append(points, ord(gap)), return_inverse=True)
    kind = np.uint8 if len(symbols) < 255 else np.uint32
    return codes[:-1].astype(kind).reshape(len(rows), -1), int(codes[-1])


def least_matches(lengths: np.ndarray, theta: float) -> np.ndarray:
    """The fewest equal columns m with ``1 - m / length <= theta``, by that very rule."""
    low = np.maximum(np.floor((1 - theta) * lengths).astype(np.int64) - 1, 0)
    for _ in range(4):
        low = np.where(1 - low / lengths <= theta, low, low + 1)
    return low


def column_sets(codes: np.ndarray, gap: int) -> np.ndarray:
    """For each column the set of codes that occur there, gaps left out, as bits (codes modulo 63)."""
    bits = np.where(codes == gap, np.uint64(0), np.uint64(1) << (codes % 63).astype(np.uint64))
    return np.bitwise_or.reduce(bits, axis=0) if len(codes) else np.zeros(codes.shape[1], np.uint64)


def reach(codes: np.ndarray, gap: int, sets: np.ndarray) -> np.ndarray:
    """The most equal columns that each row can have with any row behind the sets."""
    held = (sets[None, :] >> (codes % 63).astype(np.uint64)) & np.uint64(1)
    return np.where(codes == gap, 0, held).sum(axis=1).astype(np.int64)


def near_within(rows: np.ndarray, copies: np.ndarray, gap: int, theta: float) -> np.ndarray:
    """Copies of all rows of a block that are neighbours of each of them; a pair is looked at once for both ways."""
    out = np.zeros(len(rows), np.int64)
    need = least_matches(np.maximum((rows != gap).sum(axis=1), 1), theta)
    order = _telling_columns(rows, rows, gap)
    free = np.iinfo(rows.dtype).max
    left, right = np.ascontiguousarray(np.where(rows == gap, free, rows)[:, order].T), np.ascontiguousarray(rows[:, order].T)
    rest = _rest(rows[:, order] != gap)
    for low in range(0, len(rows), TILE):
        high = min(low + TILE, len(rows))
        x, y, same = _survivors(left[:, low:high], right[:, low:], need[low:high], need[low:], rest[:, low:high], rest[:, low:])
        x, y = x + low, y + low
        near = (same >= need[x]) & (y >= x)
        out += np.bincount(x[near], weights=copies[y[near]], minlength=len(rows)).astype(np.int64)
        near = (same >= need[y]) & (y > x)
        out += np.bincount(y[near], weights=copies[x[near]], minlength=len(rows)).astype(np.int64)
    return out


def near_weights(a: np.ndarray, b: np.ndarray, copies_a: np.ndarray, copies_b: np.ndarray, gap: int, theta: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Copies of rows of b that are neighbours of each row of a, the other way round, and pairs begun.

    Columns in which most pairs differ come first. A pair goes on while the columns to come could
    still make one of both rows the other's neighbour.
    """
    out_a, out_b, begun = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), 0
    need_a, need_b = (least_matches(np.maximum((x != gap).sum(axis=1), 1), theta) for x in (a, b))
    keep_a = np.flatnonzero(reach(a, gap, column_sets(b, gap)) >= np.minimum(need_a, need_b.min()))
    keep_b = np.flatnonzero(reach(b, gap, column_sets(a, gap)) >= np.minimum(need_b, need_a.min()))
    if not len(keep_a) or not len(keep_b):
        return out_a, out_b, begun
    a, b, need_a, need_b = a[keep_a], b[keep_b], need_a[keep_a], need_b[keep_b]
    order = _telling_columns(a, b, gap)
    free = np.iinfo(a.dtype).max  # a code that no row has, in place of one side's gaps
    left, right = np.ascontiguousarray(np.where(a == gap, free, a)[:, order].T), np.ascontiguousarray(b[:, order].T)
    rest_a, rest_b = (_rest(x[:, order] != gap) for x in (a, b))
    for low in range(0, len(a), TILE):
        rows = np.arange(low, min(low + TILE, len(a)))
        begun += len(rows) * len(b)
        x, y, same = _survivors(left[:, rows], right, need_a[rows], need_b, rest_a[:, rows], rest_b)
        near = same >= need_a[rows][x]
        out_a[keep_a[rows]] += np.bincount(x[near], weights=copies_b[keep_b][y[near]], minlength=len(rows)).astype(np.int64)
        near = same >= need_b[y]
        out_b[keep_b] += np.bincount(y[near], weights=copies_a[keep_a[rows]][x[near]], minlength=len(b)).astype(np.int64)
    return out_a, out_b, begun


def _telling_columns(a: np.ndarray, b: np.ndarray, gap: int) -> np.ndarray:
    """Columns by the share of pairs that have two different letters there, most first."""
    size = int(max(a.max(initial=0), b.max(initial=0), gap)) + 1
    width = a.shape[1]
    flat = lambda m: np.bincount((m.astype(np.int64) + size * np.arange(width)).ravel(), minlength=size * width).reshape(width, size) / len(m)
    if size > 256:
        return np.arange(width)
    share_a, share_b = flat(a), flat(b)
    share_a[:, gap] = share_b[:, gap] = 0
    return np.argsort(-(share_a.sum(axis=1) * share_b.sum(axis=1) - (share_a * share_b).sum(axis=1)), kind="stable")


def _rest(letters: np.ndarray) -> np.ndarray:
    """Letters that each row has from a column on, one line for each column and one more."""
    total = np.zeros((letters.shape[1] + 1, len(letters)), dtype=np.int32)
    total[:-1] = np.cumsum(letters.T[::-1], axis=0, dtype=np.int32)[::-1]
    return total


def _survivors(left: np.ndarray, right: np.ndarray, need_a: np.ndarray, need_b: np.ndarray, rest_a: np.ndarray, rest_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (row, row) that may be neighbours either way, and their equal columns."""
    width, shape = len(left), (left.shape[1], right.shape[1])
    total = np.zeros(shape, dtype=np.int32)
    same = np.empty(shape, dtype=bool)
    need = np.minimum(need_a[:, None], need_b[None, :]).astype(np.int32)
    # no pair can drop out before it has differed in more columns than it may
    stop, ahead = 0, min(255, max(STEP, int(1.15 * (max((rest_a[0] - need_a).max(initial=0), (rest_b[0] - need_b).max(initial=0)) + 1))))
    while stop < width:
        start, some = stop, np.zeros(shape, dtype=np.uint8)
        stop, ahead = min(start + ahead, width), STEP
        for k in range(start, stop):
            np.equal(left[k][:, None], right[k][None, :], out=same)
            some += same.view(np.uint8)
        total += some
        alive = total + np.minimum(rest_a[stop][:, None], rest_b[stop][None, :]) >= need
        count = int(np.count_nonzero(alive))
        if not count:
            return (np.zeros(0, np.int64),) * 3
        if count <= FEW * alive.size or stop == width:
            break
    x, y = np.nonzero(alive)
    found = total[x, y].astype(np.int64)
    for at in range(0, len(x) if stop < width else 0, 1 << 15):
        some = slice(at, at + (1 << 15))
        found[some] += (left[stop:, x[some]] == right[stop:, y[some]]).sum(axis=0)
    return x, y, found


def folded_rows(rows: DataFrame, msa: str, aligned: str) -> tuple[DataFrame, DataFrame]:
    """(input rows with ``__msa`` and ``__aligned``; the distinct rows of each alignment, stored, with
    copies and a number ``head``).

    A struct is equal to another one where both hold null, so null alignments group and join like others.
    """
    named = rows.withColumns({"__msa": F.struct(F.col(msa).alias("of")), "__aligned": F.col(aligned)})
    return named, cut(named.groupBy("__msa", "__aligned").agg(F.count("*").alias("copies")).withColumn("head", F.monotonically_increasing_id()))


def alignment_sizes(folded: DataFrame) -> DataFrame:
    """(__msa, no, n) of each alignment; rows that differ in width raise."""
    width = F.length("__aligned")
    ragged = F.when(F.min(width) != F.max(width), F.raise_error("rows of an alignment differ in width"))
    return folded.groupBy("__msa").agg(F.coalesce(ragged.cast("long"), F.count("*")).alias("n")).withColumn("no", F.monotonically_increasing_id())


def _nearest(placed: DataFrame, gap: str, block: int, turn: int) -> DataFrame:
    """(head, ball) of rows of large alignments: the nearest of the rows chosen by hash in this turn and how
    near it is, 0 if it differs in more than the last ring's share of the row's letters."""
    mark = F.pmod(F.xxhash64("__aligned", F.lit(turn)), F.lit(1 << 30)) / float(1 << 30)
    large = placed.filter(F.col("n") > block)
    wanted = F.least(F.lit(MOST_CHOSEN), F.ceil(F.col("n") * DRAWS / block))
    chosen = large.filter(mark < wanted / F.col("n"))
    slices = F.ceil(F.col("n") / SLICE).cast("int")
    spread = chosen.withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    dealt = large.withColumn("slice", F.pmod(F.xxhash64("head"), slices).cast("int"))

    def assign(rows: pa.Table, centres: pa.Table) -> pa.Table:
        heads = rows["head"].to_numpy()
        if not centres.num_rows or not rows.num_rows:
            return pa.table({"head": pa.array(heads, pa.int64()), "ball": pa.array(np.zeros(len(heads), np.int64))})
        centres = centres.sort_by("head")
        matrix, mark = code_matrix(centres["__aligned"].to_pylist() + rows["__aligned"].to_pylist(), gap)
        few, many = np.ascontiguousarray(matrix[: centres.num_rows].T), np.ascontiguousarray(np.where(matrix == mark, np.iinfo(matrix.dtype).max, matrix)[centres.num_rows :].T)
        best, letters = np.zeros(rows.num_rows, np.int64), (many != np.iinfo(matrix.dtype).max).sum(axis=0)
        for low in range(0, rows.num_rows, TILE):
            total = np.zeros((min(TILE, rows.num_rows - low), centres.num_rows), dtype=np.int32)
            for k in range(len(few)):
                total += many[k, low : low + TILE][:, None] == few[k][None, :]
            off = 1 - total.max(axis=1) / np.maximum(letters[low : low + TILE], 1)
            best[low : low + TILE] = np.where(off <= RINGS[-1], (total.argmax(axis=1) + 1) * len(RINGS) + np.searchsorted(RINGS, off), 0)
        return pa.table({"head": pa.array(heads, pa.int64()), "ball": pa.array(best)})

    pick = ["no", "slice", "head", "__aligned"]
    return dealt.select(*pick).groupBy("no", "slice").cogroup(spread.select(*pick).groupBy("no", "slice")).applyInArrow(assign, "head long, ball long")


def _balls(placed: DataFrame, gap: str, block: int) -> DataFrame:
    """Adds ``ball`` (turn, chosen row): in each turn rows are chosen from those that no one has drawn yet,
    as many as if these were the alignment."""
    left, found = placed, None
    for turn in range(TURNS):
        drawn = cut(left.join(_nearest(left, gap, block, turn), "head", "left").withColumn("ball", F.coalesce("ball", F.lit(0)) + F.when(F.col("ball") > 0, F.lit(turn << 32)).otherwise(0)))
        done = drawn.filter("ball > 0 OR n <= {}".format(block))
        found = done if found is None else found.unionByName(done)
        rest = drawn.filter("ball = 0 AND n > {}".format(block)).drop("ball")
        sizes = rest.groupBy("no").agg(F.count("*").alias("n"))
        left = cut(rest.drop("n").join(sizes, "no").select(*placed.columns))
        if turn == TURNS - 1 or rest.isEmpty():
            return found.unionByName(rest.withColumn("ball", F.lit(-1).cast("long")).select(*found.columns))
    return found


def blocked(folded: DataFrame, gap: str, block: int = BLOCK) -> DataFrame:
    """The distinct rows of all alignments in blocks of similar rows, stored: (no, block, head, __aligned, copies)."""
    placed = folded.join(alignment_sizes(folded), "__msa").select("no", "n", "head", "__aligned", "copies")
    near = cut(_balls(cut(placed), gap, block))
    parts = near.groupBy("no", "ball").agg(F.ceil(F.count("*") / block).cast("long").alias("parts"))
    return cut(near.join(parts, ["no", "ball"]).select("no", F.struct("ball", F.pmod(F.xxhash64("head"), "parts").alias("part")).alias("block"), "head", "__aligned", "copies"))


def whole_keys(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of each key, whole, from sorted batches that may cut it."""
    rest: pd.DataFrame | None = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if not len(rows):
            continue
        key = rows[keys].to_numpy()
        starts = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1))
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            yield rows.iloc[a:b]
        rest = rows.iloc[starts[-1] :]
    if rest is not None and len(rest):
        yield rest


def _summaries(rows: DataFrame, theta: float, gap: str) -> DataFrame:
    """(no, block, rows, least, counts, sets, centre, radius) of each block.

    ``least``: the fewest equal columns that any of its rows asks for; ``counts``: the most that a row
    has of each letter; ``sets``: the letters of each column; ``centre``: the most frequent letter of each
    column; ``radius``: the most letters that a row has other than the centre's.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole_keys(batches, ["no", "ball", "part"]):
            points = np.frombuffer("".join(part["__aligned"]).encode("utf-32-le"), dtype="<u4").reshape(len(part), -1)
            letters = points != ord(gap)
            lengths = letters.sum(axis=1)
            if (lengths == 0).any():
                raise ValueError("an alignment row has gaps only")
            bits = np.where(letters, np.uint64(1) << (points % SYMBOLS).astype(np.uint64), np.uint64(0))
            counts = np.stack([((points % SYMBOLS == s) & letters).sum(axis=1).max() for s in range(SYMBOLS)])
            centre = _centre(points, ord(gap))
            radius = (letters & (points != centre[None, :])).sum(axis=1).max()
            first = part.iloc[0]
            yield pd.DataFrame(
                {
                    "no": [first["no"]], "ball": [first["ball"]], "part": [first["part"]], "rows": [len(part)], "least": [int(least_matches(lengths, theta).min())],
                    "counts": [counts.astype("<u4").tobytes()], "sets": [np.bitwise_or.reduce(bits, axis=0).astype("<u8").tobytes()], "centre": [centre.astype("<u4").tobytes()], "radius": [int(radius)],
                }
            )

    flat = rows.select("no", "block.ball", "block.part", "__aligned").repartition("no", "ball", "part").sortWithinPartitions("no", "ball", "part")
    found = flat.mapInPandas(run, "no long, ball long, part long, rows long, least long, counts binary, sets binary, centre binary, radius long")
    return found.select("no", F.struct("ball", "part").alias("block"), "rows", "least", "counts", "sets", "centre", "radius")


def _centre(points: np.ndarray, gap: int) -> np.ndarray:
    """The most frequent letter of each column, the gap where there is none."""
    symbols, codes = np.unique(np.append(points.ravel(), gap), return_inverse=True)
    codes, mark = codes[:-1].reshape(points.shape), codes[-1]
    best, most = np.full(points.shape[1], mark), np.zeros(points.shape[1], np.int64)
    for k in range(len(symbols)):
        if k != mark:
            times = (codes == k).sum(axis=0)
            best, most = np.where(times > most, k, best), np.maximum(times, most)
    return symbols[best]


def possible_pairs(rows: DataFrame, theta: float, gap: str) -> DataFrame:
    """(no, low, high, pairs): block pairs some rows of which may be neighbours, each block with itself
    among them, and how many pairs of rows they hold.

    Summaries are compared in tasks of bounded size, as rows are. Alignments of one block need none.
    """
    blocks = rows.groupBy("no", "block").agg(F.count("*").alias("rows"))
    own = blocks.select("no", F.col("block").alias("low"), F.col("block").alias("high"), (F.col("rows") * F.col("rows")).alias("pairs"))
    many = blocks.groupBy("no").agg(F.count("*").alias("blocks")).filter("blocks > 1")
    summed = _summaries(rows.join(many.select("no"), "no", "left_semi"), theta, gap).join(many, "no")
    groups = F.ceil(F.col("blocks") / SUMMARIES).cast("int")
    dealt = summed.withColumn("own", F.pmod(F.xxhash64("block"), groups).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), groups - 1)))
    task = dealt.select("no", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "own", "block.ball", "block.part", "rows", "least", "counts", "sets", "centre", "radius")

    def bound(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["ball", "part"])
        first, second = int(part["first"].iloc[0]), int(part["second"].iloc[0])
        counts, sets, centre = (np.stack([np.frombuffer(v, dtype=kind) for v in part[c]]) for c, kind in (("counts", "<u4"), ("sets", "<u8"), ("centre", "<u4")))
        least, rows_of, own, radius = (part[c].to_numpy() for c in ("least", "rows", "own", "radius"))
        i, j = np.flatnonzero(own == first), np.flatnonzero(own == second)
        out = []
        for x in i:
            y = j[j > x] if first == second else j
            y = y[np.minimum(counts[x][None, :], counts[y]).sum(axis=1) >= np.minimum(least[x], least[y])]
            # rows equal in a column agree there with centres that agree, or one of them departs from its own
            alike = ((centre[x][None, :] == centre[y]) & (centre[x] != ord(gap))[None, :]).sum(axis=1)
            y = y[alike + radius[x] + radius[y] >= np.minimum(least[x], least[y])]
            y = y[((sets[x][None, :] & sets[y]) != 0).sum(axis=1) >= np.minimum(least[x], least[y])]
            out.append(pd.DataFrame({"x": np.full(len(y), x), "y": y}))
        pairs = pd.concat(out) if out else pd.DataFrame({"x": [], "y": []}, dtype=np.int64)
        x, y = pairs["x"].to_numpy(dtype=np.int64), pairs["y"].to_numpy(dtype=np.int64)
        ball, piece = part["ball"].to_numpy(), part["part"].to_numpy()
        return pd.DataFrame(
            {"no": np.full(len(x), part["no"].iloc[0]), "ball_x": ball[x], "part_x": piece[x], "ball_y": ball[y], "part_y": piece[y], "pairs": rows_of[x] * rows_of[y] * 2}
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole_keys(batches, ["no", "first", "second"]):
            yield bound(part)

    sorted_tasks = task.repartition("no", "first", "second").sortWithinPartitions("no", "first", "second")
    found = sorted_tasks.mapInPandas(run, "no long, ball_x long, part_x long, ball_y long, part_y long, pairs long")
    block = lambda c: F.struct(F.col(f"ball_{c}").alias("ball"), F.col(f"part_{c}").alias("part"))
    others = found.select("no", block("x").alias("low"), block("y").alias("high"), "pairs")
    return own.unionByName(others)


def alignment_key(rows: DataFrame, msa: str) -> Column:
    """An alignment as text that no other one has, null being one of them."""
    kind = rows.schema[msa].dataType.typeName()
    of = F.col(msa)
    text = F.hex(of) if kind == "binary" else F.unix_micros(of).cast("string") if kind == "timestamp" else F.to_json(F.struct(of.alias("of"))) if kind in ("struct", "array") else of.cast("string")
    return F.when(of.isNotNull(), F.concat(F.lit("="), text)).otherwise(F.lit("-"))


def row_digest(of: Column, aligned: Column) -> Column:
    """16 bytes that stand for an alignment and a text where rows are joined or summed, so that texts needn't move."""
    return F.substring(F.unhex(F.sha2(F.concat_ws("\n", of, aligned), 256)), 1, 16)


def row_codes(texts: pa.ChunkedArray, gap: str) -> tuple[np.ndarray, int]:
    """As ``code_matrix``; ASCII texts are their own codes."""
    column = pa.concat_arrays([c.cast(pa.large_string()) for c in texts.chunks])
    ends = np.frombuffer(column.buffers()[1], dtype="<i8")[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    if len(gap) == 1 and ord(gap) < 128 and not (flat & 128).any():
        if (np.diff(ends) != ends[1] - ends[0]).any():
            raise ValueError("rows of an alignment differ in width")
        return flat.reshape(len(column), -1), ord(gap)
    rows = column.to_pylist()
    if len({len(r) for r in rows}) > 1:
        raise ValueError("rows of an alignment differ in width")
    return code_matrix(rows, gap)


def _similar_blocks(codes: np.ndarray, gap: int, block: int) -> list[np.ndarray]:
    """Row numbers in blocks of similar rows: by the nearest of the first rows, which are in no order."""
    n = len(codes)
    if n <= block:
        return [np.arange(n)] if n else []
    few = np.ascontiguousarray(codes[: min(MOST_CHOSEN, -(-n * DRAWS // block))].T)
    ball = np.zeros(n, np.int64)
    for low in range(0, n, TILE):
        many = codes[low : low + TILE].T
        total = np.zeros((many.shape[1], few.shape[1]), dtype=np.int32)
        for k in range(len(few)):
            total += (many[k][:, None] == few[k][None, :]) & (many[k] != gap)[:, None]
        off = 1 - total.max(axis=1) / np.maximum((many != gap).sum(axis=0), 1)
        ball[low : low + TILE] = np.where(off <= RINGS[-1], (total.argmax(axis=1) + 1) * len(RINGS) + np.searchsorted(RINGS, off), 0)
    _, at, size = np.unique(ball, return_inverse=True, return_counts=True)
    ball[size[at] < min(LEAST_BALL, block)] = 0
    order = np.argsort(ball, kind="stable")
    ends = np.flatnonzero(np.diff(ball[order])) + 1
    return [piece for part in np.split(order, ends) for piece in np.array_split(part, -(-len(part) // block))]


def near_counts(codes: np.ndarray, copies: np.ndarray, side: np.ndarray | None, gap: int, theta: float, block: int, keyed: int = KEYED_ROWS) -> np.ndarray:
    """Copies of rows that are neighbours of each row: of all rows, or with ``side`` (0 or 1) of the other side's.

    From ``keyed`` rows on only rows that agree in a key are compared, see ``covering``, where this is less work than
    all pairs; rows that keys don't serve are compared with all others.
    """
    lengths = (codes != gap).sum(axis=1)
    found = keyed_neighbors(codes, copies, side, gap, least_matches(lengths, theta)) if len(codes) >= keyed else None
    if found is None:
        return _near_all(codes, copies, side, gap, theta, block)
    out, crowd, rest = found
    out += copies if side is None else 0
    for rows in (np.flatnonzero(crowd), np.flatnonzero(rest)):
        if len(rows):
            again = copies[rows] if side is None else 0
            out[rows] += _near_all(codes[rows], copies[rows], None if side is None else side[rows], gap, theta, block) - again
    for a, b in ((rest, ~rest),) if side is None else ((rest & (side == 0), ~rest & (side == 1)), (rest & (side == 1), ~rest & (side == 0))):
        a, b = np.flatnonzero(a), np.flatnonzero(b)
        for low in range(0, len(b) if len(a) else 0, SLICE):
            some = b[low : low + SLICE]
            to_a, to_b, _ = near_weights(codes[a], codes[some], copies[a], copies[some], gap, theta)
            out[a] += to_a
            out[some] += to_b
    return out


def _near_all(codes: np.ndarray, copies: np.ndarray, side: np.ndarray | None, gap: int, theta: float, block: int) -> np.ndarray:
    """The same by blocks.

    Rows are dealt into blocks of similar ones; block pairs that can't reach the least number of equal columns
    are left out, and of others with few letters in a column the rows that can't.
    """
    blocks = [(s, rows[b]) for s, rows in ((s, np.flatnonzero(side == s) if side is not None else np.arange(len(codes))) for s in ((0, 1) if side is not None else (0,))) for b in _similar_blocks(codes[rows], gap, block)]
    order = np.concatenate([b for _, b in blocks])
    ends = np.cumsum([0, *(len(b) for _, b in blocks)])
    of = np.array([s for s, _ in blocks])
    codes, copies = codes[order], copies[order]
    letters = codes != gap
    need = least_matches(letters.sum(axis=1), theta)
    least = np.minimum.reduceat(need, ends[:-1])
    sets = np.stack([column_sets(codes[a:b], gap) for a, b in zip(ends[:-1], ends[1:], strict=True)])
    centre = np.stack([_centre(codes[a:b], gap) for a, b in zip(ends[:-1], ends[1:], strict=True)])
    radius = np.array([(letters[a:b] & (codes[a:b] != c)).sum(axis=1).max() for a, b, c in zip(ends[:-1], ends[1:], centre, strict=True)])
    tight = np.bitwise_count(sets).mean(axis=1) <= TIGHT
    columns = _telling_columns(codes, codes, gap)
    right = np.ascontiguousarray(codes[:, columns].T)
    left = np.where(right == gap, np.iinfo(codes.dtype).max, right)  # a code that no row has, in place of one side's gaps
    rest = _rest(letters[:, columns])
    out = np.zeros(len(codes), np.int64)
    for x in range(len(blocks)):
        y = np.arange(x + 1, len(blocks))
        if side is not None:
            y = y[of[y] != of[x]]
        floor = lambda y: np.minimum(least[x], least[y])  # noqa: E731,B023
        y = y[((centre[x] == centre[y]) & (centre[x] != gap)).sum(axis=1) + radius[x] + radius[y] >= floor(y)]
        y = y[((sets[x] & sets[y]) != 0).sum(axis=1) >= floor(y)]
        for z in ([x] if side is None else []) + y.tolist():
            i, j = np.arange(ends[x], ends[x + 1]), np.arange(ends[z], ends[z + 1])
            if z != x and (tight[x] or tight[z]):
                i, j = i[reach(codes[i], gap, sets[z]) >= np.minimum(need[i], least[z])], j[reach(codes[j], gap, sets[x]) >= np.minimum(need[j], least[x])]
            for low in range(0, len(i), TILE):
                some, other = i[low : low + TILE], j[low:] if z == x else j
                if not len(other):
                    break
                p, q, same = _survivors(left[:, some], right[:, other], need[some], need[other], rest[:, some], rest[:, other])
                p, q = some[p], other[q]
                near = (same >= need[p]) & ((q >= p) | (z != x))
                out += np.bincount(p[near], weights=copies[q[near]], minlength=len(out)).astype(np.int64)
                near = (same >= need[q]) & ((q > p) | (z != x))
                out += np.bincount(q[near], weights=copies[p[near]], minlength=len(out)).astype(np.int64)
    found = np.empty_like(out)
    found[order] = out
    return found


def whole_tables(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key, whole, from sorted batches that may cut it."""
    parts: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        keys = table[key].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), table.num_rows]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            part = table.slice(a, b - a)
            if parts and parts[-1][key][0] != part[key][0]:
                yield pa.concat_tables(parts)
                parts = []
            parts.append(part)
    if parts:
        yield pa.concat_tables(parts)


def alignment_heads(rows: DataFrame, msa: str, aligned: str, row: str) -> DataFrame:
    """(of, n, __head, __aligned, digest) of each alignment, stored: its rows, and the row of least (row, aligned)."""
    named = rows.select(alignment_key(rows, msa).alias("of"), F.struct(F.col(row).alias("row"), F.col(aligned).alias("aligned")).alias("__own"))
    found = named.groupBy("of").agg(F.count("*").alias("n"), F.min("__own").alias("f"))
    return stored(found.select("of", "n", F.col("f.row").alias("__head"), F.col("f.aligned").alias("__aligned"), row_digest(F.col("of"), F.col("f.aligned")).alias("digest")))


def bounded_neighbors(
    rows: DataFrame, theta: float, gap: str, msa: str, aligned: str, row: str | None = None, block: int = BLOCK, tile: int = TILE_ROWS, most: int = MOST_TILES, heads: DataFrame | None = None,
) -> DataFrame:
    """(of, digest, copies, neighbors) of all distinct rows of alignments; ``neighbors`` counts copies, the row itself
    included, ``of`` and ``digest`` are ``alignment_key`` and ``row_digest``. With ``row`` also ``similarity``: equal columns,
    gaps counting, with the row of least (row, aligned), over the width; ``heads`` are the ``alignment_heads`` where they are known.

    An alignment of up to ``tile`` rows is a task, in which copies are folded and bounds decide what is compared.
    A larger one is dealt into tiles by digest, of which each two meet in a task, so a text moves as often as its
    alignment has tiles; beyond ``most`` tiles these are blocks of similar rows, and bounds decide which meet.
    """
    spark = rows.sparkSession
    ship_package(spark)
    named = rows.select(alignment_key(rows, msa).alias("of"), F.col(aligned).alias("__aligned")).withColumn("digest", row_digest(F.col("of"), F.col("__aligned")))
    heads = alignment_heads(rows, msa, aligned, row) if row and heads is None else heads
    sizes = named.groupBy("of").agg(F.count("*").alias("n")) if heads is None else heads.select("of", "n")
    large = cut(sizes.filter(F.col("n") > tile))  # a row for each ``tile`` rows at most
    firsts = heads.select("of", "__aligned", "digest") if row else None
    several, huge = (not large.filter(c).isEmpty() for c in (F.col("n") <= most * tile, F.col("n") > most * tile))
    known_as = ["key", "of", "side", "alone", "digest", "copies", "__aligned"]

    def tiled(df: DataFrame) -> DataFrame:
        placed = df.join(F.broadcast(large), "of", "left") if several or huge else df.withColumn("n", F.lit(None).cast("long"))
        return placed.filter(F.coalesce("n", F.lit(0)) <= most * tile).withColumn("tiles", F.coalesce(F.ceil(F.col("n") / tile), F.lit(1)).cast("int"))

    key = lambda low, high: F.concat_ws("/", "of", F.lpad(low.cast("string"), 4, "0"), F.lpad(high.cast("string"), 4, "0"))
    own = tiled(named).withColumn("own", F.pmod(F.xxhash64("digest"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    tasks = own.select(key(low, high).alias("key"), "of", (F.col("own") > F.col("other")).cast("int").alias("side"), (low == high).alias("alone"), "digest", F.lit(1).cast("long").alias("copies"), "__aligned")
    if row:
        at = tiled(firsts).withColumn("own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        tasks = tasks.unionByName(at.select(key(F.col("own"), F.col("own")).alias("key"), "of", F.lit(2).alias("side"), F.lit(True).alias("alone"), "digest", F.lit(0).cast("long").alias("copies"), "__aligned"))

    def compare(part: pa.Table) -> pa.RecordBatch:
        codes, mark = row_codes(part["__aligned"], gap)
        side, copies = part["side"].to_numpy(), part["copies"].to_numpy()
        here = np.flatnonzero(side < 2)  # in the order of their digests
        fixed = part["digest"].combine_chunks().cast(pa.binary(16))
        digests = np.frombuffer(fixed.buffers()[1], dtype="<u8").reshape(-1, 2)[fixed.offset : fixed.offset + len(fixed)][here]
        first = np.concatenate(([0], np.flatnonzero((digests[1:] != digests[:-1]).any(axis=1)) + 1))
        kept = here[first]
        if (codes[kept] == mark).all(axis=1).any():
            raise ValueError("an alignment row has gaps only")
        times = np.add.reduceat(copies[here], first)
        found = near_counts(codes[kept], times, None if part["alone"][0].as_py() else side[kept], mark, theta, block)
        head = codes[side == 2]
        same = (codes[kept] == head[0]).sum(axis=1) / max(codes.shape[1], 1) if len(head) else None
        return pa.RecordBatch.from_arrays(
            [pa.repeat(part["of"][0], len(kept)), part["digest"].combine_chunks().take(pa.array(kept)), pa.array(times), pa.array(found), pa.array(same, pa.float64()) if same is not None else pa.nulls(len(kept), pa.float64())],
            ["of", "digest", "copies", "neighbors", "similarity"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_tables(batches, "key"):
            yield compare(part)

    def counted(tasks: DataFrame) -> DataFrame:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
        done = tasks.repartition(parts, "key").sortWithinPartitions("key", "digest").mapInArrow(run, "of string, digest binary, copies long, neighbors long, similarity double")
        return done.groupBy("digest", "of").agg(F.max("copies").alias("copies"), F.sum("neighbors").alias("neighbors"), F.max("similarity").alias("similarity"))

    found = counted(tasks)
    if huge:
        own_rows = named.join(F.broadcast(large.filter(F.col("n") > most * tile).select("of")), "of", "left_semi")
        _, folded = folded_rows(own_rows, "of", "__aligned")
        placed = blocked(folded, gap, tile)
        pairs = possible_pairs(placed, theta, gap).withColumn("pair", F.monotonically_increasing_id())
        alone = F.col("low") == F.col("high")
        at = lambda c, k: F.struct(F.col(c).alias("block"), F.lit(k).alias("side"))
        sides = pairs.select("no", F.concat(F.lit("pair/"), F.col("pair").cast("string")).alias("key"), alone.alias("alone"), F.explode(F.when(alone, F.array(at("low", 0))).otherwise(F.array(at("low", 0), at("high", 1)))).alias("s"))
        names = folded.select("head", F.col("__msa.of").alias("of"))
        meet = placed.join(names, "head").join(sides.select("no", "key", "alone", "s.block", "s.side"), ["no", "block"]).withColumn("digest", row_digest(F.col("of"), F.col("__aligned")))
        more = counted(meet.select(*known_as))
        if row:
            from seqloom.operators.sampling import equal_columns

            alike = folded.select(F.col("__msa.of").alias("of"), "__aligned").join(firsts.select("of", F.col("__aligned").alias("__first")), "of")
            alike = alike.select(row_digest(F.col("of"), F.col("__aligned")).alias("digest"), (equal_columns(F.col("__aligned"), F.col("__first")) / F.length("__first")).alias("similarity"))
            more = more.drop("similarity").join(alike, "digest")
        found = found.unionByName(more)
    return found if row else found.drop("similarity")
