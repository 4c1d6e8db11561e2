"""All-pairs identity inside alignments, and homology weights."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.bounds import BLOCK, TILE_ROWS, alignment_heads, alignment_key, alignment_sizes, bounded_neighbors, code_matrix, folded_rows, row_codes, row_digest, whole_keys, whole_tables
from seqloom.operators.pair_counts import pair_matches, pair_totals
from seqloom.plans.lineage import cut, stored
from seqloom.plans.shipping import ship_package

#: A pair kernel: (rows, columns) codes of two blocks and the gap's code, to matches of all pairs.
Kernel = Callable[[np.ndarray, np.ndarray, int], np.ndarray]
#: Letters and gaps that one side of a task holds, where rows are too wide for as many as a tile has.
TILE_CELLS = 1 << 24


def match_expression(a: F.Column, b: F.Column, gap: str = "-") -> F.Column:
    """The same count for one pair as a column expression, where pairs are few."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda p, q: (p == q) & (p != gap))
    return F.size(F.filter(same, lambda m: m))


def row_statistics(
    rows: DataFrame, theta: float = 0.2, gap: str = "-", msa: str = "msa", row: str = "row_id", aligned: str = "aligned", block: int = BLOCK, kernel: Kernel | None = None,
    tile: int = TILE_ROWS,
) -> DataFrame:
    """For each row of each alignment, over all its pairs (itself included):
    (msa, row, neighbors, matches, best_other).

    ``neighbors``: rows j with ``1 - matches(i, j) / nongap(i) <= theta``; asymmetric, since i sets the
    scale. ``matches``: sum of equal columns, or of ``kernel``, over all j; ``best_other``: its most with
    another row, null for a single one. Rows belong to (msa, row): row ids may be of any type and may
    repeat, in other alignments or in one. A null alignment is one like others. A row of gaps alone raises,
    and so do rows of one alignment that differ in width.

    ``matches`` are summed by how often each letter occurs in a column. ``best_other`` needs all pairs: equal
    rows are folded with their number first, the distinct rows of an alignment are dealt into tiles of ``tile`` rows
    (fewer where these are wide), and each pair of tiles is one task of two bounded matrices, in which a pair is
    counted once for both its rows, so the output is linear and the quadratic comparison spreads over all tasks. A
    kernel's own sums take blocks of ``block`` rows likewise. Where only neighbours are asked for,
    ``neighbor_counts`` compares far fewer.
    """
    if kernel is None:
        known = _tile_statistics(rows, theta, gap, msa, aligned, tile)
        return _digested(rows, msa, aligned).select(msa, row, "__digest").join(known, "__digest").select(msa, row, "neighbors", "matches", F.when(F.col("best") >= 0, F.col("best")).alias("best_other"))
    named, folded = folded_rows(rows, msa, aligned)
    known = folded.join(_pair_statistics(folded, theta, gap, block, kernel), "head").select("__msa", "__aligned", "neighbors", "matches", F.when(F.col("best") >= 0, F.col("best")).alias("best_other"))
    return named.select(msa, row, "__msa", "__aligned").join(known, ["__msa", "__aligned"]).select(msa, row, "neighbors", "matches", "best_other")


def _tile_statistics(rows: DataFrame, theta: float, gap: str, msa: str, aligned: str, tile: int) -> DataFrame:
    """(__digest, neighbors, matches, best) of the distinct rows of all alignments; best is -1 without another row."""
    spark = rows.sparkSession
    ship_package(spark)
    named = rows.select(alignment_key(rows, msa).alias("of"), F.col(aligned).alias("__aligned")).withColumn("digest", row_digest(F.col("of"), F.col("__aligned")))
    most = F.greatest(F.lit(1), F.least(F.lit(tile), F.floor(F.lit(TILE_CELLS) / F.greatest(F.col("width"), F.lit(1)))))
    each = named.groupBy("of", "digest").agg(F.max(F.length("__aligned")).alias("width")).groupBy("of").agg(F.count("*").alias("n"), F.max("width").alias("width"))
    large = cut(each.select("of", F.ceil(F.col("n") / most).cast("int").alias("tiles")).filter("tiles > 1"))  # a row for each tile of rows at most
    once = named.groupBy("of", "digest", "__aligned").agg(F.count("*").alias("copies"))
    placed = once.join(F.broadcast(large), "of", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    dealt = placed.withColumn("own", F.pmod(F.xxhash64("digest"), "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    key = F.concat_ws("/", "of", F.lpad(low.cast("string"), 6, "0"), F.lpad(high.cast("string"), 6, "0"))
    tasks = dealt.select(key.alias("key"), (F.col("own") > F.col("other")).alias("second"), (low == high).alias("alone"), "digest", "copies", "__aligned")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_tables(batches, "key"):
            codes, mark = row_codes(part["__aligned"], gap)
            if (codes == mark).all(axis=1).any():
                raise ValueError("an alignment row has gaps only")
            second = None if part["alone"][0].as_py() else part["second"].to_numpy()
            found = pair_totals(codes, part["copies"].to_numpy(), second, mark, theta)
            yield pa.RecordBatch.from_arrays([part["digest"].combine_chunks(), *map(pa.array, found)], ["__digest", "neighbors", "matches", "best"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    done = tasks.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, "__digest binary, neighbors long, matches long, best long")
    return done.groupBy("__digest").agg(F.sum("neighbors").alias("neighbors"), F.sum("matches").alias("matches"), F.max("best").alias("best"))


def _pair_statistics(folded: DataFrame, theta: float, gap: str, block: int, kernel: Kernel) -> DataFrame:
    """(head, neighbors, matches, best) of the distinct rows, over all pairs of an alignment."""
    ship_package(folded.sparkSession)
    placed = folded.join(alignment_sizes(folded), "__msa").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("head"), "blocks").cast("int"))
    each = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = each.select("no", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "head", "__aligned", "copies")

    def compare(part: pd.DataFrame) -> list[pd.DataFrame]:
        low, high = int(part["low"].iloc[0]), int(part["high"].iloc[0])
        matrix, mark = code_matrix(part["__aligned"].tolist(), gap)
        copies, heads = part["copies"].to_numpy(), part["head"].to_numpy()
        own = part["own"].to_numpy()
        out = []
        for side, against in ((low, high), (high, low)) if low != high else ((low, low),):
            i, j = np.flatnonzero(own == side), np.flatnonzero(own == against)
            for at in range(0, len(i), 256):
                here = i[at : at + 256]
                same = kernel(matrix[here], matrix[j], mark)
                length = (matrix[here] != mark).sum(axis=1)
                if (length == 0).any():
                    raise ValueError("an alignment row has gaps only")
                near = 1 - same / length[:, None] <= theta
                another = same - 1_000_000 * ((heads[here][:, None] == heads[j][None, :]) & (copies[here] < 2)[:, None])
                best = another.max(axis=1) if len(j) else np.full(len(here), -1_000_000)
                out.append(pd.DataFrame({"head": heads[here], "neighbors": near @ copies[j], "matches": same.astype(np.int64) @ copies[j], "best": best}))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole_keys(batches, ["no", "low", "high"]):
            yield from compare(part)

    dealt = task.repartition("no", "low", "high").sortWithinPartitions("no", "low", "high")
    found = dealt.mapInPandas(run, "head long, neighbors long, matches long, best long")
    return found.groupBy("head").agg(F.sum("neighbors").alias("neighbors"), F.sum("matches").alias("matches"), F.max("best").alias("best"))


def _digested(rows: DataFrame, msa: str, aligned: str) -> DataFrame:
    return rows.withColumn("__digest", row_digest(alignment_key(rows, msa), F.col(aligned)))


def neighbor_counts(
    rows: DataFrame, theta: float = 0.2, gap: str = "-", msa: str = "msa", row: str = "row_id", aligned: str = "aligned", block: int = BLOCK, kernel: Kernel | None = None,
) -> DataFrame:
    """(msa, row, neighbors), as ``row_statistics`` defines them.

    Without a kernel of one's own, bounds decide which blocks, rows and pairs can't be neighbours, so that
    these are never compared; with one all pairs are, since nothing is known about it.
    """
    if kernel is None:
        known = bounded_neighbors(rows, theta, gap, msa, aligned, block=block).select(F.col("digest").alias("__digest"), "neighbors")
        return _digested(rows, msa, aligned).select(msa, row, "__digest").join(known, "__digest").select(msa, row, "neighbors")
    named, folded = folded_rows(rows, msa, aligned)
    known = folded.join(_pair_statistics(folded, theta, gap, block, kernel), "head").select("__msa", "__aligned", "neighbors")
    return named.select(msa, row, "__msa", "__aligned").join(known, ["__msa", "__aligned"]).select(msa, row, "neighbors")


def weighted_rows(rows: DataFrame, theta: float = 0.2, gap: str = "-", msa: str = "msa", aligned: str = "aligned", block: int = BLOCK, kernel: Kernel | None = None) -> DataFrame:
    """All rows with all their columns, and neighbors, n_eff, weight.

    Rows are joined by their alignment (null being one) and their aligned text, of which the weight
    is a function, so no row is lost and none multiplied, whatever ids rows have. Without a kernel they are
    joined by a digest of both, so texts move once to be compared and not again.
    """
    if kernel is None:
        return _weighted(rows, theta, gap, msa, aligned, block).drop("__digest")
    named, folded = folded_rows(rows, msa, aligned)
    counted = cut(folded.join(_pair_statistics(folded, theta, gap, block, kernel), "head").select("__msa", "__aligned", "copies", "neighbors"))
    total = counted.groupBy("__msa").agg(F.sum(F.col("copies") / F.col("neighbors")).alias("n_eff"))
    known = counted.join(total, "__msa").select("__msa", "__aligned", "neighbors", "n_eff", (F.lit(1.0) / F.col("neighbors") / F.col("n_eff")).alias("weight"))
    return named.join(known, ["__msa", "__aligned"]).drop("__msa", "__aligned")


def _weighted(rows: DataFrame, theta: float, gap: str, msa: str, aligned: str, block: int = BLOCK, row: str | None = None) -> DataFrame:
    """``rows`` with neighbors, n_eff, weight and ``__digest``; with ``row`` also similarity and ``__is_first``."""
    heads = alignment_heads(rows, msa, aligned, row) if row else None
    counted = stored(bounded_neighbors(rows, theta, gap, msa, aligned, row, block, heads=heads))
    total = counted.groupBy("of").agg(F.sum(F.col("copies") / F.col("neighbors")).alias("n_eff"))
    more = []
    if row:
        total = total.join(heads.select("of", "__head", F.col("digest").alias("__head_digest")), "of")
        more = ["similarity", "__head", F.coalesce(F.col("digest") == F.col("__head_digest"), F.lit(False)).alias("__is_first")]
    known = counted.join(total, "of").select(F.col("digest").alias("__digest"), "neighbors", "n_eff", (F.lit(1.0) / F.col("neighbors") / F.col("n_eff")).alias("weight"), *more)
    found = _digested(rows, msa, aligned).join(known, "__digest")
    return found.withColumn("__is_first", F.col("__is_first") & F.col(row).eqNullSafe(F.col("__head"))).drop("__head") if row else found


def weighted_similar_rows(rows: DataFrame, theta: float, msa: str, row: str, aligned: str, gap: str = "-") -> DataFrame:
    """(msa, row, aligned, weight, similarity, __is_first): weights, and likeness to each alignment's first row as
    ``sampling.similarity_to_first`` has it, both from one comparison in tasks."""
    return _weighted(rows.select(msa, row, aligned), theta, gap, msa, aligned, row=row).select(msa, row, aligned, "weight", "similarity", "__is_first")


def homology_weights(
    rows: DataFrame, theta: float = 0.2, msa: str = "msa", row: str = "row_id", aligned: str = "aligned", gap: str = "-", block: int = BLOCK, kernel: Kernel | None = None,
) -> DataFrame:
    """(msa, row, neighbors, n_eff, weight): the effective number of rows of each alignment, and each
    row's share of it, on the unfiltered alignment; ``kernel`` as in ``neighbor_counts``."""
    return weighted_rows(rows.select(msa, row, aligned), theta, gap, msa, aligned, block, kernel).select(msa, row, "neighbors", "n_eff", "weight")
