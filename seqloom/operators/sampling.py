"""Seeded, weighted and budgeted sampling of alignment rows and homologs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.functions.columns import uniform
from seqloom.functions.sequences import stable_seed, unalign
from seqloom.operators.bounds import alignment_key, whole_tables
from seqloom.operators.homology import Kernel, weighted_rows, weighted_similar_rows
from seqloom.operators.spread import RANGE_ROWS, group_key, in_ranges, numbered, running
from seqloom.plans.lineage import cut, stored
from seqloom.plans.shipping import ship_package

#: Ranges that a draw looks through at a time.
RUN = 64


def random_key(seed: Column | int, row: Column) -> Column:
    """Sort key of a seeded permutation."""
    return uniform(seed, row)


def weighted_key(seed: Column | int, row: Column, weight: Column) -> Column:
    """Sort key of a weighted permutation without replacement (an exponential race).

    Its first element is drawn by weight, and so is each next one among the rest, as if weights
    were renormalised; rows can drop out before without other rows' keys changing.
    """
    return -F.ln(uniform(seed, row)) / weight


def order_top(df: DataFrame, by: list[str], row: str) -> DataFrame:
    """Adds ``ord``, the place from 0 in each group, by row; as the other orders, spread over ranges of a group."""
    return numbered(df, by, [F.col(row)])


def order_random(df: DataFrame, by: list[str], row: str, seed: Column | int = 0) -> DataFrame:
    return numbered(df, by, [random_key(seed, F.col(row)), F.col(row)])


def order_weighted(df: DataFrame, by: list[str], row: str, weight: Column, seed: Column | int = 0) -> DataFrame:
    return numbered(df, by, [weighted_key(seed, F.col(row), weight), F.col(row)])


def equal_columns(a: Column, b: Column) -> Column:
    """Columns in which two strings are equal; null where one is missing. Counted by Arrow batches."""
    return F.pandas_udf(_equal_columns, "int")(a, b)


def _equal_columns(a: pd.Series, b: pd.Series) -> pd.Series:
    known = (a.notna() & b.notna()).to_numpy()
    left, right = a[known].tolist(), b[known].tolist()
    widths = np.array([len(x) for x in left], dtype=np.int64)
    out = np.zeros(len(left), dtype=np.int64)
    even = widths == [len(y) for y in right]
    for k in np.flatnonzero(~even):
        out[k] = sum(x == y for x, y in zip(left[k], right[k], strict=False))
    points = [np.frombuffer("".join(x for x, e in zip(side, even, strict=True) if e).encode("utf-32-le"), dtype="<u4") for side in (left, right)]
    total = np.concatenate(([0], np.cumsum(points[0] == points[1])))
    ends = np.cumsum(widths[even])
    out[even] = total[ends] - total[ends - widths[even]]
    found = pd.Series([None] * len(a), index=a.index, dtype="Int32")
    found[known] = out.astype("int32")
    return found


def similarity_to_first(df: DataFrame, msa: str, row: str, aligned: str, flag: str | None = None) -> DataFrame:
    """Adds ``similarity``: equal columns with the alignment's first row over its width; gaps count.

    The first row is the one of least (row, aligned text); ``flag`` names a column that tells it. A null
    alignment is one like others; rows alike in id and text are first together.
    """
    own = F.struct(F.col(row).alias("row"), F.col(aligned).alias("aligned"))
    ship_package(df.sparkSession)
    of = df.withColumn("__msa", F.struct(F.col(msa).alias("of")))
    first = of.groupBy("__msa").agg(F.min(own).alias("__first"))
    found = of.join(first, "__msa").withColumn("similarity", equal_columns(F.col(aligned), F.col("__first.aligned")) / F.length("__first.aligned"))
    return (found.withColumn(flag, own.eqNullSafe(F.col("__first"))) if flag else found).drop("__first", "__msa")


def similarity_filter(df: DataFrame, max_similarity: Column | float = 1.0, max_dissimilarity: Column | float = 1.0) -> DataFrame:
    """Rows near and far enough; needs ``similarity``."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return df.filter((F.col("similarity") <= as_column(max_similarity)) & (1 - F.col("similarity") <= as_column(max_dissimilarity)))


def sample_msa(
    rows: DataFrame, method: str = "weighted", seed: int = 0, theta: float = 0.2, max_similarity: float = 1.0, max_dissimilarity: float = 1.0,
    force_include_first: bool = False, msa: str = "msa", row: str = "row_id", aligned: str = "aligned", kernel: Kernel | None = None,
) -> DataFrame:
    """Order of the sampled rows of each alignment: (msa, row, aligned, ord).

    Weights are of the whole alignment, then the similarity filter, then the method ("top",
    "random" or "weighted"). ``force_include_first`` puts the first row first whatever the filter.
    ``kernel`` counts the matches of pairs for the weights, see ``homology_weights``.

    Every row stays a row: null alignments are one alignment, row ids may be of any type that sorts,
    null, or repeated; rows with one id go by their text, or by its hash where they are weighted.
    """
    if method not in ("top", "random", "weighted"):
        raise ValueError(f"unknown method {method}")
    table = rows.select(msa, row, aligned)
    tie = [F.col(row), F.col(aligned)]
    if method == "weighted":
        # stored with its key, since places in the order are sampled first; the text of a row is read only where it is asked for
        table = _weights_and_similarity(table, theta, msa, row, aligned, kernel)
        table = stored(table.withColumns({"__tie": F.xxhash64(aligned), "__key": weighted_key(seed, F.col(row), F.col("weight"))}))
        tie = [F.col(row), F.col("__tie")]
    else:
        table = similarity_to_first(table, msa, row, aligned, "__is_first")
    near = (F.col("similarity") <= max_similarity) & (1 - F.col("similarity") <= max_dissimilarity)
    kept = table.filter(near | F.col("__is_first")) if force_include_first else table.filter(near)
    if method == "top":
        return numbered(kept, [msa], [F.col(row), F.col(aligned)]).select(msa, row, aligned, "ord")
    key = F.col("__key") if method == "weighted" else random_key(seed, F.col(row))
    first = F.when(F.col("__is_first"), F.lit(-1.0)).otherwise(key) if force_include_first else key  # keys are positive
    return numbered(kept, [msa], [first, *tie]).select(msa, row, aligned, "ord")


def _weights_and_similarity(rows: DataFrame, theta: float, msa: str, row: str, aligned: str, kernel: Kernel | None) -> DataFrame:
    """(msa, row, aligned, weight, similarity, __is_first)."""
    if kernel is None:
        return weighted_similar_rows(rows, theta, msa, row, aligned)
    found = similarity_to_first(weighted_rows(rows, theta, msa=msa, aligned=aligned, kernel=kernel), msa, row, aligned, "__is_first")
    return found.select(msa, row, aligned, "weight", "similarity", "__is_first")


def token_budget(df: DataFrame, by: list[str], order: list[Column], length: Column, max_tokens: Column | int) -> DataFrame:
    """Rows in ascending order while the sum of their lengths and two framing tokens each stays in the budget.

    It stops at the first that does not fit; since lengths are positive, the running sum says so.
    Ranges of a group's order that begin beyond its budget drop out before they are sorted. A budget
    that is a column is one for each group.
    """
    most = max_tokens if isinstance(max_tokens, Column) else F.lit(max_tokens)
    return running(df, by, order, {"tokens_upto": length + 2}, ("tokens_upto", most)).filter(F.col("tokens_upto") <= most)


def truncating_budget(df: DataFrame, by: str, order: str, text: str, base: str, limit: int = 8192) -> DataFrame:
    """Assembled training text of each group: (by, assembled, n_homologs).

    ``df`` has a row for each homolog found, in ``order``, and the group's ``base`` sequence. Each is
    framed by $ and *. A homolog that leaves no room ends the list: its prefix is taken if anything
    of it fits. What is still as long as the limit is cut to one less and closed by *. Only rows that
    begin within the limit are put together, so a group's text is bounded however many rows it has.
    """
    need = F.length(text) + 2
    room = limit - (F.length(base) + 2)
    # a row has its turn while those before it leave room; the first one always, so that each group has a row
    rows = running(df, [by], [F.col(order)], {"__upto": need}, ("__upto", F.greatest(room - 1, F.lit(0))))
    left = room - (F.col("__upto") - need)
    part = F.when(left - need >= 1, F.col(text)).when(left - 3 > 0, F.substr(F.col(text), F.lit(1), (left - 3).cast("int")))
    parts = F.transform(F.array_sort(F.collect_list(F.when(part.isNotNull(), F.struct(F.col(order).alias("o"), part.alias("p"))))), lambda s: F.concat(F.lit("$"), s["p"], F.lit("*")))
    whole = rows.groupBy(by).agg(F.concat(F.lit("$"), F.first(base), F.lit("*"), F.array_join(parts, "")).alias("t"), F.count(part).alias("n_homologs"))
    return whole.select(by, F.when(F.length("t") >= limit, F.concat(F.substr(F.col("t"), F.lit(1), F.lit(limit - 1)), F.lit("*"))).otherwise(F.col("t")).alias("assembled"), "n_homologs")


def prompt_grid(spark: SparkSession, max_tokens: list[int], max_similarities: list[float], structure: list[bool], inverse: list[bool]) -> DataFrame:
    """All combinations of the parameter lists, the last changing fastest, with ``seed_offset``
    counting repeats of the same combination. The lists are parameters, so it stays on the driver."""
    rows, seen = [], {}
    for t in max_tokens:
        for s in max_similarities:
            for c in structure:
                for q in inverse:
                    key = (int(t), float(s), bool(c), bool(q))
                    rows.append((len(rows), *key, seen.get(key, 0)))
                    seen[key] = seen.get(key, 0) + 1
    return spark.createDataFrame(rows, "ord long, max_tokens long, max_similarity double, structure_in_context boolean, inverse_folding boolean, seed_offset long")


def seed_offset(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The same count for grids that are tables."""
    return df.withColumn("seed_offset", (F.row_number().over(Window.partitionBy(*key).orderBy(order)) - 1).cast("bigint"))


def final_shuffle(df: DataFrame, by: list[str], row: str, seed: Column, tie: list[Column] | None = None) -> DataFrame:
    """Seeded permutation of the rows kept; the seed is that of the string of the seed plus one.

    What is kept of a group is bounded by its budget, so that a group is one task's.
    """
    order = [random_key(stable_seed((seed + 1).cast("string")), F.col(row)), F.col(row), *(tie or [])]
    return df.withColumn("ord", (F.row_number().over(Window.partitionBy(group_key(by)).orderBy(*order)) - 1).cast("bigint"))


def sample_context(
    rows: DataFrame, grid: DataFrame, seed: int = 0, theta: float = 0.2, msa: str = "msa", row: str = "row_id", aligned: str = "aligned", kernel: Kernel | None = None,
) -> DataFrame:
    """The context of every alignment at every grid point: (msa, grid ord, row, sequence, ord).

    Weights and similarities are computed once for all grid points, and rows within some budget stored; the grid is joined to
    lengths and keys alone, and the sequences of rows within the budget are joined last. Weighted order,
    then without the query where it is masked, then the token budget over the unaligned sequences,
    then a final shuffle. ``kernel``, null alignments and repeated row ids: as in ``sample_msa``.
    """
    weighted = _weights_and_similarity(rows.select(msa, row, aligned), theta, msa, row, aligned, kernel)
    base = (
        weighted.select(F.monotonically_increasing_id().alias("__id"), msa, row, "similarity", "weight", F.col("__is_first").alias("__query"), F.xxhash64(aligned).alias("__tie"), unalign(F.col(aligned)).alias("sequence"))
        .withColumn("__length", F.length("sequence"))
    )
    asked = _points(grid, seed)
    base = stored(_within_budget(base, asked, msa, row))
    each = base.select("__id", msa, row, "__tie", "__length", F.explode("__at").alias("at")).select("*", "at.*").drop("at")
    points = grid.select(F.col("ord").alias("grid_ord"), "max_tokens", "max_similarity", "inverse_folding", (F.lit(seed) + F.col("seed_offset")).alias("__seed"))
    of_point = rows.sparkSession.createDataFrame([(k, *p) for k, p in enumerate(asked)], "__point int, max_tokens long, max_similarity double, inverse_folding boolean, __seed long")
    numbers = points.join(F.broadcast(of_point), ["max_tokens", "max_similarity", "inverse_folding", "__seed"]).select("__point", "grid_ord", "max_tokens", "__seed")
    table = each.join(F.broadcast(numbers), "__point")  # the grid is a few parameter rows
    kept = token_budget(table, [msa, "grid_ord"], [F.col("__key"), F.col(row), F.col("__tie")], F.col("__length"), F.col("max_tokens"))
    placed = final_shuffle(kept, [msa, "grid_ord"], row, F.col("__seed"), [F.col("__tie")]).select("__id", "grid_ord", "ord")
    return placed.join(base.select("__id", msa, row, "sequence"), "__id").select(msa, "grid_ord", row, "sequence", "ord")


def _points(grid: DataFrame, seed: int) -> list[tuple[int, float, bool, int]]:
    """(max_tokens, max_similarity, inverse_folding, seed) of a grid of parameters, each once."""
    plain = grid.select(F.col("max_tokens").cast("long"), F.col("max_similarity").cast("double"), "inverse_folding", (F.lit(seed) + F.col("seed_offset")).cast("long").alias("s"))
    return sorted(tuple(r) for r in plain.distinct().collect())


def _within_budget(base: DataFrame, points: list[tuple[int, float, bool, int]], msa: str, row: str) -> DataFrame:
    """Rows that may be within the budget of a grid point, going by the rows of their own partition, with ``__at``: the
    numbers of these points and the row's keys there.

    What goes before a row in its partition also goes before it in its group, so a row beyond the budget there is
    beyond it at all. Most rows of large alignments drop out before they are stored, and rows are moved for these points alone.
    """
    seeds = sorted({p[3] for p in points})
    keyed = base.withColumns({f"__k{i}": weighted_key(F.lit(s).cast("long"), F.col(row), F.col("weight")) for i, s in enumerate(seeds)}).withColumn("__of", alignment_key(base, msa))
    out = base.withColumn("__at", F.lit(None).cast("array<struct<__point:int,__key:double>>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_tables(batches, "__of"):
            similar, query, length = (part[c].to_numpy() for c in ("similarity", "__query", "__length"))
            keys, at = [part[f"__k{i}"].to_numpy() for i in range(len(seeds))], []
            for tokens, most, inverse, s in points:
                key = keys[seeds.index(s)]
                order = np.argsort(key, kind="stable")
                taken = ((similar <= most) & ~(query & inverse))[order]
                need = np.where(taken, length[order] + 2, 0)
                # rows of one key may go in any order here, so they count as if each were the first of them
                first = np.searchsorted(key[order], key[order], side="left")
                before = np.concatenate(([0], np.cumsum(need)))[first]
                at.append(order[taken & (before <= tokens)])
            where = np.concatenate(at)
            number = np.repeat(np.arange(len(points), dtype=np.int32), [len(a) for a in at])
            key = np.concatenate([keys[seeds.index(p[3])][a] for p, a in zip(points, at, strict=True)])
            by_row = np.argsort(where, kind="stable")
            count = np.bincount(where, minlength=part.num_rows)
            each = pa.StructArray.from_arrays([pa.array(number[by_row]), pa.array(key[by_row])], ["__point", "__key"])
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), each)
            yield from part.append_column("__at", listed).filter(pa.array(count > 0)).select(out.names).to_batches()

    return keyed.sortWithinPartitions("__of").mapInArrow(run, out)


def weighted_draws(records: DataFrame, k: int, seed: int = 0, by: str = "seed", item: str = "member", weight: str = "probability", range_rows: int = RANGE_ROWS) -> DataFrame:
    """k draws with replacement from each group by weight: (by, draw, item).

    The order of a group's items is cut into ranges. A draw falls into a range by the ranges' weights
    first; in each range running weights and draws are sorted together, and each draw takes the
    last item that starts at or before it. So the work is n + k a group and not n x k, and spreads over
    tasks however many items or draws a group has.
    """
    groups = records.select(by).distinct()
    return _drawn(records, groups.withColumn("__of", F.col(by)), k, seed, by, [item], item, weight, range_rows).drop("__of")


def _drawn(records: DataFrame, askers: DataFrame, k: int, seed: int, by: str, order: list[str], item: str, weight: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """k draws for each of ``askers`` (by, __of) from the group ``by`` of records: (by, __of, draw, item).

    A group's running weights are made once, however many ask. Draws are hashes of the asker and the
    number of the draw. Groups that are null draw nothing.
    """
    ranged, _ = in_ranges(records.filter(F.col(by).isNotNull()), [by], [F.col(c) for c in order], range_rows)
    totals = cut(ranged.groupBy(by, "__range").agg(F.sum(weight).alias("total")))
    before = Window.partitionBy(by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(by, "__range", "total", F.coalesce(F.sum("total").over(before), F.lit(0.0)).alias("start"))
    # a group's ranges, at most MOST_RANGES of them, in runs: a draw finds its run, then its range
    listed = starts.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("start", "__range"))).alias("ranges"), F.sum("total").alias("total"))
    runs = F.transform(F.sequence(F.lit(0), F.size("ranges") - 1, F.lit(RUN)), lambda i: F.slice("ranges", i + 1, F.lit(RUN)))
    listed = listed.select(by, "total", runs.alias("runs"))
    of_kind = askers.schema["__of"].dataType
    each = askers.join(listed, by).withColumn("draw", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint"))))
    each = each.withColumn("at", uniform(seed, F.concat_ws("/", F.col("__of").cast("string"), F.col("draw").cast("string"))) * F.col("total"))
    run = F.get("runs", F.size(F.filter("runs", lambda r: r[0]["start"] <= F.col("at"))) - 1)
    draws = each.withColumn("run", run).select(
        by, F.get("run", F.size(F.filter("run", lambda r: r["start"] <= F.col("at"))) - 1)["__range"].alias("__range"), "__of", F.lit(1).alias("kind"), "draw",
        F.lit(None).cast(records.schema[item].dataType).alias("item"), "at",
    )
    inside = Window.partitionBy(by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    items = ranged.join(starts.select(by, "__range", "start"), [by, "__range"]).select(
        by, "__range", F.lit(None).cast(of_kind).alias("__of"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("draw"), F.col(item).alias("item"),
        (F.col("start") + F.coalesce(F.sum(weight).over(inside), F.lit(0.0))).alias("at"),
    )
    together = Window.partitionBy(by, "__range").orderBy("at", "kind", "item").rowsBetween(Window.unboundedPreceding, 0)
    found = items.unionByName(draws).withColumn("item", F.last("item", ignorenulls=True).over(together))
    return found.filter("kind = 1").select(by, "__of", "draw", F.col("item").alias(item))


def sample_homologs(seeds: DataFrame, parents: DataFrame, clusters: DataFrame, members: DataFrame, k: int = 100, seed: int = 0) -> DataFrame:
    """k homologs of each seed: (seed, draw, member).

    ``parents`` (seed, parent), ``clusters`` (parent, cluster), ``members`` (cluster, member). Seeds without
    parent, cluster or member get none. All seeds of a parent draw from one distribution, which is
    made once, so the work grows with members and draws and not with seeds times members.
    """
    from seqloom.operators.clusters import sampling_records

    asking = seeds.select("seed").distinct().join(parents, "seed").select("parent", F.col("seed").alias("__of")).distinct()
    rows = clusters.join(members, "cluster").select("parent", "cluster", "member")
    records = sampling_records(rows.join(asking.select("parent").distinct(), "parent", "left_semi"), seed="parent")
    return _drawn(records, asking, k, seed, "parent", ["cluster", "member"], "member", "probability").select(F.col("__of").alias("seed"), "draw", "member")
