"""Running sums and places inside groups, spread over tasks however large a group is.

A window over a group puts the group into one task. Here the order is cut into ranges first: a range of
a group is a task's work, what the ranges before it sum up to is added to it, and ranges that can
hold nothing of interest drop out before their rows are sorted. Cut points come from a bounded sample
of all rows' places in the order, so that a group gets as many ranges as it has rows for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a range on average, ranges at most, and places that the driver sees for each.
RANGE_ROWS, MOST_RANGES, SEEN = 20_000, 4096, 16
#: Cut points that one step looks at.
BRANCH = 16


def _place(order: list[Column]) -> Column:
    return F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])


def range_cuts(places: DataFrame, range_rows: int = RANGE_ROWS) -> list[Column]:
    """Ascending cut points of a frame of one struct column, as literals: those of a sample that a hash picks.

    The driver gets MOST_RANGES x SEEN places on average at most. Beyond MOST_RANGES x ``range_rows`` rows,
    about 80 million by default, ranges grow with the rows.
    """
    (column,) = places.columns
    rows = places.count()
    ranges = max(1, min(MOST_RANGES, rows // range_rows))
    if ranges == 1:
        return []
    mark = F.pmod(F.xxhash64(column), F.lit(1 << 30)) < int(min(1.0, SEEN * ranges / rows) * (1 << 30))
    seen = [r[0] for r in places.filter(mark).distinct().sort(column).collect()]
    kept = [seen[k] for k in sorted({len(seen) * i // ranges for i in range(1, ranges)})] if seen else []
    fields = places.schema[column].dataType.fields
    return [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields, strict=True)]) for row in kept]


def range_of(place: Column, cuts: list[Column]) -> Column:
    """Number of cut points at or below a place, found in steps of ``BRANCH`` cut points each.

    Places and steps are bound to variables, since an order's hashes would be computed again for each cut point else.
    """
    if not cuts:
        return F.lit(0)
    width = 1
    while width * BRANCH < len(cuts):
        width *= BRANCH
    once = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))
    upto = lambda heads, p: F.size(F.filter(heads, lambda h: h <= p))

    def narrowed(p: Column, at: Column, width: int) -> Column:
        """Cut points at or below p, of which the one before ``at``, a multiple of ``width`` and one more, is the last known."""
        if width == 1:
            return at
        parts = F.array(*[F.array(*cuts[i : i + width : width // BRANCH]) for i in range(0, len(cuts), width)])
        own = F.floor((at - 1) / width).cast("int")
        found = once(own, lambda k: k * width + (upto(F.get(parts, k), p) - 1) * (width // BRANCH) + 1)
        return once(F.when(at > 0, found).otherwise(0), lambda n: narrowed(p, n, width // BRANCH))

    first = lambda p: once((upto(F.array(*cuts[::width]), p) - 1) * width + 1, lambda n: narrowed(p, F.greatest(n, F.lit(0)), width))
    return once(place, first).cast("int")


def group_key(by: list[str]) -> Column:
    """A group's columns as one value; structs are equal where both hold null."""
    return F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)])


def in_ranges(df: DataFrame, by: list[str], order: list[Column], range_rows: int = RANGE_ROWS) -> tuple[DataFrame, bool]:
    """Adds ``__by`` (the group) and ``__range`` (ascending ranges of the order); and whether there is more than one."""
    keys = df.withColumns({"__by": group_key(by), "__place": _place(order)})
    cuts = range_cuts(keys.select("__place"), range_rows)
    return keys.withColumn("__range", range_of(F.col("__place"), cuts)).drop("__place"), bool(cuts)


def running(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column], most: tuple[str, Column] | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds the running sums of ``sums`` (name to a value that is not null), own row included, in the
    ascending ``order`` of each group, nulls first.

    ``most`` names one of the sums, of values that are never negative, and a bound that is alike in all rows of a
    group: only rows before which the sum is at most that are returned, and of ranges that begin beyond
    it no row is sorted. Groups go by value, null being one. Rows alike in the whole order stay in one
    range and have their sums in any order. Sums of doubles may differ in their last digits from those
    of one pass.
    """
    ranged, several = in_ranges(df, by, order, range_rows)
    values = {f"__v{i}": value for i, value in enumerate(sums.values())}
    ranged = ranged.withColumns(values)
    inside = Window.partitionBy("__by", "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged
    if several:
        bound = [F.max(most[1]).alias("__bound")] if most else []
        totals = ranged.groupBy("__by", "__range").agg(*[F.sum(v).alias(v) for v in values], *bound)
        before = Window.partitionBy("__by").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        start = lambda v: F.coalesce(F.sum(v).over(before), F.lit(0).cast(totals.schema[v].dataType)).alias(f"{v}_start")
        starts = totals.select("__by", "__range", *map(start, values), *(["__bound"] if most else []))
        if most:
            starts = starts.filter(F.col(f"__v{list(sums).index(most[0])}_start") <= F.col("__bound")).drop("__bound")
        out = ranged.join(starts, ["__by", "__range"])
    base = lambda v: F.col(f"{v}_start") if several else F.lit(0)
    out = out.withColumns({name: F.sum(v).over(inside) + base(v) for name, v in zip(sums, values, strict=True)})
    if most:
        out = out.filter(F.col(most[0]) - F.col(f"__v{list(sums).index(most[0])}") <= most[1])
    return out.drop("__by", "__range", *values, *[f"{v}_start" for v in values])


def numbered(df: DataFrame, by: list[str], order: list[Column], place: str = "ord", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds ``place``, from 0 on, of each row in the ascending ``order`` of its group."""
    return running(df, by, order, {place: F.lit(1).cast("bigint")}, range_rows=range_rows).withColumn(place, F.col(place) - 1)
