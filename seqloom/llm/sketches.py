"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range. Sketches of any two
documents are samples of their shingles under one rule, so unions are sketches again and
containment between very unequal documents can be estimated. DataFrame expressions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words of a shingle, and the fraction of hashes that a sketch keeps.
SHINGLE, FRACTION = 5, 1 / 8
#: Hex digits that a fingerprint shows of each hash: all of them.
DIGITS = 16
#: Rows of a range of neighbouring ids on average, ranges at most, and ids that the driver sees for each.
BUCKET_ROWS, MOST_BUCKETS, SEEN = 1000, 16_384, 32


def words(text: Column) -> Column:
    """Words of a text in lower case, split at white space; null or blank: none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def _limit(fraction: float) -> Column:
    """The hash at which the fraction of the hash range ends."""
    return F.lit(min(-(1 << 63) + int(fraction * (1 << 64)), (1 << 63) - 1)).cast("long")


def _marks(text: Column) -> Column:
    """The hash of each word of a text."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _runs(mark: Column, size: int) -> Column:
    """The hash of each shingle, given the hashes of the words; fewer words than a shingle are one of them all."""
    runs = F.transform(F.sequence(F.lit(0), F.size(mark) - size), lambda i: F.xxhash64(*[F.get(mark, i + k) for k in range(size)]))
    single = F.array(F.aggregate(mark, F.lit(0).cast("long"), lambda a, w: F.xxhash64(a, w)))
    return F.when(F.size(mark) >= size, runs).when(F.size(mark) > 0, single).otherwise(F.array().cast("array<bigint>"))


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """All shingle hashes of a text, in text order."""
    return F.get(F.transform(F.array(_marks(text)), lambda mark: _runs(mark, size)), F.lit(0))


def with_sketch(df: DataFrame, text: str, out: str, size: int = SHINGLE, fraction: float = FRACTION, whole: str | None = None) -> DataFrame:
    """Add the sketch of a text column: ascending distinct hashes below the fraction.

    Where a text has shingles but none below the fraction, its smallest hash stands in, so that no
    text with words has an empty fingerprint; it is no sample, and comparisons and merged sketches
    leave it out. Null and blank texts have empty sketches. ``whole`` names a second column for all
    shingle hashes, in text order, by which texts without a sample are compared exactly.
    """
    marks, hashes, kept = f"__{out}_marks", f"__{out}_hashes", f"__{out}_kept"
    limit = _limit(fraction)
    found = (
        df.withColumn(marks, _marks(F.col(text)))
        .withColumn(hashes, _runs(F.col(marks), size))
        .withColumn(kept, F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < limit))))
        .withColumn(out, F.when((F.size(kept) == 0) & (F.size(hashes) > 0), F.array(F.array_min(hashes))).otherwise(F.col(kept)))
    )
    return (found.withColumn(whole, F.col(hashes)) if whole else found).drop(marks, hashes, kept)


def unsampled(sketch: Column, fraction: float = FRACTION) -> Column:
    """Whether a sketch has a stand-in only."""
    return F.coalesce(F.get(sketch, F.lit(0)) >= _limit(fraction), F.lit(False))


def _likeness(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
    )


def _containment(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_distinct(a)), F.lit(1)))


def likeness(a: Column, b: Column, whole_a: Column | None = None, whole_b: Column | None = None, fraction: float = FRACTION) -> Column:
    """Estimated Jaccard similarity of the shingle sets behind two sketches; two empty ones: 1.

    Where one of the texts has shingles but no sample of them, it is counted exactly on the whole
    sets, and without these it is null, since the sketches can't tell.
    """
    exact = F.lit(None).cast("double") if whole_a is None or whole_b is None else _likeness(whole_a, whole_b)
    return F.when(unsampled(a, fraction) | unsampled(b, fraction), exact).otherwise(_likeness(a, b))


def containment(a: Column, b: Column, whole_a: Column | None = None, whole_b: Column | None = None, fraction: float = FRACTION) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has too; an empty ``a``: 1.

    Exact on the whole sets, or null without these, where one of the texts has no sample.
    """
    exact = F.lit(None).cast("double") if whole_a is None or whole_b is None else _containment(whole_a, whole_b)
    return F.when(unsampled(a, fraction) | unsampled(b, fraction), exact).otherwise(_containment(a, b))


def merge_sketches(df: DataFrame, by: list[str], sketch: str, fraction: float = FRACTION) -> DataFrame:
    """Sketches of groups of documents: the distinct sampled hashes of their members, counted by group.

    The result is long, (group, hash), so a group may hold any share of all documents.
    """
    # the outer form, since the other one infers a filter that would compute unstored sketches again
    return df.select(*by, F.explode_outer(sketch).alias("hash")).filter(F.col("hash") < _limit(fraction)).distinct()


def fingerprint(sketch: Column, digits: int = DIGITS) -> Column:
    """A sketch as a string: the leading hex digits of its hashes, in order."""
    return F.array_join(F.transform(sketch, lambda h: F.substring(F.lpad(F.hex(h), 16, "0"), 1, digits)), "")


def next_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prepare: Callable[[DataFrame], DataFrame] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each document beside the next one by ascending id, the last beside the first.

    Returns (id, text, next_text), and each column c of ``carry`` with its next one as next_<c>; these are
    what ``prepare`` adds to rows with a ``text`` column, once for each document, after the shuffle. Ids may
    be of any type that sorts. They are dealt into ranges by a seeded sample of SEEN ids a range, so
    MOST_BUCKETS x SEEN ids on the driver at most; each range is sorted by itself and ends with a copy
    of the first document of the range that follows, so the texts are shuffled once and no task
    holds more than a row. Null ids come first; equal ids go by text. Null texts: empty. An empty
    table gives no rows; further columns are ignored.
    """
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = docs.select("id")
    cuts = _cuts(ids)
    bucket = _bucket(F.col("id"), cuts)
    firsts = ids.groupBy(bucket.alias("own")).agg(F.min(F.struct("id")).getField("id").alias("least"))
    by_range = Window.orderBy("own")
    total = Window.orderBy("own").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follow = firsts.select(
        F.coalesce(F.lag("own").over(by_range), F.max("own").over(total)).alias("bucket"),
        F.col("least"),
    )
    ends = (
        docs.join(F.broadcast(follow), docs["id"].eqNullSafe(follow["least"]))
        .groupBy("bucket", "id")
        .agg(F.min("text").alias("text"))
        .select("bucket", F.lit(1).alias("end"), "id", "text")
    )
    rows_in = docs.select(bucket.alias("bucket"), F.lit(0).alias("end"), "id", "text").unionByName(ends).repartition("bucket")
    ready = prepare(rows_in) if prepare else rows_in
    order = Window.partitionBy("bucket").orderBy("end", F.col("id").asc_nulls_first(), "text")
    paired = ready.withColumn("next", F.lead(F.struct("text", *carry)).over(order)).filter(F.col("end") == 0)
    more = [c for name in carry for c in (F.col(name), F.col(f"next.{name}").alias(f"next_{name}"))]
    return paired.select(F.col("id").alias(id_col), F.col("text").alias(text_col), F.col("next.text").alias("next_text"), *more)


def _cuts(ids: DataFrame) -> list:
    """Where ranges of ids begin: evenly spaced values of a bounded sample, which a hash of the id picks."""
    rows = ids.count()
    count = max(1, min(MOST_BUCKETS, rows // BUCKET_ROWS))
    if count == 1:
        return []
    share = min(1.0, SEEN * count / rows)
    mark = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))
    seen = sorted(r["id"] for r in ids.filter(mark & F.col("id").isNotNull()).distinct().collect())
    return sorted({seen[len(seen) * i // count] for i in range(1, count)}) if seen else []


def _bucket(value: Column, cuts: list) -> Column:
    """Number of cuts at or below a value, found in two steps of about the square root each."""
    if not cuts:
        return F.lit(0)
    width = max(1, int(len(cuts) ** 0.5))
    parts = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    heads = F.array(*[F.lit(p[0]) for p in parts])
    table = F.array(*[F.array(*[F.lit(v) for v in p]) for p in parts])
    part = F.size(F.filter(heads, lambda h: h <= value)) - 1
    inside = F.size(F.filter(F.get(table, part), lambda h: h <= value))
    return F.when(value.isNull() | (part < 0), F.lit(0)).otherwise(part * width + inside).cast("int")


def edited_text(text: Column, following: Column) -> Column:
    """A text whose last half of code points gives way to as many (or all) of the next text's first."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - half), F.substr(following, F.lit(1), half))
