"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight that changes over training time t in [0, 1]: ``w(t) = w (1 + s (2t - 1))``
with a slope s in [-1, 1]. Its integral is the source's cumulative token demand, which ends at the
source's target whatever the slope. Documents fill that demand one after another; inverting the
demand gives each of them its training position, and a range sort by position is the training
order. DataFrame expressions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.plans.lineage import cut

#: Words are runs of anything but the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights and slopes of sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
SLOPES = (-0.5, 0.0, 0.5)
#: Documents that one bucket of a prefix sum has on average.
BUCKET_ROWS = 512
HASH_BITS = 48


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _cycle(values: tuple, place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (place % len(values) + 1).cast("int"))


def source_targets(
    sizes: DataFrame, weights: tuple = WEIGHTS, slopes: tuple = SLOPES, share: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """Targets of the sources of ``sizes`` (no_source int, source string, size long).

    The targets are in proportion to the weights and sum to ``share`` of all sizes, except that none
    exceeds ``cap`` times its source's size; what is over goes to the other sources by weight. The
    capped sources are those of the least size by weight, so one ordered prefix sum over the
    sources (one row each) finds them all at once.
    """
    by_name = Window.orderBy("no_source", "source")
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "no_source", "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    table = (
        sizes.groupBy("no_source", "source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", _cycle(weights, F.col("place")))
        .withColumn("slope", _cycle(slopes, F.col("place")))
        .withColumn("total", F.sum("source_size").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("rate", (share * F.col("total") - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after))
        .withColumn("capped", (F.col("rate") * F.col("weight") > cap * F.col("source_size")).cast("int"))
        .withColumn("level", F.max(F.when(F.col("capped") == 0, F.col("rate"))).over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    return table.select(
        "no_source", "source", "source_size", "weight", "slope",
        F.when(F.col("capped") == 1, cap * F.col("source_size")).otherwise(F.coalesce(F.col("level") * F.col("weight"), F.lit(0.0))).alias("target"),
    )


def demand_time(share: Column, slope: Column) -> Column:
    """The time at which a source with this slope has asked for ``share`` of its target.

    The demand is ``t + s (t^2 - t)``; this is its inverse in a form without cancellation.
    """
    rest = F.lit(1.0) - slope
    return F.when(share <= 0, F.lit(0.0)).otherwise(2 * share / (rest + F.sqrt(rest * rest + 4 * slope * share)))


def curriculum(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple = WEIGHTS, slopes: tuple = SLOPES, share: float = 1.5, cap: float = 2.0, seed: int = 0,
) -> DataFrame:
    """Decide for each document how often and when it is trained on.

    Returns the id, the source, ``size`` (words; null text 0), ``source_size``, ``target``,
    ``copies`` (how often it is taken, up to ``cap`` rounded up), ``taken`` (words in those copies)
    and ``positions`` (training time of each copy, ascending). A source is read in the order of a
    seeded hash of the id, again from the start when it runs out; a copy is taken when its middle
    word lies within the target, so a source misses its target by half a document at most. Ties of
    the hash go by id, then size; rows that tie in all are alike. Null sources are one source,
    after all others; sources without words have target 0. Empty table: no rows. Further columns
    are ignored.
    """
    mark = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 12), 16, 10)
    slim = cut(
        df.select(
            F.col(id_col).alias("id"),
            F.col(source_col).isNull().cast("int").alias("no_source"),
            F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
            n_words(F.col(text_col)).alias("size"),
            mark.cast("long").alias("mark"),
        )
    )
    buckets = max(1, math.ceil(slim.count() / BUCKET_ROWS))
    slim = slim.withColumn("bucket", F.shiftright(F.shiftright("mark", HASH_BITS - 32) * F.lit(buckets).cast("long"), 32))
    targets = source_targets(slim, weights, slopes, share, cap)
    key = ["no_source", "source", "bucket"]
    earlier = Window.partitionBy("no_source", "source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        slim.groupBy(*key)
        .agg(F.sum("size").alias("bucket_size"))
        .withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
        .join(targets, ["no_source", "source"])
        .drop("bucket_size")
    )
    inside = Window.partitionBy(*key).orderBy("mark", F.col("id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = slim.withColumn("upto", F.sum("size").over(inside)).join(starts, key)
    middle = F.col("bucket_start") + F.col("upto") - F.col("size") / 2
    middles = F.transform(F.sequence(F.lit(0), F.lit(math.ceil(cap) - 1)), lambda p: p * F.col("source_size") + middle)
    taken = F.filter(middles, lambda m: (m <= F.col("target")) & (F.col("size") > 0))
    return placed.withColumn("taken_at", taken).select(
        F.col("id").alias(id_col),
        F.when(F.col("no_source") == 0, F.col("source")).alias(source_col),
        "size", "source_size", "target",
        F.size("taken_at").cast("long").alias("copies"),
        (F.size("taken_at") * F.col("size")).cast("long").alias("taken"),
        F.transform("taken_at", lambda m: demand_time(m / F.col("target"), F.col("slope"))).alias("positions"),
    )


def training_order(plan: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The copies of a ``curriculum``, range-sorted by position: (id, epoch, position)."""
    return plan.select(id_col, F.posexplode("positions").alias("epoch", "position")).orderBy("position", id_col, "epoch")


def repeat_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: float = 2.0, **settings) -> DataFrame:
    """The rows of ``df``, each as often as its ``curriculum`` takes it, range-sorted by training position.

    All columns stay, whatever their names. The words delivered are those planned: rows that agree
    in id, source and size have the same mark, so the plan takes the first of them in each pass over
    their source; they are numbered by the hash of their text and dealt these copies one by one.
    Null ids are an id here. An empty table stays empty.
    """
    plan = curriculum(df, id_col, text_col, source_col, cap=cap, **settings)
    passes = range(math.ceil(cap))
    at = [F.get("positions", F.lit(k)) for k in passes]  # the places of a document in the passes over its source
    group = lambda source, size, id_: F.struct(id_.alias("id"), source.cast("string").alias("source"), size.alias("size"))
    named = lambda c: F.col(f"`{c}`")
    dealt = plan.filter("copies > 0").groupBy(group(named(source_col), F.col("size"), named(id_col)).alias("group")).agg(
        F.array(*[F.struct(F.count(p).alias("rows"), F.min(p).alias("position")) for p in at]).alias("passes")
    )
    # all columns in one, so that no name of theirs meets one used here
    held = df.select(F.struct(*map(named, df.columns)).alias("row"), group(named(source_col), n_words(named(text_col)), named(id_col)).alias("group"), F.md5(named(text_col)).alias("digest"))
    number = F.row_number().over(Window.partitionBy("group").orderBy("digest"))
    mine = F.transform(F.filter("passes", lambda p: p["rows"] >= F.col("number")), lambda p: p["position"])
    copies = held.join(dealt, "group").withColumn("number", number).withColumn("position", F.explode(mine))
    return copies.orderBy("position", F.col("group.id").asc_nulls_first()).select("row.*")
