"""Cluster tables: pair tables, hierarchies and their statistics."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.sequences import is_structural, structural_source
from seqloom.plans.lineage import cut


def cluster_pairs(df: DataFrame) -> DataFrame:
    """A pair table by position: first column representative, second member."""
    return df.select(*df.columns[:2]).toDF("rep", "member")


def dedup_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.dropDuplicates(["rep", "member"])


def cluster_type(n_struct: Column, n_seq: Column) -> Column:
    """Both counts over 1: finished; only sequences over 1: not finished; else invalid."""
    return F.when((n_struct > 1) & (n_seq > 1), "finished").when(n_seq > 1, "not finished").otherwise("invalid")


def cluster_stats(pairs: DataFrame, structural: Column | None = None) -> DataFrame:
    """(rep, n_total, n_struct, n_seq, cluster_type) over distinct pairs.

    One conditional aggregation, where two aggregates and a left join would say the same. Deduping
    and counting share the representative as grouping key after one shuffle of distinct pairs.
    """
    flag = is_structural(F.col("member")) if structural is None else structural
    counts = dedup_pairs(pairs).groupBy("rep").agg(F.count("*").alias("n_total"), F.count_if(flag).alias("n_struct"))
    counts = counts.withColumn("n_seq", F.col("n_total") - F.col("n_struct"))
    return counts.withColumn("cluster_type", cluster_type(F.col("n_struct"), F.col("n_seq")))


def cluster_stats_by_join(pairs: DataFrame, structural: Column | None = None) -> DataFrame:
    """The same counts by the left join of two aggregates, missing ones 0; kept as a cross-check."""
    flag = is_structural(F.col("member")) if structural is None else structural
    once = dedup_pairs(pairs)
    every = once.groupBy("rep").agg(F.count("*").alias("n_total"))
    some = once.filter(flag).groupBy("rep").agg(F.count("*").alias("n_struct"))
    return every.join(some, "rep", "left").select("rep", "n_total", F.coalesce("n_struct", F.lit(0)).alias("n_struct"))


def size_histogram(pairs: DataFrame, by: str = "rep", bins: int = 50) -> DataFrame:
    """(bin, low, n_clusters): how many clusters have a size in each of ``bins`` even bins."""
    sizes = pairs.groupBy(by).agg(F.count("*").alias("size"))
    span = sizes.agg(F.min("size").alias("least"), F.max("size").alias("most"))
    at = F.least(F.floor((F.col("size") - F.col("least")) * bins / F.greatest(F.col("most") - F.col("least"), F.lit(1))), F.lit(bins - 1))
    return (
        sizes.crossJoin(F.broadcast(span))
        .groupBy(at.cast("bigint").alias("bin"), "least", "most")
        .agg(F.count("*").alias("n_clusters"))
        .select("bin", (F.col("least") + F.col("bin") * (F.col("most") - F.col("least")) / bins).alias("low"), "n_clusters")
    )


def page_members(pages: DataFrame) -> DataFrame:
    """Rows (cluster, ord, u50, u90, u100) of cluster pages: the representative first, then members.

    ``pages``: cluster, representativeMember struct and members array of structs with
    uniref50Id, uniref90Id and uniref100Id; a cluster may have several pages, numbered by ``page``.
    """
    ids = lambda m: F.struct(m["uniref50Id"].alias("u50"), m["uniref90Id"].alias("u90"), m["uniref100Id"].alias("u100"))
    every = F.concat(
        F.when(F.col("representativeMember").isNotNull(), F.array(ids(F.col("representativeMember")))).otherwise(F.array().cast("array<struct<u50:string,u90:string,u100:string>>")),
        F.coalesce(F.transform("members", ids), F.array().cast("array<struct<u50:string,u90:string,u100:string>>")),
    )
    return pages.select("cluster", "page", F.posexplode(every).alias("at", "m")).select("cluster", F.struct("page", "at").alias("ord"), "m.*")


def cluster_members(members: DataFrame, level: str) -> DataFrame:
    """Distinct non-blank ids of one level in each cluster: (cluster, member)."""
    own = F.trim(F.col(level))
    return members.select("cluster", own.alias("member")).filter("member <> ''").distinct()


def assert_members(members: DataFrame, clusters: DataFrame) -> DataFrame:
    """``members`` of ``clusters``; a cluster without any raises when it is read."""
    joined = clusters.join(members, "cluster", "left")
    return joined.withColumn("member", F.coalesce("member", F.raise_error(F.concat(F.lit("no members in "), F.col("cluster"))).cast("string")))


def parent_of(members: DataFrame, parent: str = "u50") -> DataFrame:
    """The first non-blank parent id of each cluster, representative first: (cluster, parent)."""
    return members.filter(F.trim(F.col(parent)) != "").groupBy("cluster").agg(F.min_by(F.trim(F.col(parent)), "ord").alias("parent"))


def sampling_records(members: DataFrame, seed: str = "seed", cluster: str = "cluster", member: str = "member") -> DataFrame:
    """Each member's probability: one over the loaded clusters of its seed, over its cluster's size.

    Clusters that were not loaded are not in ``members`` and so do not count.
    Returns (seed, cluster, member, cluster_size, probability).
    """
    sizes = members.groupBy(seed, cluster).agg(F.count("*").alias("cluster_size"))
    loaded = sizes.groupBy(seed).agg(F.count("*").alias("n_clusters"))
    table = sizes.join(loaded, seed).withColumn("probability", F.lit(1.0) / F.col("n_clusters") / F.col("cluster_size"))
    return members.join(table, [seed, cluster]).select(seed, cluster, member, "cluster_size", "probability")


def run_summary(records: DataFrame, seed: str = "seed", cluster: str = "cluster") -> DataFrame:
    """Totals of a sampling run for each seed: its clusters and members, the size of the largest cluster, and
    the least and most weight that a cluster has."""
    each = records.groupBy(seed, cluster).agg(F.count("*").alias("size"), F.sum("probability").alias("weight"))
    return each.groupBy(seed).agg(
        F.count("*").alias("n_clusters"), F.sum("size").alias("n_members"), F.max("size").alias("largest"), F.min("weight").alias("least_weight"), F.max("weight").alias("most_weight")
    )


def distinct_structures(df: DataFrame, value: str) -> DataFrame:
    """(structure): the distinct structures that values name, without their prefix; other values name none."""
    return df.select(structural_source(F.col(value)).alias("structure")).filter("structure IS NOT NULL").distinct()


def cluster_report(records: DataFrame, seed: str = "seed", cluster: str = "cluster") -> DataFrame:
    """Size and weight of each cluster, and totals of its seed."""
    each = records.groupBy(seed, cluster).agg(F.count("*").alias("size"), F.sum("probability").alias("weight"))
    totals = each.groupBy(seed).agg(F.count("*").alias("n_clusters"), F.sum("size").alias("n_members"))
    return each.join(totals, seed)


def only_unprocessed(todo: DataFrame, done: DataFrame, by: str | list[str]) -> DataFrame:
    return todo.join(done, by, "left_anti")


def lookup_sequences(ids: DataFrame, store: DataFrame, by: str) -> DataFrame:
    """Sequences of ids, in the order of their ``ord`` column; ids without one go, repeats stay."""
    return ids.join(store, by)


def last_wins(df: DataFrame, key: str | list[str], order: Column) -> DataFrame:
    """The last row of each key; an aggregation, so a hot key is reduced before it is shuffled."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("row")).select(*keys, "row.*")


def modal_label(df: DataFrame, key: str, label: str, order: str) -> DataFrame:
    """The most common label of each key, the one met first on ties: (key, label, n)."""
    each = df.groupBy(key, label).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return each.groupBy(key).agg(F.max_by(F.struct(label, "n"), F.struct("n", -F.col("first"))).alias("best")).select(key, "best.*")


def distinct_ids(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sorted distinct non-null values of several columns: (kind, value)."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in columns])).alias("v")
    return df.select(each).select("v.*").filter("value IS NOT NULL").distinct().orderBy("kind", "value")


def finite_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, n_nan, n_inf, all_finite, low, high); low and high over finite values."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("e")
    infinite = F.abs("v") == float("inf")
    finite = F.when(~F.isnan("v") & ~infinite, F.col("v"))
    return df.select(each).select("e.*").groupBy("column").agg(
        F.count("v").alias("n"), F.count_if(F.isnan("v")).alias("n_nan"), F.count_if(infinite & ~F.isnan("v")).alias("n_inf"),
        (F.count_if(F.isnan("v") | infinite) == 0).alias("all_finite"), F.min(finite).alias("low"), F.max(finite).alias("high"),
    )


def ordered_fingerprint(df: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """SHA-1 of each group's texts, concatenated in order without separator: (by, fingerprint).

    Rows are dealt by group and sorted by (group, order, text), and the digest is carried from row to
    row, so a group is never one value: it needs no more memory than a batch of rows, whatever its
    length. Null texts add nothing. A digest is sequential, so a group is one task's stream.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, last, begun = hashlib.sha1(), None, False
        for batch in batches:
            keys, done = [], []
            for key, part in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if begun and key != last:
                    keys.append(last)
                    done.append(digest.hexdigest())
                    digest = hashlib.sha1()
                last, begun = key, True
                digest.update((part or "").encode())
            kind = batch.column(0).type
            yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(done, pa.string())], ["by", "fingerprint"])
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([last], kind), pa.array([digest.hexdigest()])], ["by", "fingerprint"])

    rows = df.select(F.col(by).alias("by"), F.col(order).alias("order"), F.col(text).alias("text"))
    kind = df.schema[by].dataType.simpleString()
    return rows.repartition("by").sortWithinPartitions("by", "order", "text").mapInArrow(fold, f"by {kind}, fingerprint string").withColumnRenamed("by", by)


def chain_pages(pages: DataFrame, page: str = "url", following: str = "next") -> DataFrame:
    """Where each page stands in its chain of links: (page, first, place, status).

    ``first`` is the page from which the chain begins, ``place`` counts from 0. ``status`` is that of the
    chain: ``whole`` if its last page links to none, ``gap`` if it links to a page that isn't there,
    ``cycle`` (with no first page and no place) if the links lead back. Of several pages that link to one, the
    least leads on and the others end in a gap, since a page stands in one chain. Pages are distinct
    and not null; repeated ones count once, with their least link.

    Lists are ranked by pointer doubling: each page knows the page 1, 2, 4, ... before it, so a chain of n
    pages takes log2(n) joins on single pages, and pages that have found their first one take no part.
    """
    once = pages.select(F.col(page).alias("page"), F.col(following).alias("next")).filter("page IS NOT NULL").groupBy("page").agg(F.min("next").alias("next"))
    once = cut(once)
    before = once.filter("next IS NOT NULL").groupBy(F.col("next").alias("of")).agg(F.min("page").alias("before"))
    now = once.join(before, F.col("page") == F.col("of"), "left").select("page", F.col("before").alias("far"), F.col("before").isNotNull().cast("long").alias("place"))
    now = cut(now.withColumn("first", F.when(F.col("far").isNull(), F.col("page"))))
    rounds = max(1, once.count().bit_length() + 1)  # a page with one before it after so many rounds stands in a cycle
    for _ in range(rounds):
        open_ = now.filter("far IS NOT NULL")
        if open_.isEmpty():
            break
        jump = now.select(F.col("page").alias("far"), F.col("far").alias("farther"), F.col("place").alias("more"), F.col("first").alias("found"))
        moved = open_.select("page", "far", "place").join(jump, "far").select("page", F.col("farther").alias("far"), (F.col("place") + F.col("more")).alias("place"), F.col("found").alias("first"))
        now = cut(now.filter("far IS NULL").unionByName(moved))
    ends = once.join(before.select(F.col("before").alias("page"), F.lit(True).alias("linked")), "page", "left_anti")
    ends = ends.join(now.select("page", "first"), "page").select("first", F.when(F.col("next").isNull(), "whole").otherwise("gap").alias("status"))
    # a page that links on to one that another page leads to ends its chain there; a link to no page at all does so too
    there = once.select(F.col("page").alias("next"), F.lit(True).alias("there"))
    lost = once.filter("next IS NOT NULL").join(there, "next", "left_anti").join(now.select("page", "first"), "page").select("first", F.lit("gap").alias("status"))
    status = ends.unionByName(lost).filter("first IS NOT NULL").groupBy("first").agg(F.min("status").alias("status"))
    done = now.withColumn("first", F.when(F.col("far").isNull(), F.col("first")))
    return done.join(status, "first", "left").select(
        F.col("page").alias(page), "first", F.when(F.col("first").isNotNull(), F.col("place")).alias("place"), F.when(F.col("first").isNull(), "cycle").otherwise(F.col("status")).alias("status")
    )
