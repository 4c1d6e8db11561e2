"""Cluster sizes as pages arrive: what was seen is state, so nothing is counted twice.

Pages of a cluster come in any order, again, and late. Their ids and their members' ids are kept in
state, and each batch gives the counts that have changed. A cluster's ids are dealt into slices, each a
key of its own, so that a cluster with very many members is no task's alone; sizes are sums over
slices. State of a slice goes when the watermark has passed its last page by the time allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from seqloom.plans.shipping import ship_package

#: Keys into which a cluster's ids are dealt.
SLICES = 16
_COUNTS = "cluster string, kind string, slice int, n long"


def page_items(pages: DataFrame, slices: int = SLICES) -> DataFrame:
    """(cluster, kind, slice, item, at) of pages (cluster, page, members array, at): a row for the page and one for
    each member; blank and null members name none."""
    rows = F.concat(F.array(F.struct(F.lit("page").alias("kind"), F.col("page").cast("string").alias("item"))), F.transform(F.coalesce("members", F.array().cast("array<string>")), lambda m: F.struct(F.lit("member").alias("kind"), F.trim(m).alias("item"))))
    each = pages.select("cluster", "at", F.explode(rows).alias("x")).select("cluster", "x.kind", "x.item", "at").filter("item <> ''")
    return each.withColumn("slice", F.pmod(F.xxhash64("item"), F.lit(slices)).cast("int"))


class SeenItems(StatefulProcessor):
    """Distinct items of a slice: gives its count when it has grown, and forgets it when its time is over."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "item string", "once boolean")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.count.get()[0] if self.count.exists() else 0
        n, last = known, None
        for batch in rows:
            for item in batch["item"].unique().tolist():
                if not self.seen.containsKey((item,)):
                    self.seen.updateValue((item,), (True,))
                    n += 1
            newest = batch["at"].max()
            last = newest if last is None else max(last, newest)
        if last is not None and not pd.isna(last):
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(last.timestamp() * 1000) + self.keep_ms)
        if n != known:
            self.count.update((n,))
            yield pd.DataFrame({"cluster": [key[0]], "kind": [key[1]], "slice": [key[2]], "n": [n]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        self.count.clear()
        return iter(())

    def close(self) -> None:
        pass


def count_arriving(pages: DataFrame, out: str, checkpoint: str, late: str = "1 hour", keep_ms: int = 30 * 24 * 3_600_000, slices: int = SLICES) -> StreamingQuery:
    """Count the pages and members of each cluster as pages arrive, and end when none is left.

    ``pages`` is a stream of (cluster, page, members, at). Pages later than the watermark, ``late`` behind the
    newest, are left out; state without news for ``keep_ms`` after that goes. Each batch writes the
    slices whose counts have grown to a folder of its own, so a batch that is run again writes the same
    again; ``cluster_sizes`` reads the newest.
    """
    spark = pages.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    items = page_items(pages.withWatermark("at", late), slices)
    counts = items.groupBy("cluster", "kind", "slice").transformWithStateInPandas(SeenItems(keep_ms), _COUNTS, "Update", "EventTime")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/part={number}")

    return counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cluster_sizes(spark: SparkSession, out: str) -> DataFrame:
    """(cluster, n_pages, n_members) from what ``count_arriving`` has written: the newest count of each slice, summed."""
    rows = spark.read.schema(f"{_COUNTS}, batch long").parquet(out)
    newest = rows.groupBy("cluster", "kind", "slice").agg(F.max_by("n", "batch").alias("n"))
    size = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0).cast("long"))
    return newest.groupBy("cluster").agg(size("page").alias("n_pages"), size("member").alias("n_members"))


def sizes_of(pages: DataFrame) -> DataFrame:
    """The same from a whole table of pages at once."""
    items = page_items(pages).select("cluster", "kind", "item").distinct()
    return items.groupBy("cluster").agg(F.count_if(F.col("kind") == "page").alias("n_pages"), F.count_if(F.col("kind") == "member").alias("n_members"))
