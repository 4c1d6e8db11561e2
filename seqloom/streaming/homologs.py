"""Homolog sets for accessions as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seqloom.operators.sampling import sample_homologs


def accession_stream(spark: SparkSession, path: str) -> DataFrame:
    """(seed) of accession files that appear in a folder; blanks and # comments go."""
    lines = spark.readStream.text(path).select(F.trim("value").alias("seed"))
    return lines.filter("seed <> '' AND NOT startswith(seed, '#')")


def sample_arriving(
    accessions: DataFrame, hierarchy: Callable[[], tuple[DataFrame, DataFrame, DataFrame]], out: str, checkpoint: str, k: int = 100, seed: int = 0
) -> StreamingQuery:
    """Draw homologs for each new accession once, and end when none is left.

    The checkpoint takes the place of looking which results exist. ``hierarchy`` gives (parents,
    clusters, members) when a batch runs. A batch that is run again writes its own folder again, so
    nothing is written twice.
    """

    def run(batch: DataFrame, number: int) -> None:
        draws = sample_homologs(batch.distinct(), *hierarchy(), k=k, seed=seed)
        draws.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return accessions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
