"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, single: bool = False, partition_by: list[str] | None = None, mode: str = "error") -> None:
    """Parquet, in as many files as there are partitions; ``single``: in one, for small results only."""
    writer = (df.coalesce(1) if single else df).write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def sampled_line() -> F.Column:
    """Line of a sampled homolog."""
    return F.format_string("%s uniref90=%s probability=%.10f uniref90_size=%d", F.col("member"), F.col("cluster"), F.col("probability"), F.col("cluster_size"))


def write_sampled(draws: DataFrame, path: str, mode: str = "error") -> None:
    """Sampled homologs as text lines, in a folder for each seed.

    ``draws``: seed, draw, member, cluster, probability, cluster_size. Rows are dealt by ranges of (seed,
    draw) and sorted, so that a seed is a file or few, and one with very many draws no task's alone.
    """
    rows = draws.repartitionByRange("seed", "draw").sortWithinPartitions("seed", "draw")
    rows.select("seed", sampled_line().alias("value")).write.mode(mode).partitionBy("seed").text(path)


def append_fasta(df: DataFrame, path: str, log_path: str | None = None) -> None:
    """Appends (name, sequence) as FASTA, and with ``log_path`` the (name, n) of each as a log."""
    df.select(F.concat(F.lit(">"), "name", F.lit("\n"), "sequence").alias("value")).write.mode("append").text(path)
    if log_path:
        df.select(F.concat_ws(" ", "name", F.col("n").cast("string")).alias("value")).write.mode("append").text(log_path)


def write_training_records(df: DataFrame, path: str, mode: str = "error") -> None:
    """(id, sequence, coords, scores) as Parquet; coordinates and scores as floats."""
    df.select("id", "sequence", F.col("coords").cast("array<array<array<float>>>"), F.col("scores").cast("array<float>")).write.mode(mode).parquet(path)


def write_scores(df: DataFrame, path: str, order: str = "ord", score: str = "score", mode: str = "error") -> None:
    """Scores as floats in the order of the input."""
    df.orderBy(order).withColumn(score, F.col(score).cast("float")).write.mode(mode).parquet(path)
