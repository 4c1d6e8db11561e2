"""Views of the driver tables that stand in for sequence, structure and score tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from seqloom.functions.geometry import point


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_out(df: DataFrame) -> DataFrame:
    """The rows of a scan over all cores, where the files have fewer splits than there are cores.

    Work that is heavy for each row would leave cores idle else; large inputs are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Width of the stand-in alignments, and bytes of text that are cut into windows at a time (one text at least).
WIDTH, SOME_BYTES = 240, 1 << 22


def aln(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(msa, row_id, aligned): the letters of all texts in windows of WIDTH, the last one filled with gaps.

    The k-th windows of a source's documents are one alignment, so whole texts are read and each
    document is a row, under its own id, of as many alignments as it has windows.
    """
    docs = spread_out(table(spark, sf_dir, "documents").select("source", "doc_id", "text"))
    kind = StructType([docs.schema["source"], StructField("k", IntegerType()), docs.schema["doc_id"], StructField("aligned", StringType())])
    upper = np.zeros(256, np.uint8)
    for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        upper[c] = upper[c + 32] = c

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch["text"].cast(pa.large_string()).fill_null("")
            ends = np.frombuffer(text.buffers()[1], dtype="<i8")[text.offset : text.offset + len(text) + 1]
            data, low = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8), 0
            while low < len(text):
                high = max(int(np.searchsorted(ends, ends[low] + SOME_BYTES, side="right")) - 1, low + 1)
                all_letters = upper[data[ends[low] : ends[high]]]
                kept = all_letters != 0  # no byte of a character beyond ASCII is a letter
                upto = np.concatenate(([0], np.cumsum(kept)))[ends[low : high + 1] - ends[low]]
                letters, count = all_letters[kept], -(-np.diff(upto) // WIDTH)
                first = np.concatenate(([0], np.cumsum(count)))
                out = np.full(first[-1] * WIDTH, ord("-"), np.uint8)
                for at, a, b in zip((first[:-1] * WIDTH).tolist(), upto[:-1].tolist(), upto[1:].tolist(), strict=True):
                    out[at : at + b - a] = letters[a:b]
                of = pa.array(low + np.repeat(np.arange(high - low), count))
                aligned = pa.StringArray.from_buffers(int(first[-1]), pa.py_buffer(np.arange(first[-1] + 1, dtype=np.int32) * np.int32(WIDTH)), pa.py_buffer(out))
                k = pa.array((np.arange(first[-1]) - np.repeat(first[:-1], count)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch["source"].take(of), k, batch["doc_id"].take(of), aligned], ["source", "k", "doc_id", "aligned"])
                low = high

    each = docs.mapInArrow(windows, kind)
    return each.select(F.concat_ws("/", "source", F.col("k").cast("string")).alias("msa"), F.col("doc_id").alias("row_id"), "aligned")


ALN_SQL = f"""txt AS (SELECT source, doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS t FROM documents),
aln AS (SELECT source || '/' || k AS msa, doc_id AS row_id, rpad(substr(t, k * {WIDTH} + 1, {WIDTH}), {WIDTH}, '-') AS aligned
  FROM (SELECT *, unnest(generate_series(0, (length(t) - 1) // {WIDTH})) AS k FROM txt WHERE t <> ''))"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chain, pos, n, ca, c, plddt): 7 residues of 9 numbers from each embedding, times 100."""
    return points_of(table(spark, sf_dir, "embeddings"))


def points_of(embeddings: DataFrame, *more: str) -> DataFrame:
    """The same of some embeddings, with ``more`` of their columns."""
    e = embeddings.select("vec_id", "embedding", *more, F.explode(F.sequence(F.lit(0), F.lit(6))).alias("pos"))
    at = lambda k: F.get("embedding", (F.col("pos") * 9 + k).cast("int")).cast("double") * 100
    return e.select(
        F.col("vec_id").alias("chain"), "pos", *more,
        *[point(at(3 * k), at(3 * k + 1), at(3 * k + 2)).alias(name) for k, name in enumerate(("n", "ca", "c"))],
        ((F.col("vec_id") * 7 + F.col("pos") * 13) % 101).cast("double").alias("plddt"),
    )


def _xyz(k: int, name: str) -> str:
    return ", ".join(f"e.embedding[p.pos * 9 + {3 * k + i + 1}]::DOUBLE * 100 AS {name}{axis}" for i, axis in enumerate("xyz"))


POINTS_SQL = f"""pts AS (SELECT e.vec_id AS chain, p.pos, {_xyz(0, 'n')}, {_xyz(1, 'a')}, {_xyz(2, 'c')},
  ((e.vec_id * 7 + p.pos * 13) % 101)::DOUBLE AS plddt FROM embeddings e, generate_series(0, 6) AS p(pos))"""


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, vec_id, pos, target, logits): 29 logits of each embedding, times 10."""
    e = table(spark, sf_dir, "embeddings")
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return e.select(
        F.col("label").alias("seq_id"), "vec_id", place.alias("pos"), (F.col("vec_id") % 29).cast("int").alias("target"),
        F.transform(F.slice("embedding", 1, 29), lambda v: v.cast("double") * 10).alias("logits"),
    )


LOGITS_SQL = """lg AS (SELECT label AS seq_id, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos,
  (vec_id % 29)::INT AS target, list_transform(embedding[1:29], lambda v: v::DOUBLE * 10) AS logits FROM embeddings),
lse AS (SELECT *, list_max(logits) + ln(list_sum(list_transform(logits, lambda v: exp(v - list_max(logits))))) AS z FROM lg)"""
