"""FASTA and aligned FASTA as tables, read in splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_fasta(spark: SparkSession, path: str | list[str], upper: bool = True, comment: str = "#") -> DataFrame:
    """(file, block, rec_no, name, sequence) of FASTA files, compressed ones by suffix.

    Lines that start with ``comment`` are skipped before anything else; lines are stripped; a line
    that then starts with ``>`` begins a record, whose name is the rest of it; other lines are
    concatenated. Text before the first record is dropped, empty sequences stay. Order in a file is
    (block, rec_no): the start of the split a record was read from, and its place in there.

    Files are read record by record with the header mark as line separator, so large ones are
    split; a record is one value.
    """
    raw = (
        spark.read.option("lineSep", "\n>").text(path)
        .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    )
    # the first row of each file, which may be a preamble; the join is on single rows, so no file is gathered
    heads = raw.filter("block = 0").groupBy("file").agg(F.min("place").alias("place")).withColumn("head", F.lit(True))
    marked = raw.join(heads, ["file", "place"], "left").withColumn("is_first", F.coalesce("head", F.lit(False)))
    return _records(marked, upper, comment)


def parse_fasta(df: DataFrame, text: str, keys: list[str], upper: bool = True, comment: str = "#") -> DataFrame:
    """Records of FASTA texts held in a column: (keys..., rec_no, name, sequence)."""
    lines = F.transform(F.filter(F.split(text, "\n"), lambda x: ~F.startswith(x, F.lit(comment))), _strip)
    rows = df.select(*keys, F.posexplode(_blocks(lines)).alias("rec_no", "lines"))
    return rows.select(*keys, F.col("rec_no").cast("bigint").alias("rec_no"), *_named(F.col("lines"), upper))


def _strip(line: F.Column) -> F.Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def _named(lines: F.Column, upper: bool) -> list[F.Column]:
    sequence = F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), "")
    return [F.substr(F.get(lines, F.lit(0)), F.lit(2)).alias("name"), (F.upper(sequence) if upper else sequence).alias("sequence")]


def _blocks(lines: F.Column) -> F.Column:
    """Stripped lines as arrays of lines, one for each header; lines before the first go."""
    mark = "\x1e"
    joined = F.array_join(F.transform(lines, lambda x: F.when(F.startswith(x, F.lit(">")), F.concat(F.lit(mark), x)).otherwise(x)), "\n")
    parts = F.filter(F.split(joined, mark), lambda p: F.startswith(p, F.lit(">")))
    return F.transform(parts, lambda p: F.split(F.regexp_replace(p, "\n$", ""), "\n"))


def _records(raw: DataFrame, upper: bool, comment: str) -> DataFrame:
    # the separator took the mark of every record but a file's first, which may also be a preamble
    text = F.when(F.col("is_first"), F.col("value")).otherwise(F.concat(F.lit(">"), F.col("value")))
    lines = F.transform(F.filter(F.split(text, "\n"), lambda x: ~F.startswith(x, F.lit(comment))), _strip)
    rows = raw.select("file", "block", "place", F.posexplode(_blocks(lines)).alias("inside", "lines"))
    return rows.select("file", "block", F.struct("place", "inside").alias("rec_no"), *_named(F.col("lines"), upper))


def read_a3m(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Aligned FASTA: (msa_id, block, rec_no, name, raw_seq, aligned_seq); insertions stay in raw_seq."""
    rows = read_fasta(spark, path, upper=False)
    return rows.select(
        F.regexp_extract("file", r"([^/]+?)(?:\.a3m)?(?:\.zst|\.gz)?$", 1).alias("msa_id"), "block", "rec_no", "name",
        F.col("sequence").alias("raw_seq"), F.regexp_replace("sequence", "[a-z]", "").alias("aligned_seq"),
    )


def read_variants(spark: SparkSession, path: str, wild_type: str | None = None) -> DataFrame:
    """(ord, name, sequence, is_wt) of a variants file in file order, the wild type last.

    ``ord`` numbers one file's records; it is as long as a file of variants is.
    """
    rows = read_fasta(spark, path)
    found = rows.select((F.row_number().over(Window.partitionBy("file").orderBy("block", "rec_no")) - 1).cast("bigint").alias("ord"), "name", "sequence")
    if wild_type is None:
        return found.withColumn("is_wt", F.lit(False))
    from seqloom.operators.scoring import append_wt

    return append_wt(found, spark.createDataFrame([("WT", wild_type)], "name string, sequence string"))
