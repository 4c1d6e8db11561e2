"""Tables, lists and landed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.clusters import page_members

# Suffixes under which an archive keeps each format of an entry.
ARCHIVE_FORMATS = {
    "cif": ".cif.gz", "pdb": ".pdb.gz", "pdb1": ".pdb1.gz", "assembly1": "-assembly1.cif.gz",
    "xml": ".xml.gz", "structure_factors": "-sf.cif.gz", "restraints": ".mr.gz", "restraints_star": "_mr.str.gz",
}
_MEMBER = "struct<uniref50Id:string,uniref90Id:string,uniref100Id:string>"
PAGE_SCHEMA = f"cluster string, page int, representativeMember {_MEMBER}, members array<{_MEMBER}>, nextPageUrl string, links array<struct<rel:string,href:string>>"


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table; only the columns asked for are read."""
    table = spark.read.parquet(path)
    return table.select(*columns) if columns else table


def read_accessions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(accession): one per line, stripped; blank lines and # comments go."""
    return spark.read.text(path).select(F.trim("value").alias("accession")).filter("accession <> '' AND NOT startswith(accession, '#')")


def read_chain_list(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(protein, chain) of lines ``protein_chain``; any other number of parts raises."""
    parts = F.split(F.trim("value"), "_")
    right = F.when(F.size(parts) == 2, parts).otherwise(F.raise_error(F.concat(F.lit("not protein_chain: "), F.col("value"))).cast("array<string>"))
    return spark.read.text(path).filter("trim(value) <> ''").select(F.trim(right[0]).alias("protein"), F.trim(right[1]).alias("chain"))


def read_cluster_pages(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Members of landed cluster pages (one JSON object per line): see ``page_members``."""
    return page_members(spark.read.schema(PAGE_SCHEMA).json(path))


def next_pages(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(cluster, page, url) of the pages that follow: nextPageUrl, else the link called next."""
    pages = spark.read.schema(PAGE_SCHEMA).json(path)
    link = F.get(F.filter("links", lambda x: x["rel"] == "next"), F.lit(0))["href"]
    return pages.select("cluster", "page", F.coalesce(F.col("nextPageUrl"), link).alias("url")).filter("url IS NOT NULL")


def list_inputs(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(id, path, size) of a folder's files with a suffix; id: the name before its first dot."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "false").load(path)
    return files.select(F.regexp_extract("path", r"([^/.]+)[^/]*$", 1).alias("id"), "path", F.col("length").alias("size"))


def fetch_manifest(ids: DataFrame, formats: list[str], base: str, column: str = "value") -> DataFrame:
    """(id, format, url): comma-separated id lists times the formats chosen."""
    unknown = set(formats) - set(ARCHIVE_FORMATS)
    if unknown:
        raise ValueError(f"unknown formats {sorted(unknown)}")
    each = ids.select(F.explode(F.split(column, ",")).alias("id")).select(F.trim("id").alias("id")).filter("id <> ''")
    kinds = F.explode(F.array(*[F.struct(F.lit(f).alias("format"), F.lit(ARCHIVE_FORMATS[f]).alias("suffix")) for f in formats])).alias("k")
    return each.select("id", kinds).select("id", "k.format", F.concat(F.lit(base.rstrip("/") + "/"), "id", "k.suffix").alias("url"))
