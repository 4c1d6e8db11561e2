"""Column functions on sequences and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Prefixes of structural accessions.
STRUCTURAL_MARK, AF2, V3D, VAF = "SARRAH", "SARRAHAF2", "SARRAHV3D", "SARRAHVAF"
UNIREF = "UniRef"
SEED_MODULUS = 4294967295


def match_columns(text: Column) -> Column:
    """Alignment columns of an aligned sequence: insertions, in lower case, go."""
    return F.regexp_replace(text, "[a-z]", "")


def unalign(text: Column) -> Column:
    """The sequence without gaps, in upper case."""
    return F.replace(F.upper(text), F.lit("-"), F.lit(""))


def mask_query(text: Column) -> Column:
    """A sequence of the same length of unknown residues."""
    return F.call_function("repeat", F.lit("X"), F.length(text))


def frame_text(text: Column) -> Column:
    return F.concat(F.lit("$"), text, F.lit("*"))


def backbone_only(coords: Column) -> Column:
    """The first three atoms of each residue."""
    return F.transform(coords, lambda r: F.slice(r, 1, 3))


def accession_of(name: Column) -> Column:
    """The accession in an alignment row's name: before the first tab, after the last underscore."""
    return F.substring_index(F.substring_index(name, "\t", 1), "_", -1)


def normalize_cluster_id(value: Column, prefix: str, strict: bool = True, on_error: str = "raise") -> Column:
    """A cluster id with the prefix wanted.

    strict: blank ids and other prefixes are errors (``on_error``: "raise" or "null"); what follows
    the first underscore goes to upper case. Otherwise: ids with the prefix stay, another cluster
    prefix is swapped, anything else gets the prefix.
    """
    own = F.trim(value)
    if not strict:
        rest = F.when(F.instr(own, "_") > 0, F.substr(own, F.instr(own, "_") + 1)).otherwise(own)
        return (
            F.when(own == "", _error("cluster id cannot be empty", on_error))
            .when(F.startswith(own, F.lit(prefix)), own)
            .when(F.startswith(own, F.lit(UNIREF)), F.concat(F.lit(prefix + "_"), rest))
            .otherwise(F.concat(F.lit(prefix + "_"), own))
        )
    at = F.instr(own, "_")
    head = F.substr(own, F.lit(1), at - 1)
    return (
        F.when(own == "", _error("cluster id cannot be empty", on_error))
        .when((at > 0) & (F.lower(head) != prefix.lower()), _error(f"cluster id must start with {prefix}", on_error))
        .otherwise(F.concat(F.lit(prefix + "_"), F.upper(F.when(at > 0, F.substr(own, at + 1)).otherwise(own))))
    )


def _error(message: str, on_error: str) -> Column:
    return F.raise_error(message).cast("string") if on_error == "raise" else F.lit(None).cast("string")


def split_assigned(value: Column) -> Column:
    """struct<prefix, suffix> of a structural assignment."""
    dash = F.split_part(value, F.lit("-"), F.lit(2))
    dotless = F.substring_index(F.substr(value, F.lit(10)), ".", 1)
    return (
        F.when(F.startswith(value, F.lit(AF2)), F.struct(F.lit(AF2).alias("prefix"), dash.alias("suffix")))
        .when(F.startswith(value, F.lit(V3D)), F.struct(F.lit(V3D).alias("prefix"), F.substring_index(dash, ".", 1).alias("suffix")))
        .when(F.startswith(value, F.lit(VAF)), F.struct(F.lit(VAF).alias("prefix"), dotless.alias("suffix")))
        .otherwise(F.struct(F.lit("").alias("prefix"), F.substr(value, F.lit(10)).alias("suffix")))
    )


def structural_source(value: Column) -> Column:
    """The accession behind a V3D assignment, else null."""
    own = F.substr(value, F.lit(7))
    return F.when(F.startswith(own, F.lit("V3D")), F.substr(own, F.lit(7)))


def is_structural(member: Column) -> Column:
    return F.contains(member, F.lit(STRUCTURAL_MARK))


def stable_seed(text: Column) -> Column:
    """SHA-256 of a string as an integer modulo 2^32 - 1.

    Since 2^32 is 1 there, that is the sum of the digest's eight 32-bit words.
    """
    digest = F.sha2(text, 256)
    words = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(8)]
    total = words[0]
    for word in words[1:]:
        total = total + word
    return F.pmod(total, F.lit(SEED_MODULUS))


def grid_name(max_tokens: Column, max_similarity: Column, structure: Column, inverse: Column, seed: Column) -> Column:
    """Name of a grid point, numbers and booleans written as in Python."""
    flag = lambda b: F.initcap(b.cast("string"))
    return F.concat_ws("_", max_tokens.cast("string"), max_similarity.cast("double").cast("string"), flag(structure), flag(inverse), F.concat(F.lit("seed="), seed.cast("string")))


def needs_structure(df: DataFrame, name: str = "name") -> DataFrame:
    """Distinct names that can have a structure (archive ids cannot)."""
    return df.filter(~F.startswith(F.col(name), F.lit("UPI"))).dropDuplicates([name])


def check_alignment(df: DataFrame, by: str, aligned: str, fail: bool = False) -> DataFrame:
    """One row per alignment: (by, n_rows, width, n_widths); a sound one has a single width.

    ``fail``: raise where an alignment's rows differ in width, as stacking them would.
    """
    found = _widths(df, by, aligned)
    if not fail:
        return found
    wrong = F.concat(F.lit("rows differ in width in alignment "), F.coalesce(F.col(by).cast("string"), F.lit("(null)")))
    return found.withColumn("width", F.when(F.col("n_widths") > 1, F.raise_error(wrong).cast("bigint")).otherwise(F.col("width")))


def _widths(df: DataFrame, by: str, aligned: str) -> DataFrame:
    return df.groupBy(by).agg(
        F.count("*").alias("n_rows"), F.max(F.length(aligned)).cast("bigint").alias("width"), F.countDistinct(F.length(aligned)).alias("n_widths")
    )
