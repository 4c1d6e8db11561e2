"""Queries of the sequence and identifier operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import alphabets as A
from seqloom.functions import sequences as S
from seqloom.plans.shipping import ship_package
from seqloom.plans.views import ALN_SQL, aln, table
from seqloom.sources.fasta import parse_fasta
from seqloom.sources.tables import fetch_manifest


def fasta_parse(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("# made from a table\nno record\n>"), F.col("doc_id").cast("string"), F.lit("\n"), F.regexp_replace("text", "[^A-Za-z\n# ]", ""))
    rows = table(spark, d, "documents").select("doc_id", text.alias("fasta"))
    return parse_fasta(rows, "fasta", ["doc_id"]).select("doc_id", "rec_no", "name", "sequence")


FASTA_SQL = r"""
WITH l AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '[^A-Za-z\n# ]', '', 'g'), chr(10)), lambda x: NOT starts_with(x, '#')) AS lines FROM documents)
SELECT doc_id, 0::BIGINT AS rec_no, doc_id::VARCHAR AS name,
       upper(array_to_string(list_transform(lines, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), '')) AS sequence FROM l
"""


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source", F.regexp_replace("text", "[^A-Za-z-]", "").alias("raw"))


_MIXED_SQL = "m AS (SELECT doc_id, source, regexp_replace(text, '[^A-Za-z-]', '', 'g') AS raw FROM documents)"


def a3m_columns(spark: SparkSession, d: str) -> DataFrame:
    raw = F.col("raw")
    return _mixed(spark, d).select("doc_id", S.match_columns(raw).alias("aligned"), S.unalign(raw).alias("plain"), S.mask_query(raw).alias("masked"), S.frame_text(raw).alias("framed"))


A3M_SQL = f"""WITH {_MIXED_SQL}
SELECT doc_id, regexp_replace(raw, '[a-z]', '', 'g') AS aligned, replace(upper(raw), '-', '') AS plain, repeat('X', length(raw)) AS masked, '$' || raw || '*' AS framed FROM m"""


def alignment_check(spark: SparkSession, d: str) -> DataFrame:
    return S.check_alignment(_mixed(spark, d), "source", "raw")


CHECK_SQL = f"""WITH {_MIXED_SQL}
SELECT source, count(*) AS n_rows, max(length(raw))::BIGINT AS width, count(DISTINCT length(raw)) AS n_widths FROM m GROUP BY source"""


def _joined(tokens) -> F.Column:
    return F.array_join(tokens.cast("array<string>"), " ")


def encode_tokens(spark: SparkSession, d: str) -> DataFrame:
    tokens = {"main": A.MAIN, "structural": A.STRUCTURAL, "reduced": A.REDUCED, "dna": A.DNA, "secondary": A.SECONDARY, "twenty_one": A.twenty_one(gap=True)}
    ship_package(spark)
    coded = aln(spark, d).select("msa", "row_id", A.encode_each(F.col("aligned"), tokens, " ").alias("t"), A.recode(F.col("aligned")).alias("decoded"))
    framed = F.concat_ws(" ", F.lit(str(A.MAIN.start)), "t.main", F.lit(str(A.MAIN.stop)))
    return coded.select("msa", "row_id", "t.*", framed.alias("framed"), "decoded")



def _encode_sql(chars: str, missing: int, ids: tuple[int, ...] | None = None) -> str:
    at = f"instr('{chars}', c)"
    value = f"{at} - 1" if ids is None else f"{list(ids)}[{at}]"
    return f"array_to_string(list_transform(string_split(aligned, ''), lambda c: CASE WHEN {at} = 0 THEN {missing} ELSE {value} END), ' ')"


ENCODE_SQL = f"""WITH {ALN_SQL}
SELECT msa, row_id, {_encode_sql(A.MAIN.letters, 24)} AS main, {_encode_sql('ACDEFGHIKLMNPQRSTVWY    X-$*|', 24)} AS structural,
  {_encode_sql(A.REDUCED.chars, 255, A.REDUCED.ids)} AS reduced, {_encode_sql('ACGT', 255)} AS dna, {_encode_sql('HBEGITS ', 255)} AS secondary,
  {_encode_sql('ARNDCQEGHILKMFPSTWYV-XOUBZ', 21, (*range(20), 20, 21, 11, 4, 21, 21))} AS twenty_one,
  '26 ' || {_encode_sql(A.MAIN.letters, 24)} || ' 27' AS framed, regexp_replace(aligned, '[J]', 'X', 'g') AS decoded FROM aln"""


def kmer_unpack(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", _joined(A.kmer_unpack(key, 6, 4)).alias("digits"), A.kmer_string(key, 6).alias("kmer"))


KMER_SQL = """
WITH k AS (SELECT p_partkey, list_transform([1024, 256, 64, 16, 4, 1], lambda p: ((p_partkey // p) % 4)::INT) AS g FROM part)
SELECT p_partkey, array_to_string(g, ' ') AS digits, array_to_string(list_transform(g, lambda x: substr('ACGT', x + 1, 1)), '') AS kmer FROM k"""


def identifiers(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    kinds = F.element_at(F.array(*[F.lit(x) for x in (S.AF2, S.V3D, S.VAF, "SARRAHXYZ")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    value = F.concat(kinds, F.lit("-"), F.replace("p_type", F.lit(" "), F.lit(".")), F.lit("-x.y"))
    row = F.concat(F.lit(" UniRef90_"), F.lower("p_brand"), F.lit("_"), F.col("p_partkey").cast("string"), F.lit("\tn=1"))
    rows = parts.select("p_partkey", value.alias("v"), row.alias("r"))
    return rows.select(
        "p_partkey",
        S.accession_of(F.col("r")).alias("accession"),
        S.normalize_cluster_id(F.substring_index("r", "\t", 1), "uniref90").alias("strict_id"),
        S.normalize_cluster_id(F.substring_index("r", "\t", 1), "UniRef50", strict=False).alias("lenient_id"),
        S.split_assigned(F.col("v"))["prefix"].alias("prefix"),
        S.split_assigned(F.col("v"))["suffix"].alias("suffix"),
        S.structural_source(F.col("v")).alias("structural_source"),
        S.is_structural(F.col("v")).alias("is_structural"),
    )


IDENTIFIERS_SQL = r"""
WITH r AS (SELECT p_partkey, ['SARRAHAF2', 'SARRAHV3D', 'SARRAHVAF', 'SARRAHXYZ'][p_partkey % 4 + 1] || '-' || replace(p_type, ' ', '.') || '-x.y' AS v,
                  'UniRef90_' || lower(p_brand) || '_' || p_partkey AS a FROM part)
SELECT p_partkey, p_partkey::VARCHAR AS accession, 'uniref90_' || upper(substr(a, 10)) AS strict_id, 'UniRef50_' || substr(a, 10) AS lenient_id,
  CASE WHEN p_partkey % 4 = 3 THEN '' ELSE substr(v, 1, 9) END AS prefix,
  CASE p_partkey % 4 WHEN 0 THEN split_part(v, '-', 2) WHEN 1 THEN split_part(split_part(v, '-', 2), '.', 1)
       WHEN 2 THEN split_part(substr(v, 10), '.', 1) ELSE substr(v, 10) END AS suffix,
  CASE WHEN substr(v, 7, 3) = 'V3D' THEN substr(v, 13) END AS structural_source, contains(v, 'SARRAH') AS is_structural FROM r"""


def stable_seed(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "events").select("user_id").distinct()
    return users.select("user_id", S.stable_seed(F.col("user_id").cast("string")).alias("seed"))


STABLE_SEED_SQL = f"""
WITH u AS (SELECT DISTINCT user_id, sha256(user_id::VARCHAR) AS h FROM events)
SELECT user_id, (({' + '.join(f"('0x' || substr(h, {1 + 8 * k}, 8))::BIGINT" for k in range(8))}) % 4294967295)::BIGINT AS seed FROM u"""


def structure_manifest(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "part").select(F.concat(F.lower("p_brand"), F.lit(","), F.col("p_partkey").cast("string")).alias("value"))
    return fetch_manifest(ids, ["cif", "assembly1", "restraints_star"], "store")


MANIFEST_SQL = """
WITH i AS (SELECT lower(p_brand) AS id FROM part UNION ALL SELECT p_partkey::VARCHAR FROM part)
SELECT id, f.format, 'store/' || id || f.suffix AS url FROM i, (VALUES ('cif', '.cif.gz'), ('assembly1', '-assembly1.cif.gz'), ('restraints_star', '_mr.str.gz')) AS f(format, suffix)"""


def structure_names(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "events").select(F.concat(F.when(F.col("event_id") % 3 == 0, "UPI").otherwise("P"), F.col("user_id").cast("string")).alias("name"))
    return S.needs_structure(names)


NAMES_SQL = "SELECT DISTINCT 'P' || user_id AS name FROM events WHERE event_id % 3 <> 0"


QUERIES = {
    "fasta_parse": fasta_parse, "a3m_columns": a3m_columns, "alignment_check": alignment_check, "encode_tokens": encode_tokens, "kmer_unpack": kmer_unpack,
    "identifiers": identifiers, "stable_seed": stable_seed, "structure_manifest": structure_manifest, "structure_names": structure_names,
}
ORACLE_SQL = {
    "fasta_parse": FASTA_SQL, "a3m_columns": A3M_SQL, "alignment_check": CHECK_SQL, "encode_tokens": ENCODE_SQL, "kmer_unpack": KMER_SQL,
    "identifiers": IDENTIFIERS_SQL, "stable_seed": STABLE_SEED_SQL, "structure_manifest": MANIFEST_SQL, "structure_names": NAMES_SQL,
}
