"""Queries that write files of the driver tables' rows, in the session's shared folder, and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.functions import sequences as S
from seqloom.operators import clusters as C
from seqloom.operators import scoring
from seqloom.operators import structures as R
from seqloom.operators.spread import numbered
from seqloom.plans.cluster_queries import _RECORDS_SQL, _hierarchy
from seqloom.plans.lineage import checkpoint_folder
from seqloom.plans.views import POINTS_SQL, points, points_of, spread_out, table
from seqloom.sources import fasta, sinks, splits, structures, tables


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4()}"


def _write_fasta(spark: SparkSession, d: str, kept: str) -> str:
    """All documents as FASTA records of the letters that are kept."""
    docs = spread_out(table(spark, d, "documents").select("doc_id", "text"))
    folder = _folder(spark, "fasta")
    docs.select(F.concat(F.lit("# note\n>"), F.col("doc_id").cast("string"), F.lit("\n"), F.regexp_replace("text", f"[^{kept}]+", ""))).write.text(folder)
    return folder


def fasta_source(spark: SparkSession, d: str) -> DataFrame:
    splits.register(spark)
    return spark.read.format("fasta").option("splitBytes", 1 << 20).load(_write_fasta(spark, d, "A-Za-z\n# ")).select("name", "sequence")


FASTA_SOURCE_SQL = r"""
WITH l AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '[^A-Za-z\n# ]', '', 'g'), chr(10)), lambda x: NOT starts_with(x, '#')) AS lines FROM documents)
SELECT doc_id::VARCHAR AS name, upper(array_to_string(list_transform(lines, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), '')) AS sequence FROM l"""


def fasta_names(spark: SparkSession, d: str) -> DataFrame:
    """Names by prefix: the filter goes to the reader, and no sequence is put together."""
    splits.register(spark)
    read = spark.read.format("fasta").schema("name string, file string").option("splitBytes", 1 << 20).load(_write_fasta(spark, d, "A-Za-z\n# "))
    return read.filter(F.col("name").startswith("1")).select("name")


FASTA_NAMES_SQL = "SELECT doc_id::VARCHAR AS name FROM documents WHERE starts_with(doc_id::VARCHAR, '1')"


def fasta_text(spark: SparkSession, d: str) -> DataFrame:
    return fasta.read_fasta(spark, _write_fasta(spark, d, "A-Za-z\n# ")).select("name", "sequence")


def a3m_text(spark: SparkSession, d: str) -> DataFrame:
    return fasta.read_a3m(spark, _write_fasta(spark, d, "A-Za-z-")).select("name", "raw_seq", "aligned_seq")


A3M_TEXT_SQL = """WITH m AS (SELECT doc_id, regexp_replace(text, '[^A-Za-z-]', '', 'g') AS raw FROM documents)
SELECT doc_id::VARCHAR AS name, raw AS raw_seq, regexp_replace(raw, '[a-z]', '', 'g') AS aligned_seq FROM m"""


def variants_file(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", F.concat(F.lit(">"), "p_name", F.lit("\n"), F.regexp_replace("p_type", "[^A-Z]", "")).alias("value"))
    folder = _folder(spark, "variants")
    parts.orderBy("p_partkey").select("value").coalesce(1).write.text(folder)
    return fasta.read_variants(spark, folder, "WTWT")


VARIANTS_SQL = """
SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS ord, p_name AS name, regexp_replace(p_type, '[^A-Z]', '', 'g') AS sequence, false AS is_wt FROM part
UNION ALL SELECT count(*), 'WT', 'WTWT', true FROM part"""


def table_columns(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark, "table")
    sinks.write_parquet(table(spark, d, "orders"), folder, partition_by=["o_orderstatus"])
    return tables.read_table(spark, folder, ["o_orderkey", "o_orderstatus"])


TABLE_COLUMNS_SQL = "SELECT o_orderkey, o_orderstatus FROM orders"


def accessions_file(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "customer").select(F.concat(F.lit("# "), "c_mktsegment", F.lit("\n  "), "c_name", F.lit(" \n")).alias("value"))
    folder = _folder(spark, "accessions")
    lines.write.text(folder)
    return tables.read_accessions(spark, folder)


ACCESSIONS_SQL = "SELECT trim(c_name) AS accession FROM customer"


def chains_file(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit("_"), F.substr("p_brand", F.lit(7), F.lit(2)), F.lit(" ")).alias("value"))
    folder = _folder(spark, "chains")
    lines.write.text(folder)
    return tables.read_chain_list(spark, folder)


CHAINS_SQL = "SELECT p_partkey::VARCHAR AS protein, substr(p_brand, 7, 2) AS chain FROM part"


#: Residues of a PDB file: its columns number no more, so larger structures are several files.
PDB_RESIDUES = 9996


def pdb_source(spark: SparkSession, d: str, residues: int = PDB_RESIDUES) -> DataFrame:
    """A structure of each label, in files of as many residues as they can number: their backbones, and a second model that isn't read.

    Embeddings are numbered and dealt before residues and lines are made of them, seven residues each.
    """
    each = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 63).alias("embedding"), (F.col("vec_id") % 10).alias("label"))
    placed = numbered(each, ["label"], [F.col("vec_id")]).withColumn("part", F.floor(F.col("ord") * 7 / residues))
    dealt = placed.repartition("label", "part").sortWithinPartitions("label", "part", "ord")
    rows = points_of(dealt, "label", "part", "ord").withColumn("number", (F.col("ord") * 7 + F.col("pos") + 1 - F.col("part") * residues).cast("int"))
    place = lambda p, c: F.floor(F.col(f"{p}.{c}") * 1000) / 1000.0
    line = lambda a: F.format_string("ATOM  %5d  %-3s GLY A%4d    %8.3f%8.3f%8.3f  1.00%6.2f", "number", F.lit(f"{a:<2}"), "number", *[place(a.lower(), c) for c in "xyz"], "plddt")
    last = (F.col("number") == residues) | ((F.col("pos") == 6) & F.lead("ord").over(Window.partitionBy("label", "part").orderBy("ord", "pos")).isNull())
    second = F.lit("MODEL        2\nATOM      1  N   GLY A   1       0.000   0.000   0.000  1.00  0.00")
    lines = rows.select("label", "part", F.concat_ws("\n", *[line(a) for a in R.BACKBONE], F.when(last, second)).alias("value"))
    folder = _folder(spark, "pdb")
    lines.write.partitionBy("label", "part").option("compression", "gzip").text(folder)
    splits.register(spark)
    atoms = spark.read.format("pdb").load(folder).filter("atom = 'CA'")
    number = F.col("res_num") + F.regexp_extract("file", "part=([0-9]+)", 1).cast("int") * residues
    return atoms.select(F.regexp_extract("file", "label=([0-9]+)", 1).alias("label"), number.alias("res_num"), "atom", "x", "y", "z", "b_iso", "model")


PDB_SQL = f"""WITH {POINTS_SQL}
SELECT (chain % 10)::VARCHAR AS label, row_number() OVER (PARTITION BY chain % 10 ORDER BY chain, pos)::INT AS res_num, 'CA' AS atom,
  floor(ax * 1000) / 1000 AS x, floor(ay * 1000) / 1000 AS y, floor(az * 1000) / 1000 AS z, plddt AS b_iso, 1 AS model FROM pts"""


def _write_cif(spark: SparkSession, d: str) -> str:
    """A structure file of each brand, whose chain is its name; sites know it by another name."""
    loop = lambda category, columns: "loop_\n" + "".join(f"_{category}.{c}\n" for c in columns)
    parts = table(spark, d, "part").withColumn("brand", F.replace("p_brand", F.lit("#"), F.lit("_")))
    seq = F.row_number().over(Window.partitionBy("brand").orderBy("p_partkey"))
    parts = parts.withColumn("seq", seq)
    monomer = F.element_at(F.array(*[F.lit(n) for n in ("ALA", "GLY", "MSE", "ZZZ")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    scheme = F.concat_ws(" ", "brand", monomer, F.col("seq").cast("string"), F.col("p_partkey").cast("string"), F.lit("."))
    site = F.concat_ws(" ", F.when(F.col("p_partkey") % 5 == 0, "HETATM").otherwise("ATOM"), F.lit("CA"), "brand", F.concat(F.lit("x"), "brand"), monomer, F.col("p_partkey").cast("string"), F.lit("?"), F.lit("1.5"), F.lit("'2.5'"), F.col("p_size").cast("string"), F.lit("9.25"), F.lit("1"))
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", c.alias("line")))), lambda s: s["line"]), "\n")
    text = F.concat(
        F.lit("data_x\n_entry.id 'x y'\n" + loop("pdbx_poly_seq_scheme", structures._SCHEME)), ordered(scheme),
        F.lit("\n#\n" + loop("atom_site", ("group_PDB", "label_atom_id", "label_asym_id", "auth_asym_id", "auth_comp_id", "auth_seq_id", "pdbx_PDB_ins_code", "Cartn_x", "Cartn_y", "Cartn_z", "B_iso_or_equiv", "pdbx_PDB_model_num"))), ordered(site), F.lit("\n"),
    )
    folder = _folder(spark, "cif")
    parts.groupBy("brand").agg(text.alias("value")).withColumnRenamed("brand", "of").repartition("of").write.partitionBy("of").text(folder)
    return folder


def mmcif_scheme(spark: SparkSession, d: str) -> DataFrame:
    scheme, _ = structures.read_mmcif_tables(spark, _write_cif(spark, d))
    return scheme.select("asym_id", "mon_id", "seq_id", "auth_seq_num", "ins_code")


_CIF_SQL = "c AS (SELECT replace(p_brand, '#', '_') AS brand, *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS seq, ['ALA', 'GLY', 'MSE', 'ZZZ'][p_partkey % 4 + 1] AS monomer FROM part)"
SCHEME_SQL = f"WITH {_CIF_SQL} SELECT brand AS asym_id, monomer AS mon_id, seq::VARCHAR AS seq_id, p_partkey::VARCHAR AS auth_seq_num, '.' AS ins_code FROM c"


def mmcif_sites(spark: SparkSession, d: str) -> DataFrame:
    _, sites = structures.read_mmcif_tables(spark, _write_cif(spark, d))
    return sites.select("label", "auth", "res_num", "ins_code", "res_name", "atom", "x", "y", "z", "b_iso", "hetero", "model", "ord")


SITES_SQL = f"""WITH {_CIF_SQL}
SELECT brand AS label, 'x' || brand AS auth, p_partkey::VARCHAR AS res_num, '?' AS ins_code, monomer AS res_name, 'CA' AS atom, 1.5::DOUBLE AS x, 2.5::DOUBLE AS y, p_size::DOUBLE AS z,
  9.25::DOUBLE AS b_iso, p_partkey % 5 = 0 AS hetero, 1 AS model, seq - 1 AS ord FROM c"""


def mmcif_chains(spark: SparkSession, d: str) -> DataFrame:
    """Chains asked for by the author's names: their own names and lengths."""
    scheme, sites = structures.read_mmcif_tables(spark, _write_cif(spark, d))
    keyed = sites.withColumn("of", F.struct("structure_id", "auth"))
    labels = C.modal_label(keyed, "of", "label", "ord").select("of.structure_id", "of.auth", "label")
    wanted = sites.select("structure_id", F.col("auth").alias("chain")).distinct()
    found = R.resolve_chain(scheme, labels, wanted)
    lengths = R.seqres_length(scheme).withColumnRenamed("asym_id", "label")
    return found.join(lengths, ["structure_id", "label"]).select("chain", "label", "length")


CHAIN_LENGTH_SQL = f"WITH {_CIF_SQL} SELECT 'x' || brand AS chain, brand AS label, max(seq)::INT AS length FROM c GROUP BY brand"


def cluster_pages_file(spark: SparkSession, d: str) -> DataFrame:
    """Customers of nations as landed pages, and each cluster's members read back."""
    customer = table(spark, d, "customer").withColumn("page", (F.col("c_custkey") % 3).cast("int"))
    ids = lambda key: F.struct(F.lit("u50").alias("uniref50Id"), F.concat(F.lit(" n"), F.col(key).cast("string")).alias("uniref90Id"), F.lit("").alias("uniref100Id"))
    pages = customer.groupBy("c_nationkey", "page").agg(F.collect_list(ids("c_custkey")).alias("members"))
    pages = pages.select(F.col("c_nationkey").cast("string").alias("cluster"), "page", F.when(F.col("page") == 0, ids("c_nationkey")).alias("representativeMember"), "members")
    folder = _folder(spark, "pages")
    pages.write.json(folder)
    return C.cluster_members(tables.read_cluster_pages(spark, folder), "u90")


PAGES_SQL = """SELECT DISTINCT c_nationkey::VARCHAR AS cluster, 'n' || c_custkey AS member FROM customer
UNION SELECT c_nationkey::VARCHAR, 'n' || c_nationkey FROM customer WHERE c_custkey % 3 = 0"""


def _linked(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as pages that link to the next turn: some turns are gone, and some last turns lead back."""
    turns = table(spark, d, "conversations").select("conv_id", "turn").distinct()
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"), F.min("turn").alias("least"))
    url = lambda turn: F.concat_ws("/", F.col("conv_id").cast("string"), turn.cast("string"))
    back = F.when(F.col("conv_id") % 7 == 3, url(F.col("least")))
    rows = turns.join(last, "conv_id").withColumn("next", F.when(F.col("turn") < F.col("last"), url(F.col("turn") + 1)).otherwise(back))
    return rows.filter((F.col("conv_id") * 5 + F.col("turn")) % 11 != 6).select(url(F.col("turn")).alias("url"), "next")


def page_chains(spark: SparkSession, d: str) -> DataFrame:
    return C.chain_pages(_linked(spark, d))


CHAIN_SQL = """
WITH RECURSIVE t AS (SELECT DISTINCT conv_id, turn FROM conversations), l AS (SELECT conv_id, max(turn) AS last, min(turn) AS least FROM t GROUP BY 1),
p AS (SELECT conv_id || '/' || turn AS url, CASE WHEN turn < last THEN conv_id || '/' || (turn + 1) WHEN conv_id % 7 = 3 THEN conv_id || '/' || least END AS next
      FROM t JOIN l USING (conv_id) WHERE (conv_id * 5 + turn) % 11 <> 6),
w AS (SELECT url, next, url AS first, 0::BIGINT AS place FROM p WHERE url NOT IN (SELECT next FROM p WHERE next IS NOT NULL)
      UNION ALL SELECT p.url, p.next, first, place + 1 FROM w JOIN p ON p.url = w.next),
s AS (SELECT first, CASE WHEN bool_or(next IS NULL) THEN 'whole' ELSE 'gap' END AS status FROM w GROUP BY 1)
SELECT url, first, place, status FROM w JOIN s USING (first)
UNION ALL SELECT url, NULL, NULL, 'cycle' FROM p WHERE url NOT IN (SELECT url FROM w)"""


def input_listing(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark, "inputs")
    table(spark, d, "customer").select("c_name").repartition(5).write.text(folder)
    return tables.list_inputs(spark, folder, ".txt").agg(F.countDistinct("id").alias("n_files"), F.sum("size").cast("bigint").alias("bytes"))


LISTING_SQL = "SELECT 5::BIGINT AS n_files, sum(strlen(c_name) + 1)::BIGINT AS bytes FROM customer"


def sampled_file(spark: SparkSession, d: str) -> DataFrame:
    records = C.sampling_records(_hierarchy(spark, d)).withColumn("draw", F.col("member"))
    folder = _folder(spark, "sampled")
    sinks.write_sampled(records, folder)
    return spark.read.text(folder).select(F.col("seed").cast("int").alias("seed"), "value")


SAMPLED_SQL = f"WITH {_RECORDS_SQL} SELECT seed, member || ' uniref90=' || cluster || ' probability=' || printf('%.10f', probability) || ' uniref90_size=' || cluster_size AS value FROM rec"


def appended_file(spark: SparkSession, d: str) -> DataFrame:
    """Records and a log, appended nation by region: the log lines and what is read back."""
    customer = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.upper("c_mktsegment").alias("sequence"), F.col("c_nationkey").alias("n"))
    folder, log = _folder(spark, "appended"), _folder(spark, "log")
    for half in (0, 1):
        sinks.append_fasta(customer.filter(F.col("n") % 2 == half), folder, log)
    lines = spark.read.text(log).select(F.substring_index("value", " ", 1).alias("name"), F.substring_index("value", " ", -1).cast("int").alias("n"))
    return fasta.read_fasta(spark, folder).select("name", "sequence").join(lines, "name")


APPENDED_SQL = "SELECT c_name AS name, upper(c_mktsegment) AS sequence, c_nationkey AS n FROM customer"


def training_file(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    trio = lambda k: F.array(*[F.get("embedding", F.lit(9 * k + 3 * a)).cast("double") for a in range(3)])
    records = rows.select(F.col("vec_id").alias("id"), F.lit("AC").alias("sequence"), F.array(F.array(trio(0)), F.array(trio(1))).alias("coords"), F.array(F.lit(0.5), F.lit(None)).alias("scores"))
    folder = _folder(spark, "records")
    sinks.write_training_records(records, folder)
    back = spark.read.parquet(folder)
    at = lambda k, a: F.col("coords")[k][0][a].cast("double").alias(f"v{k}{a}")
    return back.select("id", "sequence", *[at(k, a) for k in range(2) for a in range(3)], F.col("scores")[0].cast("double").alias("score"), F.col("scores")[1].isNull().alias("none"))


TRAINING_SQL = "SELECT vec_id AS id, 'AC' AS sequence, " + ", ".join(f"embedding[{9 * k + 3 * a + 1}]::DOUBLE AS v{k}{a}" for k in range(2) for a in range(3)) + ", 0.5::DOUBLE AS score, true AS none FROM embeddings"


def scores_file(spark: SparkSession, d: str) -> DataFrame:
    scores = table(spark, d, "part").select(F.col("p_partkey").alias("ord"), (F.col("p_retailprice") / 7).alias("score"))
    folder = _folder(spark, "scores")
    sinks.write_scores(scores, folder)
    return spark.read.parquet(folder).select("ord", F.col("score").cast("double").alias("score"))


SCORES_SQL = "SELECT p_partkey AS ord, (p_retailprice / 7)::FLOAT::DOUBLE AS score FROM part"


def wild_type_last(spark: SparkSession, d: str) -> DataFrame:
    variants = table(spark, d, "supplier").select((F.col("s_suppkey") - 1).alias("ord"), F.col("s_name").alias("name"))
    wild = table(spark, d, "region").filter("r_regionkey = 0").select(F.col("r_name").alias("name"))
    return scoring.append_wt(variants, wild)


WILD_SQL = """SELECT s_suppkey - 1 AS ord, s_name AS name, false AS is_wt FROM supplier
UNION ALL SELECT (SELECT max(s_suppkey) FROM supplier), r_name, true FROM region WHERE r_regionkey = 0"""


def backbone_atoms(spark: SparkSession, d: str) -> DataFrame:
    """Residues of four atoms, of which the first three stay."""
    four = lambda r: F.array(*[F.array(*[F.get("embedding", F.lit(12 * r + 3 * a + x)).cast("double") for x in range(3)]) for a in range(4)])
    rows = table(spark, d, "embeddings").select("vec_id", S.backbone_only(F.array(four(0), four(1), four(2))).alias("coords"))
    each = rows.select("vec_id", F.posexplode("coords").alias("residue", "atoms"))
    return each.select("vec_id", "residue", F.posexplode("atoms").alias("atom", "p")).select("vec_id", "residue", "atom", F.col("p")[0].alias("x"), F.col("p")[2].alias("z"))


BACKBONE_SQL = """SELECT vec_id, r::INT AS residue, a::INT AS atom, embedding[12 * r + 3 * a + 1]::DOUBLE AS x, embedding[12 * r + 3 * a + 3]::DOUBLE AS z
FROM embeddings, generate_series(0, 2) AS g(r), generate_series(0, 2) AS h(a)"""


def near_pairs(spark: SparkSession, d: str) -> DataFrame:
    return R.near_residue_pairs(points(spark, d), most=20.0)


_FAR_SQL = """pair AS (SELECT p.chain, p.pos AS i, q.pos AS j, sqrt((p.ax - q.ax) * (p.ax - q.ax) + (p.ay - q.ay) * (p.ay - q.ay) + (p.az - q.az) * (p.az - q.az)) AS dist
  FROM pts p JOIN pts q ON p.chain = q.chain AND p.pos <> q.pos)"""
NEAR_SQL = f"""WITH {POINTS_SQL}, {_FAR_SQL}
SELECT chain, i::INT AS i, j::INT AS j, least(trunc(greatest((dist - 2.5::DOUBLE) / (48.0::DOUBLE - 2.5::DOUBLE) * 127, 0)), 127)::INT AS distance_bucket FROM pair WHERE dist < 20"""


def far_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = points(spark, d)
    return R.far_pairs(rows, R.near_residue_pairs(rows, most=20.0))


FAR_SQL = f"""WITH {POINTS_SQL}, {_FAR_SQL}
SELECT chain, count(*) AS n_pairs, count(*) FILTER (dist < 20) AS n_near, count(*) FILTER (dist >= 20) AS n_far FROM pair GROUP BY 1"""


_NAMES = {
    "fasta_source": (fasta_source, FASTA_SOURCE_SQL), "fasta_names": (fasta_names, FASTA_NAMES_SQL), "fasta_text": (fasta_text, FASTA_SOURCE_SQL), "a3m_text": (a3m_text, A3M_TEXT_SQL),
    "variants_file": (variants_file, VARIANTS_SQL), "table_columns": (table_columns, TABLE_COLUMNS_SQL), "accessions_file": (accessions_file, ACCESSIONS_SQL), "chains_file": (chains_file, CHAINS_SQL),
    "pdb_source": (pdb_source, PDB_SQL), "mmcif_scheme": (mmcif_scheme, SCHEME_SQL), "mmcif_sites": (mmcif_sites, SITES_SQL), "mmcif_chains": (mmcif_chains, CHAIN_LENGTH_SQL),
    "cluster_pages_file": (cluster_pages_file, PAGES_SQL), "page_chains": (page_chains, CHAIN_SQL), "input_listing": (input_listing, LISTING_SQL), "sampled_file": (sampled_file, SAMPLED_SQL),
    "appended_file": (appended_file, APPENDED_SQL), "training_file": (training_file, TRAINING_SQL), "scores_file": (scores_file, SCORES_SQL), "wild_type_last": (wild_type_last, WILD_SQL),
    "backbone_atoms": (backbone_atoms, BACKBONE_SQL), "near_pairs": (near_pairs, NEAR_SQL), "far_pairs": (far_pairs, FAR_SQL),
}
QUERIES = {name: query for name, (query, _) in _NAMES.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _NAMES.items()}
