"""Queries of the sampling operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.sequences import grid_name
from seqloom.operators import clusters as C
from seqloom.operators import sampling as P
from seqloom.plans.cluster_queries import _PAIR_SQL, _RECORDS_SQL, _hierarchy
from seqloom.plans.views import ALN_SQL, WIDTH, aln, table


def _u(seed: str, key: str) -> str:
    return f"((('0x' || substr(md5({seed} || ':' || {key}), 1, 12))::BIGINT)::DOUBLE + 0.5::DOUBLE) / 281474976710656.0::DOUBLE"


_SIM_SQL = f"""{ALN_SQL}, f AS (SELECT msa, arg_min(aligned, row_id) AS first, min(row_id) AS head FROM aln GROUP BY 1),
sim AS (SELECT aln.*, head, ({WIDTH} - hamming(aligned, first))::DOUBLE / {WIDTH} AS similarity FROM aln JOIN f USING (msa))"""


def similarity_filter(spark: SparkSession, d: str) -> DataFrame:
    near = P.similarity_filter(P.similarity_to_first(aln(spark, d), "msa", "row_id", "aligned"), 0.95, 0.98)
    return near.select("msa", "row_id", "similarity")


SIMILARITY_SQL = f"WITH {_SIM_SQL} SELECT msa, row_id, similarity FROM sim WHERE similarity <= 0.95::DOUBLE AND 1 - similarity <= 0.98::DOUBLE"


def order_top(spark: SparkSession, d: str) -> DataFrame:
    return P.order_top(table(spark, d, "documents").select("source", "doc_id"), ["source"], "doc_id")


ORDER_TOP_SQL = "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS ord FROM documents"


def order_random(spark: SparkSession, d: str) -> DataFrame:
    return P.order_random(table(spark, d, "documents").select("source", "doc_id"), ["source"], "doc_id", 11)


ORDER_RANDOM_SQL = f"SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {_u(chr(39) + '11' + chr(39), 'doc_id')}, doc_id) - 1 AS ord FROM documents"


def order_weighted(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return P.order_weighted(docs, ["source"], "doc_id", F.lit(1.0) / F.col("n_chars"), 5)


ORDER_WEIGHTED_SQL = f"""SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY -ln({_u(chr(39) + '5' + chr(39), 'doc_id')}) / (1.0::DOUBLE / n_chars), doc_id) - 1 AS ord FROM documents"""


def sample_msa(spark: SparkSession, d: str) -> DataFrame:
    return P.sample_msa(aln(spark, d), "weighted", seed=3, max_similarity=0.9, force_include_first=True).select("msa", "row_id", "ord")


_WEIGHT_SQL = f"""{_PAIR_SQL}, wt AS (SELECT msa, row_id, 1.0::DOUBLE / neighbors / sum(1.0::DOUBLE / neighbors) OVER (PARTITION BY msa) AS weight FROM nb)"""
SAMPLE_MSA_SQL = f"""WITH {_WEIGHT_SQL}, {_SIM_SQL[len(ALN_SQL) + 2:]}
SELECT sim.msa, sim.row_id, row_number() OVER (PARTITION BY sim.msa ORDER BY (sim.row_id <> head)::INT, -ln({_u(chr(39) + '3' + chr(39), 'sim.row_id')}) / weight, sim.row_id) - 1 AS ord
FROM sim JOIN wt USING (msa, row_id) WHERE similarity <= 0.9::DOUBLE OR sim.row_id = head"""

#: Grid of the registered context query.
GRID = ([384, 6144], [1.0, 0.5], [True], [False, True])


def sample_context(spark: SparkSession, d: str) -> DataFrame:
    return P.sample_context(aln(spark, d), P.prompt_grid(spark, *GRID), seed=188257)


_GRID_SQL = "grid AS (SELECT row_number() OVER (ORDER BY t, s DESC, q) - 1 AS grid_ord, t, s, q FROM (VALUES (384), (6144)) AS a(t), (VALUES (1.0::DOUBLE), (0.5::DOUBLE)) AS b(s), (VALUES (false), (true)) AS c(q))"
_SEED_HEX = "sha256('188258')"
_WORDS = " + ".join(f"('0x' || substr({_SEED_HEX}, {1 + 8 * k}, 8))::BIGINT" for k in range(8))
_SHUFFLE_SEED = f"((({_WORDS}) % 4294967295)::BIGINT)::VARCHAR"
_CONTEXT_SQL = f"""{_WEIGHT_SQL}, {_SIM_SQL[len(ALN_SQL) + 2:]}, {_GRID_SQL},
k AS (SELECT sim.msa, grid_ord, sim.row_id, replace(aligned, '-', '') AS sequence, t, -ln({_u(chr(39) + '188257' + chr(39), 'sim.row_id')}) / weight AS key
  FROM sim JOIN wt USING (msa, row_id), grid WHERE similarity <= s AND NOT (q AND sim.row_id = head)),
b AS (SELECT *, sum(length(sequence) + 2) OVER (PARTITION BY msa, grid_ord ORDER BY key, row_id ROWS UNBOUNDED PRECEDING) AS upto FROM k),
ctx AS (SELECT msa, grid_ord, row_id, sequence, row_number() OVER (PARTITION BY msa, grid_ord ORDER BY {_u(_SHUFFLE_SEED, 'row_id')}, row_id) - 1 AS ord FROM b WHERE upto <= t)"""
CONTEXT_SQL = f"WITH {_CONTEXT_SQL} SELECT * FROM ctx"


def sample_context_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    found = sample_context(spark, d).withColumn("prompt", F.concat_ws("/", "msa", F.col("grid_ord").cast("string")))
    return C.ordered_fingerprint(found, "prompt", "ord", "sequence")


CONTEXT_FINGERPRINT_SQL = f"WITH {_CONTEXT_SQL} SELECT msa || '/' || grid_ord AS prompt, sha1(string_agg(sequence, '' ORDER BY ord)) AS fingerprint FROM ctx GROUP BY 1"


def token_budget(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return P.token_budget(docs, ["source"], [F.col("doc_id")], F.col("n_chars"), 6144)


TOKEN_BUDGET_SQL = "SELECT * FROM (SELECT source, doc_id, n_chars, sum(n_chars + 2) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS tokens_upto FROM documents) WHERE tokens_upto <= 6144"


def truncating_budget(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "doc_id", F.regexp_replace("text", "[^A-Za-z]", "").alias("t"))
    first = docs.groupBy("source").agg(F.min("doc_id").alias("head"), F.min_by("t", "doc_id").alias("base"))
    rows = docs.join(first, "source").filter(F.col("doc_id") != F.col("head"))
    out = P.truncating_budget(rows, "source", "doc_id", "t", "base")
    return out.select("source", F.length("assembled").cast("bigint").alias("n_chars"), F.md5("assembled").alias("digest"), "n_homologs")


TRUNCATING_SQL = """
WITH d AS (SELECT source, doc_id, regexp_replace(text, '[^A-Za-z]', '', 'g') AS t FROM documents),
f AS (SELECT source, min(doc_id) AS head, arg_min(t, doc_id) AS base FROM d GROUP BY 1),
r AS (SELECT d.*, base, 8192 - (length(base) + 2) - (sum(length(t) + 2) OVER (PARTITION BY source ORDER BY doc_id) - (length(t) + 2)) AS rest FROM d JOIN f USING (source) WHERE doc_id <> head),
o AS (SELECT *, (rest - (length(t) + 2) < 1)::INT AS over FROM r),
s AS (SELECT *, sum(over) OVER (PARTITION BY source ORDER BY doc_id) AS overs FROM o),
p AS (SELECT source, doc_id, base, CASE WHEN over = 0 THEN t WHEN rest - 3 > 0 THEN substr(t, 1, (rest - 3)::BIGINT) END AS part FROM s WHERE overs = 0 OR (overs = 1 AND over = 1)),
a AS (SELECT source, '$' || first(base) || '*' || coalesce(string_agg('$' || part || '*', '' ORDER BY doc_id) FILTER (part IS NOT NULL), '') AS t, count(part) AS n_homologs FROM p GROUP BY 1),
c AS (SELECT source, CASE WHEN length(t) >= 8192 THEN substr(t, 1, 8191) || '*' ELSE t END AS t, n_homologs FROM a)
SELECT source, length(t)::BIGINT AS n_chars, md5(t) AS digest, n_homologs FROM c"""


def seed_offset(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    grid = orders.select(
        "o_orderkey", (F.col("o_orderkey") % 3 * 6144 + 6144).alias("max_tokens"), F.element_at(F.array(F.lit(1.0), F.lit(0.95), F.lit(0.9)), (F.col("o_custkey") % 3 + 1).cast("int")).alias("max_similarity"),
        (F.col("o_orderstatus") == "O").alias("structure"), (F.col("o_orderkey") % 2 == 0).alias("inverse"), F.col("o_custkey"),
    )
    out = P.seed_offset(grid, ["o_custkey", "max_tokens", "max_similarity", "structure", "inverse"], "o_orderkey")
    return out.select("o_orderkey", "seed_offset", grid_name(F.col("max_tokens"), F.col("max_similarity"), F.col("structure"), F.col("inverse"), F.col("seed_offset") + 188257).alias("name"))


SEED_OFFSET_SQL = """
WITH g AS (SELECT o_orderkey, o_custkey, o_orderkey % 3 * 6144 + 6144 AS t, ['1.0', '0.95', '0.9'][o_custkey % 3 + 1] AS s, o_orderstatus = 'O' AS c, o_orderkey % 2 = 0 AS q FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, t, s, c, q ORDER BY o_orderkey) - 1 AS seed_offset FROM g)
SELECT o_orderkey, seed_offset, t || '_' || s || '_' || CASE WHEN c THEN 'True' ELSE 'False' END || '_' || CASE WHEN q THEN 'True' ELSE 'False' END || '_seed=' || (seed_offset + 188257) AS name FROM n"""


def weighted_draws(spark: SparkSession, d: str) -> DataFrame:
    return P.weighted_draws(C.sampling_records(_hierarchy(spark, d)), 100, 7)


WEIGHTED_DRAWS_SQL = f"""WITH {_RECORDS_SQL},
cdf AS (SELECT seed, member, coalesce(sum(probability) OVER (PARTITION BY seed ORDER BY member ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM rec),
tot AS (SELECT seed, sum(probability) AS total FROM rec GROUP BY 1),
dr AS (SELECT seed, draw, {_u(chr(39) + '7' + chr(39), "(seed || '/' || draw)")} * total AS u FROM tot, generate_series(0, 99) AS g(draw))
SELECT dr.seed, dr.draw, arg_max(member, lo) AS member FROM dr JOIN cdf ON cdf.seed = dr.seed AND lo <= u GROUP BY ALL"""


def sample_homologs(spark: SparkSession, d: str) -> DataFrame:
    """Homologs of each customer by way of its nation's region."""
    nation, customer, supplier = (table(spark, d, n) for n in ("nation", "customer", "supplier"))
    seeds = customer.select(F.col("c_custkey").alias("seed"))
    parents = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("seed"), F.col("n_regionkey").alias("parent"))
    clusters = nation.select(F.col("n_regionkey").alias("parent"), F.col("n_nationkey").alias("cluster"))
    members = supplier.select(F.col("s_nationkey").alias("cluster"), F.col("s_suppkey").alias("member"))
    return P.sample_homologs(seeds, parents, clusters, members, k=10)


HOMOLOGS_SQL = f"""
WITH h AS (SELECT n_regionkey AS parent, n_nationkey AS cluster, s_suppkey AS member FROM supplier JOIN nation ON s_nationkey = n_nationkey),
z AS (SELECT parent, cluster, count(*) AS cluster_size FROM h GROUP BY ALL), n AS (SELECT parent, count(*) AS n_clusters FROM z GROUP BY 1),
rec AS (SELECT h.parent, h.cluster, h.member, 1.0::DOUBLE / n_clusters / cluster_size AS probability FROM h JOIN z USING (parent, cluster) JOIN n ON n.parent = h.parent),
cdf AS (SELECT parent, member, coalesce(sum(probability) OVER (PARTITION BY parent ORDER BY cluster, member ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM rec),
tot AS (SELECT parent, sum(probability) AS total FROM rec GROUP BY 1),
dr AS (SELECT c_custkey AS seed, parent, draw, {_u(chr(39) + '0' + chr(39), "(c_custkey || '/' || draw)")} * total AS u
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN tot ON parent = n_regionkey, generate_series(0, 9) AS g(draw))
SELECT dr.seed, dr.draw, arg_max(member, lo) AS member FROM dr JOIN cdf ON cdf.parent = dr.parent AND lo <= u GROUP BY ALL"""


_NAMES = {
    "similarity_filter": (similarity_filter, SIMILARITY_SQL), "order_top": (order_top, ORDER_TOP_SQL), "order_random": (order_random, ORDER_RANDOM_SQL),
    "order_weighted": (order_weighted, ORDER_WEIGHTED_SQL), "sample_msa": (sample_msa, SAMPLE_MSA_SQL), "sample_context": (sample_context, CONTEXT_SQL),
    "sample_context_fingerprint": (sample_context_fingerprint, CONTEXT_FINGERPRINT_SQL), "token_budget": (token_budget, TOKEN_BUDGET_SQL),
    "truncating_budget": (truncating_budget, TRUNCATING_SQL), "seed_offset": (seed_offset, SEED_OFFSET_SQL), "weighted_draws": (weighted_draws, WEIGHTED_DRAWS_SQL),
    "sample_homologs": (sample_homologs, HOMOLOGS_SQL),
}
QUERIES = {name: query for name, (query, _) in _NAMES.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _NAMES.items() if sql}
