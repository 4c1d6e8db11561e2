"""Queries of the cluster and homology operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import sequences as S
from seqloom.operators import clusters as C
from seqloom.operators import homology as H
from seqloom.operators import scoring
from seqloom.plans.views import ALN_SQL, WIDTH, aln, table


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    return C.cluster_pairs(orders.select("o_custkey", "o_orderpriority"))


def _flag() -> F.Column:
    return F.contains(F.col("member"), F.lit("M")) | F.contains(F.col("member"), F.lit("H"))


_STATS_SQL = """s AS (SELECT o_custkey AS rep, count(*) AS n_total,
  count(*) FILTER (contains(o_orderpriority, 'M') OR contains(o_orderpriority, 'H')) AS n_struct
  FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) GROUP BY 1)"""


def cluster_stats(spark: SparkSession, d: str) -> DataFrame:
    return C.cluster_stats(_pairs(spark, d), _flag())


CLUSTER_STATS_SQL = f"""WITH {_STATS_SQL}
SELECT *, n_total - n_struct AS n_seq, CASE WHEN n_struct > 1 AND n_total - n_struct > 1 THEN 'finished'
  WHEN n_total - n_struct > 1 THEN 'not finished' ELSE 'invalid' END AS cluster_type FROM s"""


def left_counts(spark: SparkSession, d: str) -> DataFrame:
    return C.cluster_stats_by_join(_pairs(spark, d), _flag())


LEFT_COUNTS_SQL = f"WITH {_STATS_SQL} SELECT * FROM s"


def size_histogram(spark: SparkSession, d: str) -> DataFrame:
    return C.size_histogram(_pairs(spark, d))


HISTOGRAM_SQL = """
WITH s AS (SELECT o_custkey, count(*) AS size FROM orders GROUP BY 1), r AS (SELECT min(size) AS least, max(size) AS most FROM s)
SELECT bin, least + bin * (most - least) / 50.0::DOUBLE AS low, count(*) AS n_clusters FROM
 (SELECT least, most, least(floor((size - least) * 50 / greatest(most - least, 1)::DOUBLE), 49)::BIGINT AS bin FROM s, r) GROUP BY ALL"""


def _hierarchy(spark: SparkSession, d: str) -> DataFrame:
    nation, customer = table(spark, d, "nation"), table(spark, d, "customer")
    rows = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    return rows.select(F.col("n_regionkey").alias("seed"), F.col("n_nationkey").alias("cluster"), F.col("c_custkey").alias("member"))


_RECORDS_SQL = """h AS (SELECT n_regionkey AS seed, n_nationkey AS cluster, c_custkey AS member FROM customer JOIN nation ON c_nationkey = n_nationkey),
z AS (SELECT seed, cluster, count(*) AS cluster_size FROM h GROUP BY ALL), n AS (SELECT seed, count(*) AS n_clusters FROM z GROUP BY 1),
rec AS (SELECT h.seed, h.cluster, h.member, cluster_size, 1.0::DOUBLE / n_clusters / cluster_size AS probability FROM h JOIN z USING (seed, cluster) JOIN n ON n.seed = h.seed)"""


def hierarchy_probability(spark: SparkSession, d: str) -> DataFrame:
    return C.sampling_records(_hierarchy(spark, d))


RECORDS_SQL = f"WITH {_RECORDS_SQL} SELECT * FROM rec"


def cluster_report(spark: SparkSession, d: str) -> DataFrame:
    report = C.cluster_report(C.sampling_records(_hierarchy(spark, d)))
    return report.withColumn("weight", F.round("weight", 9))


REPORT_SQL = f"""WITH {_RECORDS_SQL}, e AS (SELECT seed, cluster, count(*) AS size, round(sum(probability), 9) AS weight FROM rec GROUP BY ALL)
SELECT e.*, count(*) OVER (PARTITION BY seed) AS n_clusters, sum(size) OVER (PARTITION BY seed)::BIGINT AS n_members FROM e"""


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Rows of cluster pages: each nation's suppliers lead, customers follow; some ids are blank."""
    member = lambda key, name: F.struct(
        F.when(F.col(key) % 4 == 0, "").otherwise(F.concat(F.lit("UniRef50_"), (F.col(key) % 10).cast("string"))).alias("uniref50Id"),
        F.concat(F.lit("UniRef90_"), (F.col(key) % 50).cast("string")).alias("uniref90Id"),
        F.when(F.col(key) % 7 == 0, " ").otherwise(F.col(name)).alias("uniref100Id"),
    )
    supplier = table(spark, d, "supplier").select(F.col("s_nationkey").alias("cluster"), F.lit(0).alias("page"), F.col("s_suppkey").alias("at"), member("s_suppkey", "s_name").alias("m"))
    customer = table(spark, d, "customer").select(F.col("c_nationkey").alias("cluster"), F.lit(1).alias("page"), F.col("c_custkey").alias("at"), member("c_custkey", "c_name").alias("m"))
    rows = supplier.unionByName(customer)
    return rows.select("cluster", F.struct("page", "at").alias("ord"), F.col("m.uniref50Id").alias("u50"), F.col("m.uniref90Id").alias("u90"), F.col("m.uniref100Id").alias("u100"))


_PAGES_SQL = """pg AS (SELECT s_nationkey AS cluster, 0 AS page, s_suppkey AS k, s_name AS name FROM supplier
  UNION ALL SELECT c_nationkey, 1, c_custkey, c_name FROM customer)"""


def cluster_members(spark: SparkSession, d: str) -> DataFrame:
    return C.cluster_members(_pages(spark, d), "u100")


MEMBERS_SQL = f"WITH {_PAGES_SQL} SELECT DISTINCT cluster, name AS member FROM pg WHERE k % 7 <> 0"


def parent_of(spark: SparkSession, d: str) -> DataFrame:
    return C.parent_of(_pages(spark, d))


PARENT_SQL = f"""WITH {_PAGES_SQL}
SELECT cluster, 'UniRef50_' || (arg_min(k, page * 1000000000000 + k) % 10) AS parent FROM pg WHERE k % 4 <> 0 GROUP BY 1"""


def unprocessed(spark: SparkSession, d: str) -> DataFrame:
    return C.only_unprocessed(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").select("doc_id"), "doc_id")


UNPROCESSED_SQL = "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"


def lookup_sequences(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "events").select(F.col("event_id").alias("ord"), (F.col("user_id") * 3).alias("doc_id"))
    store = table(spark, d, "documents").select("doc_id", F.col("text").alias("sequence"))
    return C.lookup_sequences(ids, store, "doc_id").select("ord", "doc_id", "sequence")


LOOKUP_SQL = "SELECT event_id AS ord, doc_id, text AS sequence FROM events JOIN documents ON doc_id = user_id * 3"


def last_wins_join(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return C.last_wins(events, "user_id", F.col("event_id"))


LAST_SQL = "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"


def modal_label(spark: SparkSession, d: str) -> DataFrame:
    return C.modal_label(table(spark, d, "events"), "user_id", "event_type", "event_id")


MODAL_SQL = """
WITH e AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL)
SELECT user_id, event_type, n FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1"""


def distinct_chains(spark: SparkSession, d: str) -> DataFrame:
    return C.distinct_ids(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


DISTINCT_SQL = """
SELECT DISTINCT kind, value FROM (SELECT 'l_returnflag' AS kind, l_returnflag AS value FROM lineitem UNION ALL SELECT 'l_linestatus', l_linestatus FROM lineitem
UNION ALL SELECT 'l_linenumber', l_linenumber::VARCHAR FROM lineitem)"""


def finite_profile(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").withColumn("rate", F.when(F.col("l_linenumber") == 7, float("nan")).when(F.col("l_linenumber") == 6, float("inf")).otherwise(F.col("l_tax")))
    return C.finite_profile(items, ["l_quantity", "l_discount", "rate"])


PROFILE_SQL = """
WITH v AS (SELECT l_quantity, l_discount, CASE l_linenumber WHEN 7 THEN 'nan'::DOUBLE WHEN 6 THEN 'inf'::DOUBLE ELSE l_tax END AS rate FROM lineitem),
e AS (SELECT 'l_quantity' AS "column", l_quantity AS v FROM v UNION ALL SELECT 'l_discount', l_discount FROM v UNION ALL SELECT 'rate', rate FROM v)
SELECT "column", count(v) AS n, count(*) FILTER (isnan(v)) AS n_nan, count(*) FILTER (isinf(v)) AS n_inf, count(*) FILTER (NOT isfinite(v)) = 0 AS all_finite,
  min(v) FILTER (isfinite(v)) AS low, max(v) FILTER (isfinite(v)) AS high FROM e GROUP BY 1"""


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    records = C.sampling_records(_hierarchy(spark, d))
    return C.run_summary(records).withColumns({k: F.round(k, 9) for k in ("least_weight", "most_weight")})


SUMMARY_SQL = f"""WITH {_RECORDS_SQL}, e AS (SELECT seed, cluster, count(*) AS size, sum(probability) AS weight FROM rec GROUP BY ALL)
SELECT seed, count(*) AS n_clusters, sum(size)::BIGINT AS n_members, max(size) AS largest, round(min(weight), 9) AS least_weight, round(max(weight), 9) AS most_weight FROM e GROUP BY 1"""


def distinct_structures(spark: SparkSession, d: str) -> DataFrame:
    """Structures that parts' types name under one of four prefixes, each once."""
    kinds = F.element_at(F.array(*[F.lit(x) for x in (S.AF2, S.V3D, S.VAF, "SARRAHXYZ")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return C.distinct_structures(table(spark, d, "part").select(F.concat(kinds, F.lit("-"), F.replace("p_type", F.lit(" "), F.lit("."))).alias("v")), "v")


STRUCTURES_SQL = "SELECT DISTINCT substr('SARRAHV3D-' || replace(p_type, ' ', '.'), 13) AS structure FROM part WHERE p_partkey % 4 = 1"


def ordered_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return C.ordered_fingerprint(table(spark, d, "conversations"), "conv_id", "turn", "text")


FINGERPRINT_SQL = "SELECT conv_id, sha1(string_agg(text, '' ORDER BY turn, text)) AS fingerprint FROM conversations GROUP BY 1"


def pair_identity(spark: SparkSession, d: str) -> DataFrame:
    return H.row_statistics(aln(spark, d))


_PAIR_SQL = f"""{ALN_SQL},
p AS (SELECT a.msa, a.row_id, b.row_id AS other, length(replace(a.aligned, '-', '')) AS own,
  ({WIDTH} - hamming(replace(a.aligned, '-', '~'), b.aligned))::BIGINT AS same FROM aln a JOIN aln b USING (msa)),
nb AS (SELECT msa, row_id, count(*) FILTER (1 - same / own::DOUBLE <= 0.2::DOUBLE) AS neighbors, sum(same)::BIGINT AS matches, max(same) FILTER (other <> row_id) AS best_other
  FROM p GROUP BY ALL)"""
PAIR_SQL = f"WITH {_PAIR_SQL} SELECT * FROM nb"


def neighbor_counts(spark: SparkSession, d: str) -> DataFrame:
    return H.neighbor_counts(aln(spark, d), 0.2)


NEIGHBORS_SQL = f"WITH {_PAIR_SQL} SELECT msa, row_id, neighbors FROM nb"


def homology_weights(spark: SparkSession, d: str) -> DataFrame:
    found = H.homology_weights(aln(spark, d), 0.2)
    return found.select("msa", "row_id", "neighbors", F.round("n_eff", 6).alias("n_eff"), F.round("weight", 9).alias("weight"))


WEIGHTS_SQL = f"""WITH {_PAIR_SQL}
SELECT msa, row_id, neighbors, round(sum(1.0::DOUBLE / neighbors) OVER (PARTITION BY msa), 6) AS n_eff,
  round(1.0::DOUBLE / neighbors / sum(1.0::DOUBLE / neighbors) OVER (PARTITION BY msa), 9) AS weight FROM nb"""


def structure_fallback(spark: SparkSession, d: str) -> DataFrame:
    prompt = table(spark, d, "documents").select(F.col("doc_id").alias("name"), F.col("text").alias("sequence"), F.lit(-1).alias("score"))
    structures = table(spark, d, "labels").select(F.col("doc_id").alias("name"), F.concat(F.lit("Q"), F.col("quality").cast("string")).alias("sequence"), F.col("toxic").alias("score"))
    return scoring.with_structure_or_fallback(prompt, structures)


FALLBACK_SQL = """
SELECT d.doc_id AS name, CASE WHEN l.doc_id IS NULL THEN text ELSE 'Q' || quality END AS sequence, coalesce(toxic, -1) AS score, l.doc_id IS NOT NULL AS has_structure
FROM documents d LEFT JOIN labels l USING (doc_id)"""

_NAMES = {
    "cluster_stats": (cluster_stats, CLUSTER_STATS_SQL), "left_counts": (left_counts, LEFT_COUNTS_SQL), "size_histogram": (size_histogram, HISTOGRAM_SQL),
    "hierarchy_probability": (hierarchy_probability, RECORDS_SQL), "cluster_report": (cluster_report, REPORT_SQL), "cluster_members": (cluster_members, MEMBERS_SQL),
    "parent_of": (parent_of, PARENT_SQL), "unprocessed": (unprocessed, UNPROCESSED_SQL), "lookup_sequences": (lookup_sequences, LOOKUP_SQL),
    "last_wins_join": (last_wins_join, LAST_SQL), "modal_label": (modal_label, MODAL_SQL), "distinct_chains": (distinct_chains, DISTINCT_SQL),
    "finite_profile": (finite_profile, PROFILE_SQL), "run_summary": (run_summary, SUMMARY_SQL), "ordered_fingerprint": (ordered_fingerprint, FINGERPRINT_SQL),
    "pair_identity": (pair_identity, PAIR_SQL), "neighbor_counts": (neighbor_counts, NEIGHBORS_SQL), "homology_weights": (homology_weights, WEIGHTS_SQL),
    "distinct_structures": (distinct_structures, STRUCTURES_SQL), "structure_fallback": (structure_fallback, FALLBACK_SQL),
}
QUERIES = {name: query for name, (query, _) in _NAMES.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _NAMES.items()}
