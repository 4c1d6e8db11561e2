"""Queries of the scoring operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import scoring as S
from seqloom.plans.views import LOGITS_SQL, logits, table


def sequence_loglik(spark: SparkSession, d: str) -> DataFrame:
    out = S.sequence_log_likelihood(logits(spark, d), "seq_id", F.col("logits"), F.col("target"))
    return out.withColumn("loglik", F.round("loglik", 6))


LOGLIK_SQL = f"WITH {LOGITS_SQL} SELECT seq_id, round(sum(CASE WHEN target = 24 THEN 0 ELSE logits[target + 1] - z END), 6) AS loglik FROM lse GROUP BY 1"


def next_token_shift(spark: SparkSession, d: str) -> DataFrame:
    shifted = S.next_token_shift(logits(spark, d), "seq_id", "pos")
    out = S.sequence_log_likelihood(shifted, "seq_id", F.col("logits"), F.col("next_target"))
    return out.withColumn("loglik", F.round("loglik", 6))


SHIFT_SQL = f"""WITH {LOGITS_SQL}, n AS (SELECT *, lead(target) OVER (PARTITION BY seq_id ORDER BY pos) AS t FROM lse)
SELECT seq_id, round(sum(CASE WHEN t = 24 THEN 0 ELSE logits[t + 1] - z END), 6) AS loglik FROM n WHERE t IS NOT NULL GROUP BY 1"""


def masked_ce(spark: SparkSession, d: str) -> DataFrame:
    rows = logits(spark, d)
    mask = S.loss_mask(F.col("target"), F.col("vec_id") % 3 != 0)
    out = S.masked_cross_entropy(rows, F.col("logits"), F.col("target"), mask, ["seq_id"])
    plain = S.masked_cross_entropy(rows, F.col("logits"), F.col("target"), by=["seq_id"]).select("seq_id", F.col("loss").alias("plain"))
    return out.join(plain, "seq_id").select("seq_id", F.round("loss", 6).alias("loss"), "n", F.round(S.total_loss([F.col("loss"), F.col("plain")]), 6).alias("total"))


MASKED_SQL = f"""WITH {LOGITS_SQL}, c AS (SELECT seq_id, least(z - logits[target + 1], 20.0::DOUBLE) AS ce, (vec_id % 3 <> 0 AND target NOT IN (24, 26, 27)) AS m FROM lse),
g AS (SELECT seq_id, coalesce(sum(ce) FILTER (m), 0) / greatest(count(*) FILTER (m), 1) AS loss, count(*) FILTER (m) AS n, avg(ce) AS plain FROM c GROUP BY 1)
SELECT seq_id, round(loss, 6) AS loss, n, round(loss + plain, 6) AS total FROM g"""


def gap_to_query(spark: SparkSession, d: str) -> DataFrame:
    rows = logits(spark, d).withColumn("g", S.gap_to_query(F.col("logits"), F.col("target") % 20))
    return rows.select("vec_id", F.round(F.get("g", F.col("target") % 20), 6).alias("own"), F.round(F.get("g", F.lit(3)), 6).alias("third"), (F.get("g", F.lit(25)) == float("-inf")).alias("no_gap"))


GAP_SQL = f"""WITH {LOGITS_SQL}
SELECT vec_id, round(ln(exp(logits[target % 20 + 1] - z) + exp(logits[26] - z)), 6) AS own,
  round(CASE WHEN target % 20 = 3 THEN ln(exp(logits[4] - z) + exp(logits[26] - z)) ELSE logits[4] - z END, 6) AS third, true AS no_gap FROM lse"""


def _prompted(spark: SparkSession, d: str) -> DataFrame:
    rows = logits(spark, d).select("seq_id", "pos", "vec_id", F.posexplode("logits").alias("token", "logit"))
    return rows.withColumns({"prompt": F.col("vec_id") % 3, "grp": F.floor(F.col("pos") / 3)})


_PROMPT_SQL = f"{LOGITS_SQL}, pr AS (SELECT seq_id, pos // 3 AS grp, vec_id, (t - 1)::INT AS token, logits[t] AS logit, vec_id % 3 + 1 AS w, -(vec_id % 5)::DOUBLE AS p FROM lg, generate_series(1, 29) AS g(t))"


def mix_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    out = S.mix_next_token(_prompted(spark, d), ["seq_id", "grp", "token"], -(F.col("vec_id") % 5).cast("double"), F.col("logit"), F.col("prompt") + 1)
    return out.withColumn("mixed", F.round("mixed", 6))


MIX_A_SQL = f"""WITH {_PROMPT_SQL}, s AS (SELECT *, w / sum(w) OVER (PARTITION BY seq_id, grp, token)::DOUBLE AS sh FROM pr)
SELECT seq_id, grp, token, round(ln(sum(sh * exp(p + logit))) - ln(sum(sh * exp(p))), 6) AS mixed FROM s GROUP BY ALL"""


def mix_geometric(spark: SparkSession, d: str) -> DataFrame:
    out = S.mix_next_token(_prompted(spark, d), ["seq_id", "grp", "token"], -(F.col("vec_id") % 5).cast("double"), F.col("logit"), F.col("prompt") + 1, method="geometric")
    return out.withColumn("mixed", F.round("mixed", 6))


MIX_G_SQL = f"WITH {_PROMPT_SQL} SELECT seq_id, grp, token, round(sum(w * (p + logit)) - sum(w * p), 6) AS mixed FROM pr GROUP BY ALL"


def _token_rows(spark: SparkSession, d: str) -> DataFrame:
    return logits(spark, d).select("vec_id", F.posexplode(S.valid_token_mask(F.col("logits"), ("gap",))).alias("token", "logit")).filter("logit > -1e300")


_TOKEN_SQL = f"{LOGITS_SQL}, tr AS (SELECT vec_id, (t - 1)::INT AS token, logits[t] / 0.7::DOUBLE AS l FROM lg, generate_series(1, 29) AS g(t) WHERE t - 1 NOT IN (20, 21, 22, 23, 24, 25, 26, 28))"


def topk_filter(spark: SparkSession, d: str) -> DataFrame:
    out = S.filter_tokens(_token_rows(spark, d), ["vec_id"], "token", F.col("logit"), temperature=0.7, top_k=5)
    return out.withColumn("probability", F.round("probability", 9))


TOPK_SQL = f"""WITH {_TOKEN_SQL}, k AS (SELECT * FROM tr QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY l DESC, token) <= 5)
SELECT vec_id, token, round(exp(l - max(l) OVER (PARTITION BY vec_id)) / sum(exp(l)) OVER (PARTITION BY vec_id) * exp(max(l) OVER (PARTITION BY vec_id)), 9) AS probability FROM k"""


def topp_filter(spark: SparkSession, d: str) -> DataFrame:
    out = S.filter_tokens(_token_rows(spark, d), ["vec_id"], "token", F.col("logit"), temperature=0.7, top_k=10, top_p=0.8)
    return out.withColumn("probability", F.round("probability", 9))


TOPP_SQL = f"""WITH {_TOKEN_SQL}, k AS (SELECT * FROM tr QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY l DESC, token) <= 10),
p AS (SELECT *, exp(l) / sum(exp(l)) OVER (PARTITION BY vec_id) AS p FROM k),
c AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY l DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p)
SELECT vec_id, token, round(p / sum(p) OVER (PARTITION BY vec_id), 9) AS probability FROM c WHERE b < 0.8::DOUBLE"""


def worst_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = logits(spark, d)
    out = S.worst_tokens(rows, S.cross_entropy(F.col("logits"), F.col("target")), S.loss_mask(F.col("target")), 10, ["vec_id"])
    return out.select("seq_id", "pos", "vec_id", "target", F.round("loss", 6).alias("loss"))


WORST_SQL = f"""WITH {LOGITS_SQL}, c AS (SELECT *, least(z - logits[target + 1], 20.0::DOUBLE) AS loss FROM lse WHERE target NOT IN (24, 26, 27))
SELECT seq_id, pos::INT AS pos, vec_id, target, round(loss, 6) AS loss FROM c WHERE loss > 0 ORDER BY c.loss DESC, vec_id LIMIT 10"""


def bad_targets(spark: SparkSession, d: str) -> DataFrame:
    return S.bad_targets(logits(spark, d), "target", 20).select("vec_id", "target")


BAD_SQL = f"WITH {LOGITS_SQL} SELECT vec_id, target FROM lg WHERE target <> 24 AND target >= 20"


def half_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return logits(spark, d).select("vec_id", F.size(S.first_half(F.col("logits"))).cast("bigint").alias("n"), F.round(S.log_sum_exp(S.first_half(F.col("logits"))), 6).alias("z"))


HALF_SQL = f"WITH {LOGITS_SQL} SELECT vec_id, 14::BIGINT AS n, round(ln(list_sum(list_transform(logits[1:14], lambda v: exp(v)))), 6) AS z FROM lg"


def ensemble_mean(spark: SparkSession, d: str) -> DataFrame:
    scores = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("prompt_id"), F.col("l_suppkey").alias("variant_id"), F.col("l_extendedprice").alias("logp"))
    return S.ensemble_mean(scores).select("variant_id", F.col("score").cast("double").alias("score"))


ENSEMBLE_SQL = "SELECT l_suppkey AS variant_id, avg(l_extendedprice)::FLOAT::DOUBLE AS score FROM lineitem GROUP BY 1"


def wt_delta(spark: SparkSession, d: str) -> DataFrame:
    scores = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("variant_id")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("score"))
    return S.wt_delta(scores, F.col("variant_id") == 1)


DELTA_SQL = """WITH s AS (SELECT l_suppkey AS variant_id, sum(l_quantity::BIGINT)::BIGINT AS score FROM lineitem GROUP BY 1)
SELECT variant_id, score - (SELECT score FROM s WHERE variant_id = 1) AS delta FROM s WHERE variant_id <> 1"""


def score_with(spark: SparkSession, d: str) -> DataFrame:
    """A user's scorer called on slices: here the number of letters A, in hundreds."""
    docs = table(spark, d, "documents").select("doc_id", F.upper("text").alias("sequence"))
    return S.score_with(docs, lambda rows: rows["sequence"].str.count("A") / 100.0).select("doc_id", F.round(F.col("logp").cast("double"), 4).alias("logp"))


SCORE_WITH_SQL = "SELECT doc_id, round((len(upper(text)) - len(replace(upper(text), 'A', '')))::DOUBLE / 100, 4) AS logp FROM documents"

_NAMES = {
    "sequence_loglik": (sequence_loglik, LOGLIK_SQL), "next_token_shift": (next_token_shift, SHIFT_SQL), "masked_ce": (masked_ce, MASKED_SQL), "gap_to_query": (gap_to_query, GAP_SQL),
    "mix_arithmetic": (mix_arithmetic, MIX_A_SQL), "mix_geometric": (mix_geometric, MIX_G_SQL), "topk_filter": (topk_filter, TOPK_SQL), "topp_filter": (topp_filter, TOPP_SQL),
    "worst_tokens": (worst_tokens, WORST_SQL), "bad_targets": (bad_targets, BAD_SQL), "half_vocabulary": (half_vocabulary, HALF_SQL), "ensemble_mean": (ensemble_mean, ENSEMBLE_SQL),
    "wt_delta": (wt_delta, DELTA_SQL), "score_with": (score_with, SCORE_WITH_SQL),
}
QUERIES = {name: query for name, (query, _) in _NAMES.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _NAMES.items()}
