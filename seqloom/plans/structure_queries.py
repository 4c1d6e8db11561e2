"""Queries of the structure operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import geometry as G
from seqloom.operators import structures as R
from seqloom.plans.views import POINTS_SQL, points, table


def _atoms(spark: SparkSession, d: str) -> DataFrame:
    """Atoms of residues: a user's events of an hour, with three kinds as backbone atoms."""
    events = table(spark, d, "events")
    kinds = F.create_map(*[F.lit(x) for x in ("view", "N", "click", "CA", "purchase", "C")])
    return events.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("structure_id"), F.col("user_id").alias("chain"), F.hour("ts").alias("res_num"),
        F.coalesce(F.try_element_at(kinds, F.col("event_type")), F.lit("O")).alias("atom"), F.col("value").alias("x"), (F.col("value") * 2).alias("y"),
        F.col("event_id").cast("double").alias("z"), (F.col("value") + 1).alias("b_iso"), F.col("event_id").alias("ord"),
    )


_ATOMS_SQL = """am AS (SELECT 'u' || user_id AS structure_id, user_id AS chain, hour(ts)::INT AS res_num,
  CASE event_type WHEN 'view' THEN 'N' WHEN 'click' THEN 'CA' WHEN 'purchase' THEN 'C' ELSE 'O' END AS atom, value, event_id FROM events)"""


def backbone(spark: SparkSession, d: str) -> DataFrame:
    found = R.backbone(_atoms(spark, d), ["chain", "res_num"])
    none = F.lit(-1.0)
    return found.select("chain", "res_num", *[F.coalesce(F.col(a)["z"], none).alias(f"{a}_z") for a in ("n", "ca", "c")], F.coalesce(F.col("ca")["y"], none).alias("ca_y"), F.coalesce("score", none).alias("score"))


BACKBONE_SQL = f"""WITH {_ATOMS_SQL}, g AS (SELECT chain, res_num, max(event_id) FILTER (atom = 'N') AS n, max(event_id) FILTER (atom = 'CA') AS ca, max(event_id) FILTER (atom = 'C') AS c,
  arg_max(value, event_id) FILTER (atom = 'CA') AS v FROM am GROUP BY ALL)
SELECT chain, res_num, coalesce(n, -1)::DOUBLE AS n_z, coalesce(ca, -1)::DOUBLE AS ca_z, coalesce(c, -1)::DOUBLE AS c_z, coalesce(v * 2, -1.0::DOUBLE) AS ca_y,
  CASE WHEN n IS NOT NULL AND ca IS NOT NULL AND c IS NOT NULL THEN v + 1 ELSE -1.0::DOUBLE END AS score FROM g"""


def full_backbone_count(spark: SparkSession, d: str) -> DataFrame:
    return R.full_backbone_count(_atoms(spark, d), ["res_num"], "structure_id")


FULL_SQL = f"""WITH {_ATOMS_SQL}, r AS (SELECT structure_id, res_num, count(DISTINCT atom) FILTER (atom <> 'O') AS k FROM am GROUP BY ALL)
SELECT structure_id, count(*) AS n_residues, count(*) FILTER (k = 3) AS n_full FROM r GROUP BY 1"""


def seqres_align(spark: SparkSession, d: str) -> DataFrame:
    """Orders' line slots, as many as the highest line has, as sequence positions, their lines as residues seen."""
    names = F.array(*[F.lit(n) for n, _ in R.RESIDUES])
    slots = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linenumber").alias("slots"))
    orders = table(spark, d, "orders").join(slots, "o_orderkey").select("o_orderkey", "o_custkey", F.explode(F.sequence(F.lit(1), F.col("slots"))).alias("slot"))
    scheme = orders.select(
        F.col("o_orderkey").cast("string").alias("structure_id"), F.lit("A").alias("asym_id"), F.element_at(names, (F.col("o_custkey") % 20 + 1).cast("int")).alias("mon_id"),
        F.col("slot").alias("seq_id"), F.col("slot").alias("auth_seq_num"), F.lit(".").alias("ins_code"),
    )
    items = table(spark, d, "lineitem")
    residues = items.select(
        F.col("l_orderkey").cast("string").alias("structure_id"), F.lit("A").alias("label"), F.col("l_linenumber").alias("res_num"), F.lit("?").alias("ins_code"),
        F.when(F.col("l_returnflag") == "R", "HOH").when(F.col("l_returnflag") == "A", "MSE").otherwise("LIG").alias("res_name"), (F.col("l_linestatus") == "O").alias("hetero"),
        F.col("l_partkey").alias("ord"), F.col("l_partkey").alias("part"),
    )
    return R.seqres_align(scheme, residues).select("structure_id", "pos", "aa", F.coalesce(F.col("seen")["part"], F.lit(-1)).alias("part"))


SEQRES_SQL = f"""
WITH k AS (SELECT l_orderkey AS o_orderkey, max(l_linenumber) AS slots FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey, o_custkey, unnest(generate_series(1, slots)) AS slot FROM orders JOIN k USING (o_orderkey)),
r AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS part FROM lineitem WHERE l_returnflag <> 'R' AND (l_linestatus <> 'O' OR l_returnflag = 'A') GROUP BY ALL)
SELECT o_orderkey::VARCHAR AS structure_id, slot::INT AS pos, substr('{''.join(c for _, c in R.RESIDUES)}', o_custkey % 20 + 1, 1) AS aa, coalesce(part, -1) AS part
FROM o LEFT JOIN r ON l_orderkey = o_orderkey AND l_linenumber = slot"""


def enforce_structure(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", F.nullif(F.col("event_id") % 5, F.lit(0)).cast("double").alias("a"), F.nullif(F.round(F.col("value")) % 100, F.lit(7.0)).alias("p"))
    out = events.select("event_id", G.enforce_structure(F.array("a", F.col("a") * 2), F.col("p")).alias("s"), G.value_and_flag(F.col("p"), 100.0).alias("v"), G.pair_and_flag(F.col("a"), F.col("p")).alias("f"))
    return out.select(
        "event_id", F.coalesce(F.get("s.coords", F.lit(1)), F.lit(-1.0)).alias("coord"), F.coalesce("s.plddt", F.lit(-1.0)).alias("plddt"),
        F.col("v.value").alias("value"), F.col("v.flag").alias("flag"), F.col("f.first").alias("first"), F.col("f.flag").alias("pair_flag"),
    )


ENFORCE_SQL = """
WITH e AS (SELECT event_id, nullif(event_id % 5, 0)::DOUBLE AS a, nullif(round(value) % 100, 7.0::DOUBLE) AS p FROM events)
SELECT event_id, CASE WHEN a IS NOT NULL AND (p IS NULL OR p >= 70) THEN a * 2 ELSE -1.0::DOUBLE END AS coord, coalesce(CASE WHEN a IS NOT NULL THEN p END, -1.0::DOUBLE) AS plddt,
  coalesce(p / 100, 0.0::DOUBLE) AS value, (p IS NOT NULL)::INT AS flag, CASE WHEN a IS NOT NULL AND p IS NOT NULL THEN a ELSE 0.0::DOUBLE END AS first, (a IS NOT NULL AND p IS NOT NULL)::INT AS pair_flag FROM e"""


def local_distances(spark: SparkSession, d: str) -> DataFrame:
    found = R.local_backbone_distances(points(spark, d), "chain")
    return found.filter("local IS NOT NULL").select("chain", "pos", F.posexplode("local").alias("k", "v")).select("chain", "pos", "k", F.col("v").cast("double").alias("v"))


def _local_sql() -> str:
    atoms = [f"{side}.{a}" for side in ("p", "o", "q") for a in "nac"]
    pairs = [f"sqrt(({a}x-{b}x)*({a}x-{b}x)+({a}y-{b}y)*({a}y-{b}y)+({a}z-{b}z)*({a}z-{b}z))" for i, a in enumerate(atoms) for b in atoms[i + 1 :]]
    return f"""WITH {POINTS_SQL}, l AS (SELECT o.chain, o.pos, [{', '.join(pairs)}] AS v FROM pts o JOIN pts p ON p.chain = o.chain AND p.pos = o.pos - 1 JOIN pts q ON q.chain = o.chain AND q.pos = o.pos + 1),
h AS (SELECT chain, pos, unnest(generate_series(0, 35)) AS k, unnest(v) AS v FROM l),
s AS (SELECT *, pow(2.0::DOUBLE, greatest(floor(log2(greatest(v, pow(2.0::DOUBLE, -14)))), -14) - 10) AS step FROM h)
SELECT chain, pos::INT AS pos, k::INT AS k, round_even(v / step, 0) * step AS v FROM s"""


def pair_buckets(spark: SparkSession, d: str) -> DataFrame:
    return R.residue_pairs(points(spark, d)).select("chain", "i", "j", "distance_bucket", "angle_bucket", "pair_bucket")


PAIR_SQL = f"""WITH {POINTS_SQL},
v AS (SELECT *, nx - ax AS ux, ny - ay AS uy, nz - az AS uz, cx - ax AS wx, cy - ay AS wy, cz - az AS wz FROM pts),
c AS (SELECT *, uy * wz - uz * wy AS mx, uz * wx - ux * wz AS my, ux * wy - uy * wx AS mz FROM v),
r AS (SELECT chain, pos, ax, ay, az, plddt / 100 AS conf, mx / sqrt(mx*mx + my*my + mz*mz) AS px, my / sqrt(mx*mx + my*my + mz*mz) AS py, mz / sqrt(mx*mx + my*my + mz*mz) AS pz FROM c),
d AS (SELECT a.chain, a.pos::INT AS i, b.pos::INT AS j, a.conf AS ca, b.conf AS cb,
  trunc(least(greatest((sqrt((a.ax-b.ax)*(a.ax-b.ax) + (a.ay-b.ay)*(a.ay-b.ay) + (a.az-b.az)*(a.az-b.az)) - 2.5::DOUBLE) / (48.0::DOUBLE - 2.5::DOUBLE) * 127, 0.0::DOUBLE), 127.0::DOUBLE))::INT AS distance_bucket,
  a.px*b.px + a.py*b.py + a.pz*b.pz AS cosine, a.py*b.pz - a.pz*b.py AS sx, a.pz*b.px - a.px*b.pz AS sy, a.px*b.py - a.py*b.px AS sz FROM r a JOIN r b ON a.chain = b.chain AND a.pos <> b.pos),
t AS (SELECT *, atan2(CASE WHEN sz >= 0 THEN sqrt(sx*sx + sy*sy + sz*sz) ELSE -sqrt(sx*sx + sy*sy + sz*sz) END, cosine) AS w FROM d),
b AS (SELECT *, least(trunc(greatest(CASE WHEN w < 0 THEN w + 2 * pi() ELSE w END / (2 * pi()) * 128, 0.0::DOUBLE))::INT, 127) AS angle_bucket FROM t)
SELECT chain, i, j, distance_bucket, angle_bucket, CASE WHEN ca < 0.7::DOUBLE OR cb < 0.7::DOUBLE THEN 16385 ELSE distance_bucket * 128 + angle_bucket END AS pair_bucket FROM b"""


def residue_letters(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n, _ in R.RESIDUES + R.MODIFIED], F.lit("UNK"))
    parts = table(spark, d, "part").select("p_partkey", F.element_at(names, (F.col("p_partkey") % 24 + 1).cast("int")).alias("name"))
    return parts.select("p_partkey", R.residue_letter(F.col("name")).alias("letter"), R.residue_letter(F.col("name"), modified=False).alias("standard"))


LETTERS_SQL = f"""SELECT p_partkey, substr('{''.join(c for _, c in R.RESIDUES + R.MODIFIED)}X', p_partkey % 24 + 1, 1) AS letter,
  substr('{''.join(c for _, c in R.RESIDUES)}XXXX', p_partkey % 24 + 1, 1) AS standard FROM part"""

_NAMES = {
    "backbone": (backbone, BACKBONE_SQL), "full_backbone_count": (full_backbone_count, FULL_SQL), "seqres_align": (seqres_align, SEQRES_SQL),
    "enforce_structure": (enforce_structure, ENFORCE_SQL), "local_distances": (local_distances, _local_sql()), "pair_buckets": (pair_buckets, PAIR_SQL),
    "residue_letters": (residue_letters, LETTERS_SQL),
}
QUERIES = {name: query for name, (query, _) in _NAMES.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _NAMES.items()}
