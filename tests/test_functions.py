"""Alphabets, identifiers, geometry and random keys on exact cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from seqloom.functions import alphabets as A
from seqloom.functions import geometry as G
from seqloom.functions import sequences as S
from seqloom.functions.columns import nan_to_null, uniform
from seqloom.operators.homology import match_expression


def one(spark, column, **values):
    row = spark.range(1)
    for name, value in values.items():
        row = row.withColumn(name, F.lit(value))
    return row.select(column.alias("v")).first()["v"]


def test_framed_tokens(spark):
    framed = A.append_startstop(A.encode(F.lit("WAAAGH")))
    assert one(spark, framed) == [26, 17, 0, 0, 0, 7, 8, 27]


@pytest.mark.parametrize(
    ("text", "alphabet", "tokens"),
    [
        ("", A.MAIN, []), ("aA.-", A.MAIN, [24, 0, 24, 25]), ("OUBZX|", A.MAIN, [20, 21, 22, 23, 24, 28]), (" A", A.STRUCTURAL, [23, 0]),
        ("OUBZX-", A.twenty_one(), [11, 4, 20, 20, 20, 20]), ("-*$", A.twenty_one(True, True, True), [20, 21, 22]), ("KEROZJ", A.REDUCED, [2, 2, 2, 2, 12, 255]), ("ACGTN", A.DNA, [0, 1, 2, 3, 255]),
    ],
)
def test_encode(spark, text, alphabet, tokens):
    assert one(spark, A.encode(F.col("t"), alphabet), t=text) == tokens


def test_round_trip(spark):
    assert one(spark, A.decode(A.encode(F.lit("ARNDX-$*|")))) == "ARNDX-$*|"


def test_kmer(spark):
    assert one(spark, A.kmer_unpack(F.lit(27), 4, 4)) == [0, 1, 2, 3]
    assert one(spark, A.kmer_string(F.lit(27), 4)) == "ACGT"


@pytest.mark.parametrize(("a", "b", "same"), [("ABC", "ABA", 2), ("A-C", "ABA", 1), ("AB-", "ABA", 2), ("AB-", "AB-", 2), ("ABC", "AB-", 2)])
def test_pair_similarity(spark, a, b, same):
    assert one(spark, match_expression(F.lit(a), F.lit(b))) == same


def test_stable_seed_is_the_digest_modulo(spark):
    for text in ("", "1", "188258", "é"):
        assert one(spark, S.stable_seed(F.lit(text))) == int(hashlib.sha256(text.encode()).hexdigest(), 16) % (2**32 - 1)


def test_cluster_ids(spark):
    strict = lambda t: one(spark, S.normalize_cluster_id(F.lit(t), "UniRef90", on_error="null"))
    assert [strict(t) for t in (" uniref90_a1 ", "a1", "UniRef50_a1", " ")] == ["UniRef90_A1", "UniRef90_A1", None, None]
    lenient = lambda t: one(spark, S.normalize_cluster_id(F.lit(t), "UniRef90", strict=False, on_error="null"))
    assert [lenient(t) for t in ("UniRef90_a", "UniRef50_a", "a_b", "")] == ["UniRef90_a", "UniRef90_a", "UniRef90_a_b", None]
    with pytest.raises(Exception, match="cannot be empty"):
        one(spark, S.normalize_cluster_id(F.lit(""), "UniRef90"))


def test_assignments(spark):
    split = lambda t: tuple(one(spark, S.split_assigned(F.lit(t))))
    assert split("SARRAHAF2-P1-F1") == ("SARRAHAF2", "P1")
    assert split("SARRAHV3D-P2.pdb-x") == ("SARRAHV3D", "P2")
    assert split("SARRAHVAFP3.cif") == ("SARRAHVAF", "P3")
    assert split("SARRAHxyzP4.q") == ("", "P4.q")
    assert one(spark, S.structural_source(F.lit("SARRAHV3DxyzP5"))) == "P5"


def test_grid_name(spark):
    name = S.grid_name(F.lit(6144), F.lit(1.0), F.lit(True), F.lit(False), F.lit(7))
    assert one(spark, name) == "6144_1.0_True_False_seed=7"


def test_structure_rules_apply_in_order(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0], 80.0), (2, [1.0, None], 80.0), (3, [1.0, 2.0], 60.0), (4, [1.0, 2.0], None)], "i int, c array<double>, p double")
    found = {r["i"]: (r["s"]["coords"], r["s"]["plddt"]) for r in rows.select("i", G.enforce_structure(F.col("c"), F.col("p")).alias("s")).collect()}
    assert found == {1: ([1.0, 2.0], 80.0), 2: (None, None), 3: (None, 60.0), 4: ([1.0, 2.0], None)}


@pytest.mark.parametrize(("d", "bucket"), [(0.0, 0), (2.5, 0), (48.0, 127), (1000.0, 127), (25.25, 63)])
def test_distance_bucket(spark, d, bucket):
    assert one(spark, G.distance_bucket(F.lit(d))) == bucket


def test_missing_pairs_have_their_own_bucket(spark):
    assert one(spark, G.pair_bucket(F.lit(3), F.lit(5), F.lit(False), F.lit(0.9), F.lit(0.9))) == 128 * 128
    assert one(spark, G.pair_bucket(F.lit(3), F.lit(5), F.lit(True), F.lit(0.9), F.lit(None).cast("double"))) == 128 * 128 + 1
    assert one(spark, G.pair_bucket(F.lit(3), F.lit(5), F.lit(True), F.lit(0.9), F.lit(0.7))) == 3 * 128 + 5


def test_collinear_points_have_no_normal(spark):
    p = lambda v: G.point(F.lit(float(v)), F.lit(0.0), F.lit(0.0))
    assert one(spark, G.plane_normal(p(1), p(2), p(3))) is None


def test_nan_is_null(spark):
    assert one(spark, nan_to_null(F.lit(float("nan")))) is None


def test_uniform_depends_on_seed_and_key_alone(spark):
    rows = spark.range(1000).select(uniform(1, F.col("id")).alias("u"))
    values = [r["u"] for r in rows.repartition(7).collect()]
    assert len(set(values)) == 1000 and 0 < min(values) and max(values) < 1 and abs(sum(values) / 1000 - 0.5) < 0.05
    assert sorted(values) == sorted(r["u"] for r in rows.collect())
