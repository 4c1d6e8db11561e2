"""Neighbours by keys against all pairs, and what is no longer done for each pair, cut point, pass or grid point."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import bounds as B
from seqloom.operators import covering as C
from seqloom.operators import sampling as P
from seqloom.operators import spread as R
from seqloom.plans.views import aln

GAP = ord("-")


def alignment(n, width, letters, short, holes, seed):
    """Distinct rows, some in families of near copies, some of fewer letters."""
    deal = np.random.RandomState(seed)
    codes = deal.randint(65, 65 + letters, (n, width)).astype(np.uint8)
    for size in (2, 5, 40, n // 3):
        to = deal.randint(0, n, size)
        codes[to] = np.where(deal.rand(size, width) < deal.rand() * 0.25, codes[to], codes[to[0]])
    length = np.where(deal.rand(n) < short, deal.randint(1, width + 1, n), width)
    codes[np.arange(width)[None, :] >= length[:, None]] = GAP
    codes[(deal.rand(n, width) < holes) & (np.arange(width) > 0)[None, :]] = GAP
    codes = np.unique(codes, axis=0)
    return codes[deal.permutation(len(codes))]


@pytest.mark.parametrize("theta", [0.0, 0.2, 0.35, 1.0])
@pytest.mark.parametrize("cheap", [True, False])
@pytest.mark.parametrize("of", [(500, 240, 20, 0.3, 0.0), (400, 30, 26, 0.5, 0.02), (400, 13, 4, 0.4, 0.0)])
def test_neighbors_by_keys_equal_all_pairs(monkeypatch, of, cheap, theta):
    if cheap:  # keys wherever there can be any, and crowds of few rows
        monkeypatch.setattr(C, "ALL_COST", 10**6)
        monkeypatch.setattr(C, "CROWD", 4)
    codes = alignment(*of, seed=3)
    deal = np.random.RandomState(4)
    copies, halves = deal.randint(1, 4, len(codes)), deal.randint(0, 2, len(codes))
    same = sum(((c[:, None] == c[None, :]) & (c != GAP)[:, None]).astype(int) for c in codes.T)
    near = 1 - same / (codes != GAP).sum(axis=1)[:, None] <= theta
    for side, wanted in ((None, near @ copies), (halves, (near & (halves[:, None] != halves[None, :])) @ copies)):
        assert B.near_counts(codes, copies, side, GAP, theta, 64, keyed=0).tolist() == wanted.tolist()


@pytest.mark.parametrize("size,radius", list(itertools.product([21, 40], [0, 1, 2])))
def test_some_key_holds_none_of_the_spare_columns(size, radius):
    spare = 4
    keys = [set(k.tolist()) for k in C.covering_keys(np.arange(size), np.full(size, 0.1), spare, radius)]
    assert keys and all(0 < len(k) <= C.MOST_KEY for k in keys)
    deal = np.random.RandomState(1)
    for _ in range(500):
        lost = set(deal.choice(size, spare, replace=False).tolist())
        assert any(not k & lost for k in keys)


def test_unlike_rows_are_not_compared(monkeypatch):
    """All pairs of a task went through the comparison of columns before, however unlike."""
    deal = np.random.RandomState(1)
    codes = np.unique(deal.randint(65, 91, (3000, 240)).astype(np.uint8), axis=0)
    codes[1] = codes[0]
    codes[1, :40] = 70
    monkeypatch.setattr(B, "_survivors", None)
    found = B.near_counts(codes, np.ones(len(codes), np.int64), None, GAP, 0.2, 1024)
    assert found[:2].tolist() == [2, 2] and found[2:].max() == 1


def test_a_place_is_hashed_once_for_all_cut_points(spark):
    cuts = [F.struct(F.lit(k / 40).alias("o0")) for k in range(1, 40)]
    of = R.range_of(F.struct(P.random_key(1, F.col("id")).alias("o0")), cuts)
    plan = spark.range(9).select(of.alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\bmd5\(", plan)) == 1


def test_places_are_found_among_many_cut_points(spark):
    for n in (1, 16, 17, 257, 1000):
        cuts = sorted(np.random.RandomState(n).choice(3000, n, replace=False).tolist())
        found = spark.range(3000).select("id", R.range_of(F.struct(F.col("id").alias("o0")), [F.struct(F.lit(c).cast("long").alias("o0")) for c in cuts]).alias("r"))
        assert all(r["r"] == np.searchsorted(cuts, r["id"], side="right") for r in found.collect())


def test_rows_go_on_to_the_grid_points_that_they_may_be_in(spark):
    rows = spark.createDataFrame([("m", k, 0.5, 1.0, k == 0, 0, "A" * 40, 40) for k in range(50)], "msa string, row_id long, similarity double, weight double, __query boolean, __tie long, sequence string, __length int")
    points = [(100, 1.0, False, 1), (100, 0.4, False, 1), (420, 1.0, True, 1), (420, 1.0, True, 2)]
    found = P._within_budget(rows.coalesce(1), points, "msa", "row_id").select("row_id", F.explode("__at").alias("at")).select("row_id", "at.*").collect()
    per = {k: sum(r["__point"] == k for r in found) for k in range(4)}
    assert per == {0: 3, 1: 0, 2: 11, 3: 11}
    assert not any(r["row_id"] == 0 for r in found if r["__point"] > 1)
    assert all(r["__key"] > 0 for r in found)


def test_windows_of_texts(spark, tmp_path):
    texts = [None, "", "123 !", "é ß a-b", "x" * 240, "Ab1" * 300, "ÀZ" * 500, "q" * 241]
    docs = spark.createDataFrame([("s" if k % 3 else None, k, t) for k, t in enumerate(texts)], "source string, doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    wanted = set()
    for k, t in enumerate(texts):
        t = re.sub("[^A-Za-z]", "", t or "").upper()
        wanted |= {(("s/" if k % 3 else "") + str(i // 240), k, t[i : i + 240].ljust(240, "-")) for i in range(0, len(t), 240)}
    assert {tuple(r) for r in aln(spark, str(tmp_path)).collect()} == wanted
