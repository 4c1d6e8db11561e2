"""Neighbours by bounds against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import bounds as B
from seqloom.operators import homology as H


def by_pairs(rows, theta):
    """(row, neighbors) by a plain loop; rows (msa, row, aligned)."""
    near = lambda a, b: 1 - sum(x == y != "-" for x, y in zip(a, b, strict=True)) / sum(x != "-" for x in a) <= theta
    return sorted((r, sum(near(a, b) for n, _, b in rows if n == m)) for m, r, a in rows)


def clustered(families, members, width, seed=1, letters="ACDEFGHIKLMNPQRSTVWY"):
    """Families of near copies of random rows, with gaps."""
    deal = np.random.RandomState(seed)
    rows = []
    for _ in range(families):
        first = deal.choice(list(letters), width)
        for _ in range(members):
            own = first.copy()
            own[deal.choice(width, width // 8, replace=False)] = deal.choice(list(letters), width // 8)
            own[deal.choice(width, deal.randint(0, width // 5), replace=False)] = "-"
            rows.append("".join(own))
    deal.shuffle(rows)
    return [("m", k, r) for k, r in enumerate(rows)]


KIND = "msa string, row_id long, aligned string"


@pytest.mark.parametrize("block", [8, 40, 1024])
@pytest.mark.parametrize("theta", [0.2, 0.0, 0.6])
def test_bounded_neighbors_equal_all_pairs(spark, block, theta):
    rows = clustered(12, 14, 60) + [("n", 1000 + k, a) for k, (_, _, a) in enumerate(clustered(1, 30, 33, seed=2))] + [("o", 5000, "A"), ("o", 5001, "B"), ("o", 5002, "B")]
    df = spark.createDataFrame(rows, KIND)
    found = sorted((r["row_id"], r["neighbors"]) for r in H.neighbor_counts(df, theta, block=block).collect())
    assert found == by_pairs(rows, theta)


def test_gaps_widen_no_bound(spark):
    """A row of few letters takes rows that share little else for neighbours."""
    deal = np.random.RandomState(7)
    rows = [("m", k, "".join(deal.choice(list("AB-"), 12, p=[0.3, 0.2, 0.5])) + "A") for k in range(150)]
    df = spark.createDataFrame(rows, KIND)
    assert sorted((r["row_id"], r["neighbors"]) for r in H.neighbor_counts(df, 0.3, block=10).collect()) == by_pairs(rows, 0.3)


def test_few_pairs_of_a_clustered_alignment_are_compared(spark):
    rows = clustered(24, 50, 120)
    df = spark.createDataFrame(rows, KIND)
    _, folded = B.folded_rows(df, "msa", "aligned")
    pairs = B.possible_pairs(B.blocked(folded, "-", 128), 0.2, "-")
    begun = pairs.agg(F.sum("pairs")).first()[0]
    assert 5 * begun < folded.count() ** 2
    found = sorted((r["row_id"], r["neighbors"]) for r in H.neighbor_counts(df, block=128).collect())
    assert found == sorted((r["row_id"], r["neighbors"]) for r in H.neighbor_counts(df, block=128, kernel=H.pair_matches).collect())


def test_rows_of_one_block_drop_out():
    """Two blocks that may meet: only rows that can reach the other block are compared."""
    first = [a for _, _, a in clustered(1, 20, 80, seed=3)]
    other = [a for _, _, a in clustered(5, 20, 80, seed=4)]
    codes, gap = B.code_matrix(first + other + first[:2], "-")
    ones = lambda n: np.ones(n, np.int64)
    a, b = codes[:20], codes[20:]
    of_a, of_b, begun = B.near_weights(a, b, ones(len(a)), ones(len(b)), gap, 0.2)
    same = np.array([[np.sum((x == y) & (x != gap)) for y in b] for x in a])
    assert (of_a == (1 - same / (a != gap).sum(axis=1)[:, None] <= 0.2).sum(axis=1)).all()
    assert (of_b == (1 - same / (b != gap).sum(axis=1)[None, :] <= 0.2).sum(axis=0)).all()
    assert begun < len(a) * len(b) / 5


@pytest.mark.parametrize("theta", [0.0, 0.1, 0.2, 0.3, 0.7, 1.0])
def test_least_matches_follow_the_rule(theta):
    lengths = np.arange(1, 400)
    least = B.least_matches(lengths, theta)
    for n, m in zip(lengths, least, strict=True):
        assert m == min((k for k in range(n + 1) if 1 - k / n <= theta))


def test_weights_keep_every_row(spark):
    rows = [(None, 1, "ABCD"), (None, 1, "ABCD"), ("m", 1, "ABCE"), ("m", 2, "WXYZ"), ("m", 1, "ABCE"), ("m", None, "ABC-")]
    df = spark.createDataFrame(rows, KIND)
    found = H.weighted_rows(df).collect()
    assert sorted((tuple(r)[:3] for r in found), key=repr) == sorted(rows, key=repr)
    assert {r["msa"]: round(sum(x["weight"] for x in found if x["msa"] == r["msa"]), 9) for r in found} == {None: 1.0, "m": 1.0}
