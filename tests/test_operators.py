"""Operators on small cases that can be worked by hand or by a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from seqloom.functions import geometry as G
from seqloom.functions import sequences as Q
from seqloom.operators import bounds as B
from seqloom.operators import clusters as C
from seqloom.operators import homology as H
from seqloom.operators import sampling as P
from seqloom.operators import scoring as S
from seqloom.operators import structures as R
from seqloom.operators import training as T


def check_widths(rows, **settings):
    return Q.check_alignment(rows, "msa", "aligned", **settings)


def pairs(rows, *columns):
    return sorted(tuple(r[c] for c in columns) for r in rows.collect())


def test_neighbor_counts_are_asymmetric(spark):
    rows = spark.createDataFrame([("m", 0, "ABC"), ("m", 1, "ABA"), ("m", 2, "A-C"), ("m", 3, "AB-"), ("n", 4, "ABC")], "msa string, row_id long, aligned string")
    assert pairs(H.neighbor_counts(rows, 0.2), "row_id", "neighbors") == [(0, 1), (1, 1), (2, 2), (3, 3), (4, 1)]


def test_gap_only_rows_raise(spark):
    rows = spark.createDataFrame([("m", 0, "--"), ("m", 1, "AB")], "msa string, row_id long, aligned string")
    with pytest.raises(Exception, match="gaps only"):
        H.neighbor_counts(rows).collect()


@pytest.mark.parametrize("block", [2, 3, 1000])
def test_blocks_do_not_change_counts(spark, block):
    rng = random.Random(4)
    table = [("m", i, "".join(rng.choice("AB-") for _ in range(6)) + "A") for i in range(40)]
    near = lambda a, b: 1 - sum(x == y != "-" for x, y in zip(a, b, strict=True)) / sum(x != "-" for x in a) <= 0.3
    wanted = [(i, sum(near(a, b) for _, _, b in table)) for _, i, a in table]
    rows = spark.createDataFrame(table, "msa string, row_id long, aligned string")
    assert pairs(H.neighbor_counts(rows, 0.3, block=block), "row_id", "neighbors") == wanted


def test_weights_sum_to_one(spark):
    rows = spark.createDataFrame([("m", i, "AB" + "ABC"[i % 3]) for i in range(9)], "msa string, row_id long, aligned string")
    found = H.homology_weights(rows).collect()
    assert abs(sum(r["weight"] for r in found) - 1) < 1e-12 and abs(found[0]["n_eff"] - 3) < 1e-12


def test_weighted_order_draws_by_weight(spark):
    rows = spark.range(4000).select(F.col("id").alias("g"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("r")).withColumn("k", F.concat_ws("-", "g", "r"))
    first = P.order_weighted(rows, ["g"], "k", F.lit(1.0) + F.col("r"), 3).filter("ord = 0").groupBy("r").count()
    share = {r["r"]: r["count"] / 4000 for r in first.collect()}
    assert all(abs(share[r] - (1 + r) / 6) < 0.03 for r in range(3))


def test_budget_stops_at_the_first_overflow(spark):
    rows = spark.createDataFrame([("p", 0, 3), ("p", 1, 10), ("p", 2, 1)], "p string, o int, n int")
    assert pairs(P.token_budget(rows, ["p"], [F.col("o")], F.col("n"), 12), "o") == [(0,)]


@pytest.mark.parametrize("lengths", [[10, 20], [100, 3], [28, 5], [27, 1], [29], [25, 1, 1]])
def test_truncating_budget_equals_a_loop(spark, lengths):
    limit, base = 40, "B" * 6
    homologs = [chr(65 + k) * n for k, n in enumerate(lengths)]
    left, out, taken = limit - len(base) - 2, ["$" + base + "*"], 0
    for h in homologs:
        if left - len(h) - 2 < 1:
            if left - 3 > 0:
                out.append("$" + h[: left - 3] + "*")
                taken += 1
            break
        out.append("$" + h + "*")
        left -= len(h) + 2
        taken += 1
    text = "".join(out)
    text = text[: limit - 1] + "*" if len(text) >= limit else text
    rows = spark.createDataFrame([("s", k, h, base) for k, h in enumerate(homologs)], "s string, o int, t string, b string")
    assert pairs(P.truncating_budget(rows, "s", "o", "t", "b", limit), "assembled", "n_homologs") == [(text, taken)]


def test_draws_follow_probabilities(spark):
    records = spark.createDataFrame([("s", "a", 0.5), ("s", "b", 0.3), ("s", "c", 0.2)], "seed string, member string, probability double")
    found = {r["member"]: r["count"] for r in P.weighted_draws(records, 3000, 1).groupBy("member").count().collect()}
    assert sum(found.values()) == 3000 and abs(found["a"] - 1500) < 120 and abs(found["c"] - 600) < 90


def test_prompt_grid_counts_repeats(spark):
    grid = P.prompt_grid(spark, [6144, 6144], [1.0], [True], [False, True])
    assert pairs(grid, "ord", "seed_offset") == [(0, 0), (1, 0), (2, 1), (3, 1)]


def test_forced_row_leads(spark):
    rows = spark.createDataFrame([("m", i, a) for i, a in enumerate(["AAAA", "AAAB", "ABCD", "AACD"])], "msa string, row_id long, aligned string")
    for method in ("top", "random", "weighted"):
        got = P.sample_msa(rows, method, max_similarity=0.6, force_include_first=True).orderBy("ord").collect()
        assert got[0]["row_id"] == 0 and {r["row_id"] for r in got} == {0, 2, 3}
    assert P.sample_msa(rows, "top", max_similarity=0.6).filter("row_id = 0").count() == 0


def test_cluster_type_is_strict(spark):
    rows = spark.createDataFrame([(2, 2), (2, 1), (1, 2), (1, 1)], "a int, b int")
    kinds = [r["k"] for r in rows.select(C.cluster_type(F.col("a"), F.col("b")).alias("k")).collect()]
    assert kinds == ["finished", "invalid", "not finished", "invalid"]


def test_cluster_stats_equal_their_join_form(spark):
    rows = spark.createDataFrame([("r", "SARRAH1"), ("r", "SARRAH1"), ("r", "x"), ("q", "y")], "a string, b string")
    table = C.cluster_pairs(rows)
    assert pairs(C.cluster_stats(table), "rep", "n_total", "n_struct") == pairs(C.cluster_stats_by_join(table), "rep", "n_total", "n_struct") == [("q", 1, 0), ("r", 2, 1)]


def test_later_atoms_win_and_scores_need_all_three(spark):
    atoms = spark.createDataFrame(
        [(1, "N", 1.0, 0), (1, "CA", 2.0, 1), (1, "CA", 3.0, 2), (1, "C", 4.0, 3), (2, "CA", 5.0, 4)], "res int, atom string, v double, ord long"
    ).withColumns({k: F.col("v") for k in ("x", "y", "z", "b_iso")})
    found = {r["res"]: r for r in R.backbone(atoms, ["res"]).collect()}
    assert found[1]["ca"]["x"] == 3.0 and found[1]["score"] == 3.0
    assert found[2]["score"] is None and found[2]["ca"]["x"] == 5.0 and found[2]["n"] is None


def test_chain_resolution(spark):
    scheme = spark.createDataFrame([("s", "A")], "structure_id string, asym_id string")
    labels = spark.createDataFrame([("s", "X", "A")], "structure_id string, auth string, label string")
    ask = lambda c: R.resolve_chain(scheme, labels, spark.createDataFrame([("s", c)], "structure_id string, chain string")).first()["label"]
    assert ask("A") == "A" and ask("X") == "A"
    with pytest.raises(Exception, match="no chain Z"):
        ask("Z")


def test_local_distances_of_ends_are_missing(spark):
    rows = spark.createDataFrame([("c", i, float(i)) for i in range(3)], "chain string, pos int, v double")
    for k, name in enumerate(("n", "ca", "c")):
        rows = rows.withColumn(name, F.struct((F.col("v") * 3 + k).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z")))
    found = {r["pos"]: r["local"] for r in R.local_backbone_distances(rows, "chain").collect()}
    assert found[0] is None and found[2] is None
    assert found[1] == [float(j - i) for i in range(9) for j in range(i + 1, 9)]


def test_spliced_record(spark):
    one = spark.createDataFrame([("$AB*CD*", "WXY", [1.0, 2.0, 3.0])], "s string, t string, v array<double>")
    row = one.select(T.splice_structured(F.col("s"), F.col("t")).alias("f"), F.col("v")).select("f", T.splice_values(F.col("v"), F.length("f")).alias("w")).first()
    assert row["f"] == "$WXY*CD*" and row["w"] == [None, 1.0, 2.0, 3.0, None, None, None, None]


def test_empty_prompt_is_one_mask(spark):
    prompts = spark.createDataFrame([(1,), (2,)], "p int")
    segments = spark.createDataFrame([(1, 1, [5, 6]), (1, 0, [4])], "p int, o int, tokens array<int>")
    assert pairs(T.concat_prompt(prompts, segments, "p", "o"), "p", "tokens", "segment_sizes") == [(1, [4, 5, 6], [1, 2]), (2, [24], [1])]


def test_pad_and_unpad_are_inverse(spark):
    rows = spark.createDataFrame([(0, 1, [1, 2, 3]), (0, 2, [4])], "batch int, k int, tokens array<int>")
    padded = T.pad_batch(rows, "batch")
    assert pairs(padded, "k", "tokens", "segment_size") == [(1, [1, 2, 3], 3), (2, [4, 24, 24], 1)]
    assert pairs(T.pad(T.unpad(padded, ["k"]), ["k"]), "k", "tokens") == [(1, [1, 2, 3]), (2, [4, 0, 0])]


def test_mixing_one_prompt_changes_nothing(spark):
    rows = spark.createDataFrame([(0, -1.0, -0.5), (1, -1.0, -1.5)], "t int, p double, v double")
    for method in ("arithmetic", "geometric"):
        assert [(t, round(m, 9)) for t, m in pairs(S.mix_next_token(rows, ["t"], F.col("p"), F.col("v"), method=method), "t", "mixed")] == [(0, -0.5), (1, -1.5)]
    with pytest.raises(ValueError, match="unknown method"):
        S.mix_next_token(rows, ["t"], F.col("p"), F.col("v"), method="median")


def test_top_p_keeps_the_prefix_that_reaches_the_mass(spark):
    rows = spark.createDataFrame([(0, 0, 0.0), (0, 1, 0.0), (0, 2, -50.0)], "g int, t int, l double")
    assert [t for t, _ in pairs(S.filter_tokens(rows, ["g"], "t", F.col("l"), top_p=0.9), "t", "probability")] == [0, 1]
    assert [t for t, _ in pairs(S.filter_tokens(rows, ["g"], "t", F.col("l"), top_k=1), "t", "probability")] == [0]


def test_loss_over_an_empty_mask_is_zero(spark):
    rows = spark.createDataFrame([([0.0, 1.0], 0)], "l array<double>, t int")
    assert S.masked_cross_entropy(rows, F.col("l"), F.col("t"), F.lit(False)).first()["loss"] == 0.0


def test_wild_type_row_goes(spark):
    rows = spark.createDataFrame([("a", 3.0), ("WT", 1.0)], "variant_id string, score double")
    assert pairs(S.wt_delta(rows, F.col("variant_id") == "WT"), "variant_id", "delta") == [("a", 2.0)]


def slow_counts(table, theta):
    """(alignment, row, neighbors, matches, best other) by a plain loop over pairs."""
    out = []
    for m, i, a in table:
        same = [(j, sum(x == y != "-" for x, y in zip(a, b, strict=True))) for n, j, b in table if n == m]
        own = sum(x != "-" for x in a)
        others = [s for k, (j, s) in enumerate(same) if j != i]
        out.append((m, i, sum(1 - s / own <= theta for _, s in same), sum(s for _, s in same), max(others, default=None)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_row_ids_repeat_in_other_alignments_and_alignments_may_be_null(spark, kind):
    rng = random.Random(13)
    name = (lambda i: i) if kind == "long" else (lambda i: f"row {i}")
    table = [(m, name(i), "".join(rng.choice("ABé🙂-") for _ in range(5)) + "A") for m, n in (("A", 9), ("B", 7), (None, 5), ("C", 1)) for i in range(n)]
    rows = spark.createDataFrame(table, f"msa string, row_id {kind}, aligned string")
    found = [tuple(r) for r in H.row_statistics(rows, 0.3, block=3).select("msa", "row_id", "neighbors", "matches", "best_other").collect()]
    assert sorted(found, key=repr) == slow_counts(table, 0.3)
    sums = {r["msa"]: r["w"] for r in H.homology_weights(rows).groupBy("msa").agg(F.sum("weight").alias("w")).collect()}
    assert set(sums) == {"A", "B", "C", None} and all(abs(w - 1) < 1e-9 for w in sums.values())


def test_ragged_alignments_raise(spark):
    rows = spark.createDataFrame([("m", 0, "AB"), ("m", 1, "ABC"), ("n", 0, "A")], "msa string, row_id long, aligned string")
    with pytest.raises(Exception, match="differ in width"):
        H.neighbor_counts(rows).collect()


def test_another_kernel_counts_its_own_matches(spark):
    def gaps_too(a, b, gap):
        return (a[:, None, :] == b[None, :, :]).sum(axis=2)

    rows = spark.createDataFrame([("m", 0, "A--"), ("m", 1, "B--")], "msa string, row_id long, aligned string")
    assert pairs(H.row_statistics(rows, kernel=gaps_too), "row_id", "matches", "best_other") == [(0, 5, 2), (1, 5, 2)]
    assert pairs(H.row_statistics(rows), "row_id", "matches", "best_other") == [(0, 1, 0), (1, 1, 0)]


def test_wide_rows_count_beyond_a_byte():
    a = B.code_matrix(["A" * 700, "AB" * 350], "-")
    assert H.pair_matches(a[0], a[0], a[1]).tolist() == [[700, 350], [350, 700]]


def test_sides_are_padded_with_nulls_and_follow_the_prompt(spark):
    rows = spark.createDataFrame([(0, 1, [1, 2, 3], [0.1, None, 0.3]), (0, 2, [4], [0.4])], "batch int, k int, tokens array<int>, plddt array<double>")
    assert pairs(T.pad_batch(rows, "batch", sides=["plddt"]), "k", "tokens", "plddt") == [(1, [1, 2, 3], [0.1, None, 0.3]), (2, [4, 24, 24], [0.4, None, None])]
    prompts = spark.createDataFrame([(0,), (9,)], "batch int")
    assert pairs(T.concat_prompt(prompts, rows, "batch", "k", sides=["plddt"]), "batch", "tokens", "plddt") == [(0, [1, 2, 3, 4], [0.1, None, 0.3, 0.4]), (9, [24], [None])]


def test_half_precision_equals_numpy(spark):
    import numpy as np

    values = [0.0, 1e-9, 3e-8, 1e-5, 0.1, 1.0, 1.00049, 3.14159, 2049.0, 2051.0, 65519.0, 65521.0, 1e6, *[random.Random(1).uniform(0, 200) for _ in range(50)]]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", G.rounded_to_half(F.col("v")).alias("h")).collect()
    with np.errstate(over="ignore"):
        assert all(r["h"] == float(np.float16(r["v"])) for r in rows)


def test_checks_raise(spark):
    rows = spark.createDataFrame([("m", "AB"), ("m", "ABC"), ("n", "A")], "msa string, aligned string")
    assert pairs(check_widths(rows), "msa", "n_widths") == [("m", 2), ("n", 1)]
    with pytest.raises(Exception, match="alignment m"):
        check_widths(rows, fail=True).collect()
    assert check_widths(rows.filter("msa = 'n'"), fail=True).first()["width"] == 1
    targets = spark.createDataFrame([(3,), (24,), (7,)], "t int")
    assert pairs(S.bad_targets(targets, "t", 5), "t") == [(7,)]
    with pytest.raises(Exception, match="out of range: 7"):
        S.assert_targets(targets, "t", 5).collect()
    assert S.assert_targets(targets.filter("t <> 7"), "t", 5).count() == 2


def test_backbone_atoms_and_lengths(spark):
    rows = spark.createDataFrame([([[[1.0], [2.0], [3.0], [4.0]], [[5.0], [6.0]]],)], "c array<array<array<double>>>")
    assert rows.select(Q.backbone_only(F.col("c")).alias("b")).first()["b"] == [[[1.0], [2.0], [3.0]], [[5.0], [6.0]]]
    scheme = spark.createDataFrame([("s", "A", "2"), ("s", "A", "10"), ("s", "B", "1")], "structure_id string, asym_id string, seq_id string")
    assert pairs(R.seqres_length(scheme), "asym_id", "length") == [("A", 10), ("B", 1)]


def test_homologs_follow_the_parents_distribution(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    seeds = frame([(k,) for k in range(30)] + [(99,)], "seed long")
    parents = frame([(k, "p" if k < 20 else "q") for k in range(30)], "seed long, parent string")
    clusters = frame([("p", 1), ("p", 2), ("q", 3)], "parent string, cluster int")
    members = frame([(1, "a"), (2, "b"), (2, "c"), (3, "d")], "cluster int, member string")
    draws = P.sample_homologs(seeds, parents, clusters, members, k=100)
    found = {(r["s"], r["member"]): r["count"] for r in draws.groupBy((F.col("seed") < 20).alias("s"), "member").count().collect()}
    assert found[(False, "d")] == 1000 and sum(n for (s, _), n in found.items() if s) == 2000
    assert abs(found[(True, "a")] - 1000) < 120 and abs(found[(True, "b")] - 500) < 100
    assert draws.filter("seed = 99").count() == 0 and draws.groupBy("seed").count().filter("count <> 100").count() == 0
