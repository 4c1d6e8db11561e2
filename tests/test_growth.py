"""What grows with the input stays out of joins, checkpoints and workers' memory."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_homology import by_pairs, clustered
from test_operators import slow_counts

from seqloom.functions import alphabets as A
from seqloom.operators import bounds, pair_counts, scoring
from seqloom.operators import homology as H
from seqloom.operators import training as T
from seqloom.plans import catalog, file_queries
from seqloom.sources import structures

SMALL = "/root/testdata/sf0.001"


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_references_join_segments_and_never_broadcast_their_positions(spark):
    """The tables are far under the broadcast threshold here, as compressed long texts may seem to be."""
    plan = plan_of(catalog.QUERIES["query_refs"](spark, SMALL))
    assert "BroadcastExchange" not in plan and plan.count("SortMergeJoin") == 1


def test_references_bring_the_token_referred_to(spark):
    encoder = spark.createDataFrame([(1, 0, [5, 24]), (1, 1, [7])], "batch_id long, segment long, tokens array<int>")
    decoder = spark.createDataFrame([(1, 0, 3, 0), (1, 1, 1, None)], "batch_id long, segment long, length int, query_segment long")
    found = T.query_refs(encoder, decoder, value=True).orderBy("y_pos").collect()
    assert [tuple(r) for r in found] == [(1, 0, 0, True, 5), (1, 1, 1, False, 24), (1, 2, -100, False, None), (1, 3, -100, False, None)]


@pytest.mark.parametrize("tile, most", [(1 << 16, 8), (40, 8), (10, 4)])
def test_tiles_and_blocks_of_large_alignments_equal_all_pairs(spark, tile, most):
    rows = clustered(6, 14, 40) + [("n", 1000 + k, a) for k, (_, _, a) in enumerate(clustered(1, 20, 33, seed=2))]
    df = spark.createDataFrame([*rows, rows[0], rows[0]], "msa string, row_id long, aligned string")
    found = bounds.bounded_neighbors(df, 0.2, "-", "msa", "aligned", "row_id", block=8, tile=tile, most=most)
    keyed = df.withColumn("digest", bounds.row_digest(bounds.alignment_key(df, "msa"), F.col("aligned"))).join(found, "digest").collect()
    assert sorted((r["row_id"], r["neighbors"]) for r in keyed) == by_pairs([*rows, rows[0], rows[0]], 0.2)
    first = {m: min((k, a) for n, k, a in rows if n == m)[1] for m in "mn"}
    assert all(abs(r["similarity"] - sum(x == y for x, y in zip(r["aligned"], first[r["msa"]], strict=True)) / len(r["aligned"])) < 1e-9 for r in keyed)


@pytest.mark.parametrize("name", ["neighbor_counts", "homology_weights", "sample_msa", "sample_context"])
def test_texts_of_alignments_are_checkpointed_nowhere(spark, name, monkeypatch):
    kept = []
    monkeypatch.setattr(bounds, "cut", lambda df, f=bounds.cut: (kept.append(df.columns), f(df))[1])
    catalog.QUERIES[name](spark, SMALL)
    assert kept and not any("__aligned" in columns or "aligned" in columns for columns in kept)


def test_structures_of_more_residues_than_a_file_can_number(spark):
    whole, split = (sorted(map(tuple, frame.collect())) for frame in (file_queries.pdb_source(spark, SMALL), file_queries.pdb_source(spark, SMALL, 21)))
    assert whole == split and len({r[1] for r in split}) > 21


def test_rows_of_a_structure_file_come_as_they_are_parsed():
    """The first rows are there before what follows them is looked at."""
    text = "data_x\nloop_\n_a.k\n_a.v\n" + "1 'x y'\n" * 50_000 + "#\n_b.k 7\n"
    rows = structures._table_rows(text)
    assert next(rows) == ("_a", {"k": "1", "v": "x y"})
    assert rows.gi_frame.f_locals["values"] == ["1", "x y"]  # the row just given, no other
    assert sum(1 for _ in rows) == 50_000  # the others, and the single value's row


def test_a_scorer_sees_slices_of_a_batch_only(spark):
    """No more rows than a slice become Python objects; null scores and other columns stay."""
    df = spark.range(1000).selectExpr("id", "repeat('A', 10) AS s", "array(id) AS more").coalesce(1)
    found = scoring.score_with(df, lambda rows: rows["id"].where(rows["id"] % 2 == 0) + 0 * len(rows), batch=64)
    assert "MapInArrow" in plan_of(found) and found.filter("logp IS NULL").count() == 500 and found.filter("more[0] = id AND logp = id").count() == 500


def test_several_alphabets_at_once_equal_each(spark):
    df = spark.createDataFrame([("ARND-X\U0001f642é~",), ("",), (None,)], "s string")
    for alphabet in (A.MAIN, A.DNA, A.REDUCED, A.twenty_one(gap=True)):
        both = df.select(A.encode_each(F.col("s"), {"a": alphabet})["a"].alias("a"), A.encode(F.col("s"), alphabet).alias("b")).collect()
        assert all(r["a"] == r["b"] for r in both)
        texts = df.select(A.encode_each(F.col("s"), {"a": alphabet}, " ")["a"].alias("a"), F.array_join(A.encode(F.col("s"), alphabet).cast("array<string>"), " ").alias("b")).collect()
        assert all(r["a"] == r["b"] for r in texts)
        again = df.select(A.recode(F.col("s"), alphabet).alias("a"), A.decode(A.encode(F.col("s"), alphabet), alphabet).alias("b")).collect()
        assert all(r["a"] == r["b"] for r in again)
    assert "ArrowEvalPython" in plan_of(catalog.QUERIES["encode_tokens"](spark, SMALL))


@pytest.mark.parametrize("tile", [1 << 16, 30, 7])
def test_statistics_of_tiles_equal_all_pairs(spark, tile):
    table = clustered(5, 14, 40) + [("n", 1000 + k, a) for k, (_, _, a) in enumerate(clustered(1, 20, 33, seed=2))] + [(None, 7, "AB"), (None, 8, "AB"), ("o", 9, "-é")]
    df = spark.createDataFrame(table, "msa string, row_id long, aligned string")
    found = [tuple(r) for r in H.row_statistics(df, 0.2, tile=tile).select("msa", "row_id", "neighbors", "matches", "best_other").collect()]
    assert sorted(found, key=repr) == slow_counts(table, 0.2)


def test_rows_of_an_alignment_move_once_for_each_tile(spark, monkeypatch):
    """1,500 rows are one tile, so no row meets others in more than one task."""
    given = []
    monkeypatch.setattr(H, "whole_keys", lambda *a: given.append(a))
    rows = [("m", k, f"{k:011b}".replace("0", "A").replace("1", "C")) for k in range(1500)]
    df = spark.createDataFrame(rows, "msa string, row_id long, aligned string")
    tasks = H.row_statistics(df)
    assert "MapInArrow" in plan_of(tasks) and "MapInPandas" not in plan_of(tasks) and not given
    bits = np.array([[c == "A" for c in a] for _, _, a in rows])
    ones = bits.sum(axis=0)
    wanted = {k: int(sum(ones[c] if b else 1500 - ones[c] for c, b in enumerate(row))) for k, row in enumerate(bits)}
    assert {r["row_id"]: r["matches"] for r in tasks.collect()} == wanted and tasks.filter("best_other <> 10 OR neighbors < 2").count() == 0


@pytest.mark.parametrize("width, letters, theta", [(60, 4, 0.2), (300, 3, 0.5), (7, 2, 0.0), (7, 2, 1.0)])
@pytest.mark.parametrize("side, strip", [(64, 8), (128, 64), (1 << 14, 1 << 14)])
def test_counts_by_bits_equal_all_pairs(width, letters, theta, side, strip, monkeypatch):
    for name, value in (("LEAF", 16), ("PAY", 1), ("SIDE", side), ("STRIP", strip)):
        monkeypatch.setattr(pair_counts, name, value)
    deal = np.random.RandomState(width)
    codes = deal.randint(0, letters + 1, (300, width)).astype(np.uint8)
    codes[50:100] = codes[:50]
    codes[50:100, deal.randint(width)] = 2
    codes[deal.rand(300) < 0.3, width // 2 :] = 0
    codes[:, 0] = 1
    codes = np.unique(codes, axis=0)
    deal.shuffle(codes)
    copies, length = deal.randint(1, 3, len(codes)).astype(np.int64), (codes != 0).sum(axis=1)
    same = ((codes[:, None] == codes[None]) & (codes != 0)[:, None]).sum(axis=2)
    for second in (None, deal.rand(len(codes)) < 0.4):
        meet = np.full(same.shape, True) if second is None else second[:, None] != second[None]
        most = np.where(meet, same, -1)
        if second is None:
            np.fill_diagonal(most, np.where(copies > 1, length, -1))
        neighbors, matches, best = pair_counts.pair_totals(codes, copies, second, 0, theta)
        assert (neighbors == ((1 - same / length[:, None] <= theta) & meet) @ copies).all()
        assert (matches == (same * meet) @ copies).all() and (best == most.max(axis=1)).all()
