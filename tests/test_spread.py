"""Running sums, places, budgets and draws that are spread inside groups."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.operators import sampling as P
from seqloom.operators import spread as R


def by_loop(rows):
    """rows (group, place, value): running sums of each group."""
    out, total = [], {}
    for g, o, v in sorted(rows, key=lambda r: (repr(r[0]), r[1] is not None, r[1] or 0, r[2])):
        total[g] = total.get(g, 0) + v
        out.append((g, o, v, total[g]))
    return sorted(out, key=repr)


def table(spark, n=600):
    rng = random.Random(2)
    rows = [("hot" if k % 3 == 0 else rng.choice(["a", "b", None]), None if k % 50 == 1 else rng.randint(-200, 200), rng.randint(0, 9)) for k in range(n)]
    return rows, spark.createDataFrame(rows, "g string, o int, v int").repartition(7)


@pytest.mark.parametrize("range_rows", [5, 60, 100_000])
def test_running_sums_equal_a_loop(spark, range_rows):
    rows, df = table(spark)
    found = R.running(df, ["g"], [F.col("o"), F.col("v")], {"upto": F.col("v")}, range_rows=range_rows)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == by_loop(rows)


@pytest.mark.parametrize("range_rows", [5, 60, 100_000])
def test_bounds_keep_the_same_rows(spark, range_rows):
    rows, df = table(spark)
    found = R.running(df, ["g"], [F.col("o"), F.col("v")], {"upto": F.col("v")}, ("upto", F.lit(100)), range_rows=range_rows)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == [r for r in by_loop(rows) if r[3] - r[2] <= 100]


@pytest.mark.parametrize("range_rows", [5, 100_000])
def test_places_equal_a_window(spark, range_rows):
    _, df = table(spark)
    df = df.withColumn("text", F.concat("g", F.col("o").cast("string"))).filter("g IS NOT NULL")
    window = Window.partitionBy("g").orderBy("text", "o", "v")
    both = R.numbered(df, ["g"], [F.col("text"), F.col("o"), F.col("v")], range_rows=range_rows).withColumn("wanted", (F.row_number().over(window) - 1).cast("bigint"))
    # rows alike in the whole order may change places
    assert sorted(tuple(r) for r in both.select("g", "ord").collect()) == sorted(tuple(r) for r in both.select("g", "wanted").collect())
    alike = both.groupBy("g", "text", "o", "v").agg(F.sort_array(F.collect_list("ord")).alias("a"), F.sort_array(F.collect_list("wanted")).alias("b"))
    assert alike.filter("NOT a <=> b").count() == 0


def test_a_hot_group_runs_in_many_tasks(spark):
    """A group of a third of all rows is no task's alone."""
    n = 30_000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50 + 1).alias("g"), F.hash("id").alias("o"), F.lit(1).alias("v"))
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        placed = R.numbered(df, ["g"], [F.col("o")], range_rows=500)
        tasks = placed.filter("g = 0").groupBy(F.spark_partition_id().alias("p")).agg(F.count("ord").alias("count"), F.max("ord")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    assert len(tasks) >= 12 and max(r["count"] for r in tasks) < 0.25 * n / 3
    assert placed.filter("g = 0").agg(F.countDistinct("ord"), F.max("ord")).first()[:] == (n // 3, n // 3 - 1)


def test_ranges_beyond_the_budget_are_not_sorted(spark):
    df = spark.range(20_000).select(F.lit(1).alias("g"), F.hash("id").alias("o"), F.lit(10).alias("v"))
    ranged, several = R.in_ranges(df, ["g"], [F.col("o")], 500)
    assert several and ranged.select("__range").distinct().count() >= 30
    kept = P.token_budget(df, ["g"], [F.col("o")], F.col("v"), 1200)
    assert kept.count() == 100 and kept.agg(F.max("o")).first()[0] < df.agg(F.expr("percentile(o, 0.006)")).first()[0]


@pytest.mark.parametrize("range_rows", [4, 1_000_000])
def test_draws_of_a_hot_group_follow_weights_in_any_ranges(spark, range_rows):
    """One group has a third of all items; ranges change no draw."""
    items = [("hot" if k % 3 == 0 else f"g{k % 5}", f"m{k:04d}", 1.0 + k % 4) for k in range(240)]
    records = spark.createDataFrame(items, "seed string, member string, probability double")
    found = P.weighted_draws(records, 2000, 4, range_rows=range_rows).collect()
    whole = P.weighted_draws(records, 2000, 4).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, whole))
    hot = [r["member"] for r in found if r["seed"] == "hot"]
    total = sum(w for g, _, w in items if g == "hot")
    share = {w: sum(v == w for m in hot for _, k, v in items if k == m) / 2000 for w in (1.0, 2.0, 3.0, 4.0)}
    assert len(hot) == 2000
    for w, got in share.items():
        assert abs(got - sum(v for g, _, v in items if g == "hot" and v == w) / total) < 0.04


def test_samples_keep_null_alignments_and_repeated_rows(spark):
    rows = [(None, "r1", "ABCD"), (None, "r2", "ABCE"), ("m", "1", "ABCD"), ("m", "1", "WXYZ"), ("m", "2", "ABCD"), ("m", "1", "ABCD"), ("m", None, "QQQQ")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "msa string, row_id string, aligned string, weight string").drop("weight")
    for method in ("top", "random", "weighted"):
        found = P.sample_msa(df, method, seed=1).collect()
        assert sorted(((r["msa"], r["row_id"], r["aligned"]) for r in found), key=repr) == sorted(rows, key=repr)
        assert sorted(((r["msa"], r["ord"]) for r in found), key=repr) == [("m", 0), ("m", 1), ("m", 2), ("m", 3), ("m", 4), (None, 0), (None, 1)]
    top = {(r["msa"], r["ord"]): r["row_id"] for r in P.sample_msa(df, "top").collect()}
    assert [top["m", k] for k in range(5)] == [None, "1", "1", "1", "2"]
    grid = P.prompt_grid(spark, [10_000], [1.0], [True], [False, True])
    context = P.sample_context(df, grid).collect()
    assert len([r for r in context if r["grid_ord"] == 0]) == len(rows)
    assert len([r for r in context if r["grid_ord"] == 1]) == len(rows) - 2  # without each alignment's query


def test_a_kernel_goes_through_sampling(spark):
    rows = [("m", k, a) for k, a in enumerate(["AAAA", "AAAB", "CDEF", "-DEF"])]
    df = spark.createDataFrame(rows, "msa string, row_id long, aligned string")
    none = lambda a, b, gap: ((a[:, None, :] == b[None, :, :]) & (a != gap)[:, None, :]).sum(axis=2) * 0 + (a != gap).sum(axis=1)[:, None]
    from seqloom.operators.homology import homology_weights

    assert {r["neighbors"] for r in homology_weights(df, kernel=none).collect()} == {4}  # with this one all rows are alike
    assert {r["neighbors"] for r in homology_weights(df).collect()} == {1, 2}
    assert P.sample_msa(df, kernel=none).count() == P.sample_context(df, P.prompt_grid(spark, [100], [1.0], [True], [False]), kernel=none).count() == 4
