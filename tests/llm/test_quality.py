"""The ordinal classifier: gradients, held-out accuracy, defined results for odd input."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from seqloom.llm import quality as Q

WORDS = [f"w{i}" for i in range(60)]


def sample(n, seed):
    rng, texts, grades = random.Random(seed), [], []
    for _ in range(n):
        grade = rng.randrange(3)
        words = [rng.choice(WORDS) for _ in range(60)]
        if grade == 0:
            words = [w.upper() + "!!" for w in words]
        if grade == 1:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["rude", "nasty", "vile"])
        texts.append(" ".join(words))
        grades.append(grade)
    return texts, np.array(grades)


def test_held_out_accuracy_and_order():
    model = Q.fit(*sample(900, 1))
    texts, grades = sample(400, 2)
    tails = model.tails(pa.array(texts), {})
    assert (np.diff(model.thresholds) > 0).all()
    assert ((tails > 0.5).sum(axis=1) == grades).mean() > 0.95
    assert (tails[:, 0] >= tails[:, 1]).all()


def test_driver_labels_are_learnt(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held_out = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = Q.fit_on(docs, labels.filter(~held_out), F.expr(Q.LABEL_GRADE))
    rows = docs.join(labels.filter(held_out), "doc_id").withColumn("s", Q.scorer(model, spark)(F.col("text"))).select("quality", "toxic", "s.tail_prob").collect()
    good = [r["tail_prob"] >= Q.LEAST_TAIL for r in rows if r["quality"] == 1 and r["toxic"] == 0]
    junk = [r["tail_prob"] >= Q.LEAST_TAIL for r in rows if r["quality"] == 0]
    assert sum(good) / len(good) > 0.97 and sum(junk) / len(junk) < 0.2


def test_odd_input_has_scores(spark):
    model = Q.fit(*sample(60, 3), rounds=20)
    frame = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 200_000), (4, "é 🙂"), (4, "é 🙂")], "doc_id long, text string").withColumns({"score": F.lit(1), "tail_prob": F.lit(2)})
    rows = frame.select("doc_id", Q.scorer(model, spark)(F.col("text")).alias("s")).select("doc_id", "s.*").collect()
    assert len(rows) == 5 and all(0 <= r["tail_prob"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in rows)
    assert rows[0][1:] == rows[1][1:] and rows[3] == rows[4]
    assert Q.select_quality(frame, model, least_tail=0.0).columns == frame.columns
    assert Q.select_quality(frame.limit(0), model).count() == 0


def test_no_ratings_still_fit(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    ratings = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = Q.fit_on(docs, ratings, F.expr(Q.LABEL_GRADE))
    assert Q.scorer(model, spark)(F.col("text")) is not None and (model.weights == 0).all()


def test_samples_are_bounded_and_repeatable(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    ratings = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    draw = lambda frame: sorted(map(tuple, Q.rated_sample(frame, ratings.union(ratings), F.expr(Q.LABEL_GRADE), rows=100).collect()))
    first = draw(docs)
    assert 50 < len(first) < 150 and first == draw(docs.repartition(3))


def test_slopes_equal_differences_of_the_loss():
    rng = np.random.RandomState(3)
    row, at, value = np.repeat(np.arange(12), 3), rng.randint(0, 6, 36), rng.rand(36)
    grades = np.array([0, 1, 2, 3] * 3)
    weights, first, gaps = rng.randn(6), -0.4, rng.randn(2)
    _, d_weights, d_first, d_gaps = Q.loss_and_slopes(weights, first, gaps, row, at, value, grades)
    loss = lambda w, f, g: Q.loss_and_slopes(w, f, g, row, at, value, grades)[0]
    h = 1e-6
    for k in range(6):
        step = np.eye(6)[k] * h
        assert abs((loss(weights + step, first, gaps) - loss(weights - step, first, gaps)) / (2 * h) - d_weights[k]) < 1e-7
    assert abs((loss(weights, first + h, gaps) - loss(weights, first - h, gaps)) / (2 * h) - d_first) < 1e-7
    for k in range(2):
        step = np.eye(2)[k] * h
        assert abs((loss(weights, first, gaps + step) - loss(weights, first, gaps - step)) / (2 * h) - d_gaps[k]) < 1e-7


def test_loss_equals_the_likelihood_by_hand():
    loss, *_ = Q.loss_and_slopes(np.array([2.0]), 0.0, np.array([0.0]), np.array([0, 1]), np.array([0, 0]), np.array([1.0, -1.0]), np.array([2, 0]))
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    assert abs(loss - (-np.log(sigmoid(2.0 - 1.0)) - np.log(1 - sigmoid(-2.0))) / 2 - Q.RIDGE / 2 / 2 * 4) < 1e-9


def test_only_telling_features_get_weights():
    texts, grades = sample(900, 1)
    grades = (grades == 2).astype(np.int64)
    row, col, value = Q.features(pa.array(texts), {})
    found = Q.evidence(row, col, grades, 2) > 0
    rude = [Q._features_of(w)[0] for w in ("rude", "nasty", "vile")]
    assert all(found[k] for k in rude)
    noise = np.random.RandomState(0).permutation(grades)
    assert (Q.evidence(row, col, noise, 2) > 0).sum() <= 1


def test_insults_are_rejected_and_clean_documents_stay(spark):
    """Held-out figures on the driver's ratings, with few and with many rows to learn from."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held_out = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    rated = docs.join(labels.filter(held_out), "doc_id")
    for rows, most in ((300, 0.5), (8000, 0.2)):
        model = Q.fit_on(docs, labels.filter(~held_out), F.expr(Q.LABEL_GRADE), rows=rows)
        found = rated.select("quality", "toxic", (Q.scorer(model, spark)(F.col("text"))["tail_prob"] >= Q.LEAST_TAIL).alias("kept")).collect()
        share = lambda q, t: np.mean([r["kept"] for r in found if (r["quality"], r["toxic"]) == (q, t)])
        assert share(1, 0) > 0.98 and share(0, 0) < 0.2 and share(1, 1) < most, (rows, share(1, 0), share(0, 0), share(1, 1))


def test_forms_of_a_word_share_its_stem():
    first, second, short = (Q._features_of(w) for w in ("Réeuxment,", "réeuxpa", "Réeu"))
    assert first[0] != second[0] and first[2] == second[2] >= 0 and short[2:] == (-1, -1, -1) and second[2:].count(-1) == 1
    row, col, value = Q.features(pa.array(["réeuxment réeuxpa réeuxpa", None]), {})
    assert value[(row == 0) & (col == first[2])].tolist() == [1.0]
    shape = Q._features_of("réeuxpa")[1]
    assert value[(row == 0) & (col == shape)].tolist() == [4.0]


def test_white_space_of_any_kind_parts_words():
    one, other = (Q.features(pa.array([t]), {}) for t in ("some words here", "some\twords\vhere"))
    assert sorted(zip(*one, strict=True)) == sorted(zip(*other, strict=True))


def test_ids_of_two_types_match(spark):
    docs = spark.range(400).select(F.col("id").cast("int").alias("doc_id"), F.col("id").cast("string").alias("text"))
    for kind in ("long", "string"):
        ratings = docs.select(F.col("doc_id").cast(kind).alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
        for rows in (200, 400):
            assert abs(Q.rated_sample(docs, ratings, F.expr(Q.LABEL_GRADE), rows=rows).count() - rows) < 60


def test_few_ratings_single_out_what_is_wrong(spark):
    """On the smallest tables most documents rated bad are told from clean ones."""
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = Q.fit_on(docs, labels, F.expr(Q.LABEL_GRADE))
    found = docs.join(labels, "doc_id").select("quality", "toxic", (Q.scorer(model, spark)(F.col("text"))["tail_prob"] >= Q.LEAST_TAIL).alias("kept")).collect()
    share = lambda q, t: np.mean([r["kept"] for r in found if (r["quality"], r["toxic"]) == (q, t)])
    assert share(1, 0) > 0.97 and share(0, 0) < 0.3 and share(1, 1) < 0.5
