"""Language identification: its parts against plain loops, and held-out accuracy."""

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from seqloom.llm import language
from seqloom.llm.queries import QUERIES


def test_counts_are_those_of_each_text_alone():
    texts = ["Hello, wörld!", None, "", "12 34", "a", "Ab" * 3000, "Hello, wörld!"]
    found = list(language.gram_counts(pa.array(texts)))
    for text, (features, counts) in zip(texts, found, strict=True):
        letters = "".join(c.lower() if c.isalpha() else " " for c in text or "").split()
        clean = " " + "".join(w + " " for w in letters) if letters else ""
        assert counts.sum() == sum(max(0, len(clean) - k + 1) for k in language.ORDERS)
        assert (np.diff(features) > 0).all()
        (alone,) = language.gram_counts(pa.array([text], pa.string()))
        assert (alone[0] == features).all() and (alone[1] == counts).all()
    assert found[0][0].tolist() == found[-1][0].tolist()


def test_an_update_is_that_of_the_formula():
    leader = language.Leader(2)
    features, values = np.array([3, 7]), np.array([0.6, 0.8])
    leader.learn(features, values, 1)
    leader.learn(features, values, 0)
    # the same by hand: two coordinates, two classes
    z, n = np.zeros((2, 2)), np.zeros((2, 2))
    zb, nb = np.zeros(2), np.zeros(2)

    def weight(pull, squares, l1):
        return 0.0 if abs(pull) <= l1 else -(pull - math.copysign(l1, pull)) / ((language.BETA + math.sqrt(squares)) / language.ALPHA + language.L2)

    for truth in (1, 0):
        w = [[weight(z[i, k], n[i, k], language.L1) for k in range(2)] for i in range(2)]
        b = [weight(zb[k], nb[k], 0.0) for k in range(2)]
        score = [sum(values[i] * w[i][k] for i in range(2)) + b[k] for k in range(2)]
        p = [math.exp(s) / sum(map(math.exp, score)) for s in score]
        for k in range(2):
            error = p[k] - (k == truth)
            for i in range(2):
                g = values[i] * error
                z[i, k] += g - (math.sqrt(n[i, k] + g * g) - math.sqrt(n[i, k])) / language.ALPHA * w[i][k]
                n[i, k] += g * g
            zb[k] += error - (math.sqrt(nb[k] + error * error) - math.sqrt(nb[k])) / language.ALPHA * b[k]
            nb[k] += error * error
    assert np.allclose(leader.pull[features], z) and np.allclose(leader.bias_pull, zb)


def test_weights_are_sparse_and_the_temperature_calibrates():
    deal = np.random.RandomState(1)
    words = {"aa": ["lago", "mira", "sol"], "bb": ["berg", "strand", "zug"]}
    names = [("aa", "bb")[k % 2] for k in range(400)]
    texts = [" ".join(deal.choice(words[n if deal.rand() > 0.2 else ("bb" if n == "aa" else "aa")]) for _ in range(6)) for n in names]
    rows = list(language.gram_counts(pa.array(texts)))
    held = np.zeros(language.DIMENSIONS)
    for features, _ in rows:
        held[features] += 1
    model = language.fit(rows, names, np.log((1 + len(rows)) / (1 + held)) + 1)
    assert 0 < np.count_nonzero(model.weights) < 0.05 * model.weights.size
    found, score = model.predict(pa.array(texts))
    right = np.mean([a == b for a, b in zip(found, names, strict=True)])
    assert right > 0.9 and abs(score.mean() - right) < 0.08
    scores = deal.randn(5000, 2) * 3
    drawn = (deal.rand(5000) < 1 / (1 + np.exp((scores[:, 0] - scores[:, 1]) / 2.5))).astype(int)
    assert abs(language.temperature(scores, drawn) - 2.5) < 0.3


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_held_out_documents_are_identified(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = QUERIES["op11_language"](spark, folder).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.98


def test_odd_rows(spark):
    kind = "doc_id long, text string, lang string, score double, mark int"
    learned = [(k, "der die das und nicht" if k % 2 else "the and of not with", "de" if k % 2 else "en", 0.0, 1) for k in range(40)]
    odd = [(None, None, "xx", 0.0, 1), (50, "", "en", 0.0, 1), (50, "123 ...", None, 0.0, 1), (51, "the of " * 100_000, None, 0.0, 1), (51, "́", "de", 0.0, 1)]
    df = spark.createDataFrame(learned + odd, kind)
    model = language.fit_on(df)
    assert set(model.languages) <= {"de", "en"}
    rows = [(r["doc_id"], r["language"]["lang"], r["language"]["score"]) for r in language.identify(df, model).collect()]
    assert len(rows) == 45 and [r[1] for r in rows[:40]] == ["de" if k % 2 else "en" for k in range(40)]
    assert [r[1] for r in rows[40:]] == ["und", "und", "und", "en", "und"] and all((r[2] == 0) == (r[1] == "und") for r in rows)
    empty = df.limit(0)
    untaught = language.fit_on(empty)
    assert language.identify(empty, untaught).collect() == []
    assert {r["language"]["lang"] for r in language.identify(df, untaught).collect()} == {"und"}
