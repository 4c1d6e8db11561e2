"""The near-copy join against all pairs by brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.llm import near_copies as N


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(table, threshold=0.8):
    sets = {k: shingles(t) for k, t in table}
    links = {k: 0 for k in sets}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for x, a in enumerate(keys):
        for b in keys[x + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {k: (find(k), links[k]) for k in keys}


def corpus():
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = []
    for base in range(12):
        text = [word() for _ in range(rng.choice([6, 40, 150, 400]))]
        rows.append(" ".join(text))
        for _ in range(rng.randrange(0, 9)):
            copy = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, len(text) // 60 + 1, len(text) // 12])):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy).upper() if rng.random() < 0.3 else "  ".join(copy))
    rows += ["", None, " \n", "one two", "one two", "ONE two", "three", *[" ".join(word() for _ in range(30)) for _ in range(20)], "long " * 30_000]
    return [(3 * k + 1, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("block_texts", [4, 2048])
def test_classes_and_links_equal_brute_force(spark, monkeypatch, block_texts):
    monkeypatch.setattr(N, "BLOCK_TEXTS", block_texts)
    table = corpus()
    found = N.jaccard_classes(spark.createDataFrame(table, "doc_id long, text string")).collect()
    wanted = brute(table)
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in found} == wanted


def test_no_documents(spark):
    assert N.jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_one_of_each_class_stays(spark):
    table = [(5, "a b c d e f", 1), (2, "a b c d e f", 2), (2, "a b c d e f", 2), (9, "q r s t u v", 3), (7, None, 4)]
    kept = N.keep_one(spark.createDataFrame(table, "doc_id long, text string, class_id int"))
    assert kept.columns == ["doc_id", "text", "class_id"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 7, 9]


def test_depth_shortens_until_the_recall():
    assert N.matched_depth(0.8, 32, 8, 0.9) == 8 and N.matched_depth(0.8, 32, 8, 0.999) == 7
    assert N.matched_depth(0.8, 32, 8, 0.9999999) < 6 and N.matched_depth(0.1, 2, 8, 0.9999) == 1


def test_forest_recall_near_the_threshold():
    rng, depth, met = random.Random(9), N.matched_depth(), 0
    base = [f"b{i}" for i in range(600)]
    own = N.node_keys(N.signature(N.shingle_sets(pa.array([" ".join(base)]))[0]), depth)
    for _ in range(200):
        copy = list(base)
        for i in rng.sample(range(600), 13):
            copy[i] = f"x{rng.random()}"
        other = N.node_keys(N.signature(N.shingle_sets(pa.array([" ".join(copy)]))[0]), depth)
        met += bool((own == other).any())
    assert met >= 198


def test_blocks_count_exactly():
    rng = np.random.RandomState(1)
    sets = [np.unique(rng.randint(0, 60, 40).astype(np.uint64)) for _ in range(30)]
    ids, copies = np.arange(30), rng.randint(1, 4, 30)
    weight, _ = N.verify_block(ids, copies, np.zeros(30, dtype=int), sets, 0.4)
    near = lambda i, j: len(np.intersect1d(sets[i], sets[j])) >= 0.4 * len(np.union1d(sets[i], sets[j]))
    assert weight.tolist() == [sum(copies[j] for j in range(30) if j != i and near(i, j)) for i in range(30)]
    sides = np.array([1, 2] * 15)
    weight, _ = N.verify_block(ids, copies, sides, sets, 0.4)
    assert weight.tolist() == [sum(copies[j] for j in range(30) if sides[j] != sides[i] and near(i, j)) for i in range(30)]


def test_components(spark):
    chain = [(k, k + 1) for k in range(20)] + [(100, 101), (101, 102), (100, 102), (5, 5)]
    found = {r["id"]: r["root"] for r in N.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(21)}, 100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize("block_texts", [4, 2048])
def test_null_and_repeated_ids_are_rows_of_their_own(spark, monkeypatch, block_texts):
    """Each row a vertex, against brute force over rows; whatever ids say."""
    monkeypatch.setattr(N, "BLOCK_TEXTS", block_texts)
    texts = [t for _, t in corpus()]
    rng = random.Random(4)
    ids = [rng.choice([None, 5, 5, 6, 100 + k]) for k in range(len(texts))]
    wanted, first = brute(list(enumerate(texts))), {}
    mark = lambda k: None if texts[k] is None else hashlib.md5(texts[k].encode()).hexdigest()
    order = lambda k: (ids[k] is None, ids[k] or 0, mark(k) or "")
    for k, (root, _) in wanted.items():
        first[root] = min(first.get(root, k), k, key=order)
    # brute force has texts alike without words apart, and they are no class
    frame = spark.createDataFrame([(i, t, str(k)) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], "doc_id long, text string, row string")
    found = [(r["doc_id"], r["class_id"], r["class_hash"], r["n_links"]) for r in N.jaccard_classes(frame).collect()]
    assert sorted(map(repr, found)) == sorted(repr((ids[k], ids[first[root]], mark(first[root]), n)) for k, (root, n) in wanted.items())
    kept = [(r["doc_id"], r["text"]) for r in N.keep_one(frame).collect()]
    assert sorted(map(repr, kept)) == sorted(repr((ids[k], texts[k])) for k in first.values())
    again = N.keep_one(frame.orderBy(F.desc("row")).repartition(3)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, N.keep_one(frame).collect()))


def test_clean_documents_without_id_stay(spark):
    table = [(None, "a clean text of its own here"), (None, "and another one quite unlike it"), (3, "the first text of number three"), (3, "something else of number three altogether")]
    frame = spark.createDataFrame(table, "doc_id long, text string")
    assert sorted(r["text"] for r in N.keep_one(frame).collect()) == sorted(t for _, t in table)


def test_least_similarity_equals_all_overlaps():
    for size in range(1, 60):
        every = [k / (size + extra) for k in range(1, size + 1) for extra in range(size) if k / (size + extra) >= 0.8 - 1e-12]
        assert N.least_similarity(size) == pytest.approx(min(every)), size


def test_texts_meet_with_the_recall_wanted_at_every_size():
    """Whatever two sizes can be similar, both stand at a depth that gives pairs of theirs the recall."""
    assert N.levels(3) == (8,) and N.levels(1000) == (7,) and {N.levels(n) for n in range(1, 200)} >= {(7,), (8,), (7, 8)}
    for a in range(1, 130):
        for b in range(a, int(a / 0.8) + 1):
            own_a, own_b = N.levels(a), N.levels(b)
            met = max(own_a[0], own_b[0])
            assert met in own_a and met in own_b
            for shared in range(1, a + 1):
                likeness = shared / (a + b - shared)
                if likeness >= 0.8:
                    assert 1 - (1 - likeness**met) ** N.TREES >= N.RECALL, (a, b, shared)


def test_many_small_near_copies_are_all_linked(spark):
    """Short texts, whose prefixes are shortened unlike, against brute force."""
    rng = random.Random(11)
    table = []
    for _ in range(40):
        words = [f"w{rng.randrange(900)}" for _ in range(rng.randrange(4, 20))]
        for _ in range(4):
            cut_off = rng.randrange(0, 3)
            table.append((len(table), " ".join(words[: len(words) - cut_off])))
    frame = spark.createDataFrame(table, "doc_id long, text string")
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in N.jaccard_classes(frame).collect()}
    assert found == brute(table)


def test_parted_groups_are_whole(spark, monkeypatch):
    """A group in many blocks has the links of one block."""
    rng = random.Random(12)
    words = [f"w{k}" for k in range(300)]
    table = []
    for k in range(150):
        own = list(words)
        for _ in range(rng.randrange(0, 12)):
            own[rng.randrange(300)] = f"x{rng.randrange(50)}"
        table.append((k, " ".join(own)))
    frame = spark.createDataFrame(table, "doc_id long, text string")
    monkeypatch.setattr(N, "PART_TEXTS", 9)
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in N.jaccard_classes(frame).collect()}
    assert found == brute(table)
