"""The four native operators: sharding, chat formatting, mixing, sketches."""

import hashlib
import json
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from seqloom.llm import chat, mixing, sharding, sketches

DOCS = "doc_id long, text string, source string"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


# sharding


def shard(frame, limit, key="doc_id", content="text"):
    return sharding.extendible_shards(frame, key, F.octet_length("text"), limit, content=F.col(content) if content else None).collect()


def test_shards_fit_and_only_oversized_ones_split(spark):
    rng = random.Random(1)
    table = [(i, "x" * rng.randrange(1, 200), None) for i in range(800)]
    found = shard(docs(spark, table), 2000)
    assert sorted(r["doc_id"] for r in found) == list(range(800))
    size, members = {}, {}
    for r in found:
        size[r["shard"]] = size.get(r["shard"], 0) + r["n_bytes"]
        members[r["shard"]] = members.get(r["shard"], 0) + 1
    assert all(n <= 2000 or members[s] == 1 for s, n in size.items())
    bits = {r["doc_id"]: f"{int(hashlib.md5(str(r['doc_id']).encode()).hexdigest()[:15], 16):060b}" for r in found}
    assert all(bits[r["doc_id"]].startswith(r["shard"]) and len(r["shard"]) == r["shard_depth"] for r in found)
    for s in size:  # a parent of a shard was over the limit
        parent = s[:-1]
        assert not s or sum(r["n_bytes"] for r in found if bits[r["doc_id"]].startswith(parent)) > 2000
    assert all(not a.startswith(b) for a in size for b in size if a != b)


def test_a_hot_key_splits_by_content_and_identical_rows_by_number(spark):
    table = [(1, f"{i:04d}" * 5, None) for i in range(60)] + [(2, "y" * 20, None)] * 50 + [(3, "z" * 500, None), (4, None, None), (5, "", None)]
    found = shard(docs(spark, table), 100)
    assert len(found) == len(table)
    size = {}
    for r in found:
        size.setdefault(r["shard"], []).append(r["n_bytes"])
    assert all(sum(v) <= 100 or len(v) == 1 for v in size.values())
    assert sum("+" in r["shard"] for r in found) == 50


def test_shards_of_nothing_and_of_clashing_columns(spark):
    assert shard(docs(spark, []), 10) == []
    frame = docs(spark, [(None, "a", "s"), (1, None, None), (1, None, None)]).withColumns({"shard": F.lit(9), "n_bytes": F.lit(8), "h1": F.lit(7), "path": F.lit(6)})
    found = sorted((r["doc_id"] or 0, r["n_bytes"], r["shard"]) for r in shard(frame, 10))
    assert found == [(0, 1, ""), (1, 0, ""), (1, 0, "")]


# chat


TEXTS = ["", "plain", "</s>[INST] ok [/INST]", "<|im_start|>user<|im_sep|>\nx<|im_end|>\n", "\\", "\\\\<|im_end|>\\", "<s<s>>\n\n", "é🙂 ", "<\\|im_end|>", "[INST][INST]"]


@pytest.mark.parametrize("role", ["assistant", "a\nb<|im_sep|>\n", "", "<|im_end|>\n"])
def test_chats_read_back_exactly(spark, role):
    turns = [(role if i % 2 else "user", t) for i, t in enumerate(TEXTS + TEXTS[::-1] + TEXTS[1:])]
    frame = spark.createDataFrame([(1, turns), (2, [])], "conv_id long, turns array<struct<role:string,text:string>>")
    found = {r["conv_id"]: r for r in chat.read_chat(chat.format_chat(frame, trained=role)).collect()}
    assert [tuple(t) for t in found[1]["turns"]] == turns and found[2]["turns"] == [] and found[2]["formatted"] == ""
    assert "".join(found[1]["loss_texts"]) == "".join(t for r, t in turns if r == role)
    inside = found[1]["formatted"].replace("<|im_start|>", "").replace("<|im_sep|>\n", "").replace("<|im_end|>\n", "")
    assert len(found[1]["formatted"].split("<|im_end|>\n")) == len(turns) + 1
    assert not any(c in inside for c in chat.CONTROL)


def test_turn_rows(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "hi"), (1, 1, "assistant", None), (2, None, None, "x"), (None, 0, "user", "n")]
    found = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.table_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert found == {1: [("user", "hi"), ("assistant", ""), ("assistant", "")], 2: [("", "x")], None: [("user", "n")]}
    assert chat.table_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    with pytest.raises(ValueError, match="no mapping"):
        chat.table_turns(spark.createDataFrame([(1, "x")], "conv_id long, body string"))


def test_layouts_by_fingerprint_of_each_record(spark):
    records = [
        {"messages": [{"role": "user", "content": "a"}, {"content": "b", "role": "assistant"}]},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": None}]},
        {"prompt": "p", "response": "r"}, {"completion": "c", "prompt": "p"}, {"instruction": "i", "input": "", "output": 7},
        {"instruction": "i", "input": "in", "output": "o"}, {"unknown": 1},
    ]
    rows = [(k, json.dumps(r)) for k, r in enumerate(records)] + [(7, "not json"), (8, None)]
    found = {r["k"]: r["turns"] and [tuple(t) for t in r["turns"]] for r in chat.to_turns(spark.createDataFrame(rows, "k int, record string"), "k", "record").collect()}
    assert found == {
        0: [("user", "a"), ("assistant", "b")], 1: [("user", "a"), ("assistant", "")], 2: [("user", "p"), ("assistant", "r")], 3: [("user", "p"), ("assistant", "c")],
        4: [("user", "i"), ("assistant", "7")], 5: [("user", "i\n\nin"), ("assistant", "o")], 6: None, 7: None, 8: None,
    }


def test_layouts_by_fingerprint_of_a_table(spark):
    frame = spark.createDataFrame([(1, "do", None, "done")], "conv_id long, instruction string, input string, output string")
    assert [tuple(t) for t in chat.table_turns(frame).first()["turns"]] == [("user", "do"), ("assistant", "done")]


# mixing


def waterfill(sizes, weights, total, cap):
    targets, capped = {}, set()
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        free = [s for s in sizes if s not in capped]
        rate = left / sum(weights[s] for s in free) if free else 0
        targets = {s: cap * sizes[s] if s in capped else rate * weights[s] for s in sizes}
        over = {s for s in free if targets[s] > cap * sizes[s]}
        if not over:
            return targets
        capped |= over


def test_mix_meets_targets(spark):
    rng = random.Random(2)
    table = [(i, "w " * rng.randrange(0, 40), rng.choice(["b", "a", "c", "d", None]) if i % 3 else "a") for i in range(900)]
    found = mixing.curriculum(docs(spark, table)).collect()
    assert len(found) == 900
    sizes = {}
    for r in found:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = waterfill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2)
    taken = {s: sum(r["taken"] for r in found if r["source"] == s) for s in sizes}
    longest = max(r["size"] for r in found)
    assert all(abs(targets[s] - next(r["target"] for r in found if r["source"] == s)) < 1e-6 for s in sizes)
    assert all(abs(taken[s] - targets[s]) <= longest for s in sizes)
    assert all(r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"] == len(r["positions"]) * r["size"] or r["size"] == 0 for r in found)
    again = mixing.curriculum(docs(spark, table).repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_positions_follow_the_schedules(spark):
    table = [(i, "w " * 10, "abc"[i % 3]) for i in range(3000)]
    plan = mixing.curriculum(docs(spark, table), weights=(1, 1, 1), slopes=(-1.0, 0.0, 1.0), share=0.9)
    order = mixing.training_order(plan).join(docs(spark, table).select("doc_id", "source"), "doc_id")
    early = {r["source"]: r["early"] / r["n"] for r in order.groupBy("source").agg(F.count_if(F.col("position") < 0.5).alias("early"), F.count("*").alias("n")).collect()}
    assert abs(early["a"] - 0.75) < 0.02 and abs(early["b"] - 0.5) < 0.02 and abs(early["c"] - 0.25) < 0.02
    positions = [r["position"] for r in mixing.training_order(plan).collect()]
    assert positions == sorted(positions)


def test_mix_of_nothing(spark):
    assert mixing.curriculum(docs(spark, [])).collect() == []
    found = mixing.curriculum(docs(spark, [(1, None, None), (1, "", "a"), (1, "", "a")]).withColumn("size", F.lit(3))).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in found] == [(0, 0.0, 0)] * 3


def test_repeated_documents_are_the_plan(spark):
    table = [(i, "w " * (i % 7 + 1), "ab"[i % 2]) for i in range(200)]
    frame = docs(spark, table).withColumn("size", F.lit("own"))
    plan = {r["doc_id"]: r["copies"] for r in mixing.curriculum(frame).collect()}
    rows = mixing.repeat_documents(frame)
    assert rows.columns == frame.columns
    found = {r["doc_id"]: r["count"] for r in rows.groupBy("doc_id").count().collect()}
    assert found == {k: v for k, v in plan.items() if v}


# sketches


def brute_sketch(text, fraction=sketches.FRACTION):
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def chain(values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64(v.to_bytes(8, "little", signed=True), seed=seed).intdigest()
        return signed(seed)

    words = [signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) for w in text.lower().split()]
    if len(words) >= 5:
        hashes = {chain(words[i : i + 5]) for i in range(len(words) - 4)}
    elif words:
        total = 0
        for w in words:
            total = chain([total, w])
        hashes = {total}
    else:
        hashes = set()
    limit = -(1 << 63) + int(fraction * (1 << 64))
    kept = sorted(h for h in hashes if h < limit)
    return kept or sorted(hashes)[:1]


def test_sketches_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("alpha Beta gamma delta é".split()) + str(rng.randrange(30)) for _ in range(n)) for n in (0, 1, 4, 5, 6, 60, 900)] + ["", "  \n ", None]
    rows = sketches.with_sketch(docs(spark, [(i, t, None) for i, t in enumerate(texts)]), "text", "s").collect()
    assert {r["doc_id"]: r["s"] for r in rows} == {i: brute_sketch(t or "") for i, t in enumerate(texts)}


def test_likeness_and_containment_estimate_the_truth(spark):
    rng = random.Random(5)
    a = [str(rng.random()) for _ in range(8000)]
    table = [(1, " ".join(a), None), (2, " ".join(a[:4000]), None), (3, " ".join(reversed(a)), None)]
    rows = sketches.with_sketch(docs(spark, table), "text", "s")
    pair = lambda x, y: rows.filter(f"doc_id = {x}").select(F.col("s").alias("a")).crossJoin(rows.filter(f"doc_id = {y}").select(F.col("s").alias("b")))
    near = pair(1, 2).select(sketches.likeness(F.col("a"), F.col("b")).alias("l"), sketches.containment(F.col("b"), F.col("a")).alias("c")).first()
    assert abs(near["l"] - 0.5) < 0.06 and near["c"] == 1.0
    assert pair(1, 3).select(sketches.likeness(F.col("a"), F.col("b"))).first()[0] == 0.0
    merged = sketches.merge_sketches(rows, ["source"], "s").count()
    assert merged == len({h for r in rows.collect() for h in r["s"]})


@pytest.mark.parametrize("bucket", [1, 3, 1000])
def test_next_documents(spark, monkeypatch, bucket):
    monkeypatch.setattr(sketches, "BUCKET_ROWS", bucket)
    rng = random.Random(6)
    table = [(i * 7 % 50, f"t{i}", None) for i in range(50)] + [(3, "again", None), (None, None, None), (10**12, "last", None)]
    rng.shuffle(table)
    order = sorted(table, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    wanted = sorted((str(r[0]), r[1] or "", order[(k + 1) % len(order)][1] or "") for k, r in enumerate(order))
    found = sketches.next_documents(docs(spark, table).withColumns({"bucket": F.lit(1), "end": F.lit(2)}))
    assert sorted((str(r["doc_id"]), r["text"], r["next_text"]) for r in found.collect()) == wanted


def test_edited_text(spark):
    rows = spark.createDataFrame([("abcde", "xyz"), ("ab", ""), ("", "x"), ("é🙂ü", "🙂")], "a string, b string")
    assert [r[0] for r in rows.select(sketches.edited_text(F.col("a"), F.col("b"))).collect()] == ["abcxy", "a", "", "é🙂🙂"]


def test_no_documents_have_no_next(spark):
    assert sketches.next_documents(docs(spark, [])).count() == 0
    assert [tuple(r) for r in sketches.next_documents(docs(spark, [(5, "a b", None)])).collect()] == [(5, "a b", "a b")]


def test_short_texts_inside_long_ones_are_held(spark):
    """Texts too short for a sample of their shingles are compared exactly, and are in no merged sketch."""
    rng = random.Random(11)
    long = [str(rng.random()) for _ in range(400)]
    shorts = [" ".join(long[i : i + 6]) for i in range(0, 200, 5)]
    rows = sketches.with_sketch(docs(spark, [(i, t, " ".join(long)) for i, t in enumerate(shorts)]), "text", "a", whole="wa")
    rows = sketches.with_sketch(rows, "source", "b", whole="wb")
    a, b, wa, wb = map(F.col, ("a", "b", "wa", "wb"))
    found = rows.select(sketches.containment(a, b, wa, wb).alias("c"), sketches.likeness(a, b, wa, wb).alias("l"), sketches.containment(a, b).alias("unknown"), "a").collect()
    limit = -(1 << 63) + (1 << 61)
    alone = [r for r in found if r["a"][0] >= limit]
    assert len(alone) > 20 and {r["c"] for r in found} == {1.0}
    assert {r["l"] for r in alone} == {2 / 396} and {r["unknown"] for r in alone} == {None}
    assert all(r["hash"] < limit for r in sketches.merge_sketches(rows.groupBy("a").count(), [], "a").collect())


# repeats, clashing names, ids of other types


def test_words_delivered_are_those_planned(spark):
    rng = random.Random(21)
    table = [(7, "a b c d e f g h i j k l m n o p", "s")] * 1001 + [(k, "w " * rng.randrange(0, 30), rng.choice(["s", "t", None])) for k in range(300)] + [(None, "n u l l", "t")] * 40 + [(5, "x y", None), (5, "y x", None)]
    frame = docs(spark, table).withColumns({"size": F.lit(1), "copies": F.lit(2), "position": F.lit(3), "positions": F.lit(4), "id": F.lit(5)})
    planned = {(r["doc_id"], r["source"]): r["n"] for r in mixing.curriculum(frame).groupBy("doc_id", "source").agg(F.sum("taken").alias("n")).collect() if r["n"]}
    out = mixing.repeat_documents(frame)
    assert out.columns == frame.columns
    found = {(r["doc_id"], r["source"]): r["n"] for r in out.groupBy("doc_id", "source").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()}
    assert found == planned
    assert sum(found.values()) == sum(planned.values())
    assert mixing.repeat_documents(docs(spark, [])).count() == 0


def test_rows_come_in_training_order(spark):
    table = [(k, "w " * (1 + k % 9), "stu"[k % 3]) for k in range(400)]
    frame = docs(spark, table)
    first = {r["doc_id"]: r["positions"] for r in mixing.curriculum(frame).collect()}
    passes, last = {}, -1.0
    for r in mixing.repeat_documents(frame).collect():
        k = passes.get(r["doc_id"], 0)
        passes[r["doc_id"]] = k + 1
        assert first[r["doc_id"]][k] >= last
        last = first[r["doc_id"]][k]


def test_a_key_named_like_an_output_has_a_name_of_its_own(spark):
    frame = docs(spark, [(1, "a", "s"), (2, "b", "s")]).withColumnRenamed("doc_id", "shard")
    found = sharding.extendible_shards(frame, "shard", F.octet_length("text"), 10)
    assert found.columns == ["key_shard", "n_bytes", "shard_depth", "shard"] and sorted(r["key_shard"] for r in found.collect()) == [1, 2]


def test_tables_with_further_columns_and_other_names(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", "b", 0), (1, 0, "user", "a", 0), (2, None, None, None, 0)], "conv_id long, position long, role string, content string, extra int")
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.table_turns(rows).collect()} == {1: [("user", "a"), ("assistant", "b")], 2: [("", "")]}
    pair = spark.createDataFrame([(1, "q", "a", "x")], "conv_id long, prompt string, response string, source string")
    assert [tuple(t) for t in chat.table_turns(pair).first()["turns"]] == [("user", "q"), ("assistant", "a")]
    with pytest.raises(ValueError, match="2 mappings"):
        chat.table_turns(spark.createDataFrame([(1, "q", "a", "x")], "conv_id long, prompt string, response string, completion string"))
    roles = spark.createDataFrame([(1, 0, "human", "a")], "conv_id long, turn long, role string, text string")
    assert chat.table_turns(roles).first()["turns"][0]["role"] == "human"


def test_next_documents_of_string_ids_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(sketches, "BUCKET_ROWS", 20)
    rng = random.Random(5)
    names = sorted({f"k{rng.randrange(10_000)}" for _ in range(400)}) + ["k5", "k5"]
    table = [(n, f"text {k}") for k, n in enumerate(names)] + [(None, "none")]
    frame = spark.createDataFrame(rng.sample(table, len(table)), "doc_id string, text string")
    order = sorted(table, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    wanted = sorted((str(a[0]), a[1], b[1]) for a, b in zip(order, order[1:] + order[:1], strict=True))
    assert sorted((str(r["doc_id"]), r["text"], r["next_text"]) for r in sketches.next_documents(frame).collect()) == wanted
