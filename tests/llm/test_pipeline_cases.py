"""The pipeline by plain loops on the smallest tables, and on odd tables."""

import hashlib
from collections import Counter

import corpus_pipeline
import duckdb
import pytest

from seqloom.llm import packing, secret_scan
from seqloom.llm.queries import OP7_SQL

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows that each stage gets and gives, as lists of dictionaries, and the folder of what it gives."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{D}/documents.parquet"), []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        given = [r.asDict() for r in docs.collect()]
        stage(spark, docs, D).write.parquet(str(folder / str(number)))
        docs = spark.read.parquet(str(folder / str(number)))
        out.append((name, given, [r.asDict() for r in docs.collect()], str(folder / str(number))))
    return out


def test_quality_drops_rows_and_changes_none(stages):
    _, given, kept, _ = stages[0]
    known = {r["doc_id"]: r for r in given}
    assert all(known[r["doc_id"]] == r for r in kept) and len(kept) > 0.7 * len(given)
    labels = duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{D}/labels.parquet'").fetchall()
    ids = {r["doc_id"] for r in kept}
    share = lambda q, t: [k in ids for k, a, b in labels if (a, b) == (q, t)]
    assert sum(share(1, 0)) > 0.97 * len(share(1, 0)) and sum(share(0, 0)) < 0.3 * len(share(0, 0)) and sum(share(1, 1)) < 0.5 * len(share(1, 1))


def test_one_of_each_class_stays(stages):
    _, given, kept, _ = stages[1]
    sets = {}
    for r in given:
        words = (r["text"] or "").lower().split()
        sets[r["doc_id"]] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    root = {k: k for k in sets}
    keys = sorted(sets)
    for x, a in enumerate(keys):
        for b in keys[x + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert sorted(r["doc_id"] for r in kept) == sorted(set(root.values()))
    known = {r["doc_id"]: r for r in given}
    assert all(known[r["doc_id"]] == r for r in kept)


def test_secrets_are_replaced_and_nothing_else(spark, stages):
    _, given, kept, _ = stages[2]
    spans = {r["doc_id"]: sorted((s["start"], s["end"]) for s in r["spans"]) for r in secret_scan.find_secrets(spark.read.parquet(stages[1][3])).collect()}
    for before, after in zip(sorted(given, key=lambda r: r["doc_id"]), sorted(kept, key=lambda r: r["doc_id"]), strict=True):
        out, at = "", 0
        for start, end in spans[before["doc_id"]]:
            if start >= at:
                out += before["text"][at:start] + "[secret]"
            at = max(at, end)
        wanted = out + before["text"][at:]
        assert after["text"] == wanted and after["n_chars"] == len(wanted)


def test_documents_are_repeated_as_the_mix_plans(stages):
    _, given, kept, _ = stages[3]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{stages[2][3]}/*.parquet'")
    planned = {k: taken // size for k, size, taken in con.sql(f"SELECT doc_id, size, taken FROM ({OP7_SQL})").fetchall() if taken}
    assert Counter(r["doc_id"] for r in kept) == planned
    known = {r["doc_id"]: r for r in given}
    assert all(known[r["doc_id"]] == r for r in kept)


def check_packed(given, packed):
    """Pieces make up each copy's tokens, and sequences are gapless."""
    tokenizer = packing._WordIds.of(packing.tokenizer_path()).tokenizer
    wanted = Counter()
    for r in given:
        n = len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1
        wanted.update((r["doc_id"], k, min(4096, n - at)) for k, at in enumerate(range(0, n, 4096)))
    assert Counter((r["doc_id"], r["piece"], r["length"]) for r in packed) == wanted
    places = {}
    for r in packed:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096


def test_sequences_hold_all_tokens(stages):
    check_packed(stages[4][1], stages[4][2])


def write(spark, folder, rows, labels, columns="doc_id long, text string, lang string, source string, n_chars long"):
    spark.createDataFrame(rows, columns).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_nulls_repeats_and_long_texts(spark, tmp_path):
    clean = "The first of many plain words that stand here for a while and then go on to the end of it. "
    rows = [(k, clean + f"number {k} " * 30, "en", f"s{k % 2}", 10) for k in range(30)]
    rows += [(3, rows[3][1], "en", "s1", 10), (3, rows[3][1], "en", "s1", 10), (None, None, None, None, None), (None, "one lone text without id", None, None, None), (31, "", "en", "s0", 0), (32, None, "en", "s1", None), (33, "long " * 400_000 + "end", "en", None, 7), (None, "one lone text without id", None, None, None)]
    found = corpus_pipeline.run(spark, write(spark, tmp_path, rows, [(1, 1, 0), (2, 1, 0), (2, None, 0), (None, 1, 0)])).collect()
    ids = {r["doc_id"] for r in found}
    assert {*range(30), 33, None} <= ids | {None} and 33 in ids
    each = Counter((r["doc_id"], r["piece"]) for r in found)
    assert max(each.values()) <= 2  # no document more often than twice, and of rows alike one
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert hashlib.sha256(repr(sorted(map(repr, found))).encode()).digest() == hashlib.sha256(repr(sorted(map(repr, again))).encode()).digest()


def test_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(spark, tmp_path, [], [])).collect() == []


def test_further_columns_stay_up_to_the_last_stage(spark, tmp_path):
    more = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, `__tie` int, row string, position double"
    rows = [(k, f"text number {k} with some words of its own {k}", "en", "s", 1, "x", k, "r", 0.5) for k in range(12)]
    docs = spark.read.parquet(write(spark, tmp_path, rows, [], more) + "/documents.parquet")
    columns = docs.columns
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns
        out.write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
    assert {(r["doc_id"], r["a.b"], r["__tie"], r["row"], r["position"]) for r in docs.collect()} <= {(k, "x", k, "r", 0.5) for k in range(12)}
    assert docs.count() > 0
