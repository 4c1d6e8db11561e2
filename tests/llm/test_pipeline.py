"""The pipeline's stages keep what they should, and its rows are whole."""

from collections import defaultdict

import corpus_pipeline
from __spark_entry__ import queries

D = "/root/testdata/sf0.001"


def test_stages_one_after_another(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    clean = spark.read.parquet(f"{D}/labels.parquet").filter("quality = 1 AND toxic = 0").select("doc_id")
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, D)
        out.write.parquet(str(tmp_path / str(number)))
        out = spark.read.parquet(str(tmp_path / str(number)))
        counts.append(out.count())
        if name == "quality classifier":
            before, after = docs.join(clean, "doc_id").count(), out.join(clean, "doc_id").count()
            assert after >= 0.95 * before
        if name == "n-gram Jaccard join":
            assert out.select("doc_id").distinct().count() == out.count()
        if name == "secret scans":
            assert out.count() == docs.count() and not out.filter("text rlike 'token = \"[0-9a-f]{40}'").count()
        if number < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        docs = out
    places = defaultdict(list)
    for r in docs.collect():
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096


def test_all_eleven_are_registered():
    names = queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
