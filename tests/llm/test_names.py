"""All operators on tables with odd columns: names that operators use themselves, dots, string ids, nulls, ties."""

import pytest
from pyspark.sql import functions as F

from seqloom.llm import alignment, language, licenses, merkle, mixing, near_copies, ogg, packing, quality, secret_scan, sharding, sketches

ODD = ["__hash", "__group", "__number", "__tie", "a.b", "row", "id", "text_hash", "position", "bucket", "end", "key", "digest", "pos", "n", "links", "row_id", "tie"]


def table(spark, ids="string"):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [("k1", text, "s"), ("k2", text + " more", "s"), ("k2", text, None), (None, None, "s"), ("k3", "", "t"), ("k4", "word " * 20_000, "t"), ("k5", "Released under the MIT License.", "t"), (None, "alone here", "t")]
    if ids == "long":
        rows = [(None if k is None else int(k[1:]), t, s) for k, t, s in rows]
    df = spark.createDataFrame(rows, f"doc_id {ids}, text string, source string").withColumn("n_chars", F.length("text").cast("long")).withColumn("lang", F.lit("en"))
    for place, name in enumerate(ODD):
        df = df.withColumn(name, F.lit(f"kept {place}"))
    return df


def kept(df):
    """Whether all odd columns are what they were."""
    return all(df.filter(F.col(f"`{name}`") != f"kept {place}").count() == 0 for place, name in enumerate(ODD)) and set(ODD) <= set(df.columns)


@pytest.mark.parametrize("ids", ["string", "long"])
def test_operators_that_give_rows_back_keep_all_columns(spark, ids):
    df = table(spark, ids)
    one = near_copies.keep_one(df)
    assert kept(one) and one.columns == df.columns and one.count() == 6
    mixed = mixing.repeat_documents(df)
    assert kept(mixed) and mixed.columns == df.columns and mixed.filter("text IS NULL").count() == 0
    clean = secret_scan.redact(df)
    assert kept(clean) and clean.columns == df.columns and clean.count() == df.count()
    pieces = packing.token_pieces(df.select("doc_id", "text"))
    for place, name in enumerate(ODD):
        pieces = pieces.withColumn(name, F.lit(f"kept {place}"))
    packed = packing.pack_pieces(pieces)
    assert kept(packed) and packed.count() == pieces.count() and packed.filter("offset IS NULL").count() == 0
    model = quality.fit_on(df, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"), F.expr(quality.LABEL_GRADE))
    assert quality.select_quality(df, model, 0.0).columns == df.columns
    named = language.identify(df, language.fit_on(df))
    assert kept(named) and named.count() == df.count()


@pytest.mark.parametrize("ids", ["string", "long"])
def test_operators_that_report_on_rows_give_one_each(spark, ids):
    df = table(spark, ids)
    n = df.count()
    classes = near_copies.jaccard_classes(df)
    assert classes.count() == n and classes.schema["class_id"].dataType.simpleString() in (ids, "bigint")
    assert {r["n_links"] for r in classes.filter("n_copies = 2").collect()} == {2}
    assert secret_scan.find_secrets(df).count() == n
    assert alignment.align_tokenizers(df).count() == n
    assert merkle.manifest(df, ["doc_id", "text"], "source", "doc_id").count() == n
    assert mixing.curriculum(df).count() == n
    assert sharding.extendible_shards(df, "doc_id", F.octet_length("text"), 1000, content=F.col("text")).count() == n
    assert sketches.next_documents(df).count() == n
    assert ogg.read_media(ogg.write_media(df)).count() == n
    assert licenses.find_licenses(df).count() == 1 and licenses.document_licenses(df).count() == 6
    nothing = df.limit(0)
    assert near_copies.jaccard_classes(nothing).count() == near_copies.keep_one(nothing).count() == 0
    assert ogg.read_media(ogg.write_media(nothing)).count() == mixing.repeat_documents(nothing).count() == 0
