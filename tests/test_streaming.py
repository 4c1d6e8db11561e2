"""Cluster sizes as pages arrive, against a batch over all of them."""

import json

from pyspark.sql import functions as F

from seqloom.streaming import sizes

KIND = "cluster string, page string, members array<string>, at timestamp"


def test_arriving_pages_are_counted_once_over_restarts(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def land(name, pages):
        lines = [json.dumps({"cluster": c, "page": p, "members": m, "at": at}) for c, p, m, at in pages]
        (tmp_path / "in" / name).write_text("\n".join(lines) + "\n")

    def run():
        pages = spark.readStream.schema(KIND).json(str(tmp_path / "in"))
        query = sizes.count_arriving(pages, str(tmp_path / "out"), str(tmp_path / "cp"), slices=4)
        query.awaitTermination(300)
        assert query.exception() is None
        return sorted(map(tuple, sizes.cluster_sizes(spark, str(tmp_path / "out")).collect()))

    def whole():
        return sorted(map(tuple, sizes.sizes_of(spark.read.schema(KIND).json(str(tmp_path / "in"))).collect()))

    day = lambda h: f"2024-05-01T{h:02d}:00:00Z"
    land("1.json", [("a", "p1", [f"m{k}" for k in range(40)], day(1)), ("a", "p2", ["m1", "m99", " ", None], day(1)), ("b", "p1", None, day(2))])
    assert run() == whole() == [("a", 2, 41), ("b", 1, 0)]
    # again after a restart: a page that comes twice, one that adds to what is known, and one out of order but not late
    land("2.json", [("a", "p1", [f"m{k}" for k in range(40)], day(3)), ("a", "p3", ["m2", "new"], day(3)), ("b", "p2", ["x", "y"], day(2))])
    assert run() == whole() == [("a", 3, 42), ("b", 2, 2)]
    # the watermark stands at 20 hours less one when the next batch comes; an old page is left out, a new one counts
    land("3.json", [("c", "p1", ["z"], day(20))])
    assert run() == whole()
    land("4.json", [("a", "late", ["late"], day(4)), ("c", "p2", ["w"], day(20))])
    assert run() == [("a", 3, 42), ("b", 2, 2), ("c", 2, 2)]


def test_items_of_pages(spark):
    pages = spark.createDataFrame([("a", "p", ["x", "", "x"], None)], KIND)
    rows = sizes.page_items(pages, 1).select("cluster", "kind", "item", "slice").collect()
    assert sorted(map(tuple, rows)) == [("a", "member", "x", 0), ("a", "member", "x", 0), ("a", "page", "p", 0)]
    assert sizes.sizes_of(pages.filter(F.lit(False))).collect() == []
