"""The Merkle manifest against plain loops over small tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from seqloom.llm import merkle

FIELDS = ["doc_id", "source", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def way(levels, place):
    out = []
    for level in levels[:-1]:
        run = place - place % 3
        out.append(("".join(level[run:place]), "".join(level[place + 1 : run + 3])))
        place //= 3
    return out


def by_loops(rows, changed):
    """Lines of a manifest, of rows (doc_id, source, text), as a sorted list."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, sha("".join(map(field, row))), row))
    names = sorted(groups, key=lambda n: (n is not None, (n or "").encode()))
    trees = {n: tree([leaf for _, _, leaf, _ in sorted(groups[n], key=lambda x: x[:3])]) for n in names}
    top = tree([trees[n][-1][0] for n in names])
    out = []
    for k, n in enumerate(names):
        for place, (_, _, leaf, row) in enumerate(sorted(groups[n], key=lambda x: x[:3])):
            steps = way(trees[n], place) + way(top, k)
            other = changed(row)
            folded = leaf if other is None else sha("".join(map(field, other)))
            for before, after in steps:
                folded = sha(before + folded + after)
            copied = None if other is None else len(steps) + 1
            out.append((row[0], leaf, trees[n][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), folded, folded == top[-1][0], copied))
    return sorted(out, key=repr)


def lines(df, **more):
    changed = F.when(F.col("doc_id") % 2 == 0, merkle.leaf_digest([F.col("doc_id"), F.col("source"), F.upper("text")]))
    found = merkle.manifest(df, FIELDS, "source", "doc_id", changed, **more)
    return sorted([tuple(r) for r in found.collect()], key=repr)


def upper(row):
    return (row[0], row[1], None if row[2] is None else row[2].upper()) if row[0] is not None and row[0] % 2 == 0 else None


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest_equals_plain_loops(spark, levels):
    rows = [(k, f"s{k % 3}" if k < 90 else "hot", f"text {k}\n" if k % 5 else "X") for k in range(130)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    found = lines(df, block_levels=levels)
    assert found == by_loops(rows, upper)
    assert {r[6] for r in found if r[7] is not None} == {True, False}  # an upper-case text stays what it was


def test_nulls_ties_and_single_rows(spark):
    rows = [(1, None, "a"), (1, None, "b"), (1, None, "b"), (None, None, None), (2, "", ""), (4, "é", "ü" * 50_000), (3, "z", None)]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, source string, text string, __no string, pos int")
    assert lines(df) == by_loops(rows, upper)


def test_one_row_and_none(spark):
    kind = "doc_id long, source string, text string"
    assert lines(spark.createDataFrame([(2, "s", "t")], kind)) == by_loops([(2, "s", "t")], upper)
    assert lines(spark.createDataFrame([], kind)) == []


def test_versions_share_what_they_do_not_copy():
    levels = merkle.grown([bytes([k]) * 32 for k in range(20)], 3)
    top = levels[-1][0]
    version = merkle.with_leaf(top, merkle.turns_to(13, 3), merkle.Node(b"y" * 32))
    apart = [0]

    def walk(a, b):
        if a is not b:
            apart[0] += 1
            for x, y in zip(a.children, b.children, strict=True):
                walk(x, y)

    walk(top, version)
    assert apart[0] == 4  # the leaf and its three ancestors
    assert merkle.folded(b"y" * 32, merkle.siblings(levels, 13)) == version.digest


def test_ranks_do_not_depend_on_partitions(spark):
    rows = [(k % 7, f"g{k % 2}") for k in range(500)]
    for parts in (1, 9):
        df = spark.createDataFrame(rows, "v long, g string").repartition(parts)
        found = merkle.ranked(df, "g", ["v"], "place").collect()
        for g in ("g0", "g1"):
            own = sorted((r["place"], r["v"]) for r in found if r["g"] == g)
            assert [p for p, _ in own] == list(range(250)) and [v for _, v in own] == sorted(v for _, v in own)
