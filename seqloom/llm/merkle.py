"""Merkle manifest of a dataset: a persistent tree over all rows, changed by path copying.

Rows are leaves of one tree for each group; the trees' roots are the leaves of the tree above them. Every
tree is cut into aligned blocks of a power of the fan-out, so that a block is a subtree of its own and
one bounded task. A changed row makes a version of its block that shares all untouched nodes and
copies its ancestors only; the version goes on above the block along the path of the block's top,
which is handed down from tree to tree, so that the upper part of each version is made where its
lower part was, by as many tasks as there are blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.plans.lineage import cut
from seqloom.plans.shipping import ship_package

#: Children of a node, and levels of an aligned block.
FANOUT, BLOCK_LEVELS = 3, 6
_STEPS = "array<struct<left:binary,right:binary>>"
_NODE = "g long, pos long, n long, digest binary"


def field_text(value: Column) -> Column:
    """A field as a leaf holds it: ``-`` for null, else the number of its UTF-8 bytes, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of a row's fields, in lower-case hex digits."""
    return F.sha2(F.concat(*[field_text(f) for f in fields]), 256)


def digest(parts: Iterator[bytes] | tuple[bytes, ...]) -> bytes:
    """SHA-256 of digests, which go in as hex text one after another."""
    return hashlib.sha256(b"".join(parts).hex().encode()).digest()


class Node(NamedTuple):
    """A node of a persistent tree; versions share nodes."""

    digest: bytes
    children: tuple[Node, ...] = ()


def parent(children: tuple[Node, ...]) -> Node:
    return Node(digest(tuple(c.digest for c in children)), children)


def levels_of(n: int, most: int) -> int:
    """Levels by which a block rises whose group has ``n`` nodes: ``most``, or until one node is left."""
    levels = 0
    while n > 1 and levels < most:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def grown(digests: list[bytes], levels: int) -> list[list[Node]]:
    """All levels of a block, lowest first; the last run of a level may be short, even of one node."""
    out = [[Node(d) for d in digests]]
    for _ in range(levels):
        below = out[-1]
        out.append([parent(tuple(below[i : i + FANOUT])) for i in range(0, len(below), FANOUT)])
    return out


def with_leaf(node: Node, turns: list[int], leaf: Node) -> Node:
    """A version of the tree under ``node`` with another leaf at the end of ``turns``.

    The nodes on the way are copied, all others are those of the version before.
    """
    if not turns:
        return leaf
    at = turns[0]
    return parent((*node.children[:at], with_leaf(node.children[at], turns[1:], leaf), *node.children[at + 1 :]))


def turns_to(place: int, levels: int) -> list[int]:
    """Which child leads from a block's top to a place at its bottom, level by level."""
    return [place // FANOUT**k % FANOUT for k in reversed(range(levels))]


def siblings(levels: list[list[Node]], place: int) -> list[dict[str, bytes]]:
    """The digests before and after a node in its run, level by level up to the block's top."""
    out = []
    for level in levels[:-1]:
        run = place - place % FANOUT
        left, right = level[run:place], level[place + 1 : run + FANOUT]
        out.append({"left": b"".join(x.digest for x in left), "right": b"".join(x.digest for x in right)})
        place //= FANOUT
    return out


def folded(start: bytes, steps: list[dict[str, bytes]]) -> bytes:
    """What a node's digest becomes along the siblings on its way."""
    for step in steps:
        start = digest((step["left"], start, step["right"]))
    return start


def _levels(table: pa.Table, most: int) -> tuple[pa.Table, list[list[Node]]]:
    table = table.sort_by("pos")
    return table, grown(table["digest"].to_pylist(), levels_of(table["n"][0].as_py(), most))


def _tops(nodes: DataFrame, most: int) -> DataFrame:
    """The top of each block of nodes, as nodes of the stage above."""

    def top(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table, levels = _levels(table, most)
        g, block, n = key[0].as_py(), key[1].as_py(), table["n"][0].as_py()
        return pa.table({"g": pa.array([g], pa.int64()), "pos": pa.array([block], pa.int64()), "n": pa.array([-(-n // FANOUT**most)], pa.int64()), "digest": pa.array([levels[-1][0].digest], pa.binary())})

    return nodes.groupBy("g", _block(most)).applyInArrow(top, _NODE)


def _block(most: int) -> Column:
    return F.expr(f"pos div {FANOUT**most}").alias("block")


def _stages(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The nodes at the bottom of each stage of blocks; of the last stage each group has one node.

    Of a stage there are as many times fewer nodes as a block has, so there are few stages.
    """
    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        out.append(cut(_tops(out[-1], most)))
    return out


def _paths(nodes: DataFrame, above: DataFrame, most: int) -> DataFrame:
    """(g, pos, steps, subroot, root) of the nodes of a stage, given those of the stage above."""

    def down(table: pa.Table, path: pa.Table) -> pa.Table:
        table, levels = _levels(table, most)
        rest, subroot, root = (path[c][0].as_py() for c in ("steps", "subroot", "root"))
        size = table.num_rows
        steps = [siblings(levels, k) + rest for k in range(size)]
        kind = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))
        return pa.table({"g": table["g"], "pos": table["pos"], "steps": pa.array(steps, kind), "subroot": pa.array([subroot] * size, pa.binary()), "root": pa.array([root] * size, pa.binary())})

    return nodes.groupBy("g", _block(most)).cogroup(above.groupBy("g", F.col("pos").alias("block"))).applyInArrow(down, f"g long, pos long, steps {_STEPS}, subroot binary, root binary")


def ranked(df: DataFrame, by: str, order: list[str], place: str) -> DataFrame:
    """Adds ``place``, from 0 on, of each row in its group by ``order``; no group is gathered.

    Rows are dealt into ranges of (group, order) and numbered in each; a group's place in a range
    starts where its rows of the ranges before end. What is counted for that has a row for each
    range and group in it.
    """
    number = F.monotonically_increasing_id()
    dealt = df.withColumn("__tie", number).repartitionByRange(by, *order, "__tie").sortWithinPartitions(by, *order, "__tie")
    numbered = cut(dealt.drop("__tie").withColumn("__no", number)).withColumn("__range", F.shiftright("__no", 33))
    before = Window.partitionBy(by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = numbered.groupBy(by, "__range").agg(F.min("__no").alias("__first"), F.count("*").alias("__rows"))
    starts = counts.select(by, "__range", (F.coalesce(F.sum("__rows").over(before), F.lit(0)) - F.col("__first")).alias("__shift"))
    return numbered.join(starts, [by, "__range"]).withColumn(place, F.col("__no") + F.col("__shift")).drop("__no", "__range", "__shift")


def manifest(df: DataFrame, fields: list[str], group: str, order: str, changed: Column | None = None, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """The manifest's line for each row, and what becomes of it under a change of that row.

    ``changed`` is the leaf digest of each row after a change, null for rows that don't change; each
    changed row is a version by itself. Returns ``order`` and leaf, subroot (of the row's group), root,
    proof_sha256 (SHA-256 of all siblings on the way up), folded_root (made from the changed leaf and
    the siblings as they were), verified (whether that is the root), n_copied (nodes that the version
    doesn't share; null without a change). Digests are lower-case hex.

    One row per row of ``df``: rows alike are leaves of their own, next to each other. Groups go by
    name, null first; rows of a group by ``order``, nulls first, then by leaf. Null fields are told from
    empty ones; numbers count as their decimal text. Texts of any length are hashed whole, in the scan; only digests are shuffled. An
    empty table gives no rows; further columns are ignored.
    """
    ship_package(df.sparkSession)
    leaf = leaf_digest([F.col(f) for f in fields])
    other = F.lit(None).cast("string") if changed is None else changed
    rows = cut(df.select(F.struct(F.col(group).alias("name")).alias("of"), F.col(order).alias("id"), F.unhex(leaf).alias("digest"), F.unhex(other).alias("changed")))
    placed = ranked(rows, "of", ["id", "digest"], "pos")
    sizes = cut(rows.groupBy("of").agg(F.count("*").alias("n")).withColumn("all", F.lit(0)))
    groups = ranked(sizes, "all", ["of"], "g").select("of", "g", "n")
    leaves = cut(placed.join(groups, "of").select("g", "pos", "n", "id", "digest", "changed"))

    stages = _stages(leaves.select("g", "pos", "n", "digest"), block_levels)
    subroots = stages[-1].select(F.lit(0).cast("long").alias("g"), F.col("g").alias("pos"), "digest")
    upper = _stages(cut(subroots.crossJoin(F.broadcast(sizes.agg(F.count("*").alias("n")))).select("g", "pos", "n", "digest")), block_levels)  # against one row
    nothing = F.array().cast(_STEPS)
    path = upper[-1].select("g", "pos", nothing.alias("steps"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    for nodes in reversed(upper[:-1]):
        path = cut(_paths(nodes, path, block_levels))
    tops = stages[-1].select(F.col("g").alias("of"), F.col("digest").alias("own"))
    path = cut(path.join(tops, F.col("pos") == F.col("of")).select(F.col("of").alias("g"), F.lit(0).cast("long").alias("pos"), "steps", F.col("own").alias("subroot"), "root"))
    for nodes in reversed(stages[1:-1]):
        path = cut(_paths(nodes, path, block_levels))
    return _lines(leaves, path, order, df.schema[order].dataType.simpleString(), block_levels)


def _lines(leaves: DataFrame, path: DataFrame, order: str, kind: str, most: int) -> DataFrame:
    """The manifest's lines, block by block."""

    def lines(table: pa.Table, above: pa.Table) -> pa.Table:
        table, levels = _levels(table, most)
        rest, subroot, root = (above[c][0].as_py() for c in ("steps", "subroot", "root"))
        height, top = len(levels) - 1, levels[-1][0]
        proofs, roots, copied = [], [], []
        for place, (leaf, other) in enumerate(zip(table["digest"].to_pylist(), table["changed"].to_pylist(), strict=True)):
            steps = siblings(levels, place)
            every = steps + rest
            proofs.append(digest(tuple(x for s in every for x in (s["left"], s["right"]))))
            if other is None:
                roots.append(folded(leaf, every))
                copied.append(None)
            else:
                version = with_leaf(top, turns_to(place, height), Node(other))
                roots.append(folded(version.digest, rest))
                copied.append(len(every) + 1)
        size = table.num_rows
        return pa.table(
            {
                "id": table["id"], "leaf": table["digest"], "subroot": pa.array([subroot] * size, pa.binary()), "root": pa.array([root] * size, pa.binary()),
                "proof": pa.array(proofs, pa.binary()), "folded": pa.array(roots, pa.binary()), "n_copied": pa.array(copied, pa.int64()),
            }
        )

    found = leaves.groupBy("g", _block(most)).cogroup(path.groupBy("g", F.col("pos").alias("block"))).applyInArrow(
        lines, f"id {kind}, leaf binary, subroot binary, root binary, proof binary, folded binary, n_copied long"
    )
    text = lambda c: F.lower(F.hex(c))
    return found.select(
        F.col("id").alias(order), text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), text("proof").alias("proof_sha256"),
        text("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"), "n_copied",
    )
