"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

Each text becomes the set of its word shingles and a MinHash signature. Every tree of the forest
is a prefix trie over its own stretch of the signature, kept as the keys of its nodes, which Spark
sorts; two texts meet in the node of a prefix that they share. Each text starts from full depth, and
its prefix is shortened until the pairs that it can be part of, given how many shingles it has, meet
with the target recall. Texts that meet are verified on their whole shingle sets, in blocks of
bounded size, so a large group of near copies is counted in matrix products and never written out as
pairs.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.workers import tidy
from seqloom.plans.lineage import cut
from seqloom.plans.shipping import ship_package

#: Words of a shingle, similarity of a link.
SHINGLE, THRESHOLD = 5, 0.8
#: Trees, full depth of a tree, and recall wanted of pairs right at the threshold.
TREES, DEPTH, RECALL = 32, 8, 0.999
#: Shingles and texts that one side of a verification block has on average, at most.
BLOCK, BLOCK_TEXTS = 1 << 18, 2048
#: A smaller group is parted too, into blocks of so many texts, as long as there are no more blocks than that.
PART_TEXTS, PARTS = 64, 64

_MULTIPLY = np.random.RandomState(7).randint(0, 1 << 31, TREES * DEPTH, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = np.random.RandomState(8).randint(0, 1 << 32, TREES * DEPTH, dtype=np.int64).astype(np.uint32)


def matched_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix with which pairs at the threshold still meet often enough.

    A pair of similarity s shares d values with probability s^d in a tree, and meets in one of the
    trees with probability 1 - (1 - s^d)^trees; d is shortened until that is the recall wanted.
    """
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


@functools.lru_cache(maxsize=None)
def least_similarity(size: int, threshold: float = THRESHOLD) -> float:
    """The least similarity of at least ``threshold`` that a set of ``size`` can have with any other.

    With k shared elements and e of the other set alone it is k / (size + e), so few values are
    possible for a small set: one of three can only be equal to be similar at 0.8.
    """
    least = 1.0
    for shared in range(max(1, math.ceil(threshold * size - 1e-9)), size + 1):
        extra = math.floor(shared / threshold - size + 1e-9)
        least = min(least, shared / (size + max(extra, 0)))
    return least


@functools.lru_cache(maxsize=None)
def levels(size: int, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> tuple[int, ...]:
    """The depths at which a text of ``size`` shingles stands in the forest, shortest prefix first.

    The first is its own: full depth, shortened until the pairs that it can be part of meet with the
    recall wanted. The others are those of texts that could be similar to it and stop before.
    Two similar texts meet at the longer of their own depths, where both stand.
    """
    shortest = matched_depth(threshold, trees, depth, recall)
    if matched_depth(min(1.0, threshold + 1 / (threshold * size)), trees, depth, recall) == shortest:
        return (shortest,)  # so large that it and all that are near its size can come as close to the threshold
    own = lambda n: matched_depth(least_similarity(n, threshold), trees, depth, recall)
    mine = own(size)
    near = range(max(1, math.ceil(threshold * size - 1e-9)), math.floor(size / threshold + 1e-9) + 1)
    return tuple(sorted({mine} | {d for d in map(own, near) if d > mine}))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that sums of word hashes spread over all bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text.

    Words are what blanks and line ends part, in lower case. A text of fewer words than a shingle
    is one shingle of them all; a text without words has none.
    """
    from xxhash import xxh64_intdigest

    blank = pc.utf8_lower(pc.replace_substring_regex(pc.fill_null(texts, "").cast(pa.large_string()), r"[\t\n\v\f\r]", " "))
    parts = pc.split_pattern(blank, " ")
    coded = parts.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    table = np.fromiter((xxh64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))
    filled = np.fromiter((w != "" for w in words), dtype=bool, count=len(words))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    offsets = parts.offsets.to_numpy()
    out = []
    with np.errstate(over="ignore"):
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            own = codes[a:b]
            marks = table[own[filled[own]]] if len(own) else np.zeros(0, np.uint64)
            n = len(marks) - size + 1
            width = size if n > 0 else len(marks)
            n = max(n, 1 if len(marks) else 0)
            total = np.zeros(n, dtype=np.uint64)
            for k in range(width if n else 0):
                total = _mix(total + marks[k : k + n])
            out.append(np.unique(total))
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """MinHash values of a shingle set, trees one after another."""
    low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    best = np.full(TREES * DEPTH, 0xFFFFFFFF, dtype=np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(low), 2048):
            part = low[None, at : at + 2048] * _MULTIPLY[:, None] + _ADD[:, None]
            part ^= part >> np.uint32(15)
            part *= np.uint32(0x2C1B3C6D)
            np.minimum(best, part.min(axis=1), out=best)
    return best


def node_keys(values: np.ndarray, depth: int) -> np.ndarray:
    """The trie node at ``depth`` in which a text stands in each tree, as one 64-bit key."""
    with np.errstate(over="ignore"):
        total = np.arange(1, TREES + 1, dtype=np.uint64)
        for k in range(depth):
            total = _mix(total + values.reshape(TREES, DEPTH)[:, k].astype(np.uint64))
    return total.astype(np.int64)


def _nodes(hashes: np.ndarray, threshold: float, recall: float) -> np.ndarray:
    """All nodes of the forest in which a shingle set stands."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    values = signature(hashes)
    return np.concatenate([node_keys(values, depth) for depth in levels(len(hashes), threshold, recall=recall)])


def _signed(df: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(id, text_hash, shingles, nodes) of each row; nodes: its places in all trees, none without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sets = shingle_sets(part.column(2))
                nodes = [_nodes(s, threshold, recall) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.list_(pa.int64()))],
                    ["id", "text_hash", "shingles", "nodes"],
                )

    kind = df.schema["id"].dataType.simpleString()
    return df.select("id", "text_hash", "text").mapInArrow(tidy(run), f"id {kind}, text_hash string, shingles long, nodes array<long>")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) edges: (id, root), root the least id of the component.

    Large-star and small-star steps by turns until nothing changes. Every step groups with partial
    minima and joins on ids. The minima are stored before they are joined, so that both sides of a
    join are dealt anew and Spark can split a vertex with very many edges. The number of steps
    grows with the logarithm of a component's size.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large)
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        now = cut(small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
        before = state


def _counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted sets."""
    every, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    sizes_l, sizes_r = [len(s) for s in left], [len(s) for s in right]
    at_l, at_r = at[: sum(sizes_l)], at[sum(sizes_l) :]
    row_l, row_r = np.repeat(np.arange(len(left)), sizes_l), np.repeat(np.arange(len(right)), sizes_r)
    shared = np.flatnonzero((np.bincount(at_l, minlength=len(every)) > 0) & (np.bincount(at_r, minlength=len(every)) > 0))
    place = np.full(len(every), -1, dtype=np.int64)
    place[shared] = np.arange(len(shared))
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    width = 1 << 13
    for low in range(0, len(shared), width):
        a = np.zeros((len(left), width), dtype=np.float32)
        b = np.zeros((len(right), width), dtype=np.float32)
        for dense, rows, ats in ((a, row_l, place[at_l]), (b, row_r, place[at_r])):
            here = (ats >= low) & (ats < low + width)
            dense[rows[here], ats[here] - low] = 1
        used = min(width, len(shared) - low)
        out += a[:, :used] @ b[:, :used].T
    return out


def verify_block(ids: np.ndarray, copies: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Links of a block: for each text the weight of its links and the least id it reaches.

    ``sides``: 0 for both sides of a block against itself, else 1 and 2 for two blocks against
    each other. Large blocks are compared a stretch of rows at a time.
    """
    own = np.flatnonzero(sides < 2)
    other = own if not (sides == 2).any() else np.flatnonzero(sides == 2)
    size = np.array([len(s) for s in sets], dtype=np.float64)
    weight, reach = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
    pairs_a, pairs_b = [], []
    for low in range(0, len(own), 512):
        rows = own[low : low + 512]
        shared = _counts([sets[i] for i in rows], [sets[i] for i in other]).astype(np.float64)
        union = size[rows][:, None] + size[other][None, :] - shared
        linked = (shared >= threshold * union - 1e-9) & (ids[rows][:, None] != ids[other][None, :])
        weight[rows] += linked @ copies[other]
        if other is not own:
            weight[other] += linked.T @ copies[rows]
        x, y = np.nonzero(linked)
        pairs_a.append(rows[x])
        pairs_b.append(other[y])
    a = np.concatenate(pairs_a) if pairs_a else np.zeros(0, np.int64)
    b = np.concatenate(pairs_b) if pairs_b else np.zeros(0, np.int64)
    while len(a):
        least = reach.copy()
        np.minimum.at(least, a, reach[b])
        np.minimum.at(least, b, reach[a])
        least = np.minimum(least, least[least])
        if (least == reach).all():
            break
        reach = least
    return weight, reach


def jaccard_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Near-copy classes of all documents: (id, class_id, n_copies, n_links, class_hash).

    Two documents are linked when the Jaccard similarity of their shingle sets is at least
    ``threshold``. The first document of a connected component is the one of least (id, text hash),
    null ids last: ``class_id`` is its id, ``class_hash`` the MD5 of its text, and both together tell
    classes apart where ids repeat. ``n_copies`` is the number of documents with the very same
    text, ``n_links`` the number of other documents linked to it, copies counted. One row per row of
    ``df``, and each row is a document, whether its id is null, repeated or neither. Equal texts
    always share a class. Documents without words (null, empty, blank) are linked to nothing:
    class_id is their own id. Empty table: no rows. Further columns are ignored. Ids may be of any type that
    sorts. Texts are read whole, however long.

    No pair is missed but for the forest's recall at the threshold, which rises fast above it; no
    bucket is capped. Copies are folded into one text before, with partial minima.
    """
    signed, texts = _text_classes(_documents(df, id_col, text_col), threshold, recall)
    return signed.select("id", "text_hash").join(texts.drop("rep"), "text_hash", "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("copies").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("class_hash", "text_hash").alias("class_hash"),
    )


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, text) of each row; ids stay of their type."""
    return df.select(F.col(id_col).alias("id"), F.md5(text_col).alias("text_hash"), F.col(text_col).alias("text"))


def _text_classes(docs: DataFrame, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and for each distinct text with words: (text_hash, rep, copies, links,
    class_id, class_hash), rep the least id of the text.

    Texts are the vertices. A text's key is a number made when texts are stored, so that the graph
    is joined on longs; nothing returned depends on it.
    """
    ship_package(docs.sparkSession)
    signed = cut(_signed(docs, threshold, recall))
    worded = signed.filter("shingles > 0")
    texts = cut(
        worded.groupBy("text_hash").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("shingles").alias("shingles")).withColumn("key", F.monotonically_increasing_id())
    )
    one = texts.select(F.col("text_hash").alias("of"), "rep", "key")
    meet = worded.join(one, (F.col("text_hash") == F.col("of")) & F.col("id").eqNullSafe(F.col("rep"))).select("key", F.explode("nodes").alias("node"))
    heads = meet.groupBy("node").agg(F.min("key").alias("head"), F.max("key").alias("last")).filter("last > head").select("node", "head")
    stars = meet.join(heads, "node").filter("key <> head").select(F.col("key").alias("a"), F.col("head").alias("b")).distinct()
    groups = components(stars)
    members = groups.join(texts.withColumnRenamed("key", "id"), "id")
    spread = F.least(F.ceil(F.count("*") / PART_TEXTS), F.lit(PARTS))
    blocks = members.groupBy("root").agg(F.greatest(spread, F.ceil(F.sum("shingles") / BLOCK), F.ceil(F.count("*") / BLOCK_TEXTS)).cast("int").alias("blocks"))
    member = members.join(blocks, "root").select("id", "text_hash", "rep", "root", "copies", "blocks", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("own"))
    verified = cut(_verified(docs, cut(member), threshold))
    links = verified.groupBy("id").agg(F.sum("links").alias("links"))
    local = verified.filter("blocks = 1").select("id", F.col("reach").alias("root"))
    joined = components(verified.filter("blocks > 1").select(F.col("id").alias("a"), F.col("reach").alias("b")))
    classes = local.unionByName(joined)
    placed = cut(
        texts.join(links, texts["key"] == links["id"], "left").drop("id")
        .join(classes, F.col("key") == classes["id"], "left")
        .select("text_hash", "rep", F.coalesce("root", "key").alias("root"), "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    )
    firsts = placed.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "text_hash")).alias("first"))
    final = placed.join(firsts, "root").select("text_hash", "rep", "copies", "links", F.col("first.rep").alias("class_id"), F.col("first.text_hash").alias("class_hash"))
    return signed, final


def _verified(docs: DataFrame, member: DataFrame, threshold: float) -> DataFrame:
    """(id, blocks, links, reach) of each member for each block pair it stands in."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    member = member.withColumnRenamed("id", "key").withColumnRenamed("text_hash", "of")
    met = docs.join(member, (F.col("text_hash") == F.col("of")) & F.col("id").eqNullSafe(F.col("rep")))
    cast = met.dropDuplicates(["key"]).select(F.col("key").alias("id"), "root", "copies", "blocks", "own", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                raw = pa.array([s.tobytes() for s in shingle_sets(part.column(5))], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:5], raw], ["id", "root", "copies", "blocks", "own", "set"])

    spread = (
        cast.mapInArrow(tidy(sets), "id long, root long, copies long, blocks int, own int, set binary")
        .withColumn("other", other)
        .withColumn("low", F.least("own", "other"))
        .withColumn("high", F.greatest("own", "other"))
        .withColumn("side", F.when(F.col("low") == F.col("high"), 0).when(F.col("own") == F.col("low"), 1).otherwise(2))
    )

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        sets_here = [np.frombuffer(s, dtype=np.uint64) for s in rows["set"]]
        ids = rows["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        links, reach = verify_block(ids[order], rows["copies"].to_numpy()[order], rows["side"].to_numpy()[order], [sets_here[i] for i in order], threshold)
        return pd.DataFrame({"id": ids[order], "blocks": rows["blocks"].to_numpy()[order], "links": links, "reach": ids[order][reach]})

    return spread.groupBy("root", "low", "high").applyInPandas(block, "id long, blocks int, links long, reach long")


#: True for texts in which ``shingle_sets`` finds words.
_HAS_WORDS = r"[^ \t\n\x0B\f\r]"


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each near-copy class, its first by (id, text hash), null ids last, with all columns.

    Every row is a document: those with a null or repeated id go only if their class has an earlier
    one. Of rows alike in id and text the one whose other columns are least as JSON stays. Documents
    without words all stay.
    """
    _, texts = _text_classes(_documents(docs, id_col, text_col), THRESHOLD, RECALL)
    first = texts.filter("text_hash = class_hash").select(F.col("text_hash").alias("hash"), F.col("rep"))
    named = lambda c: F.col(f"`{c}`")
    rest = [named(c) for c in docs.columns if c not in (id_col, text_col)]
    # all columns in one, so that no name of theirs meets one used here
    held = docs.select(F.struct(*map(named, docs.columns)).alias("row"), named(id_col).alias("id"), named(text_col).alias("text"), (F.to_json(F.struct(*rest)) if rest else F.lit("")).alias("rest"))
    kept = (
        held.join(first, (F.md5("text") == F.col("hash")) & F.col("id").eqNullSafe(F.col("rep")))
        .groupBy("hash")
        .agg(F.min_by("row", "rest").alias("row"))
        .select("row.*")
    )
    wordless = held.filter(~F.coalesce(F.col("text"), F.lit("")).rlike(_HAS_WORDS)).select("row.*")
    return kept.unionByName(wordless)
