"""Cross-tokenizer alignment: two tokenizations of a text, cut where both have a token's end.

The byte offsets at which tokens end are one ascending list for each tokenizer. The shorter list
drives a galloping intersection: each of its offsets is sought in the longer one by steps that
double from where the search stands, then by halving. Common offsets cut both tokenizations into
groups, and the ranks between which a token's bytes begin and end are the tokens of the other side
that it overlaps. Texts are tokenized once: what they link is kept in packed form, counted over the
whole corpus, and read again beside the counts.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.plans.lineage import cut
from seqloom.plans.shipping import ship_package

#: Bits of a second tokenizer's ids in a pair's number.
SHIFT = 20
#: Distinct pairs of ids that are broadcast at most; more are joined. 20 bytes each, so 40 MB.
MOST_SHARED = 2_000_000
#: Pairs that a task counts before it hands its partial counts on.
PARTIAL = 1_000_000
#: Driving offsets between which one gallop starts from the last.
STRIDE = 32
#: Characters of texts that are tokenized and aligned together, about.
TOGETHER = 1 << 20


def gallop(driver: np.ndarray, longer: np.ndarray, start: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each driving offset the first place in ``longer``, from ``start`` on, that holds no less.

    ``longer`` ascends from ``start`` to ``last`` and is no less than the offset there. All searches
    go side by side: steps double while what is found is less, then the last step is halved.
    """
    low, high = start.copy(), np.minimum(start, last)
    alive, step = np.arange(len(driver)), 1
    while len(alive):
        less = longer[high[alive]] < driver[alive]
        alive = alive[less]
        low[alive] = high[alive] + 1
        high[alive] = np.minimum(high[alive] + step, last[alive])
        step *= 2
    alive = np.flatnonzero(low < high)
    while len(alive):
        middle = (low[alive] + high[alive]) >> 1
        less = longer[middle] < driver[alive]
        low[alive[less]] = middle[less] + 1
        high[alive[~less]] = middle[~less]
        alive = alive[low[alive] < high[alive]]
    return low


def places(driver: np.ndarray, longer: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """``gallop`` from where the one before it came to: every STRIDE-th offset first, then those between.

    ``first`` and ``last`` bound each offset's own text in ``longer``.
    """
    heads = np.arange(0, len(driver), STRIDE)
    found = gallop(driver[heads], longer, first[heads], last[heads])
    return gallop(driver, longer, np.maximum(np.repeat(found, STRIDE)[: len(driver)], first), last)


class Aligned:
    """Alignment of many texts at once, from the tokens' byte lengths and the number of tokens of each.

    Every text must have equally many bytes, and more than none, on both sides. ``common_a`` and
    ``common_b``: ranks of the tokens that end a group; ``links``: (token of a, token of b) that overlap,
    by the token of the longer side.
    """

    def __init__(self, length_a: np.ndarray, length_b: np.ndarray, count_a: np.ndarray, count_b: np.ndarray):
        self.count_a, self.count_b = count_a, count_b
        end_a, end_b = np.cumsum(length_a), np.cumsum(length_b)  # texts one after another: offsets go on
        stop_a, stop_b = np.cumsum(count_a), np.cumsum(count_b)
        a_drives = count_a <= count_b
        self.common_a, self.common_b, self.link_a, self.link_b = [], [], [], []
        for swapped in (False, True):
            texts = np.flatnonzero(~a_drives if swapped else a_drives)
            sides = ((end_b, stop_b, count_b), (end_a, stop_a, count_a)) if swapped else ((end_a, stop_a, count_a), (end_b, stop_b, count_b))
            short_common, long_common, short_link, long_link = self._one_way(texts, *sides[0], *sides[1])
            for into, what in ((self.common_a, long_common if swapped else short_common), (self.common_b, short_common if swapped else long_common), (self.link_a, long_link if swapped else short_link), (self.link_b, short_link if swapped else long_link)):
                into.append(what)
        self.common_a, self.common_b, self.link_a, self.link_b = (np.concatenate(x) for x in (self.common_a, self.common_b, self.link_a, self.link_b))

    @staticmethod
    def _one_way(texts, short_end, short_stop, short_count, long_end, long_stop, long_count):
        """Of the texts whose first side drives: ranks of common ends, and of overlapping tokens."""
        count = short_count[texts]
        rank = np.repeat(short_stop[texts] - count - np.concatenate(([0], np.cumsum(count)[:-1])).astype(np.int64), count) + np.arange(count.sum()) if len(texts) else np.zeros(0, np.int64)
        first = np.repeat(long_stop[texts] - long_count[texts], count)
        last = np.repeat(long_stop[texts] - 1, count)
        found = places(short_end[rank], long_end, first, last)
        same = long_end[found] == short_end[rank]
        # a token overlaps from where the one before it ended (past it, if both sides end there) to where it ends itself
        begin = np.empty_like(found)
        begin[1:] = found[:-1] + same[:-1]
        starts = np.concatenate(([0], np.cumsum(count)[:-1])).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
        begin[starts] = first[starts]
        many = found - begin + 1
        offset = np.repeat(np.cumsum(many) - many, many)
        return rank[same], found[same], np.repeat(rank, many), np.repeat(begin, many) + np.arange(len(offset)) - offset


class Tokenizers:
    """Both tokenizers of a worker, the bytes of their tokens, and the tokens as decimal text.

    The byte-level one is read from its table of ranks, which gives the very ids of its other form
    and knows no control strings.
    """

    _shared: Tokenizers | None = None

    def __init__(self) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.first = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        of_rank = {rank: token for token, rank in ranks.items()}
        self.bytes_a = [of_rank.get(k, b"") for k in range(max(of_rank) + 1)]
        self.bytes_b = [self._piece(k) for k in range(self.second.get_piece_size())]
        self.length_a, self.length_b = (np.array([len(t) for t in table], dtype=np.int64) for table in (self.bytes_a, self.bytes_b))
        n_a, n_b = len(self.bytes_a), len(self.bytes_b)
        #: each id as text, with what may follow it: of a: another one, or its group's end; of b likewise
        self.text = [f"{k}," for k in range(n_a)] + [f"{k}|" for k in range(n_a)] + [f"{k}," for k in range(n_b)] + [f"{k};" for k in range(n_b)]
        self.at_b = 2 * n_a

    def _piece(self, k: int) -> bytes:
        if self.second.is_control(k) or self.second.is_unknown(k):
            return b""
        piece = self.second.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if self.second.is_byte(k) else piece.replace("▁", " ").encode()

    @classmethod
    def get(cls) -> Tokenizers:
        if cls._shared is None:
            cls._shared = cls()
        return cls._shared

    def __call__(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        """Ids of both sides, and whether the bytes of both are the text's after a space; else it has no tokens."""
        first, second, kept = [], [], np.zeros(len(texts), dtype=bool)
        for k, (text, ids) in enumerate(zip(texts, self.second.encode(texts, num_threads=1), strict=True)):
            raw = b" " + text.encode()
            if text and b"".join(map(self.bytes_b.__getitem__, ids)) == raw:
                own = self.first.encode_ordinary(" " + text)
                if b"".join(map(self.bytes_a.__getitem__, own)) == raw:
                    kept[k] = True
                    first.append(own)
                    second.append(ids)
        return first, second, kept


def pack_links(pairs: np.ndarray, times: np.ndarray) -> bytes:
    """A text's distinct pairs, ascending, and how often each is linked, compressed."""
    import zstandard

    gaps = np.diff(pairs, prepend=0)
    raw = np.concatenate([[len(pairs)], gaps, times]).astype("<i8").view(np.uint8).reshape(-1, 8).T  # byte planes, most of them zeros
    return zstandard.ZstdCompressor(level=1).compress(raw.tobytes())


def unpack_links(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=np.uint8)
    values = np.ascontiguousarray(raw.reshape(8, -1).T).view("<i8").ravel()
    n = int(values[0])
    return np.cumsum(values[1 : 1 + n]), values[1 + n :]


def align_texts(texts: list[str]) -> list[tuple[int, int, int, int, str, bytes | None]]:
    """(n_a, n_b, n_groups, n_links, groups_sha256, packed links) of each text."""
    tools = Tokenizers.get()
    out: list[tuple[int, int, int, int, str, bytes | None]] = [(0, 0, 0, 0, "", None)] * len(texts)
    first, second, kept = tools(texts)
    if not first:
        return out
    count_a, count_b = (np.array([len(x) for x in side], dtype=np.int64) for side in (first, second))
    ids_a, ids_b = (np.concatenate([np.array(x, dtype=np.int64) for x in side]) for side in (first, second))
    found = Aligned(tools.length_a[ids_a], tools.length_b[ids_b], count_a, count_b)
    closes_a, closes_b = np.zeros(len(ids_a), dtype=np.int64), np.zeros(len(ids_b), dtype=np.int64)
    closes_a[found.common_a] = 1
    closes_b[found.common_b] = 1
    group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
    # the order of the groups' text: all of a group's a ids, then its b ids
    merged = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
    merged[np.arange(len(ids_a)) + np.searchsorted(group_b, group_a, side="left")] = ids_a + closes_a * len(tools.bytes_a)
    merged[np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, side="right")] = ids_b + closes_b * len(tools.bytes_b) + tools.at_b
    merged = merged.tolist()
    stop_a, stop_b = np.cumsum(count_a), np.cumsum(count_b)
    stop = stop_a + stop_b
    groups = np.diff(np.searchsorted(np.sort(found.common_a), stop_a), prepend=0)
    of_link = np.searchsorted(stop_a, found.link_a, side="right")
    order = np.lexsort((pairs := (ids_a[found.link_a] << SHIFT) | ids_b[found.link_b], of_link))
    pairs, of_link = pairs[order], of_link[order]
    fresh = np.flatnonzero(np.concatenate(([True], (pairs[1:] != pairs[:-1]) | (of_link[1:] != of_link[:-1]))))
    times = np.diff(np.append(fresh, len(pairs)))
    ends = np.searchsorted(of_link[fresh], np.arange(len(first)), side="right")
    links = np.bincount(of_link, minlength=len(first))
    begin = 0
    for k, place in enumerate(np.flatnonzero(kept).tolist()):
        low = int(ends[k - 1]) if k else 0
        text = "".join(map(tools.text.__getitem__, merged[begin : stop[k]]))[:-1]
        begin = stop[k]
        out[place] = (int(count_a[k]), int(count_b[k]), int(groups[k]), int(links[k]), hashlib.sha256(text.encode()).hexdigest(), pack_links(pairs[fresh[low : ends[k]]], times[low : ends[k]]))
    return out


def _parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of bounded size together; a text is whole."""
    start, total = 0, 0
    for k, text in enumerate(texts):
        total += len(text)
        if total >= TOGETHER:
            yield start, k + 1
            start, total = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


_ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"


def aligned_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, links) of each row, stored.

    ``links`` has the distinct pairs of ids that overlap and their numbers, packed, null without tokens.
    """
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for low, high in _parts(texts):
                found = list(zip(*align_texts(texts[low:high]), strict=True))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *[pa.array(v, t) for v, t in zip(found, kinds, strict=True)]], names)

    names = ["id", *[f.split()[0] for f in _ALIGNED.split(", ")]]
    kind = df.schema[id_col].dataType.simpleString()
    return cut(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {_ALIGNED}"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n_docs, best) for each pair of ids linked anywhere: how many rows hold it, and whether no
    other pair of its first id is held by more."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def counted() -> pa.RecordBatch:
            pairs, times = np.unique(np.concatenate(waiting), return_counts=True) if waiting else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(times)], ["pair", "n"])

        for batch in batches:
            for packed in batch.column(0).to_pylist():
                waiting.append(unpack_links(packed)[0])
                size += len(waiting[-1])
                if size >= PARTIAL:
                    yield counted()
                    waiting, size = [], 0
        yield counted()

    each = aligned.filter("links IS NOT NULL").select("links").mapInArrow(partial, "pair long, n long")
    counts = cut(each.groupBy("pair").agg(F.sum("n").alias("n_docs")).withColumn("a", F.shiftright("pair", SHIFT)))
    most = counts.groupBy("a").agg(F.max("n_docs").alias("most"))
    return cut(counts.join(most, "a").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best")))


def _with_shared(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, ..., n_best, count_sum) by a broadcast table of counts."""
    spark = aligned.sparkSession
    rows = counts.toArrow().sort_by("pair")
    shared = spark.sparkContext.broadcast(tuple(rows[c].to_numpy() for c in ("pair", "n_docs", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n_docs, best = shared.value
        for batch in batches:
            n_best, total = [], []
            for packed in batch.column("links").to_pylist():
                if packed is None:
                    n_best.append(0)
                    total.append(0)
                    continue
                own, times = unpack_links(packed)
                at = np.searchsorted(pair, own)
                n_best.append(int(times[best[at]].sum()))
                total.append(int(times @ n_docs[at]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n_best, pa.int64()), pa.array(total, pa.int64())], [*batch.schema.names[:-1], "n_best", "count_sum"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.schema if f.name != "links"]
    return aligned.mapInArrow(run, ", ".join([*fields, "n_best long", "count_sum long"]))


def _with_joined(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """The same by a join on pairs, for more of them than are broadcast."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pairs, times = unpack_links(packed)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), row)), pa.array(pairs), pa.array(times)], ["row", "pair", "times"])

    stored = cut(aligned.withColumn("row", F.monotonically_increasing_id()))
    each = stored.filter("links IS NOT NULL").select("row", "links").mapInArrow(spread, "row long, pair long, times long")
    sums = each.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n_docs")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return stored.join(sums, "row", "left").drop("row", "links").withColumns({"n_best": F.coalesce("n_best", zero), "count_sum": F.coalesce("count_sum", zero)})


def align_tokenizers(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_shared: int = MOST_SHARED) -> DataFrame:
    """How the two tokenizations of each text overlap:
    (id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum).

    A token of each side is linked to all of the other's whose bytes overlap its own. A pair of ids
    counts once for each row that links it anywhere. ``n_best``: links whose pair no other pair of its a
    id outnumbers; ``count_sum``: their counts, over all links. Null and empty texts, and those of which
    either side's tokens aren't the text's bytes after a space, have no tokens: zeros and no digest.

    One row per row: repeated rows and null ids count as rows of their own; an empty table gives none;
    further columns are ignored. Texts are aligned whole; a very long one is one row's work. Counts of
    up to ``most_shared`` distinct pairs go to the workers as one table, more are joined; both give the
    same.
    """
    aligned = aligned_texts(df, id_col, text_col)
    counts = pair_counts(aligned)
    found = _with_shared(aligned, counts) if counts.count() <= most_shared else _with_joined(aligned, counts)
    return found.withColumnRenamed("id", id_col)
