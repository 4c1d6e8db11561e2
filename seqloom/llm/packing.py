"""Best-fit packing of token pieces by a grouping genetic algorithm.

Documents are tokenized and cut into pieces of at most a sequence's length. Pieces are dealt into
cells; each cell is packed by several islands, populations of packings whose genes are whole bins.
Crossover injects well-filled bins of one parent into the other, drops the bins that hold pieces
twice, and best-fits the displaced pieces. Between epochs each island's elite moves on to the next
island of its cell through a shuffle. Packings of equally many bins compete by how much of the
empty space they gather in few bins; the emptiest bins of all cells are then dealt into new cells
and evolve once more, from the packing they have. Only lengths are shuffled, never texts or tokens.
"""

from __future__ import annotations

import bisect
import math
import os
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqloom.llm.workers import tidy
from seqloom.plans.lineage import cut
from seqloom.plans.shipping import ship_package

#: Tokens of a sequence, and the id that ends each document.
CAPACITY, END_ID = 4096, 1
#: Pieces of a cell on average, islands of a cell, packings of an island.
CELL, ISLANDS, POPULATION = 4096, 2, 4
#: Epochs (with a migration between them) and crossovers of an island in each.
EPOCHS, CROSSOVERS = 2, 4
#: Share of a cell's bins, the emptiest ones and one at least, that are packed again with other cells'.
LEFT = 0.02
#: Distinct words that a Python worker remembers: twice this many at most, the latest used ones.
CACHE = 120_000
#: Bytes of text that are tokenized at once.
SLICE = 2 << 20


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _WordIds:
    """Token ids of blank-separated words, remembered within a worker.

    This tokenizer drops white space and never joins what white space parts, so a text's ids are
    those of its words one after another, and each distinct word is tokenized once. A word of Latin
    letters is one unit for it, in lower case: such words go in many to a call, without the
    normalizing and splitting that would leave them as they are.
    """

    _shared: dict[str, _WordIds] = {}
    _LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.of_ascii, self.of_latin = (Tokenizer(self.tokenizer.model) for _ in range(2))  # its words and merges are shared
        blanks, raw = pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.of_ascii.pre_tokenizer = blanks  # ASCII letters stand for their own bytes
        self.of_latin.pre_tokenizer = pre_tokenizers.Sequence([blanks, raw])
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])

    @classmethod
    def of(cls, path: str) -> _WordIds:
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def _learn_letters(self, units, words: list[str]) -> None:
        """Words of lower-case letters only."""
        lines = [" ".join(words[at : at + 512]) for at in range(0, len(words), 512)]
        for at, found in enumerate(units.encode_batch_fast(lines, add_special_tokens=False)):
            some = words[512 * at : 512 * at + 512]
            ids = np.array(found.ids, dtype="<u4")
            stops = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            assert len(stops) == len(some), "a word of letters is one unit"
            raw, start = ids.tobytes(), 0
            for word, stop in zip(some, stops, strict=True):
                self.known[word] = raw[start:stop]
                start = stop

    def __call__(self, words: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each word."""
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        fresh = []
        for word in words:
            if word not in known:
                if word in older:
                    known[word] = older[word]
                else:
                    fresh.append(word)
        plain, rest, letters = {}, [], self._LETTERS.fullmatch
        for word in fresh:
            if letters(word):
                plain[word] = word.lower()
            else:
                rest.append(word)
        units = [w for w in dict.fromkeys(plain.values()) if w not in known]
        self._learn_letters(self.of_ascii, [w for w in units if w.isascii()])
        self._learn_letters(self.of_latin, [w for w in units if not w.isascii()])
        for word, low in plain.items():
            known[word] = known[low]
        for word, found in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            known[word] = np.array(found.ids, dtype="<u4").tobytes()
        return [known[w] for w in words]


#: The tokenizer's own control strings, which it finds before it lowers or splits a text.
_SPECIAL = re.compile(r"<\|(startoftext|endoftext)\|>")
#: A letter before a mark that the tokenizer always parts from it. A bar is none, since control strings have it.
_MARKED = r"([a-zà-öø-ÿ])([.,;:!?#$%&*\"()\[\]{}/+=_-])"


def _blank_separated(texts: pa.Array) -> pa.Array:
    """Texts with the same ids, in which fewer distinct words stand between blanks.

    ASCII letters are lowered and a blank parts each letter from a mark after it, as the tokenizer
    does itself; texts whose lowered form has one of its control strings stay as they are.
    """
    flat = pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), "\n", " ")
    low = pc.ascii_lower(flat)
    keep = pc.match_substring_regex(low, _SPECIAL.pattern)
    return pc.if_else(keep, flat, pc.replace_substring_regex(low, _MARKED, r"\1 \2"))


def _ids_of(texts: pa.Array, words: _WordIds) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, ends): the ids of each text followed by END_ID, texts one after another."""
    parts = pc.split_pattern(_blank_separated(texts), " ")
    coded = parts.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    raw = words(coded.dictionary.to_pylist())
    flat = np.frombuffer(b"".join(raw), dtype="<u4")
    sizes = np.fromiter((len(r) >> 2 for r in raw), dtype=np.int32, count=len(raw))
    starts = np.cumsum(sizes) - sizes
    n = sizes[codes]
    upto = np.concatenate(([0], np.cumsum(n)))
    first = upto[parts.offsets.to_numpy()]  # ids before each text
    lengths = np.diff(first)
    ends = np.cumsum(lengths + 1)
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint32)
    if len(ends):
        place = np.arange(upto[-1], dtype=np.int32) + np.repeat((starts[codes] - upto[:-1]).astype(np.int32), n)
        mask = np.ones(len(out), dtype=bool)
        mask[ends - 1] = False
        out[mask] = flat[place]
        out[ends - 1] = END_ID
    return out, ends


def token_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of the tokenized texts: (id, piece int, start, length, ids_crc32).

    A document is its token ids and END_ID; only one of more than ``capacity`` ids is cut, into
    pieces of that many, the last maybe shorter. Null and empty texts are END_ID alone. Repeated rows
    give repeated pieces. Further columns are ignored.
    """
    path = path or tokenizer_path()
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordIds.of(path)
        for batch in batches:
            for start, stop in _slices(batch.column(1)):
                keys, texts = batch.column(0)[start:stop], batch.column(1)[start:stop]
                ids, ends = _ids_of(texts, words)
                rows: list[tuple[int, int, int, int, int]] = []
                before = 0
                for row, end in enumerate(ends.tolist()):
                    for piece, at in enumerate(range(before, end, capacity)):
                        here = ids[at : min(at + capacity, end)]
                        rows.append((row, piece, at - before, len(here), zlib.crc32(here)))
                    before = end
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])],
                    [id_col, "piece", "start", "length", "ids_crc32"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


def _slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for k, n in enumerate(sizes):
        total += int(n)
        if total >= most:
            yield start, k + 1
            start, total = k + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def best_fit(items: list[int], lengths: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Put items, in the order given, each into the fullest bin that has room; extend ``bins``."""
    room = sorted((capacity - sum(lengths[i] for i in b), k) for k, b in enumerate(bins))
    for i in items:
        at = bisect.bisect_left(room, (lengths[i], -1))
        if at == len(room):
            bins.append([i])
            left, k = capacity - lengths[i], len(bins) - 1
        else:
            left, k = room.pop(at)
            bins[k].append(i)
            left -= lengths[i]
        if left:
            bisect.insort(room, (left, k))
    return bins


def fitness(bins: list[list[int]], lengths: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones (the sum of squared fills), so that empty space gathers."""
    return -len(bins), sum((sum([lengths[i] for i in b]) / capacity) ** 2 for b in bins)


def crossover(mother: list[list[int]], father: list[list[int]], lengths: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Inject a share of the father's fullest bins whole, drop what they duplicate, best-fit the rest."""
    ranked = sorted(father, key=lambda b: -sum(lengths[i] for i in b))
    full = [b for b in ranked[: max(1, len(ranked) // 2)] if rng.random() < 0.5] or ranked[:1]
    inside = {i for b in full for i in b}
    kept, displaced = [list(b) for b in full], []
    for b in mother:
        if inside.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced += [i for i in b if i not in inside]
    # a few of the emptiest bins are dissolved as well, so that their pieces can find better places
    kept.sort(key=lambda b: -sum(lengths[i] for i in b))
    for _ in range(min(len(kept) - 1, 1 + len(kept) // 50)):
        displaced += kept.pop()
    return best_fit(sorted(displaced, key=lambda i: (-lengths[i], i)), lengths, kept, capacity)


def evolve(lengths: list[int], seeds: list[list[list[int]]], rng: random.Random, capacity: int = CAPACITY, population: int = POPULATION, crossovers: int = CROSSOVERS) -> list[list[int]]:
    """The best packing of one island after an epoch.

    Starts from ``seeds`` (packings that came in), best-fit of the descending order, and best-fit of
    shuffled near-descending orders. Never worse than any seed.
    """
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    people = [s for s in seeds if s]
    if len(people) < population:
        people.append(best_fit(order, lengths, [], capacity))
    while len(people) < population:
        jitter = [n * rng.uniform(0.9, 1.0) for n in lengths]
        people.append(best_fit(sorted(order, key=lambda i: -jitter[i]), lengths, [], capacity))
    ranked = sorted(((fitness(p, lengths, capacity), p) for p in people), key=lambda x: x[0], reverse=True)
    for _ in range(crossovers):
        mother, father = ranked[0][1], ranked[rng.randrange(1, len(ranked))][1]
        if rng.random() < 0.5:
            mother, father = father, mother
        child = crossover(mother, father, lengths, capacity, rng)
        ranked = sorted([*ranked, (fitness(child, lengths, capacity), child)], key=lambda x: x[0], reverse=True)[:population]
    return ranked[0][1]


def _packing(bins: list[list[int]], lengths: list[int]) -> np.ndarray:
    """The bin of each piece, bins numbered from the emptiest one."""
    out = np.empty(len(lengths), dtype=np.int32)
    for k, b in enumerate(sorted(bins, key=lambda b: (sum([lengths[i] for i in b]), min(b)))):
        out[b] = k
    return out


def _bins(packing: np.ndarray) -> list[list[int]]:
    """The pieces of each bin; bins may be numbered by any integers."""
    bins: dict[int, list[int]] = {}
    for i, k in enumerate(packing.tolist()):
        bins.setdefault(k, []).append(i)
    return list(bins.values())


def _one_epoch(level: int, epoch: int, capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            best, rank = [], []
            for c, k, lens, elites in zip(batch["cell"], batch["island"], batch["lengths"], batch["elites"], strict=True):
                sizes = [int(n) for n in lens]
                found = evolve(sizes, [_bins(e) for e in elites], random.Random(f"{level}:{c}:{k}:{epoch}"), capacity)
                best.append(_packing(found, sizes))
                rank.append(-fitness(found, sizes, capacity)[1])
            yield pd.DataFrame({"cell": batch["cell"], "island": batch["island"], "lengths": batch["lengths"], "packing": best, "rank": rank})

    return run


def _tasks(spark: SparkSession, islands: int) -> int:
    """Tasks for so many islands: bytes say little of their work, so Spark's own merging would leave too few."""
    return max(1, min(islands, int(spark.conf.get("spark.sql.shuffle.partitions"))), math.ceil(islands / 256))


def _evolved(loose: DataFrame, level: int, capacity: int, islands: int, epochs: int) -> DataFrame:
    """Pack the pieces (tie, n, cell, label) of each cell: (cell, tie, n, bin, bins).

    ``label`` is the bin that a piece comes in, null if it comes in none; the packing by labels is
    one of those that each island starts from. ``bins`` is the number of bins of the cell.
    """
    items = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "tie", "label")))
    cells = cut(loose.groupBy("cell").agg(items.alias("items")))
    tasks = _tasks(loose.sparkSession, cells.count() * islands)
    labels = F.transform("items", lambda x: x["label"])
    lengths = F.transform("items", lambda x: -x["less"])
    state = cells.select(
        "cell",
        F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
        lengths.alias("lengths"),
        F.when(F.exists(labels, lambda x: x.isNull()), F.array().cast("array<array<int>>")).otherwise(F.array(labels)).alias("elites"),
    )
    for epoch in range(epochs):
        spread = state.repartition(tasks, "cell", "island")
        packed = cut(spread.mapInPandas(tidy(_one_epoch(level, epoch, capacity)), "cell long, island int, lengths array<int>, packing array<int>, rank double"))
        moved = packed.select("cell", ((F.col("island") + 1) % islands).alias("island"), F.array("packing").alias("elites"))
        own = packed.select("cell", "island", "lengths", F.array("packing").alias("kept"))
        state = own.join(moved, ["cell", "island"]).select("cell", "island", "lengths", F.concat("kept", "elites").alias("elites"))
    bins = F.array_max("packing") + 1
    best = packed.groupBy("cell").agg(F.min_by(F.struct("packing", bins.alias("bins")), F.struct(bins, "rank", "island")).alias("best"))
    each = cells.join(best, "cell").select("cell", "best.bins", F.explode(F.arrays_zip("items", "best.packing")).alias("x"))
    return each.select("cell", F.col("x.items.tie").alias("tie"), (-F.col("x.items.less")).alias("n"), F.col("x.packing").alias("bin"), "bins")


def pack_pieces(pieces: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, cell: int = CELL, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """Place each piece in a sequence: adds ``sequence_id`` and ``offset``.

    Full pieces are sequences of their own. The others are dealt by a hash into cells of about
    ``cell`` pieces (a document's pieces and repeated rows spread too), so work per task is bounded
    at any size; the hash is of a row's place in the stored pieces. ``islands`` copies of a cell's
    lengths evolve apart; after each epoch an island's elite goes to the next one. The emptiest bins
    of each cell are dealt whole into new cells and evolve in the same way, never into more bins.
    Places inside a sequence go by id, then piece. Runs over the same files and settings agree.
    An empty table gives no rows. Further columns stay, but for the two that are added.
    """
    ship_package(pieces.sparkSession)
    named = lambda c: F.col(f"`{c}`")
    # all columns in one, so that no name of theirs meets one used here
    held = F.struct(*[named(c) for c in pieces.columns if c not in ("sequence_id", "offset")])
    rows = cut(pieces.select(held.alias("row"), named(id_col).alias("id"), "piece", "length").withColumn("tie", F.monotonically_increasing_id()))
    loose = rows.filter(F.col("length") < capacity).select("tie", F.col("length").cast("int").alias("n"))
    cells = max(1, math.ceil(loose.count() / cell))
    dealt = loose.withColumns({"cell": F.pmod(F.xxhash64("tie"), F.lit(cells)), "label": F.lit(None).cast("int")})
    first = cut(_evolved(dealt, 0, capacity, islands, epochs))
    place = lambda start: F.shiftleft(F.col("cell") + start, 31) + F.col("bin")
    if cells == 1:
        placed = first.select("tie", place(0).alias("sequence_id"))
    else:
        again = F.col("bin") < F.greatest(F.lit(1), F.floor(F.col("bins") * LEFT))
        emptiest = first.filter(again)
        others = max(1, math.ceil(emptiest.count() / cell))
        label = F.xxhash64("cell", "bin")
        regrouped = emptiest.select("tie", "n", F.pmod(label, F.lit(others)).alias("cell"), F.dense_rank().over(Window.partitionBy(F.pmod(label, F.lit(others))).orderBy("cell", "bin")).cast("int").alias("label"))
        second = _evolved(regrouped, 1, capacity, islands, epochs)
        placed = first.filter(~again).select("tie", place(0).alias("sequence_id")).unionByName(second.select("tie", place(cells).alias("sequence_id")))
    inside = Window.partitionBy("sequence_id").orderBy(F.col("id").asc_nulls_first(), "piece", "tie").rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(placed, "tie")
    packed = joined.select("row.*", "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long").alias("offset"))
    full = rows.filter(F.col("length") == capacity).select("row.*", (-1 - F.col("tie")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)
