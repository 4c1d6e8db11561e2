"""Packing: pieces against the plain tokenizer, whole sequences, quality of the packings."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from seqloom.llm import packing as P


def test_ids_are_those_of_whole_texts():
    words = P._WordIds.of(P.tokenizer_path())
    latin = ["Éa È.Ê, ÿß", "x=y{z}[w] a$$$ b*** c|d|e", "<|ENDOFTEXT|> Ab", "e\u0301a. =\u0338 a=\u0338"]
    texts = [*latin, None, "", "  a  b\n\n", "<|endoftext|> x<|startoftext|>", "it's I'll 123 a1b2 ΣΑΣ İx é é x|y", "A B c\x1cd e\tf", "Hello, WORLD!!! (abc) ### $%$", "don't stop... e.g., 'tis 1,000.50"]
    ids, ends = P._ids_of(pa.array(texts), words)
    before = 0
    for text, end in zip(texts, ends, strict=True):
        assert ids[before:end].tolist() == words.tokenizer.encode(text or "", add_special_tokens=False).ids + [1], text
        before = end


def test_packed_pieces_are_whole(spark):
    rng = random.Random(3)
    table = [(k, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice([0, 5, 300, 1200, 5000])))) for k in range(60)] + [(7, "same"), (7, "same"), (None, None)]
    frame = spark.createDataFrame(table, "doc_id long, text string")
    names = ("tie", "cell", "item", "bin", "n", "label", "bins")
    pieces = P.token_pieces(frame).withColumns({name: F.concat(F.lit(name), F.col("ids_crc32")) for name in names})
    rows = P.pack_pieces(pieces, cell=40).collect()
    assert all(r[name] == f"{name}{r['ids_crc32']}" for r in rows for name in names)
    tokenizer = P._WordIds.of(P.tokenizer_path()).tokenizer
    wanted = []
    for key, text in table:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            here = ids[start : start + 4096]
            wanted.append((key, piece, start, len(here), zlib.crc32(np.array(here, dtype="<u4").tobytes())))
    plain = lambda x: tuple(str(v) for v in x)
    assert sorted(map(plain, ((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows))) == sorted(map(plain, wanted))
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(w[3] for w in wanted)
    assert len(sequences) <= -(-total // 4096) + 4


def test_no_documents(spark):
    assert P.pack_pieces(P.token_pieces(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def test_crossover_keeps_every_piece_once():
    rng = random.Random(1)
    lengths = [rng.randint(1, 4095) for _ in range(300)]
    order = lambda: rng.sample(range(300), 300)
    mother, father = (P.best_fit(order(), lengths, [], 4096) for _ in range(2))
    child = P.crossover(mother, father, lengths, 4096, rng)
    assert sorted(i for b in child for i in b) == list(range(300))
    assert all(sum(lengths[i] for i in b) <= 4096 for b in child)


def test_evolution_never_loses_to_best_fit():
    rng = random.Random(2)
    better = 0
    for trial in range(5):
        lengths = [rng.randint(900, 2300) for _ in range(400)]
        plain = P.best_fit(sorted(range(400), key=lambda i: -lengths[i]), lengths, [], 4096)
        found = P.evolve(lengths, [], random.Random(trial), crossovers=20)
        assert sorted(i for b in found for i in b) == list(range(400))
        assert len(found) <= len(plain)
        better += len(found) < len(plain)
    assert better >= 1


def test_islands_beat_best_fit_through_the_query_path(spark):
    """Best-fit of each cell misses what evolution, migration and the second deal reach."""
    rng = random.Random(5)
    lengths = [rng.randint(900, 2300) for _ in range(900)]
    frame = spark.createDataFrame([(k, 0, 0, n, k) for k, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")

    def used(**settings):
        rows = P.pack_pieces(frame, cell=300, **settings).collect()
        assert sorted(r["doc_id"] for r in rows) == list(range(900))
        return len({r["sequence_id"] for r in rows})

    plain = len(P.best_fit(sorted(range(900), key=lambda i: -lengths[i]), lengths, [], 4096))
    found = used(islands=3, epochs=4)
    assert -(-sum(lengths) // 4096) <= found < plain
    assert found <= used(islands=1, epochs=1)


def test_second_deal_gathers_the_cells_rest(spark):
    frame = spark.createDataFrame([(k, 0, 0, 100, k) for k in range(1000)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = P.pack_pieces(frame, cell=50).collect()
    assert len({r["sequence_id"] for r in rows}) <= 30  # 40 without it


def test_a_packing_that_comes_in_is_never_lost():
    lengths = [3000, 1096, 2000, 2096, 1000]
    perfect = [[0, 1], [2, 3], [4]]
    found = P.evolve(lengths, [perfect], random.Random(0), crossovers=8)
    assert len(found) == 3
    assert P._bins(P._packing(found, lengths)) and P._packing(perfect, lengths).tolist() == [1, 1, 2, 2, 0]
