"""The tokenizer alignment against plain loops."""

import hashlib
import random

import numpy as np
import pytest

from seqloom.llm import alignment


def tokens(text):
    """(ids, byte ends) of both sides, or none of either."""
    tools = alignment.Tokenizers.get()
    a = tools.first.encode_ordinary(" " + text) if text else []
    b = tools.second.encode(text) if text else []
    raw = b" " + text.encode()
    if not text or b"".join(tools.bytes_a[i] for i in a) != raw or b"".join(tools.bytes_b[i] for i in b) != raw:
        return ([], []), ([], [])
    return tuple((ids, list(np.cumsum([len(table[i]) for i in ids]))) for ids, table in ((a, tools.bytes_a), (b, tools.bytes_b)))


def by_loops(texts):
    """n_a, n_b, n_groups, n_links, digest, n_best, count_sum of each text."""
    linked, out = [], []
    for text in texts:
        (a, end_a), (b, end_b) = tokens(text or "")
        links = [
            (a[i], b[j])
            for i in range(len(a))
            for j in range(len(b))
            if (end_a[i - 1] if i else 0) < end_b[j] and (end_b[j - 1] if j else 0) < end_a[i]
        ]
        groups, i, j = [], 0, 0
        for stop in sorted(set(end_a) & set(end_b)):
            i2, j2 = end_a.index(stop) + 1, end_b.index(stop) + 1
            groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            i, j = i2, j2
        linked.append(links)
        out.append((len(a), len(b), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    counts, most = {}, {}
    for links in linked:
        for pair in set(links):
            counts[pair] = counts.get(pair, 0) + 1
    for (a, _), n in counts.items():
        most[a] = max(most.get(a, 0), n)
    return [(*row, sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links)) for row, links in zip(out, linked, strict=True)]


TEXTS = [
    "The thing is tokenized twice.", "The thing is tokenized twice.", "", None, "x", "  two  blanks\n\tand more ", "<|endoftext|></s><unk> stay text",
    "Übergrößenträger çà et là", "日本語のテキスト 🎉🎉", "a▁b", "\0\x01", "ñ" * 40, " ".join(f"word{k}" for k in range(120)),
]


@pytest.mark.parametrize("most_shared", [alignment.MOST_SHARED, 0])
def test_alignment_equals_plain_loops(spark, most_shared):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS)] + [(None, "The thing", "y"), (3, "is", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, pair string").repartition(3)
    found = alignment.align_tokenizers(df, most_shared=most_shared).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum").collect()
    wanted = [(r[0], *line) for r, line in zip(rows, by_loops([t for _, t, _ in rows]), strict=True)]
    assert sorted(map(repr, (tuple(r) for r in found))) == sorted(map(repr, wanted))


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id string, text string")
    assert alignment.align_tokenizers(df).collect() == []


def test_gallop_finds_first_places():
    deal = np.random.RandomState(3)
    for n, m in ((1, 1), (5, 400), (300, 310), (1000, 5000)):
        longer = np.sort(deal.choice(10 * m, m, replace=False))
        driver = np.sort(deal.choice(longer[-1] + 1, n))
        first, last = np.zeros(n, np.int64), np.full(n, m - 1)
        assert (alignment.places(driver, longer, first, last) == np.searchsorted(longer, driver)).all()


def test_links_read_back():
    pairs = np.array([5, 9, (50_000 << alignment.SHIFT) | 31_999])
    back = alignment.unpack_links(alignment.pack_links(pairs, np.array([1, 70_000, 3])))
    assert back[0].tolist() == pairs.tolist() and back[1].tolist() == [1, 70_000, 3]


def test_both_forms_of_the_first_tokenizer_agree():
    import public_tokenizers
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    deal = random.Random(4)
    pools = [range(0x20, 0x7F), range(0xA0, 0x2000), range(0x2000, 0xD800), range(0x10000, 0x1F000), [32, 10, 9, 13, 11, 0xA0, 39, 115, 116, 48]]
    texts = ["".join(chr(deal.choice(deal.choice(pools))) for _ in range(deal.randint(1, 30))) for _ in range(3000)] + [t for t in TEXTS if t]
    ours = [alignment.Tokenizers.get().first.encode_ordinary(" " + t) for t in texts]
    assert ours == [e.ids for e in other.encode_batch([" " + t for t in texts], add_special_tokens=False)]
