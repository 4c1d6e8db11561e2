"""License scans: exact and edited wordings, clean text, odd input."""

import random

import pytest

from seqloom.llm import licenses as L


@pytest.mark.parametrize(("name", "wording"), L.TEMPLATES)
def test_every_template_finds_itself(name, wording):
    text = f"é Some words before.\n\n{wording}\n\nAnd after."
    found = [x for low, high in L.blocks(text) for x in L.scan_block(text[low:high])]
    assert found and found[0][0] == name and found[0][5:] == ("", "")


def test_wording_differences_are_exact():
    text = L.TEMPLATES[15][1].replace("granted", "given")
    (found,) = L.scan_block(text)
    assert (found[0], found[5], found[6]) == ("MIT", "granted", "given")


@pytest.mark.parametrize("text", ["", "no cue at all", "the license plate of my car", "copyright law is long and warrants study", "permission slip for the school trip"])
def test_other_text_is_left_alone(text):
    assert [x for low, high in L.blocks(text) for x in L.scan_block(text[low:high])] == []


def test_close_versions_are_told_apart():
    for name in ("GPL-2.0", "GPL-3.0", "LGPL-3.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0"):
        wording = next(w for n, w in L.TEMPLATES if n == name)
        assert [x[0] for x in L.scan_block(wording)] == [name]


def test_two_licenses_in_a_block():
    block = "Released under the MIT License. Some code is other. Licensed under CC BY-NC 4.0."
    assert [(x[0], block[x[1] : x[2]]) for x in L.scan_block(block)] == [("MIT", "Released under the MIT License"), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0")]


def test_documents(spark):
    line = "Released under the MIT License."
    rows = [(1, f"é\n{line} more"), (2, None), (3, ""), (4, "word " * 50_000 + "\n" + line), (5, line), (5, line), (6, "nothing")]
    frame = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, license string")
    found = sorted((r["doc_id"], r["start"], r["end"], r["license"], r["exact"]) for r in L.find_licenses(frame).collect())
    assert found == [(1, 2, 32, "MIT", True), (4, 250001, 250031, "MIT", True), (5, 0, 30, "MIT", True), (5, 0, 30, "MIT", True)]
    assert L.find_licenses(frame.limit(0)).count() == 0


@pytest.mark.parametrize("words", [0, 700, 10_000])
@pytest.mark.parametrize(("name", "wording"), L.TEMPLATES)
def test_long_paragraphs_keep_their_license(name, wording, words):
    """Whatever stands around it in its paragraph: before and after, on its own lines or others'."""
    rng = random.Random(words)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 9))) for _ in range(n))
    broken = wording.split()
    broken = " ".join(broken[:2]) + "\n" + " ".join(broken[2:])
    for text in (f"{wording} {prose(words)}", f"{prose(words)} {wording} {prose(words)}", f"{prose(words)}\n{broken}\n{prose(words)}"):
        found = [x for low, high in L.blocks(text) for x in L.scan_block(text[low:high])]
        assert [x[0] for x in found] == [name] and found[0][5:] == ("", "")


def test_many_licenses_in_one_paragraph():
    text = "and so on ".join(f"{wording} " * 3 for _, wording in L.TEMPLATES)
    assert [x[0] for x in L.scan_block(text)] == [name for name, _ in L.TEMPLATES for _ in range(3)]


def test_licenses_of_null_and_repeated_ids(spark):
    mit, cc = "Released under the MIT License.", "Licensed under CC BY 4.0."
    frame = spark.createDataFrame([(None, mit), (1, mit), (1, cc), (1, mit), (2, "nothing"), (3, None)], "doc_id long, text string")
    found = {r["doc_id"]: (r["licenses"], r["n_findings"]) for r in L.document_licenses(frame).collect()}
    assert found == {None: ("MIT", 1), 1: ("CC-BY-4.0,MIT", 3), 2: ("", 0), 3: ("", 0)}
    assert L.document_licenses(frame.limit(0)).count() == 0


def as_file(wording, mark=""):
    """A wording in the layout of a license file: title and copyright line, lines of 70 letters, blank lines between sentences."""
    import textwrap

    parts = [p for p in wording.replace(": ", ":\n").replace(". ", ".\n").split("\n") if p]
    paragraphs = ["Some Project", "Copyright (c) 2021 Some One <some@one.example>", *parts]
    return "\n".join(mark + line for p in paragraphs for line in [*textwrap.wrap(p, 70), ""])


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
@pytest.mark.parametrize(("name", "wording"), L.TEMPLATES)
def test_license_files_in_their_usual_layout(name, wording, mark):
    text = as_file(wording, mark)
    found = [x for low, high in L.blocks(text) for x in L.scan_block(text[low:high])]
    assert [x[0] for x in found] == [name]


def test_numbered_clauses_are_found():
    wording = next(w for n, w in L.TEMPLATES if n == "BSD-3-Clause" and len(w) > 100)
    text = wording.replace("Redistributions of", "\n\n1. Redistributions of").replace("Redistributions in", "\n\n2. Redistributions in").replace("Neither", "\n\n3. Neither").replace("THIS", "\n\nTHIS")
    found = [x for low, high in L.blocks(text) for x in L.scan_block(text[low:high])]
    assert [(x[0], x[5]) for x in found] == [("BSD-3-Clause", "")] and set(found[0][6].split()) <= {"1", "2", "3"}


def by_every_window(text):
    """Licenses of a text by comparing every template at every word, without compression."""
    import difflib

    words = [(m[0].lower(), m.start(), m.end()) for m in L._WORD.finditer(text)]
    held = []
    for name, wording in L.TEMPLATES:
        wording = L._words(wording)
        own, bag = set(wording), len(wording) - int((1 - L.LEAST_FOUND) * len(wording))
        for at in range(len(words)):
            window = [w for w, _, _ in words[at : at + L._width(len(wording))]]
            if window and window[0] in own and sum(w in own for w in window) >= bag:
                codes = difflib.SequenceMatcher(None, wording, window, autojunk=False).get_opcodes()
                while codes and codes[-1][0] == "insert":
                    codes.pop()
                missing = sum(b - a for tag, a, b, _, _ in codes if tag in ("delete", "replace"))
                added = sum(b - a for tag, _, _, a, b in codes if tag in ("insert", "replace"))
                if missing <= (1 - L.LEAST_FOUND) * len(wording) and missing + added <= L.MOST_DIFFERENT * len(wording):
                    end = max((d for tag, _, _, _, d in codes if tag == "equal"), default=0)
                    held.append(((missing + added) / len(wording), -len(wording), words[at][1], words[at + end - 1][2], name))
    taken = []
    for _, _, start, stop, name in sorted(held, key=lambda h: (h[1] + h[0] * -h[1], h[0], h[2])):
        if all(stop <= s or e <= start for s, e, _ in taken):
            taken.append((start, stop, name))
    return sorted(taken)


def test_all_documents_equal_every_window(spark):
    import duckdb

    from seqloom.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall())
    found = {}
    for r in QUERIES["op3_licenses"](spark, folder).collect():
        found.setdefault(r["doc_id"], []).append((r["start"], r["end"], r["license"]))
    wanted = {k: by_every_window(t) for k, t in texts.items()}
    assert {k: sorted(v) for k, v in found.items()} == {k: v for k, v in wanted.items() if v}
