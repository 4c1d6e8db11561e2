"""Token alphabets as column functions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.functions.columns import lit_array


@dataclass(frozen=True)
class Alphabet:
    """A character table: ``chars[i]`` encodes to ``ids[i]``, everything else to ``missing``.

    ``letters[k]`` is what token k decodes to.
    """

    chars: str
    ids: tuple[int, ...]
    missing: int
    letters: str
    gap: int = -1
    start: int = -1
    stop: int = -1


def _plain(letters: str, missing: int, **special: int) -> Alphabet:
    """Characters numbered in order; of a repeated character the last place counts."""
    last = {c: k for k, c in enumerate(letters)}
    return Alphabet("".join(last), tuple(last.values()), missing, letters, **special)


# The alphabets that the sequence data uses.
MAIN = _plain("ARNDCQEGHILKMFPSTWYVOUBZX-$*|", 24, gap=25, start=26, stop=27)
STRUCTURAL = _plain("ACDEFGHIKLMNPQRSTVWY    X-$*|", 24, gap=25, start=26, stop=27)
DNA = _plain("ACGT", 255)
SECONDARY = _plain("HBEGITS ", 255)
REDUCED_GROUPS = ("A", "D", "KERO", "N", "TSQ", "YF", "LIVM", "CU", "W", "H", "G", "P", "XBZ")
REDUCED = Alphabet("".join(REDUCED_GROUPS), tuple(k for k, g in enumerate(REDUCED_GROUPS) for _ in g), 255, "".join(g[0] for g in REDUCED_GROUPS))
CLS = 28


def twenty_one(gap: bool = False, stop: bool = False, start: bool = False) -> Alphabet:
    """The 20 amino acids, the specials asked for, and a mask that also stands for B, X and Z.

    O and U are read as K and C.
    """
    letters = "ARNDCQEGHILKMFPSTWYV" + "-" * gap + "*" * stop + "$" * start
    mask = len(letters)
    table = {c: k for k, c in enumerate(letters)} | {"X": mask, "O": 11, "U": 4, "B": mask, "Z": mask}
    at = lambda c: letters.find(c)
    return Alphabet("".join(table), tuple(table.values()), mask, letters + "X", gap=at("-"), stop=at("*"), start=at("$"))


def characters(text: Column) -> Column:
    """The characters of a string; the empty string has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def code_points(text: Column) -> Column:
    """The code points of a string; several alphabets can encode what is split once."""
    return F.transform(characters(text), F.ascii)


def encode_points(points: Column, alphabet: Alphabet = MAIN) -> Column:
    """Tokens of code points: one look-up in a table by code point."""
    table = [alphabet.missing] * (max(map(ord, alphabet.chars)) + 1)
    for char, token in zip(alphabet.chars, alphabet.ids, strict=True):
        table[ord(char)] = token
    tokens = lit_array(table)
    return F.transform(points, lambda p: F.coalesce(F.get(tokens, p), F.lit(alphabet.missing)))


def encode(text: Column, alphabet: Alphabet = MAIN) -> Column:
    """Tokens of a string. Case is not folded: lower case is unknown unless the table has it."""
    return encode_points(code_points(text), alphabet)


def _table(alphabet: Alphabet) -> np.ndarray:
    """Tokens by code point, the last place standing for all others."""
    table = np.full(max(map(ord, alphabet.chars)) + 2, alphabet.missing, dtype=np.int32)
    table[[ord(c) for c in alphabet.chars]] = alphabet.ids
    return table


def encode_each(text: Column, alphabets: dict[str, Alphabet], joined: str | None = None) -> Column:
    """A struct of the tokens of a string by several alphabets, by name; the same tokens as ``encode`` has.

    Batches are looked up whole, by Arrow; long columns take a small part of the time of ``encode``. With ``joined``
    tokens are texts, with that between them, as ``array_join`` has them.
    """
    return _looked_up(text, {name: (_table(a), None if joined is None else [str(k) for k in range(max(a.missing, *a.ids) + 1)]) for name, a in alphabets.items()}, joined)


def recode(text: Column, alphabet: Alphabet = MAIN) -> Column:
    """What ``decode`` makes of ``encode``'s tokens, by Arrow."""
    letters = [*alphabet.letters, *[""] * (max(alphabet.missing, *alphabet.ids) + 1 - len(alphabet.letters))]
    return _looked_up(text, {"text": (_table(alphabet), letters)}, "")["text"]


def _looked_up(text: Column, tables: dict[str, tuple[np.ndarray, list[str] | None]], joined: str | None) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        rows = texts.to_pylist()
        points = np.frombuffer("".join(r or "" for r in rows).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        ends = pa.array(np.cumsum([0, *(len(r or "") for r in rows)]), pa.int32())
        none = pa.array([r is None for r in rows], pa.bool_())
        found = []
        for table, names in tables.values():
            tokens = pa.array(table[np.minimum(points, len(table) - 1)])
            if names is None:
                found.append(pa.ListArray.from_arrays(ends, tokens, mask=none))
            else:
                found.append(pc.binary_join(pa.ListArray.from_arrays(ends, pc.take(pa.array(names, pa.string()), tokens), mask=none), joined))
        return pa.StructArray.from_arrays(found, list(tables))

    kinds = {name: "array<int>" if names is None else "string" for name, (_, names) in tables.items()}
    return F.arrow_udf(run, ", ".join(f"{name} {kind}" for name, kind in kinds.items()))(text)


def decode(tokens: Column, alphabet: Alphabet = MAIN) -> Column:
    """The string of an array of tokens; a token that is no place in the table gives nothing."""
    letters = lit_array(alphabet.letters, "string")
    return F.array_join(F.transform(tokens, lambda t: F.get(letters, t.cast("int"))), "")


def kmer_unpack(value: Column, k: int, n: int) -> Column:
    """The k base-n digits of an integer, most significant first."""
    return F.transform(lit_array([n ** (k - 1 - i) for i in range(k)], "bigint"), lambda p: F.pmod(F.call_function("div", value, p), F.lit(n)).cast("int"))


def kmer_string(value: Column, k: int, alphabet: Alphabet = DNA) -> Column:
    """An integer as a k-mer of the alphabet's letters."""
    return decode(kmer_unpack(value, k, len(alphabet.letters)), alphabet)


def append_startstop(tokens: Column, alphabet: Alphabet = MAIN) -> Column:
    """Tokens framed by start and stop."""
    return F.concat(F.array(F.lit(alphabet.start)), tokens, F.array(F.lit(alphabet.stop)))
