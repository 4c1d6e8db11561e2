"""Secret scans: fixed patterns, and a randomness test battery with false-discovery control.

Candidates are the long runs of key-like characters. For each its encoding is inferred, and three
tests compare its digits with a random string of that encoding: chi-squared uniformity of the
alphabet, runs above and below the alphabet's middle, and serial correlation of neighbours. A secret
is a candidate that the battery does not reject and that ordinary text would hardly be: what the
same three statistics are for ordinary text is measured on the whole corpus, read through the same
alphabet. Ordinary text strays from randomness the more, the longer it is, so false discoveries are
controlled in classes of length, over all candidates of the corpus.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.workers import tidy
from seqloom.plans.lineage import cut
from seqloom.plans.shipping import ship_package

#: The base patterns, whose letters fold in ASCII only. Kinds in the order that breaks ties.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: Characters of a candidate, and how many it has at least.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_LONG = re.compile(r"[A-Za-z0-9]{20,}")
#: False-discovery rate of the added spans, level of the battery, and lengths at which a new length class starts.
RATE, LEVEL, CLASSES = 0.01, 0.001, (20, 24, 28, 32, 40, 48, 64, 96)
#: Steps of -log10 p in the histogram that sets the bound.
STEP, STEPS = 0.05, 400

_LOW, _UP, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings from the smallest alphabet: what matches them, their digits in order of value, and others that stand for the same digits.
ENCODINGS = (
    ("decimal", re.compile(r"[0-9]+"), _DIGITS, ""),
    ("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), _DIGITS + _LOW[:6], "\0" * 10 + _UP[:6]),
    ("letters", re.compile(r"[a-z]+|[A-Z]+"), _LOW, _UP),
    ("base32", re.compile(r"[A-Z2-7]+"), _UP + _DIGITS[2:8], _LOW),
    ("base36", re.compile(r"[0-9a-z]+|[0-9A-Z]+"), _DIGITS + _LOW, "\0" * 10 + _UP),
    ("base52", re.compile(r"[A-Za-z]+"), _UP + _LOW, ""),
    ("base62", re.compile(r"[A-Za-z0-9]+"), _DIGITS + _UP + _LOW, ""),
    ("base64", re.compile(r"[A-Za-z0-9+/_-]+"), _UP + _LOW + _DIGITS + "+/", "\0" * 62 + "-_"),
)
#: What bytes outside an alphabet and the ends of texts are read as; the byte between texts is in no UTF-8.
_NONE, _BETWEEN, _END = 255, 254, b"\xff"


def _values(digits: str, others: str) -> np.ndarray:
    """The digit that each byte stands for, _NONE for bytes outside the alphabet, _BETWEEN for _END."""
    table = np.full(256, _NONE, dtype=np.uint8)
    table[_END[0]] = _BETWEEN
    for alphabet in (others, digits):
        for value, c in enumerate(alphabet):
            if c != "\0":
                table[ord(c)] = value
    return table


_TABLES = [_values(digits, others) for _, _, digits, others in ENCODINGS]
_SIZES = [len(digits) for _, _, digits, _ in ENCODINGS]


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns in code points, ordered."""
    spans = []
    if ":" in text or "=" in text:
        spans += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    for run in _LONG.finditer(text):
        # access and hex matches that are long enough lie inside a run of 20 letters and digits
        at, own = run.start(), run[0]
        if "AKIA" in own:
            spans += [(at + m.start(), "access", at + m.end()) for m in ACCESS.finditer(own) if len(m[0]) >= LEAST["access"]]
        if len(own) >= LEAST["hex"]:
            spans += [(at + m.start(), "hex", at + m.end()) for m in HEX.finditer(own) if len(m[0]) >= LEAST["hex"]]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def encoding(run: str) -> int:
    """The place in ENCODINGS of the smallest one that has all characters of a run, padding aside."""
    own = run.rstrip("=")
    return next(k for k, (_, pattern, _, _) in enumerate(ENCODINGS) if pattern.fullmatch(own))


def statistics(run: str) -> tuple[int, int, float, int, int, float]:
    """(encoding, n, chi-squared, changes, digits in the upper half, serial correlation) of a run.

    ``changes`` counts neighbours on different sides of the alphabet's middle, which is the number of
    runs less one. A run of one digit alone has serial correlation 1.
    """
    kind = encoding(run)
    codes = _TABLES[kind][np.frombuffer(run.rstrip("=").encode(), dtype=np.uint8)].astype(np.float64)
    n, size = len(codes), _SIZES[kind]
    chi = float((np.bincount(codes.astype(np.int64)).astype(np.float64) ** 2).sum() * size / n - n)
    upper = codes >= size / 2
    away = codes - codes.mean()
    spread = float((away * away).sum())
    serial = float((away[1:] * away[:-1]).sum()) / spread if spread else 1.0
    return kind, n, chi, int(np.count_nonzero(upper[1:] != upper[:-1])), int(upper.sum()), serial


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(size: int, n: int, chi: float, changes: int, upper: int, serial: float) -> tuple[float, float, float]:
    """p-values of the three tests of randomness, two-sided.

    Chi-squared by the cube root approximation, runs by their law given how many digits lie in each
    half, serial correlation by its law for independent digits. A run all in one half has runs p 0.
    """
    free = size - 1
    z_chi = (max(chi, 0.0) / free) ** (1 / 3) - (1 - 2 / (9 * free))
    pairs = 2 * upper * (n - upper)
    if pairs == 0:
        p_runs = 0.0
    else:
        spread = pairs * (pairs - n) / (n * n * (n - 1))
        p_runs = _two_sided((changes - pairs / n) / math.sqrt(spread)) if spread > 0 else 1.0
    return _two_sided(z_chi / math.sqrt(2 / (9 * free))), p_runs, _two_sided((serial + 1 / n) * math.sqrt(n))


def _chi_law(size: int, n: int, second: float, third: float) -> tuple[float, float]:
    """Mean and deviation of chi-squared where digits have these sums of squared and cubed shares."""
    variance = 2 * n * (n - 1) * (second - second**2) + 4 * n * (n - 1) * (n - 2) * (third - second**2)
    return size * (1 + (n - 1) * second) - n, size / n * math.sqrt(max(variance, 1e-12))


def ordinary_p(size: int, n: int, chi: float, changes: int, serial: float, law: tuple[float, float, float, float] | None) -> float:
    """How likely ordinary text of this length would look as random as this run does.

    ``law`` is what ``ordinary_laws`` found for the run's encoding; without one the p-value is 1. Each
    statistic is as many deviations from what ordinary text has, towards what a random string has,
    as it is; they are combined by Stouffer's rule, each with the distance of the two as its weight.
    """
    if law is None:
        return 1.0
    second, third, change, link = law
    mean, spread = _chi_law(size, n, second, third)
    tests = [
        (chi, mean, spread, size - 1.0),
        (changes, (n - 1) * change, math.sqrt(max((n - 1) * change * (1 - change), 1e-12)), (n - 1) / 2),
        (serial, link - 1 / n, 1 / math.sqrt(n), -1 / n),
    ]
    total = weight = 0.0
    for found, usual, spread, random in tests:
        distance = (random - usual) / spread
        total += distance * (found - usual) / spread
        weight += distance * distance
    return 0.5 * math.erfc(total / math.sqrt(2 * weight)) if weight > 0 else 1.0


def text_sums(texts: list[str]) -> list[np.ndarray]:
    """For each encoding what texts, each read through its alphabet, add to the corpus's sums:
    neighbours, those on different sides, the sum of their products, then the count of each digit."""
    raw = np.frombuffer(_END.join([t.encode("utf-8", "replace") for t in texts]), dtype=np.uint8)
    out = []
    for table, size in zip(_TABLES, _SIZES, strict=True):
        codes = table[raw]
        codes = codes[codes != _NONE]
        inside = codes != _BETWEEN
        upper = codes >= size / 2
        near = inside[1:] & inside[:-1]
        wide = np.where(inside, codes, 0).astype(np.float64)  # sums of products stay whole numbers far below 2^53
        head = [np.count_nonzero(near), np.count_nonzero(near & (upper[1:] != upper[:-1])), int(wide[:-1] @ wide[1:])]
        out.append(np.concatenate((head, np.bincount(codes, minlength=256)[:size])).astype(np.int64))
    return out


def ordinary_laws(sums: dict[int, list[int]]) -> dict[int, tuple[float, float, float, float]]:
    """For each encoding (sum of squared shares, of cubed shares, chance of a change, serial correlation)."""
    laws = {}
    for kind, (near, changes, products, *counts) in sums.items():
        n, values = sum(counts), np.arange(len(counts), dtype=np.float64)
        if near < 1:
            continue
        share = np.array(counts, dtype=np.float64) / n
        mean = float((share * values).sum())
        spread = float((share * values**2).sum()) - mean**2
        laws[kind] = (float((share**2).sum()), float((share**3).sum()), changes / near, (products / near - mean**2) / spread if spread > 0 else 1.0)
    return laws


def _candidates(text: str) -> list[tuple]:
    return [(m.start(), m.end(), *statistics(m[0])) for m in CANDIDATE.finditer(text)]


def _judged(kind: int, n: int, chi: float, changes: int, upper: int, serial: float, laws: dict) -> tuple[int, int] | None:
    """(length class, step of -log10 p) of a candidate that the battery does not reject, else None."""
    size = _SIZES[kind]
    if 3 * min(battery(size, n, chi, changes, upper, serial)) < LEVEL:
        return None
    p = ordinary_p(size, n, chi, changes, serial, laws.get(kind))
    return sum(n >= c for c in CLASSES), min(STEPS, int(-math.log10(max(p, 1e-30)) / STEP))


_SPANS = "array<struct<start:long,kind:string,end:long>>"
_FOUND = "array<struct<start:long,end:long,kind:int,n:long,chi:double,changes:long,upper:long,serial:double>>"
_FIELDS = ("start", "end", "kind", "n", "chi", "changes", "upper", "serial")
_SPANS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))
_FOUND_ARROW = pa.list_(pa.struct(list(zip(_FIELDS, [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64()], strict=True))))
#: Letters of text whose sums are taken at once.
SLICE = 1 << 22


def _scanned(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One pass: a row (id, base, found) for each text, and for each task and encoding one with its sums."""
    id_kind = df.schema[id_col].dataType.simpleString()

    def row(keys: pa.Array, base: list, found: list, kinds: list, sums: list) -> pa.RecordBatch:
        columns = [keys, pa.array(base, _SPANS_ARROW), pa.array(found, _FOUND_ARROW), pa.array(kinds, pa.int32()), pa.array(sums, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["id", "base", "found", "encoding", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(3 + size, dtype=np.int64) for size in _SIZES]
        key_type = None
        for batch in batches:
            key_type, texts = batch.column(0).type, [t or "" for t in batch.column(1).to_pylist()]
            part, letters = [], 0
            for k, text in enumerate(texts):
                part.append(text)
                letters += len(text)
                if letters >= SLICE or k == len(texts) - 1:
                    total = [a + b for a, b in zip(total, text_sums(part), strict=True)]
                    part, letters = [], 0
            base = [[{"start": s, "kind": k, "end": e} for s, k, e in base_spans(t)] for t in texts]
            found = [[dict(zip(_FIELDS, c, strict=True)) for c in _candidates(t)] for t in texts]
            nothing = [None] * len(texts)
            yield row(batch.column(0), base, found, nothing, nothing)
        if key_type is not None:
            nothing = [None] * len(total)
            yield row(pa.nulls(len(total), key_type), nothing, nothing, list(range(len(total))), [t.tolist() for t in total])

    ship_package(df.sparkSession)
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(tidy(run), f"id {id_kind}, base {_SPANS}, found {_FOUND}, encoding int, sums array<long>")


def _laws(scanned: DataFrame) -> dict[int, tuple[float, float, float, float]]:
    """The corpus's ordinary text: at most one row for each encoding and digit comes to the driver."""
    each = scanned.filter("encoding IS NOT NULL").select("encoding", F.posexplode("sums").alias("place", "n"))
    sums: dict[int, list[int]] = {}
    for r in each.groupBy("encoding", "place").agg(F.sum("n").alias("n")).orderBy("encoding", "place").collect():
        sums.setdefault(r["encoding"], []).append(r["n"])
    return ordinary_laws(sums)


def _limits(scanned: DataFrame, laws: dict, rate: float) -> tuple[Callable, dict[int, int]]:
    """A column function that judges candidates, and the bound of each length class."""

    @F.pandas_udf("array<struct<start:long,end:long,class:int,step:int>>")
    def judge(found: pd.Series) -> pd.Series:
        out = []
        for own in found:
            judged = [(c["start"], c["end"], _judged(*(c[f] for f in _FIELDS[2:]), laws)) for c in own]
            out.append([{"start": s, "end": e, "class": j[0], "step": j[1]} for s, e, j in judged if j])
        return pd.Series(out)

    some = scanned.filter("size(found) > 0").select(F.explode(judge(F.col("found"))).alias("c"))
    each = some.groupBy("c.class", "c.step").count()
    return judge, _bounds([(r["class"], r["step"], r["count"]) for r in each.collect()], rate)


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """Secret spans of each whole text: (id, base, spans).

    ``base`` and ``spans`` are arrays of struct<start, kind, end> in code points, end exclusive, in
    the order start, kind, end; ``spans`` has the base ones and those that the battery adds, which
    are not equal to a base span. Null texts are empty; every row gives a row, repeated ones too.
    What ordinary text is like comes from sums over the whole corpus, and the bound of each length
    class from a histogram of all its candidates, of at most classes x steps rows
    (Benjamini-Hochberg on binned p-values, rounded to the careful side). So one text's spans depend
    on the corpus, but equal texts have equal spans. No candidates: the base spans alone. An empty
    table gives no rows. Further columns are ignored.
    """
    scanned = cut(_scanned(df, id_col, text_col))
    judge, bounds = _limits(scanned, _laws(scanned), rate)
    limits = F.array(*[F.lit(bounds.get(k, STEPS + 1)) for k in range(len(CLASSES) + 1)])
    known = F.transform("base", lambda b: F.struct(b["start"], b["end"]))
    added = F.transform(
        F.filter("more", lambda m: (m["step"] >= F.get(limits, m["class"])) & ~F.array_contains(known, F.struct(m["start"], m["end"]))),
        lambda m: F.struct(m["start"].alias("start"), F.lit("random").alias("kind"), m["end"].alias("end")),
    )
    order = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.transform(
        F.array_sort(F.transform(F.concat("base", added), lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("place"), s["end"].alias("end"), s["kind"].alias("kind")))),
        lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")),
    )
    texts = scanned.filter("encoding IS NULL")
    plain = texts.filter("size(found) = 0").withColumn("more", F.array().cast("array<struct<start:long,end:long,class:int,step:int>>"))
    each = plain.unionByName(texts.filter("size(found) > 0").withColumn("more", judge(F.col("found"))))
    return each.select(F.col("id").alias(id_col), "base", ordered.alias("spans"))


def _bounds(histogram: list[tuple[int, int, int]], rate: float) -> dict[int, int]:
    """For each length class the least step whose p-value passes Benjamini-Hochberg."""
    out = {}
    for own in {c for c, _, _ in histogram}:
        steps = sorted(((s, n) for c, s, n in histogram if c == own), reverse=True)
        total, seen = sum(n for _, n in steps), 0
        for step, n in steps:
            seen += n
            if 10 ** (-step * STEP) <= rate * seen / total:
                out[own] = step
    return out


def span_text(spans: Column | str) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, mark: str = "[secret]", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """``df`` with each stretch of text that secret spans cover replaced by ``mark``.

    All rows, repeated ones too, and all other columns stay, whatever their names; null texts stay null;
    texts of any length are scanned whole; an empty table stays empty. One pass over the whole table finds what ordinary text is like and the bounds, then
    each text is scanned again in place, so no text is shuffled.
    """
    slim = df.select(F.lit(0).alias("id"), F.col(text_col).alias("text"))
    scanned = cut(_scanned(slim, "id", "text").drop("id", "base").filter("encoding IS NOT NULL OR size(found) > 0"))
    laws = _laws(scanned)
    _, bounds = _limits(scanned, laws, rate)

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        judged = [(c[0], c[1], _judged(*c[2:], laws)) for c in _candidates(text)]
        spans = sorted([(s, e) for s, _, e in base_spans(text)] + [(s, e) for s, e, j in judged if j and j[1] >= bounds.get(j[0], STEPS + 1)])
        out, at = [], 0
        for start, end in spans:
            if start >= at:
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join(out) + text[at:]

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return texts.map(clean)

    return df.withColumn(text_col, cleaned(F.col(text_col)))
