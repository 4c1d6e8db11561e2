"""Secret scans: the base patterns against plain regular expressions, the battery, redaction."""

import hashlib
import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import secret_scan as S

PATTERNS = {
    "assign": (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
}


def plain_base(text):
    found = []
    for rank, (kind, (pattern, keep)) in enumerate(PATTERNS.items()):
        found += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text) if keep(m)]
    return [(s, k, e) for s, _, k, e in sorted(found)]


def random_texts():
    rng = random.Random(4)
    parts = ["password", "Secret", "TOKEN", "api_key", "APIKEY", "passwd", " = ", ":", "=", '"', "'", " ", "AKIA", "AKIAAKIA", "é🙂", "\n", "A1B2C3D4E5F6G7H8", "deadbeef", "0123456789abcdef", "ABCDEF", "xyz_-./+="]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]


def test_base_spans_equal_plain_patterns():
    for text in random_texts():
        assert S.base_spans(text) == plain_base(text), text


def test_only_ascii_letters_fold():
    assert S.base_spans("\u017fecret = abcdef1 to\u212aen: abcdef1") == [] and len(S.base_spans("SeCrEt = abcdef1")) == 1


PROSE = "It was the best of times, it was the worst of times, it was the age of wisdom, it was the age of foolishness. " * 40


def laws():
    return S.ordinary_laws({k: v.tolist() for k, v in enumerate(S.text_sums([PROSE, "", PROSE.upper(), "Year 1859, page 12 of 358. Call 555 123."]))})


def slow_statistics(run):
    """The same six numbers by plain loops over the inferred alphabet."""
    own = run.rstrip("=")
    name = S.ENCODINGS[S.encoding(run)][0]
    alphabet = {"decimal": "0123456789", "hex": "0123456789abcdef", "letters": string.ascii_lowercase, "base32": string.ascii_uppercase + "234567", "base36": "0123456789" + string.ascii_lowercase,
                "base52": string.ascii_uppercase + string.ascii_lowercase, "base62": "0123456789" + string.ascii_uppercase + string.ascii_lowercase, "base64": string.ascii_uppercase + string.ascii_lowercase + "0123456789+/"}[name]
    if name in ("hex", "letters", "base36"):
        own = own.lower()
    digits = [alphabet.index(c) for c in own.replace("-", "+").replace("_", "/")]
    n, k = len(digits), len(alphabet)
    chi = sum((digits.count(v) - n / k) ** 2 / (n / k) for v in range(k))
    high = [d >= k / 2 for d in digits]
    mean = sum(digits) / n
    spread = sum((d - mean) ** 2 for d in digits)
    serial = sum((a - mean) * (b - mean) for a, b in zip(digits, digits[1:], strict=False)) / spread if spread else 1.0
    return n, chi, sum(a != b for a, b in zip(high, high[1:], strict=False)), sum(high), serial


def test_statistics_equal_plain_loops():
    rng = random.Random(9)
    for alphabet in ("0123456789", "abcdef0123456789", string.ascii_uppercase, string.ascii_letters, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", "aB-_", "ABCDEFG234567", "a", "AB12CDEF"):
        for n in (20, 33, 200):
            run = "".join(rng.choice(alphabet) for _ in range(n)) + rng.choice(["", "=", "=="])
            kind, *found = S.statistics(run)
            assert found == pytest.approx(slow_statistics(run)), run


def test_ordinary_sums_equal_plain_loops():
    texts = ["Ab 1c", "", "é-x_Y+9/z", "deadBEEF 00"]
    for (name, _, digits, others), found in zip(S.ENCODINGS, S.text_sums(texts), strict=True):
        near = changes = products = 0
        counts = [0] * len(digits)
        for text in texts:
            own = [digits.index(c) if c in digits else others.index(c) for c in text if c in digits or (c in others and c != "\0")]
            for v in own:
                counts[v] += 1
            for a, b in zip(own, own[1:], strict=False):
                near, changes, products = near + 1, changes + ((a >= len(digits) / 2) != (b >= len(digits) / 2)), products + a * b
        assert found.tolist() == [near, changes, products, *counts], name


def test_sums_do_not_depend_on_how_texts_are_grouped():
    texts = [PROSE[: 7 * k] for k in range(9)]
    whole = S.text_sums(texts)
    apart = [sum(x) for x in zip(*[S.text_sums([t]) for t in texts], strict=True)]
    assert all((a == b).all() for a, b in zip(whole, apart, strict=True))


def test_laws_of_the_statistics_hold_in_simulation():
    """Chi-squared of texts drawn from ordinary shares has the mean and deviation that the null uses."""
    share = np.array([8, 4, 2, 1, 1], dtype=float) / 16
    draws = np.random.RandomState(3).multinomial(30, share, size=1_000_000)
    chi = (draws.astype(float) ** 2).sum(axis=1) * 5 / 30 - 30
    mean, spread = S._chi_law(5, 30, float((share**2).sum()), float((share**3).sum()))
    assert abs(chi.mean() - mean) < 0.1 and abs(chi.std() - spread) < 0.1


def test_battery_keeps_random_runs_at_its_level_and_rejects_patterns():
    rng = random.Random(7)
    for alphabet in ("0123456789abcdef", string.ascii_letters + string.digits, string.ascii_lowercase):
        runs = ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(2000)]
        rejected = 0
        for run in runs:
            kind, *found = S.statistics(run)
            rejected += 3 * min(S.battery(S._SIZES[kind], *found)) < S.LEVEL
        assert rejected <= 12
    for run in ("a" * 30 + "1", string.ascii_lowercase + "0123456789", "ab" * 20 + "1", "0123456789" * 4):
        kind, *found = S.statistics(run)
        assert 3 * min(S.battery(S._SIZES[kind], *found)) < S.LEVEL, run


def test_random_keys_look_random_and_words_do_not():
    rng, found = random.Random(5), laws()

    def p(run):
        kind, n, chi, changes, _, serial = S.statistics(run)
        return S.ordinary_p(S._SIZES[kind], n, chi, changes, serial, found.get(kind))

    for length, most in ((32, 1e-2), (40, 1e-3), (64, 1e-4)):
        for letters in (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"):
            keys = ["".join(rng.choice(letters) for _ in range(length)) for _ in range(100)]
            assert sum(p(k) < most for k in keys) > 90
    for word in ("internationalizationoftimes", "thebestoftimesitwastheworstoftimes", "get_user_account_by_id_version", "path/to/some/directory/with/files", "SomeVeryLongCamelCaseClassNameFactory"):
        assert S._judged(*S.statistics(word), found) is None or p(word) > 0.02
    assert p("12345678901234567890") == 1.0 or 0 in found


def test_bounds_control_false_discoveries():
    assert S._bounds([(1, 0, 1000), (1, 200, 5)], 0.01) == {1: 200}
    assert S._bounds([(1, 0, 1000)], 0.01) == {}
    assert S._bounds([(1, 60, 10), (2, 30, 1)], 0.01) == {1: 60}


def test_spans_of_documents(spark):
    rng = random.Random(6)
    key = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40))
    texts = {1: f"é see {key} here", 2: None, 3: "", 4: 'x token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" y', 5: f"é see {key} here", 6: "plain words " * 20_000, **{10 + k: t for k, t in enumerate(random_texts()[:60])}}
    frame = spark.createDataFrame([(k, t, 0) for k, t in texts.items()], "doc_id long, text string, spans int")
    found = {r["doc_id"]: r for r in S.find_secrets(frame).select("doc_id", S.span_text(F.col("base")).alias("b"), S.span_text(F.col("spans")).alias("s")).collect()}
    assert set(found) == set(texts)
    for k, text in texts.items():
        assert found[k]["b"] == ",".join(f"{kind}:{s}:{e}" for s, kind, e in plain_base(text or ""))
        assert set(filter(None, found[k]["b"].split(","))) <= set(found[k]["s"].split(","))
    assert found[1]["s"] == found[5]["s"] == "random:6:46" and found[6]["s"] == ""
    assert hashlib.sha256(found[3]["b"].encode()).hexdigest().startswith("e3b0c442")
    clean = S.redact(frame)
    rows = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert clean.columns == frame.columns and rows[1] == "é see [secret] here" and rows[2] is None and rows[6] == texts[6]
    assert rows[4] == 'x [secret]" y'


def test_nothing_to_scan(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.find_secrets(empty).count() == 0 and S.redact(empty).count() == 0


@pytest.mark.parametrize(("run", "kind"), [("12345", "decimal"), ("12af", "hex"), ("GZ27", "base32"), ("a1z", "base36"), ("abz", "letters"), ("GZ=", "letters"), ("aZ", "base52"), ("aZ9", "base62"), ("a+/", "base64")])
def test_encodings(run, kind):
    assert S.ENCODINGS[S.encoding(run)][0] == kind
