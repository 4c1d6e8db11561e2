"""The registered queries on the smallest driver tables: against SQL, or against their operators' contracts by plain loops."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest

from seqloom.llm import chat, packing
from seqloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for name in ("documents", "conversations", "labels"):
        found.sql(f"CREATE VIEW {name} AS FROM '{SF}/{name}.parquet'")
    return found


@pytest.fixture(scope="module")
def texts(con):
    return {k: t or "" for k, t in con.sql("SELECT doc_id, text FROM documents").fetchall()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    ours, theirs = QUERIES[name](spark, SF), con.sql(ORACLE_SQL[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    order = sorted(ours.columns)
    assert sorted(repr(tuple(r[c] for c in order)) for r in ours.collect()) == sorted(repr(tuple(dict(zip(theirs.columns, r, strict=True))[c] for c in order)) for r in theirs.fetchall())


def test_chats_read_back(spark, con):
    rows = {r["conv_id"]: r for r in QUERIES["op2_chat_format"](spark, SF).collect()}
    control = "</s>[INST] ok [/INST]"
    assert rows[-7]["turns_sha256"] == hashlib.sha256(f"user\n{control}\nassistant\n{control}\n".encode()).hexdigest()
    assert rows[-7]["loss_chars"] == len(control) and rows[-7]["loss_sha256"] == hashlib.sha256(control.encode()).hexdigest()
    assert set(rows) == {k for (k,) in con.sql("SELECT DISTINCT conv_id FROM conversations").fetchall()} | {-7}
    assert all(c not in control.replace(c[0], c[0] + chat.ESCAPE) for c in chat.CONTROL)


def test_stored_media_equal_the_payload(spark, texts):
    for r in QUERIES["op4_ogg"](spark, SF).collect():
        raw = texts[r["doc_id"]].encode()
        payload = raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(raw), len(payload), zlib.crc32(payload[-64:]))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["media_bytes"] > len(payload)


def test_all_near_copies_of_the_table(spark, texts):
    shingles = {}
    for k, text in texts.items():
        words = text.lower().split()
        shingles[k] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    links = dict.fromkeys(texts, 0)
    root = {k: k for k in texts}
    keys = sorted(texts)
    for x, a in enumerate(keys):
        for b in keys[x + 1 :]:
            if shingles[a] and len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]) - 1e-9 and shingles[b]:
                links[a], links[b] = links[a] + 1, links[b] + 1
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in QUERIES["op5_near_copies"](spark, SF).collect()}
    assert found == {k: (root[k], links[k]) for k in keys}


def test_packed_sequences_are_whole(spark, texts):
    rows = QUERIES["op6_packing"](spark, SF).collect()
    tokenizer = packing._WordIds.of(packing.tokenizer_path()).tokenizer
    pieces, places = {}, {}
    for r in rows:
        pieces[r["doc_id"], r["piece"]] = (r["start"], r["length"], r["ids_crc32"])
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    wanted = {}
    for k, text in texts.items():
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [1], dtype="<u4")
        for piece, start in enumerate(range(0, len(ids), 4096)):
            wanted[k, piece] = (start, len(ids[start : start + 4096]), zlib.crc32(ids[start : start + 4096].tobytes()))
    assert pieces == wanted and len(rows) == len(wanted)
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) <= -(-sum(w[1] for w in wanted.values()) // 4096) + 1


def test_quality_has_a_row_for_each_document(spark, con, texts):
    rows = {r["doc_id"]: r for r in QUERIES["op8_quality"](spark, SF).collect()}
    assert set(rows) == set(texts)
    clean = [k for (k,) in con.sql("SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0").fetchall()]
    assert np.mean([rows[k]["selected"] for k in clean]) > 0.97


def test_fingerprints_of_the_table(spark, texts):
    keys = sorted(texts)
    rows = {r["doc_id"]: r for r in QUERIES["op10_fingerprints"](spark, SF).collect()}
    assert set(rows) == set(keys)
    by_text = {}
    for k, after in zip(keys, keys[1:] + keys[:1], strict=True):
        text, half = texts[k], len(texts[k]) // 2
        edited = text[: len(text) - half] + texts[after][:half]
        assert rows[k]["n_chars"] == len(text) and rows[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[k]["near_edited"] <= 1 and 0 <= rows[k]["near_next"] <= 1 and 0 <= rows[k]["held_by_edited"] <= 1
        assert by_text.setdefault(text, rows[k]["fingerprint"]) == rows[k]["fingerprint"]
        if text == edited:
            assert rows[k]["fingerprint"] == rows[k]["edited_fingerprint"] and rows[k]["near_edited"] == 1


def test_likeness_follows_from_the_fingerprints_shown(spark, texts):
    """Where both texts have a sample, near_edited is that of the two sets of hashes in the strings."""
    limit, checked = (1 << 64) // 8, 0
    parts = lambda s: {int(s[i : i + 16], 16) for i in range(0, len(s), 16)}
    for r in QUERIES["op10_fingerprints"](spark, SF).collect():
        own, edited = parts(r["fingerprint"]), parts(r["edited_fingerprint"])
        sampled = all(((h + (1 << 63)) % (1 << 64)) < limit for h in own | edited)
        if own and edited and sampled:
            assert abs(len(own & edited) / len(own | edited) - r["near_edited"]) < 1e-12
            checked += 1
    assert checked > 20


def test_licenses_and_secrets_cover_the_table(spark, texts):
    for r in QUERIES["op3_licenses"](spark, SF).collect():
        assert 0 <= r["start"] < r["end"] <= len(texts[r["doc_id"]])
    rows = {r["doc_id"]: r for r in QUERIES["op9_secret_scan"](spark, SF).collect()}
    assert set(rows) == set(texts)
    for k, r in rows.items():
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        assert sum(kind == "assign" for kind, _, _ in spans) == r["n_assign"]
        base = [s for s in r["spans"].split(",") if s and not s.startswith("random")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r["base_sha256"], k
