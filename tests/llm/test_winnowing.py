"""Winnowing against a plain version, its match guarantee, and the comparison with edited texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from labelloom.llm import winnowing

SCHEMA = "doc_id long, text string, hash string, run int, extra string, weight int, `_part` int"
MASK = (1 << 64) - 1


def make_docs(spark, rows):
    return spark.createDataFrame([(i, t, "h", 1, "e", 2, 3) for i, t in rows], SCHEMA)


def plain(text, gram=winnowing.GRAM, window=winnowing.WINDOW):
    """Selected (hash, position), one gram and one window at a time."""
    gram = min(gram, len(text))
    hashes = []
    for i in range(len(text) - gram + 1 if text else 0):
        h = sum((ord(c) + 1) * pow(winnowing.BASE, j, 1 << 64) for j, c in enumerate(text[i : i + gram])) & MASK
        h ^= h >> 32
        hashes.append((h * winnowing.SCRAMBLE & MASK) >> 32)
    out = []
    window = min(window, len(hashes))
    for i in range(len(hashes) - window + 1 if hashes else 0):
        at = max((p for p in range(i, i + window)), key=lambda p: (-hashes[p], p))
        if not out or out[-1][1] != at:
            out.append((hashes[at], at))
    return out


def texts():
    rng = random.Random(3)
    out = ["".join(rng.choice("ab é\U0001f600日\n") for _ in range(rng.randrange(200))) for _ in range(60)]
    return out + ["", "a", "ab", "a" * 500, "ab" * 300, "x" * 19, "x" * 20, "x" * 39, "x" * 40, "words " * 4000]


def test_winnow():
    roller = winnowing.Roller()
    for text in texts():
        for gram, window in ((winnowing.GRAM, winnowing.WINDOW), (5, 1), (1, 7)):
            hashes, positions = winnowing.winnow(winnowing.code_points(text), roller, gram, window)
            if len(text) < 700:
                assert list(zip(hashes.tolist(), positions.tolist())) == plain(text, gram, window)


def test_shared_passages_are_matched():
    rng, roller = random.Random(9), winnowing.Roller()
    long = winnowing.GRAM + winnowing.WINDOW - 1
    for _ in range(200):
        passage = "".join(rng.choice("abcdef ") for _ in range(long))
        sides = []
        for _ in range(2):
            before = "".join(rng.choice("ghij ") for _ in range(rng.randrange(60)))
            text = before + passage + "".join(rng.choice("klmn ") for _ in range(rng.randrange(60)))
            hashes, positions = winnowing.winnow(winnowing.code_points(text), roller)
            sides.append({(h, p - len(before)) for h, p in zip(hashes.tolist(), positions.tolist())})
        assert any(0 <= p <= long - winnowing.GRAM for _, p in sides[0] & sides[1])


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))


def likeness(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("parts", ["1", "8", "40"])
def test_against_edited(spark, parts):
    rows = [(7 * i % 71, t) for i, t in enumerate(texts())] + [(1000, None), (None, "null id " * 20)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = {r.doc_id: r for r in winnowing.against_edited(make_docs(spark, rows).repartition(4)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(found) == len(rows)
    ordered = order(rows)
    for (doc_id, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        r, text, following = found[doc_id], text or "", following or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        own, changed, other = plain(text[:3000]) if len(text) < 700 else None, plain(edited), plain(following)
        if own is not None and len(following) < 700:
            assert r.fingerprint == "".join(f"{h:08x}" for h, _ in own) and r.positions == [p for _, p in own]
            assert r.edited_fingerprint == "".join(f"{h:08x}" for h, _ in changed) and r.edited_positions == [p for _, p in changed]
            assert (r.near_edited, r.near_next) == (likeness(own, changed), likeness(own, other))


def test_repeats_and_small_tables(spark):
    same = [(5, "the same text, again and again and again and again")] * 40 + [(4, "another text that is long enough to be told"), (5, None), (None, None), (None, None)]
    rows = winnowing.against_edited(make_docs(spark, same).repartition(3)).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in same)
    assert len({r.fingerprint for r in rows if r.n_chars == 50 and r.doc_id == 5}) == 1
    assert sum(r.near_next == 1.0 for r in rows if r.doc_id == 5) >= 39
    alone = winnowing.against_edited(make_docs(spark, [(1, "abcdef")])).collect()
    assert [(r.n_chars, r.edited_sha256, r.near_next) for r in alone] == [(6, hashlib.sha256(b"abcabc").hexdigest(), 1.0)]
    assert winnowing.against_edited(make_docs(spark, [])).count() == 0
    own = {r.doc_id: r for r in winnowing.fingerprints(make_docs(spark, [(1, "abcdef"), (2, None)])).collect()}
    assert own[1].fingerprint == alone[0].fingerprint and (own[2].fingerprint, own[2].positions) == ("", [])


def test_powers_grow():
    roller, codes = winnowing.Roller(), winnowing.code_points("ab" * 5000)
    assert len(set(roller.hashes(codes, 20).tolist())) == 2
    assert np.array_equal(roller.hashes(codes, 20)[:10], winnowing.Roller().hashes(codes[:29], 20))
