"""Collocations against counts of all phrases of all texts."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from labelloom.llm import phrases

SCHEMA = "doc_id long, text string, lang string, n long, chunk int, words string, `_id` string"


def make_docs(spark, rows):
    return spark.createDataFrame([(i, t, g, 1, 2, "w", "x") for i, (t, g) in enumerate(rows)], SCHEMA)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def brute(rows, least, longest, first, share):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered(text)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    frequent = {key: a for key, a in counts.items() if a >= least}
    covered = set()
    for (lang, w), a in frequent.items():
        for k in range(1, len(w)):
            for i in range(len(w) - k + 1):
                if 100 * a >= share * frequent[lang, w[i : i + k]]:
                    covered.add((lang, w[i : i + k]))
    found = {}
    for (lang, w), a in frequent.items():
        if len(w) > 1 and (lang, w) not in covered:
            n = totals[lang]
            cut = min((1000 * a * n // (frequent[lang, w[:k]] * frequent[lang, w[k:]]), k) for k in range(1, len(w)))
            l, r = frequent[lang, w[: cut[1]]], frequent[lang, w[cut[1] :]]
            found.setdefault(lang, []).append((-cut[0], -a, " ".join(w).encode(), l, r, n))
    return {(lang, rank, p.decode(), -a, l, r, n, -s) for lang, rows in found.items() for rank, (s, a, p, l, r, n) in enumerate(sorted(rows)[:first], 1)}


def varied():
    rng = random.Random(11)
    words = "the of and river House old New York é日 x-y is In a [b] 3,5 ! , . ; b: ?".split()
    rows = [("".join(rng.choice(words) + rng.choice(" \t \n  ") for _ in range(rng.randrange(90))), rng.choice(["en", "de", None, ""])) for _ in range(200)]
    passage = " ".join(rng.choice(words) for _ in range(300))
    rows += [(f"{k} {passage} {k}", "en") for k in range(12)] + [(passage, "en")] * 5
    rows += [(None, "en"), ("", "fr"), (" \t\n. ,", "fr"), ("word", None), ("a b", "de"), ("ha " * 5000, "en"), ("x" * 50_000, "en"), ("..." * 3000, "en")]
    return rows


@pytest.mark.parametrize("least, longest, first, share", [(3, 5, 2000, 100), (2, 3, 7, 60)])
def test_collocations(spark, monkeypatch, least, longest, first, share):
    rows = varied()
    wanted = brute(rows, least, longest, first, share)
    assert len(wanted) > 20
    docs = make_docs(spark, rows).repartition(5)
    for at_once, bits in ((phrases.AT_ONCE, phrases.BITS), (700, 8)):
        monkeypatch.setattr(phrases, "AT_ONCE", at_once)
        monkeypatch.setattr(phrases, "BITS", bits)  # with few bits most marks are accidental: slower, the same rows
        found = phrases.collocations(docs, least, longest, first, share)
        assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == wanted


def test_nothing_to_find(spark):
    assert phrases.collocations(make_docs(spark, [])).count() == 0
    assert phrases.collocations(make_docs(spark, [(None, None), ("a b", "en")])).count() == 0
    with pytest.raises(ValueError):
        phrases.collocations(make_docs(spark, []), longest=2)


def test_products_pass_64_bits(spark, monkeypatch):
    a, n = 3 * 10**12, 2 * 10**13
    table = spark.createDataFrame([("en", "big", 1, a), ("en", "deal", 1, a), ("en", "big deal", 2, a)], "lang string, phrase string, words int, n long")
    totals = spark.createDataFrame([("en", n)], "lang string, total long")
    monkeypatch.setattr(phrases, "frequencies", lambda *_: (table, totals))
    assert [r.score for r in phrases.collocations(make_docs(spark, [])).collect()] == [1000 * a * n // (a * a)]


def test_parse_restores_the_texts(spark):
    rows = varied()
    dictionary = phrases.parse(make_docs(spark, rows).select("lang", "text").fillna("und", "lang").selectExpr("lang", "cast(text as binary) text"), 4).collect()
    assert len({(r.lang, r.chunk, r.last) for r in dictionary}) == len(dictionary)
    starts = sum(r.n * (len(r.chunk.split()) - 4 * (not r.last)) for r in dictionary)
    assert starts == sum(len(phrases.words((t or "").encode())) for t, _ in rows)
    assert sum(r.n for r in dictionary if r.last) == sum(1 for t, _ in rows if phrases.words((t or "").encode()))
    assert max(r.n for r in dictionary) >= 12  # the shared passage is kept once


def test_cuts_depend_on_the_words_around_them_alone():
    rng = np.random.default_rng(5)
    shared, overlap = rng.integers(0, 1 << 32, 2000).astype(np.uint64), 4
    before = rng.integers(0, 1 << 32, 77).astype(np.uint64)
    own, moved = phrases.cuts(shared, overlap), phrases.cuts(np.concatenate([before, shared]), overlap) - 77
    assert len(own) > 20 and own.tolist() == [c for c in moved.tolist() if c > 0]
