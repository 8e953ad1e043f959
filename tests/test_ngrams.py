"""Character n-grams as numbers, against plain sets of substrings, and the smaller blocks of a fit."""

from __future__ import annotations

import random
from collections import Counter
from dataclasses import replace

import numpy as np
import pyarrow as pa

from labelloom.functions import ngrams
from labelloom.operators import features as ft, linear, vectors as vec

CHOICE = random.Random(1)
TEXTS = ["", "ab", "abc", "abcd", "a\0b\0\0c", "".join(chr(0x4E00 + i) for i in range(5000)), "".join(chr(0x4E00 + i) for i in range(3000)) + "abc"]
TEXTS += ["".join(CHOICE.choice("abcé漢😀\0 ") for _ in range(CHOICE.randrange(60))) for _ in range(50)]


def grams(text):
    return {text[at : at + n] for n in (3, 4, 5) for at in range(len(text) - n + 1)}


def test_document_counts_of_any_alphabet():
    found = Counter()
    for terms, counts in ngrams.document_counts(TEXTS, 3, 5):
        terms.validate(full=True)
        found.update(dict(zip(terms.to_pylist(), counts.tolist())))
    assert found == Counter(gram for text in TEXTS for gram in grams(text))


def test_known_ngrams_are_found():
    every = sorted(set().union(*map(grams, TEXTS[:5] + TEXTS[7:])))
    terms = CHOICE.sample(every, 300)
    ends, index, weights = ngrams.Vocabulary.of(pa.array(terms), 3, 5).encode([*TEXTS, None])
    want = [[i for i, term in enumerate(terms) if term in grams(text)] for text in TEXTS] + [[]]
    assert [index[a:b].tolist() for a, b in zip(ends, ends[1:])] == want
    assert np.allclose(weights, np.repeat([len(w) ** -0.5 if w else 0 for w in want], [len(w) for w in want]))
    assert ngrams.Vocabulary.of(pa.array([chr(0x4E00 + i) * 3 for i in range(5000)]), 3, 5) is None


def test_texts_count_and_encode_as_their_terms_do(spark, monkeypatch):
    """Also with few characters at once, by fold, and with nulls; the terms of each text as strings leave no room for the rows of large tables."""
    monkeypatch.setattr(ft, "CHARS_AT_ONCE", 100)
    texts = [text + " Ä  b" for text in TEXTS[:5] + TEXTS[7:]] + [None, " \t"]
    rows = spark.createDataFrame([(i, i % 3, text) for i, text in enumerate(texts)], "id long, fold int, text string").repartition(3)
    chars = replace(ft.CHAR_NGRAMS, max_features=200, min_df=1)
    folded, terms = rows.withColumn("text", ft.folded_text("text", chars)), ft.with_terms(rows, "text", chars)
    ordered = lambda df: sorted(map(tuple, df.collect()))
    assert ordered(ft.text_term_counts(folded, "text", chars, "fold", range(3))) == ordered(ft.term_counts(terms, True, "fold", range(3)))
    assert ordered(ft.text_term_counts(folded, "text", chars)) == ordered(ft.term_counts(terms, True))
    encoder = ft.fit_encoder(ft.vocabulary(ft.text_term_counts(folded, "text", chars), len(texts), 1, 1.0, 200), chars)
    want = ordered(ft.encode(terms, encoder, ["id", "fold"]))
    made = ft.encode_text(folded, "text", chars, encoder, ["id", "fold"], unmade=True)
    assert ordered(ft.encode_text(folded, "text", chars, encoder, ["id", "fold"])) == want == ordered(made.rows())
    assert "regexp_extract_all" not in made.rows()._jdf.queryExecution().toString()


def test_short_blocks_hold_the_same_rows():
    lengths = np.array([2, 0, 2, 1], np.int32)
    for indices in ([1, 70000, 5, 140000, 3], [140000, 1, 5, 3, 70000]):
        index = np.array(indices, np.int32)
        block = vec.full_block((*vec.short_indices(index, lengths), None, None))
        assert block[0].tolist() == lengths.tolist() and block[1].tolist() == indices
    assert vec.short_indices(np.array([1, 70000], np.int32), np.array([2], np.int32))[1].dtype == np.uint16
    assert vec.alike_in_rows(np.array([2.0, 2, 3, 3, 4]), lengths).tolist() == [[2], [0], [3], [4]]
    assert vec.alike_in_rows(np.array([2.0, 1, 3, 3, 4]), lengths).tolist() == [2, 1, 3, 3, 4]


def test_sample_inverse_is_exact():
    chance = np.random.default_rng(3)
    dense = np.where(chance.random((12, 30)) < 0.3, chance.random((12, 30)), 0.0)
    row, index = np.nonzero(dense)
    order = np.argsort(index, kind="stable")
    lengths, counts = np.bincount(row, minlength=12), np.bincount(index, minlength=30)
    gram = linear._gram(lengths, index, dense[row, index], 30)
    sample = linear.Sample(
        np.arange(31), lengths, index, dense[row, index], counts, row[order], dense[row, index][order],
        chance.integers(0, 2, (12, 1)).astype(float), 0.5, gram,
    )
    whole = np.column_stack([dense, np.ones(12)])
    assert np.allclose(gram, whole @ whole.T)
    curved, wanted = np.where(chance.random(12) < 0.5, 0.0, 3.0), chance.random(31)
    found = linear.SampledCost(sample, 0, linear.SQUARED_HINGE, (1.0, 1.0)).inverse(curved)(wanted)
    assert np.allclose(found, np.linalg.solve(np.eye(31) + whole.T @ (curved[:, None] * whole), wanted))


def test_character_ngrams_are_looked_up_as_numbers(spark):
    """Also in the long form, and of unseen rows: no text becomes an array of strings."""
    texts = [text + " Ä  b" for text in TEXTS[:5] + TEXTS[7:]] + [None, " \t"]
    rows = spark.createDataFrame([(i, text) for i, text in enumerate(texts)], "id long, text string").repartition(3)
    chars = replace(ft.CHAR_NGRAMS, max_features=200, min_df=1)
    vocab = ft.vocabulary(ft.term_counts(ft.with_terms(rows, "text", chars), True), len(texts), 1, 1.0, 200)
    index = {r["term"]: r["term_idx"] for r in vocab.collect()}
    for make, bare in ((ft.transform_with, [(None, None, None)]), (ft.binary_ngrams, [])):
        long = make(rows, vocab, "id", "text", chars)
        found = {}
        for r in long.collect():
            found.setdefault(r["id"], []).append((r["term_idx"], r["term"], r["value"] and round(r["value"], 9)))
        for r in ft.with_terms(rows, "text", chars).collect():
            known = sorted(t for t in r["terms"] or [] if t in index)
            want = [(index[t], t, round(len(known) ** -0.5, 9)) for t in known] or bare
            assert sorted(found.get(r["id"], [])) == sorted(want)
        assert "regexp_extract_all" not in long._jdf.queryExecution().toString()


def test_packed_rows_are_the_encoded_rows(spark):
    texts = [text + " Ä  b" for text in TEXTS[:5] + TEXTS[7:]] + [None, ""]
    rows = spark.createDataFrame([(i, i % 3, text) for i, text in enumerate(texts)], "id long, fold int, text string").repartition(3)
    for representation in (replace(ft.CHAR_NGRAMS, max_features=200, min_df=1), replace(ft.WORD_TFIDF, min_df=1, max_df=1.0)):
        folded = rows.withColumn("text", ft.folded_text("text", representation))
        vocab = ft.vocabulary(ft.text_term_counts(folded, "text", representation), len(texts), 1, 1.0, 200)
        encoder = ft.fit_encoder(vocab, representation, len(texts))
        unmade = ft.encode_text(folded, "text", representation, encoder, ["id", "fold"], unmade=True)
        want = sorted(map(tuple, unmade.rows().collect()))
        assert sorted(map(tuple, unmade.packed().rows().collect())) == want
        apart = unmade.packed(apart="fold")
        assert apart.count() == len(texts)
        some = apart.where("apart <> 1").select("indices", "values", "id")
        assert sorted(map(tuple, some.rows().collect())) == sorted((r[2], r[3], r[0]) for r in want if r[1] != 1)
