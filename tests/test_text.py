"""Text functions against Python's own Unicode rules."""

import re
import unicodedata

import pytest
import pyarrow as pa
from pyspark.sql import functions as F

from labelloom.functions import text as tx

TEXTS = [
    "", " ", "\n\t ", "One. Two! Three", "Wait... what?!No", "a\n\nb\n", "'q' a''b x'y'z '' '",
    "Straße STRASSE straße", "Ｆｕｌｌ ｗｉｄｔｈ", "Café naïve É é İstanbul ΑΣΣ", "½ ² x² ٣",
    "no break\u0085next wide\x1cfile", "tail. ", "日本語。テスト", "a_b 1_2 _", "don't just stop",
    "😀 ok 😀😀", "a" * 40 + "'" + "b" * 40, "x'" * 5000, "dot.", ".", "?!", "end . ", "ab", "abc", "ab  cd\n\nef \t g",
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(len(TEXTS), None)], "i int, text string")


def _values(rows, column):
    return [r[0] for r in rows.orderBy("i").select(column).collect()]


def _python(function):
    return [function(t) for t in TEXTS]


def _fold(text):
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def test_canonical_text(rows):
    expected = _python(lambda t: re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t).casefold()).strip())
    assert _values(rows, tx.canonical_text("text")) == expected + [None]


def test_canonical_text_of_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for row in table.select("text", tx.canonical_text("text").alias("key")).collect():
        assert row["key"] == re.sub(r"\s+", " ", unicodedata.normalize("NFKC", row["text"]).casefold()).strip()


def test_fold_accents(rows):
    assert _values(rows, tx.fold_accents("text")) == _python(_fold) + [None]


def test_tokens(rows):
    expected = _python(lambda t: re.findall(r"(?u)\b[\w']+\b", t))
    assert _values(rows, tx.tokens("text"))[:-1] == expected
    assert _values(rows, tx.token_count("text"))[:-1] == [len(words) for words in expected]


def test_word_tokens_min2(rows):
    expected = _python(lambda t: re.findall(r"(?u)\b[\w']{2,}\b", _fold(t)))
    assert _values(rows, tx.word_tokens_min2(tx.fold_accents("text")))[:-1] == expected


def test_stop_words_keep_repeats(spark):
    df = spark.createDataFrame([(["the", "cat", "and", "cat", "don't"],)], "w array<string>")
    assert df.select(tx.remove_stop_words("w")).first()[0] == ["cat", "cat", "don't"]


def test_sentence_like_count(rows):
    def count(text):
        stripped = text.strip()
        if not stripped:
            return 0
        return max(1, sum(bool(p.strip()) for p in re.split(r"(?:[.!?]+(?=\s|$)|\n+)", stripped)))

    assert _values(rows, tx.sentence_like_count("text"))[:-1] == _python(count)


def test_word_ngrams(rows):
    def grams(text):
        words = re.findall(r"(?u)\b[\w']+\b", _fold(text))
        return words + [f"{a} {b}" for a, b in zip(words, words[1:])]

    assert _values(rows, tx.word_ngrams(tx.tokens(tx.fold_accents("text"))))[:-1] == _python(grams)


@pytest.mark.parametrize("low,high", [(3, 5), (1, 2), (2, 2)])
def test_char_ngrams(rows, low, high):
    def grams(text):
        spaced = re.sub(r"\s\s+", " ", _fold(text))
        return [spaced[i : i + n] for n in range(low, high + 1) for i in range(len(spaced) - n + 1)]

    assert _values(rows, tx.char_ngrams(tx.fold_accents("text"), low, high))[:-1] == _python(grams)


def test_ascii_texts_skip_python(spark):
    df = spark.createDataFrame([("Plain",), ("Ünï",)], "t string")
    assert [r[0] for r in df.select(tx.is_ascii("t")).collect()] == [True, False]
    assert df.select(F.collect_list(tx.fold_accents("t"))).first()[0] == ["plain", "uni"]


def test_char_ngrams_of_characters_of_two_units(spark):
    """A look-ahead would cut them in halves; texts without them are not split into characters."""
    texts = ["a😀b𝒳cd", "ab\ncd", "é😀", "", "ab"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = [r[0] for r in rows.orderBy("id").select(tx.char_ngrams("text")).collect()]
    assert found == [[t[i : i + n] for n in (3, 4, 5) for i in range(len(t) - n + 1)] for t in texts]
    assert "regexp_extract_all" in rows.select(tx.char_ngrams("text"))._jdf.queryExecution().toString()


def test_unicode_texts_are_held_a_slice_at_a_time():
    sizes = []
    texts = pa.array(["é"] * (2 * tx.TEXTS_AT_ONCE + 1) + [None])

    def change(some):
        sizes.append(len(some))
        return some

    assert tx._slice_by_slice(texts, change).equals(texts) and max(sizes) == tx.TEXTS_AT_ONCE and len(sizes) == 3
    assert len(tx._slice_by_slice(texts.slice(0, 0), change)) == 0
