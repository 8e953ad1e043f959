"""Text functions as Spark columns.

Everything runs in the JVM except Unicode normalisation (NFKC with case folding, NFKD for
accents), which Spark has no function for. Those two go through Arrow, and only for texts that
hold a non-ASCII character; the others reach the UDF as nulls.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# A word is a run of letters, digits and underscores, with apostrophes allowed between such runs.
# The possessive quantifiers keep Java's matcher iterative on long words.
WORD = r"[\p{L}\p{N}_]++(?:'++[\p{L}\p{N}_]++)*+"
# Unicode white space, including the four ASCII separators that Java's class leaves out.
SPACE = r"[\s\x1C-\x1F]"
ASCII_SPACES = r"[\s\x1C-\x1F]+"
SENTENCE_END = r"(?U)[.!?]+(?=[\s\x1C-\x1F]|\z)|\n+"
NOT_BLANK = r"(?U)[^\s\x1C-\x1F]"
SPACE_RUN = r"(?U)[\s\x1C-\x1F]{2,}"
# Characters beyond the first plane, two units of UTF-16 each.
TWO_UNITS = r"[\x{10000}-\x{10FFFF}]"
# Texts that a Unicode function holds as Python strings at a time.
TEXTS_AT_ONCE = 256


def _text(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def is_ascii(col: Column | str) -> Column:
    """True where every character takes one byte."""
    text = _text(col)
    return F.octet_length(text) == F.char_length(text)


def _slice_by_slice(texts: pa.Array, change: Callable[[list], list]) -> pa.Array:
    """A batch's texts changed ``TEXTS_AT_ONCE`` at a time, so that a batch of long texts is held in Arrow alone."""
    parts = [
        pa.array(change(texts.slice(start, TEXTS_AT_ONCE).to_pylist()), pa.string())
        for start in range(0, len(texts), TEXTS_AT_ONCE)
    ]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.arrow_udf(StringType())
def _canonical_unicode(texts: pa.Array) -> pa.Array:
    spaces = re.compile(r"\s+")

    def canonical(text):
        if text is None:
            return None
        return spaces.sub(" ", unicodedata.normalize("NFKC", text).casefold()).strip()

    return _slice_by_slice(texts, lambda some: [canonical(text) for text in some])


def canonical_text(col: Column | str) -> Column:
    """NFKC, case folding, white space runs to one space, ends stripped."""
    text = _text(col)
    plain = F.trim(F.regexp_replace(F.lower(text), ASCII_SPACES, " "))
    return F.coalesce(_canonical_unicode(F.when(~is_ascii(text), text)), plain)


@F.arrow_udf(StringType())
def _fold_unicode(texts: pa.Array) -> pa.Array:
    def fold(some):
        present = set().union(*(set(text) for text in some if text is not None))
        decomposed = set(unicodedata.normalize("NFKD", "".join(present).lower()))
        marks = {ord(c): None for c in decomposed if unicodedata.combining(c)}
        return [None if t is None else unicodedata.normalize("NFKD", t.lower()).translate(marks) for t in some]

    return _slice_by_slice(texts, fold)


def fold_accents(col: Column | str) -> Column:
    """Lower case, then NFKD without combining marks."""
    text = _text(col)
    return F.coalesce(_fold_unicode(F.when(~is_ascii(text), text)), F.lower(text))


def tokens(col: Column | str) -> Column:
    """All words, case kept, in order, repeats included."""
    return F.regexp_extract_all(_text(col), F.lit(WORD), F.lit(0))


def token_count(col: Column | str) -> Column:
    """Number of words."""
    return F.regexp_count(_text(col), F.lit(WORD))


def sentence_like_count(col: Column | str) -> Column:
    """Non-blank parts between sentence ends or line breaks; 0 for a blank text."""
    text = _text(col)
    parts = F.filter(F.split(text, SENTENCE_END), lambda part: part.rlike(NOT_BLANK))
    return F.when(text.rlike(NOT_BLANK), F.greatest(F.lit(1), F.size(parts))).otherwise(0)


def word_tokens_min2(folded: Column | str) -> Column:
    """Words of at least two characters of an accent-folded text."""
    return F.filter(tokens(folded), lambda token: F.char_length(token) >= 2)


# English stop words for the descriptive word table (Spark's default English list
# without the forms that hold an apostrophe and without "just").
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself they them their theirs themselves what which who whom "
    "this that these those am is are was were be been being have has had having do does did "
    "doing a an the and but if or because as until while of at by for with about against between "
    "into through during before after above below to from up down in out on off over under again "
    "further then once here there when where why how all any both each few more most other some "
    "such no nor not only own same so than too very s t can will don should now cannot could ought would"
).split()


def remove_stop_words(token_array: Column | str, stop_words=tuple(STOP_WORDS)) -> Column:
    """Tokens that are not stop words, repeats kept."""
    return F.filter(_text(token_array), lambda token: ~token.isin(*stop_words))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` refers to it.

    A lambda variable stands for the value, because the optimizer would otherwise repeat the
    expression at each reference inside the array functions.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def word_ngrams(token_array: Column | str) -> Column:
    """Unigrams, then bigrams joined by a space."""

    def with_pairs(words):
        following = F.slice(words, F.lit(2), F.size(words))
        # The last word meets a null and gives a null bigram, which array_compact drops.
        pairs = F.zip_with(words, following, lambda a, b: F.concat(a, F.lit(" "), b))
        return F.array_compact(F.concat(words, pairs))

    return _let(_text(token_array), with_pairs)


def single_spaces(folded: Column | str) -> Column:
    """White space runs become a space, as before character n-grams are made."""
    return F.regexp_replace(_text(folded), SPACE_RUN, " ")


def char_ngrams(folded: Column | str, low: int = 3, high: int = 5) -> Column:
    """Every substring of ``low`` to ``high`` characters, after white space runs became a space.

    A look-ahead finds the substrings of one length, at every place. It moves by UTF-16 units, so texts with characters of two
    units are split into characters instead.
    """

    def grams(text):
        found = [F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in range(low, high + 1)]
        return F.when(text.rlike(TWO_UNITS), _grams_of_split(text, low, high)).otherwise(F.concat(*found))

    return _let(single_spaces(folded), grams)


def _grams_of_split(text: Column, low: int, high: int) -> Column:
    """The same from a text split into characters once.

    Each length is the previous one with the next character appended, so the work is linear in the text and no lambda looks
    back at it.
    """

    def lengthen(chars, grams, n):
        """N-grams of length ``n`` (given as ``grams``) up to ``high``."""
        if n == high:
            return grams
        following = F.slice(chars, F.lit(n + 1), F.size(chars))
        longer = _let(
            F.zip_with(grams, following, lambda a, b: F.concat(a, b)),
            lambda more: lengthen(chars, more, n + 1),
        )
        return F.concat(grams, longer) if n >= low else longer

    # Past the end of the text the next character is null, and so is the n-gram.
    grams = _let(F.split(text, ""), lambda c: lengthen(c, c, 1))
    return F.filter(grams, lambda gram: gram.isNotNull() & (gram != ""))
