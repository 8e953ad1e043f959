"""Distinct character n-grams of texts as numbers, for use inside tasks.

An n-gram is a key of 63 bits: the numbers of its characters in an alphabet, from 1, the first character highest, and zeros after a
short one. Keys sort like the strings. A zero where a character is not in the alphabet hides the n-grams that hold it:
what remains of such a key is a shorter n-gram of the same place, or nothing that occurs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CODE_POINTS = 0x110000


def _bits(high: int) -> int:
    return 63 // high


def _chars(texts: Sequence[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)


def _alphabet(chars: np.ndarray) -> np.ndarray:
    seen = np.zeros(CODE_POINTS, bool)
    seen[chars] = True
    return np.flatnonzero(seen)


def _numbers(alphabet: np.ndarray) -> np.ndarray:
    """The number of every code point in the alphabet, 0 outside it."""
    numbers = np.zeros(CODE_POINTS, np.int64)
    numbers[alphabet] = np.arange(1, len(alphabet) + 1)
    return numbers


def _distinct(numbers: np.ndarray, low: int, high: int) -> np.ndarray:
    """The sorted distinct keys of the n-grams of one text, given as numbers of its characters."""
    bits, key, found = _bits(high), numbers, []
    for length in range(1, high + 1):
        if length > 1:
            key = key[:-1] << bits | numbers[length - 1 :]
        if length >= low:
            found.append(key << bits * (high - length))
    keys = np.concatenate(found)
    keys.sort()
    return keys[np.diff(keys, prepend=-1) != 0]


def _strings(keys: np.ndarray, alphabet: np.ndarray, high: int) -> pa.Array:
    """The n-grams of keys."""
    bits = _bits(high)
    digits = keys[:, None] >> np.arange(bits * (high - 1), -1, -bits) & (1 << bits) - 1
    held = digits > 0
    chars = alphabet[digits[held] - 1]
    widths = np.ones(digits.shape, np.int32)
    widths[held] += (chars > 0x7F).astype(np.int32) + (chars > 0x7FF) + (chars > 0xFFFF)
    ends = np.append(0, np.cumsum((widths * held).sum(axis=1))).astype(np.int32)
    data = chars.astype("<u4").tobytes().decode("utf-32-le").encode()
    return pa.StringArray.from_buffers(len(keys), pa.py_buffer(ends), pa.py_buffer(data))


def document_counts(texts: Sequence[str], low: int, high: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """N-grams and in how many of the texts they are, in parts that may share n-grams: texts with more characters than keys can tell are
    taken in halves, and a single one as strings."""
    chars = _chars(texts)
    alphabet = _alphabet(chars)
    if len(alphabet) >> _bits(high):
        if len(texts) > 1:
            yield from document_counts(texts[: len(texts) // 2], low, high)
            yield from document_counts(texts[len(texts) // 2 :], low, high)
        else:
            found = {texts[0][at : at + n] for n in range(low, high + 1) for at in range(len(texts[0]) - n + 1)}
            yield pa.array(sorted(found), pa.string()), np.ones(len(found), np.int64)
        return
    numbers, ends = _numbers(alphabet), np.cumsum([len(text) for text in texts])
    each = [_distinct(numbers[chars[end - len(text) : end]], low, high) for text, end in zip(texts, ends)]
    keys = np.concatenate(each) if each else np.zeros(0, np.int64)
    keys.sort()
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    if len(first):
        yield _strings(keys[first], alphabet, high), np.diff(np.append(first, len(keys)))


@dataclass(frozen=True)
class Vocabulary:
    """The sorted keys of known n-grams, the index of each, and the alphabet of them all."""

    keys: np.ndarray
    index: np.ndarray
    alphabet: np.ndarray
    low: int
    high: int

    @classmethod
    def of(cls, terms: pa.Array, low: int, high: int) -> Vocabulary | None:
        """None if the terms have more characters than keys can tell. Terms of other lengths occur nowhere."""
        lengths = pc.utf8_length(terms).to_numpy(zero_copy_only=False)
        fits = np.flatnonzero((lengths >= low) & (lengths <= high))
        lengths, bits = lengths[fits], _bits(high)
        chars = _chars(terms.take(pa.array(fits)).to_pylist())
        alphabet = _alphabet(chars)
        if len(alphabet) >> bits:
            return None
        digits = np.zeros((len(fits), high), np.int64)
        digits[np.arange(high) < lengths[:, None]] = _numbers(alphabet)[chars]
        keys = (digits << np.arange(bits * (high - 1), -1, -bits)).sum(axis=1)
        order = np.argsort(keys)
        return cls(keys[order], fits[order], alphabet, low, high)

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row offsets, sorted indices and unit-length weights of the known n-grams of texts, all of a text alike."""
        numbers, found = _numbers(self.alphabet), []
        for text in texts:
            keys = _distinct(numbers[_chars([text or ""])], self.low, self.high)
            place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            found.append(np.sort(self.index[place[self.keys[place] == keys]]))
        counts = np.array([len(index) for index in found], np.int64)
        weights = np.repeat(1.0 / np.sqrt(np.maximum(counts, 1)), counts)
        return np.append(0, np.cumsum(counts)), np.concatenate([np.zeros(0, np.int64), *found]), weights
