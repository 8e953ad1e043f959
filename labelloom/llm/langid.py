"""Language identification by unigram pieces, summed over all segmentations.

A fixed public vocabulary gives the pieces. Every language has a probability for each, from the pieces of its labelled
texts. The probability of a word in a language is the sum over all ways to cut it into pieces, which a forward
recursion over the word's characters finds; a text is scored by its words. All words of one length are
scored together.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, functions as F

from labelloom.llm.common import kept_by_worker

VOCABULARY = "piece_bpe_32k.model"
START = "▁"
#: Letters; other characters say nothing about the language.
LETTERS = re.compile(r"[^\W\d_]+")
#: Length of the parts that ``words_of`` cuts longer words into, unless asked not to; the operators score words whole.
LONGEST = 32
#: Characters after which the forward sums are scaled, so that they stay in range.
RESCALE = 8
SMOOTHING, UNKNOWN = 0.1, 1e-8
#: Labelled documents of each language that the probabilities are learnt from, at most: a bounded sample by hash.
SAMPLE = 20_000
#: Scored words that a task keeps.
CACHE = 250_000
UNDETERMINED = "und"
#: Sum of hashes along a string; odd, so that it can be undone modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The usable pieces of the vocabulary: letters in lower case, after a word start or not."""

    def __init__(self, vocabulary: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary))
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        letters = [p.removeprefix(START) for p in pieces]
        usable = [
            i for i, (p, x) in enumerate(zip(pieces, letters))
            if (p == START or LETTERS.fullmatch(x) and x == x.lower()) and self.model.is_control(i) is False
        ]
        self.number = np.full(len(pieces), -1)
        self.number[usable] = np.arange(len(usable))
        self.size = len(usable)
        self.longest = max(len(pieces[i]) for i in usable)
        hashes = np.array([self._hash(pieces[i]) for i in usable], np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for ch in piece:
            h = (h * int(BASE) + ord(ch) + 1) % 2**64
        return h

    def count(self, words: Counter) -> np.ndarray:
        """How often each usable piece occurs in the vocabulary's own segmentation of the words."""
        out = np.zeros(self.size)
        listed = list(words)
        for ids, n in zip(self.model.encode(listed, num_threads=1), words.values()):
            numbers = self.number[ids]
            np.add.at(out, numbers[numbers >= 0], n)
        return out

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes; ``size`` where there is none."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), self.size - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], self.size)

    def log_likelihood(self, words: Sequence[str], probability: np.ndarray) -> np.ndarray:
        """Words by languages: the log probability of each word, over all segmentations.

        ``probability`` has a row for each piece and a last row of zeros for no piece.
        """
        out = np.empty((len(words), probability.shape[1]))
        lengths = np.fromiter(map(len, words), int, len(words))
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order], prepend=-1))
        for rows in np.split(order, cuts[1:]) if len(order) else []:
            out[rows] = self._forward([START + words[i] for i in rows], probability)
        return out

    def _forward(self, words: list[str], probability: np.ndarray) -> np.ndarray:
        """Logarithms of the sums for words of one length."""
        length = len(words[0])
        codes = np.array(words, f"<U{length}").view(np.uint32).reshape(len(words), length).astype(np.uint64) + np.uint64(1)
        alpha = [np.ones((len(words), probability.shape[1]))]  # sums up to the last places that a piece can start from
        scale = np.zeros_like(alpha[0])
        suffix: list[np.ndarray] = []  # hashes of the substrings that end here, shortest first
        with np.errstate(over="ignore"):
            for i in range(length):
                suffix = [codes[:, i], *(h * BASE + codes[:, i] for h in suffix[: self.longest - 1])]
                total = np.zeros_like(scale)
                for n, hashes in enumerate(suffix, 1):
                    piece = self.find(hashes)
                    at = np.flatnonzero(piece < self.size)
                    if len(at) == len(words):
                        total += alpha[-n] * probability[piece]
                    elif len(at):
                        total[at] += alpha[-n][at] * probability[piece[at]]
                    if n == 1:
                        total += alpha[-1] * np.where(piece == self.size, UNKNOWN, 0.0)[:, None]
                alpha = [*alpha[1 - self.longest :], total] if self.longest > 1 else [total]
                if i % RESCALE == RESCALE - 1:
                    alpha, scale = [a / total for a in alpha], scale + np.log(total)
        return np.log(alpha[-1]) + scale


def pieces_of(vocabulary: str) -> Pieces:
    return kept_by_worker(f"pieces {vocabulary}", lambda: Pieces(vocabulary))


def words_of(text: str, longest: int | None = LONGEST) -> Counter:
    """Runs of letters in lower case, in parts of at most ``longest`` characters if given."""
    words = Counter(LETTERS.findall(text.lower()))
    for word in [w for w in words if longest and len(w) > longest]:
        n = words.pop(word)
        for i in range(0, len(word), longest):
            words[word[i : i + longest]] += n
    return words


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(rows: DataFrame, vocabulary: str = VOCABULARY, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages by code point, and the probability of each piece (rows; a last one of zeros) in each.

    ``rows`` has ``text, lang, pick``; of each language about ``sample`` rows are taken, by the hash ``pick``.
    The model has one number for each piece and language, whatever the number of rows.
    """
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((pieces_of(vocabulary).size + 1, 0))
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, sample / sizes[lang]))) for lang in langs])
    chosen = rows.where(F.pmod("pick", F.lit(1 << 20)) < share * (1 << 20)).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, totals = pieces_of(vocabulary), {}
        words: dict[str, Counter] = {}

        def add() -> None:
            for lang, own in words.items():
                totals[lang] = totals.get(lang, 0) + pieces.count(own)
            words.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                own = words.setdefault(lang, Counter())
                own.update(words_of(text.as_py(), None))
                if len(own) > CACHE // 2:
                    add()
        add()
        for lang, n in totals.items():
            at = np.flatnonzero(n)
            columns = [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "piece", "n"])

    counts = chosen.mapInArrow(count, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
    size = pieces_of(vocabulary).size
    table = np.full((size + 1, len(langs)), SMOOTHING)
    for r in counts:
        table[r["piece"], langs.index(r["lang"])] += r["n"]
    table[-1] = 0
    return langs, table / table.sum(axis=0)


def identify(docs: DataFrame, langs: Sequence[str], probability: np.ndarray, vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds ``lang_pred`` and ``score``, the posterior of that language among the learned ones, all alike at first.

    ``und`` and 0 where the text is null or has no letter, or no language was learned. Texts are read whole; ties
    go to the language that is first by code point. Other columns pass through; columns that had these two names lose
    them to the results.
    """
    docs = docs.drop("lang_pred", "score")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, number, logs = pieces_of(vocabulary), {}, np.empty((0, len(langs)))
        for batch in batches:
            preds, scores = [], []
            waiting: list[Counter] = []
            size = 0

            def score() -> None:
                nonlocal logs, size
                new = list(dict.fromkeys(w for words in waiting for w in words if w not in number))
                number.update(zip(new, range(len(number), len(number) + len(new))))
                logs = np.concatenate([logs, pieces.log_likelihood(new, probability)])
                for words in waiting:
                    if not words or not langs:
                        preds.append(UNDETERMINED)
                        scores.append(0.0)
                        continue
                    at = np.fromiter(map(number.__getitem__, words), int, len(words))
                    total = np.fromiter(words.values(), float, len(words)) @ logs[at]
                    best = int(total.argmax())
                    preds.append(langs[best])
                    scores.append(float(1 / np.exp(total - total[best]).sum()))
                waiting.clear()
                size = 0
                if len(number) > CACHE:
                    number.clear()
                    logs = logs[:0]

            for text in batch.column("text"):
                waiting.append(words_of(text.as_py() or "", None))
                size += len(waiting[-1])
                if size > CACHE // 2:
                    score()
            score()
            columns = batch.columns + [pa.array(preds, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, schema + ", lang_pred string, score double")


def has_letter(text: Column) -> Column:
    """Whether a text has a character of ``LETTERS``, by the same expression; false for null."""

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: bool(t) and LETTERS.search(t.lower()) is not None).astype(bool)

    return run(text)


def fitted(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``identify`` with what is learned from the labelled documents that are not held out, and the languages learned."""
    training = docs.where(~held_out()).select("text", "lang", F.xxhash64("doc_id").alias("pick"))
    langs, probability = learn(training)
    return identify(docs, langs, probability), langs


def fit_and_identify(docs: DataFrame) -> DataFrame:
    """``identify`` with what is learned from the labelled documents that are not held out."""
    return fitted(docs)[0]
