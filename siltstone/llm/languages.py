"""Operator 9: language identification of mixed-language text.

A word's script narrows its candidate languages; its score in each comes from letter trigrams. A
Viterbi pass over the words, with a penalty for each switch, labels spans. Scores are kept by
word, and many texts step through the pass together.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: First and last code points of scripts. Letters outside them all count as "other".
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F), ("arabic", 0xFB50, 0xFDFF),
    ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7AF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF),
)
_WORD = re.compile(r"[^\W\d_]+")
#: Numbers that are no decimal digits (superscripts, fractions, Roman ones): ``\\w`` takes them for letters.
_NUMBERS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Nl", "No"))
_NO_NUMBERS = {ord(c): " " for c in _NUMBERS}


def letter_words(text: str) -> list[str]:
    """Runs of letters in lower case."""
    text = text.lower()
    if not text.isascii() and not _NUMBERS.isdisjoint(text):
        text = text.translate(_NO_NUMBERS)
    return _WORD.findall(text)


def script_of(word: str) -> str:
    c = ord(word[0])
    return next((name for name, a, b in SCRIPTS if a <= c <= b), "other")


def trigrams(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


class Model:
    """Letter trigram log probabilities by language, and the share of letters that each script has in it."""

    def __init__(self, counts: dict[str, dict[str, int]], scripts: dict[str, dict[str, int]], smooth: float = 0.5, unlikely: float = -12.0):
        self.languages = sorted(counts)
        grams = sorted({g for c in counts.values() for g in c})
        self.rows = {g: i for i, g in enumerate(grams)}
        n = np.array([[counts[x].get(g, 0) for x in self.languages] for g in grams], float).reshape(len(grams), len(self.languages)) + smooth
        unseen = np.log(smooth / (n.sum(0) + smooth)) if grams else np.zeros(len(self.languages))
        self.logs = np.vstack([np.log(n / (n.sum(0) + smooth)), unseen[None, :]]).astype("f4")  # the last row is for trigrams never met
        self.scripts = {}
        for s in {s for c in scripts.values() for s in c}:
            share = np.array([scripts[x].get(s, 0) / max(1, sum(scripts[x].values())) for x in self.languages])
            self.scripts[s] = np.where(share >= 0.001, 0, unlikely).astype("f4")

    def scores(self, words: list[str]) -> np.ndarray:
        """Log likelihoods of each word by language, greatest 0 and least -12; all 0 if no language writes the script."""
        out = np.zeros((len(words), len(self.languages)), "f4")
        find, unseen, zero = self.rows.get, len(self.rows), np.zeros(len(self.languages), "f4")
        step = 1 + 2_000_000 // max(1, len(self.languages))
        for start in range(0, len(words), step):
            group = words[start : start + step]
            at = [find(g, unseen) for w in group for g in trigrams(w)]
            starts = np.cumsum([0, *(len(w) for w in group[:-1])])  # as many trigrams as letters
            scripts = [script_of(w) for w in group]
            total = np.add.reduceat(self.logs[at], starts) + np.array([self.scripts.get(s, zero) for s in scripts])
            total = np.maximum(total - total.max(1, keepdims=True), -12.0)
            total[[s not in self.scripts for s in scripts]] = 0
            out[start : start + step] = total
        return out


def viterbi(scores: np.ndarray, idx: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """For each text (word numbers in ``idx``, rows of ``scores``) the best label of each word, paying ``penalty`` a switch."""
    longest, n = max(map(len, idx)), scores.shape[1]
    at = np.full((longest, len(idx)), len(scores) - 1, np.int32)  # the last row is all 0: padding changes nothing
    for k, x in enumerate(idx):
        at[: len(x), k] = x
    value = scores[at[0]].copy()
    stays = np.zeros((longest, len(idx), n), bool)
    tops = np.zeros((longest, len(idx)), np.int32)
    for t in range(1, longest):
        tops[t] = top = value.argmax(1)
        switched = value[np.arange(len(idx)), top] - penalty
        stays[t] = stay = value >= switched[:, None]
        value = np.where(stay, value, switched[:, None]) + scores[at[t]]
    label = value.argmax(1)
    out = np.empty((longest, len(idx)), np.int32)
    lane = np.arange(len(idx))
    for t in range(longest - 1, -1, -1):
        out[t] = label
        label = np.where(stays[t, lane, label], label, tops[t])
    return [out[: len(x), k] for k, x in enumerate(idx)]


class Labeller:
    """Labels batches of texts; scores of the first ``cached`` words are kept."""

    def __init__(self, model: Model, penalty: float, cached: int = 400_000, cells: int = 8_000_000):
        self.model, self.penalty, self.cached, self.cells = model, penalty, cached, cells // max(4, len(model.languages))
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((1024, len(model.languages)), "f4")

    def _number(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.rows]
        if len(self.rows) + len(new) > self.cached:
            self.rows = {}
            new = list(words)
        need = len(self.rows) + len(new) + 1
        if need > len(self.scores):
            self.scores = np.vstack([self.scores[: len(self.rows)], np.zeros((2 * need - len(self.rows), self.scores.shape[1]), "f4")])
        if new:
            first = len(self.rows)
            self.rows.update(zip(new, range(first, first + len(new)), strict=True))
            self.scores[first : first + len(new)] = self.model.scores(new)
        self.scores[-1] = 0

    def label(self, texts: list[str], most: int = 2_000_000) -> Iterator[tuple[list[str], np.ndarray, np.ndarray] | None]:
        """(words, label numbers, mean scores) of each text, None without a letter. Some ``most`` characters are held as words at a time."""
        start = size = 0
        for i, x in enumerate(texts):
            size += len(x)
            if size >= most or i == len(texts) - 1:
                yield from self._labelled(texts[start : i + 1])
                start, size = i + 1, 0

    def _labelled(self, texts: list[str]) -> list:
        out: list = [None] * len(texts)
        words = [letter_words(x) for x in texts]
        order = sorted((i for i, w in enumerate(words) if w), key=lambda i: len(words[i]))
        while order:
            group, widest = [], 0
            while order and (not group or (len(group) + 1) * widest <= self.cells and len(group) < 1024):
                i = order.pop()
                widest = widest or len(words[i])
                group.append(i)
            self._number(set().union(*(words[i] for i in group)))
            idx = [np.fromiter(map(self.rows.__getitem__, words[i]), np.int32, len(words[i])) for i in group]
            for i, x, labels in zip(group, idx, viterbi(self.scores, idx, self.penalty), strict=True):
                out[i] = words[i], labels, self.scores[x].mean(0)
        return out


def fit(docs: DataFrame, trained: Column, text_col: str, lang_col: str, per_language: int) -> Model:
    """Trigram and script counts of about ``per_language`` texts of each language, drawn by a hash of the text."""
    rows = docs.where(trained & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col).cast("string")).count().collect()}
    if not sizes:
        return Model({}, {})
    # A map literal of one entry a language: the part of its texts to draw, in millionths.
    part = F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1_000_000, 1_000_000 * per_language // n + 1))])
    drawn = rows.where(F.pmod(F.xxhash64(text_col, F.lit(7)), F.lit(1_000_000)) < part[F.col(lang_col).cast("string")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, n in Counter(letter_words(text)).items():
                    grams[lang, "s" + script_of(word)] += n * len(word)
                    for g in trigrams(word):
                        grams[lang, "g" + g] += n
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in grams], pa.string()), pa.array([k[1] for k in grams], pa.string()), pa.array(list(grams.values()), pa.int64())], ["lang", "what", "n"])

    told = drawn.select(F.col(lang_col).cast("string"), text_col).mapInArrow(count, "lang string, what string, n long").groupBy("lang", "what").agg(F.sum("n"))
    grams: dict = {k: {} for k in sizes}
    scripts: dict = {k: {} for k in sizes}
    for lang, what, n in told.collect():
        (grams if what[0] == "g" else scripts)[lang][what[1:]] = n
    return Model(grams, scripts)


OUTPUT = "lang_pred string, score double, share double, spans array<struct<lang:string,first_word:int,end_word:int>>"


def predicted(model: Model, text: Column, spark: SparkSession, penalty: float = 10.0) -> Column:
    """A struct of ``OUTPUT`` for each whole text, by Arrow batches; only the text goes to Python."""
    shared = spark.sparkContext.broadcast(model)  # trigram counts: bounded by the fit's sample

    def told(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        labeller, names = Labeller(model, penalty), model.languages
        for batch in batches:
            texts = [x or "" for x in batch]
            rows = []
            for found in labeller.label(texts) if names else [None] * len(texts):
                if found is None:
                    rows.append(("und", 0.0, 0.0, []))
                    continue
                words, labels, mean = found
                size = np.bincount(labels, weights=np.fromiter(map(len, words), float, len(words)), minlength=len(names))
                best = int(size.argmax())
                certain = 1 / np.exp(np.minimum(mean - mean[best], 30) * min(len(words), 20)).sum() if len(names) > 1 else 1.0
                share = float(size[best] / size.sum())
                edges = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
                spans = [{"lang": names[labels[a]], "first_word": a, "end_word": b} for a, b in zip(edges, edges[1:], strict=False)]
                rows.append((names[best], float(np.clip(share * certain, 0, 1)), share, spans))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "share", "spans"])

    kind = StructType.fromDDL(OUTPUT)
    return F.pandas_udf(told, kind).asNondeterministic()(text)  # once a text


def identify(docs: DataFrame, trained: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1500, penalty: float = 10.0) -> DataFrame:
    """The language of every whole text, and its spans.

    Learns from rows where ``trained`` holds, language and text are not null; about ``per_language``
    texts of each language, the fit's documented bound. The prediction reads the text alone.

    Rows: id, lang_pred (the language that most letters are labelled with; ``und`` if the text is
    null or has no letter, or nothing was learned), score (0 to 1: the share of letters so
    labelled, times the certainty that the text's words give it; 0 for ``und``), share (the first of
    these factors), spans (array of struct lang, first_word, end_word over runs of letters). One
    row for each row of ``docs``; ties go to the first language by name; repeated rows repeat;
    null ids stay null; extra columns are ignored.
    """
    model = fit(docs, trained, text_col, lang_col, per_language)
    told = predicted(model, F.col(text_col).cast("string"), docs.sparkSession, penalty)
    return docs.select(F.col(id_col), told.alias("_told")).select(id_col, "_told.*")
