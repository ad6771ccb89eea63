"""Language identification: known words first, shorter and shorter character n-grams after.

The model holds log frequencies per language of the most frequent words and of
the n-grams of all sampled words. A word of a text is scored by its own
frequencies if it is known; otherwise by its n-grams of the greatest length of
which any is known. Every word's scores are made a log posterior over the
languages, so both kinds weigh alike, and the words' posteriors add up.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tangency.llm.common import held_out, per_process

UNKNOWN = "und"
_WORDS = re.compile(r"[^\W\d_]+")
_LETTER = regex.compile(r"\p{L}")


def _signatures(letters: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each n-gram; ``letters`` has its code points, one row per place in the n-gram."""
    h = np.full(letters.shape[1], len(letters), np.uint64)
    with np.errstate(over="ignore"):
        for row in letters:
            h = h * np.uint64(0x9E3779B97F4A7C15) + row
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


@dataclass(frozen=True)
class Table:
    """Counts of known keys by language: sorted 64-bit hashes and, for each, the languages that have it.

    ``gain`` is how far a count lifts the log frequency above that of a key
    never seen in the language, which is ``base``.
    """

    keys: np.ndarray
    first: np.ndarray
    language: np.ndarray
    gain: np.ndarray
    base: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, language: np.ndarray, counts: np.ndarray, languages: int, smooth: float = 0.5) -> Table:
        order = np.argsort(hashes, kind="stable")
        keys, first = np.unique(hashes[order], return_index=True)
        total = np.bincount(language, counts, languages) + smooth * (len(keys) + 1)
        gain = np.log((counts[order] + smooth) / smooth).astype(np.float32)
        return cls(keys, np.r_[first, len(order)], language[order].astype(np.uint16), gain, np.log(smooth / total))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each hash's key, or -1."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)

    def posteriors(self, numbers: np.ndarray) -> np.ndarray:
        """Log posteriors over the languages of the keys of these numbers."""
        logs = np.tile(self.base, (len(numbers), 1))
        size = self.first[numbers + 1] - self.first[numbers]
        place = np.repeat(self.first[numbers] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        logs[np.repeat(np.arange(len(numbers)), size), self.language[place]] += self.gain[place]
        top = logs.max(1, keepdims=True)
        return logs - top - np.log(np.exp(logs - top).sum(1, keepdims=True))


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order, the table of known words, and one of n-grams per length, the longest first.

    N-grams are of the word between two spaces.
    """

    languages: tuple[str, ...]
    words: Table | None
    grams: tuple[tuple[int, Table], ...]

    def posteriors(self, words: list[str]) -> np.ndarray:
        """A row of log posteriors per word: its own if known, else the mean over its longest known n-grams."""
        width = max(1, len(self.languages))
        out = np.full((len(words), width), -math.log(width))
        if self.words is None or not words:
            return out
        found = self.words.find(np.fromiter(map(_word_hash, words), np.uint64, len(words)))
        out[found >= 0] = self.words.posteriors(found[found >= 0])
        rest = np.flatnonzero(found < 0)
        for n, known in self.grams:
            if not len(rest):
                break
            letters = _code_points("".join(f" {words[i]} " for i in rest.tolist()))
            sizes = np.fromiter((len(words[i]) + 2 for i in rest.tolist()), np.int64, len(rest))
            count = len(letters) - n + 1
            if count < 1:
                continue
            owner = np.repeat(np.arange(len(rest)), sizes)
            found = known.find(_signatures(np.stack([letters[k : k + count] for k in range(n)])))
            at = np.flatnonzero((found >= 0) & (owner[:count] == owner[n - 1 :]))
            hits = np.bincount(owner[at], minlength=len(rest))
            rows = known.posteriors(found[at])
            for k in range(width):
                sums = np.bincount(owner[at], rows[:, k], len(rest))
                out[rest[hits > 0], k] = sums[hits > 0] / hits[hits > 0]
            rest = rest[hits == 0]
        return out


def train(
    docs: DataFrame,
    rows_per_language: int = 1500,
    most_words: int | None = 20_000,
    most_grams: int | None = 20_000,
    lengths: tuple[int, ...] = (5, 4, 3, 2, 1),
) -> LanguageModel:
    """Fits the model on (text, lang) of ``docs``; rows with a null in either are left out.

    The fit is on a sample bounded by its parameters: about
    ``rows_per_language`` rows of each language, drawn by a hash of doc_id (if
    there) and text. Every labelled language is learned. Words and n-grams are
    counted in Spark; what comes to the driver is the ``most_words`` words of
    each language and the ``most_grams`` n-grams of each length and language,
    or, where that is None, all of the sample's.
    """
    ids = [F.col("doc_id")] if "doc_id" in docs.columns else []
    rows = docs.where("text is not null and lang is not null").select("lang", "text", F.xxhash64(*ids, "text", F.lit(11)).alias("draw"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not sizes:
        return LanguageModel((), None, ())
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, rows_per_language / r["n"]))])
    draw = F.shiftrightunsigned("draw", 11).cast("double") / float(1 << 53)
    sample = rows.withColumn("share", F.element_at(share, F.col("lang"))).where(draw < F.col("share"))
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(0))).alias("key"))
    words = words.groupBy("lang", "key").agg(F.count("*").alias("n"))
    padded = F.concat(F.lit(" "), "key", F.lit(" "))
    last = F.length("key") + 3 - F.col("length")
    grams = words.withColumn("length", F.explode(F.array(*[F.lit(n) for n in lengths]))).where(last >= 1)
    grams = grams.withColumn("at", F.explode(F.sequence(F.lit(1), last)))
    grams = grams.select("lang", "length", F.substr(padded, F.col("at"), F.col("length")).alias("key"), "n")
    grams = grams.groupBy("lang", "length", "key").agg(F.sum("n").alias("n"))
    both = words.select("lang", F.lit(0).alias("length"), "key", "n").union(grams)
    best = Window.partitionBy("lang", "length").orderBy(F.col("n").desc(), "key")
    every = (1 << 31) - 1
    most = F.when(F.col("length") == 0, every if most_words is None else most_words).otherwise(every if most_grams is None else most_grams)
    kept = both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).drop("rank").toArrow()

    languages = tuple(sorted(r["lang"] for r in sizes))
    place = {lang: i for i, lang in enumerate(languages)}
    language = np.array([place[lang] for lang in kept["lang"].to_pylist()], np.int64)
    length, counts = kept["length"].to_numpy(), kept["n"].to_numpy().astype(np.float64)
    tables = {}
    for n in (0, *lengths):
        own = np.flatnonzero(length == n)
        keys = kept["key"].take(pa.array(own)).to_pylist()
        if n == 0:
            hashes = np.fromiter(map(_word_hash, keys), np.uint64, len(keys))
        else:
            hashes = _signatures(_code_points("".join(keys)).reshape(-1, n).T)
        tables[n] = Table.of(hashes, language[own], counts[own], len(languages))
    return LanguageModel(languages, tables[0], tuple((n, tables[n]) for n in sorted(lengths, reverse=True)))


class Scorer(dict):
    """Sums of word posteriors for many texts; keeps the rows of words seen, about ``most`` numbers in all.

    As a dictionary it numbers words; ``rows`` has a row per number.
    """

    def __init__(self, model: LanguageModel, most: int = 1_500_000):
        super().__init__()
        self.model, self.most = model, most
        self.rows = np.zeros((1024, max(1, len(model.languages))), np.float32)

    def learn(self, words: set[str], at_once: int = 1 << 20) -> None:
        """Numbers the words not yet known; ``at_once`` bounds letters times languages worked on together."""
        if self.rows.shape[1] * len(self) > self.most:
            self.clear()
        new = [w for w in words if w not in self]
        if len(self) + len(new) > len(self.rows):
            more = np.zeros((max(2 * len(self.rows), len(self) + len(new)), self.rows.shape[1]), np.float32)
            more[: len(self)] = self.rows[: len(self)]
            self.rows = more
        begin, held = 0, 0
        for i, w in enumerate(new, 1):
            held += (len(w) + 2) * self.rows.shape[1]
            if held >= at_once or i == len(new):
                self.rows[len(self) : len(self) + i - begin] = self.model.posteriors(new[begin:i])
                self.update(zip(new[begin:i], range(len(self), len(self) + i - begin)))
                begin, held = i, 0

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language of each text and its posterior; UNKNOWN and 0 without a letter or without a model."""
        if not self.model.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        words = [_WORDS.findall(t.lower()) or [t] if t and _LETTER.search(t) else [] for t in texts]
        self.learn(set().union(*words))
        return [self._best(own) if own else (UNKNOWN, 0.0) for own in words]

    def _best(self, words: list[str]) -> tuple[str, float]:
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self._best_of(self.rows[numbers].sum(0, dtype=np.float64))

    def _best_of(self, total: np.ndarray) -> tuple[str, float]:
        best = int(np.argmax(total))
        return self.model.languages[best], float(1 / np.exp(total - total[best]).sum())

    def sums(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per lower-cased token without white space the sum of its words' rows, and whether it has a word."""
        words = [_WORDS.findall(t) for t in tokens]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out = np.zeros((len(tokens), self.rows.shape[1]), np.float32)
        if self.model.languages and sizes.any():
            self.learn(set().union(*words))
            numbers = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
            out[sizes > 0] = np.add.reduceat(self.rows[numbers], (np.cumsum(sizes) - sizes)[sizes > 0], axis=0)
        return out, sizes > 0

    def predict_from(self, text: str | None, sums: np.ndarray, has_word: np.ndarray) -> tuple[str, float]:
        """As predict_all, of one text whose tokens have these ``sums``: no word is looked up again."""
        if self.model.languages and has_word.any() and _LETTER.search(text):
            return self._best_of(sums.sum(0, dtype=np.float64))
        return self.predict_all([text])[0]


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` plus lang_pred and score, from the whole text alone.

    A text that is null or has no letter is ``und`` at score 0, as is every
    text if the model has no language; ties go to the first language by name.
    Repeated rows and null ids stay. A column lang_pred or score of ``docs`` is replaced.
    """
    schema = docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = uuid.uuid4().hex
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = per_process(("language", name), lambda: Scorer(shared.value))
        for batch in batches:
            texts = batch.column(at)
            found, held, letters = [], [], 0
            for i in range(batch.num_rows):
                held.append(texts[i].as_py())
                letters += len(held[-1] or "")
                if letters >= 1 << 21 or i == batch.num_rows - 1:
                    found += scorer.predict_all(held)
                    held, letters = [], 0
            columns = dict(zip(batch.schema.names, batch.columns))
            columns["lang_pred"] = pa.array([f[0] for f in found], pa.string())
            columns["score"] = pa.array([f[1] for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([columns[c] for c in schema.names], schema.names)

    return docs.mapInArrow(run, schema)


def identified(docs: DataFrame, modulus: int = 4, remainder: int = 2, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row; held-out rows are not learned from."""
    model = train(docs.where(~held_out("doc_id", modulus, remainder)), **options)
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), "lang_pred", "score")


def with_known_language(docs: DataFrame, least_score: float = 0.4, **options) -> DataFrame:
    """``docs`` without rows of no letter, or of no language at ``least_score``; all columns kept."""
    model = train(docs, **options)
    names = [F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]
    plain = docs.select(*names, F.col("text").alias("text"))
    out = identify(plain, model).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
