"""Language identification: known words by log frequency, unseen words by ever shorter character n-grams.

A model is fitted on a sample of labelled rows of at most about `TRAIN_ROWS`, with all their languages; counting runs on
Spark. All words and n-grams that the sample holds `MIN_COUNT` times come to the driver, so what is broadcast is bounded by
the sample.

Defined results: `und` with score 0 for null texts and texts without a letter; ties go to the alphabetically first language;
a null doc_id reads as the empty string where rows are held out; repeated rows count and are judged separately; extra
columns pass through, whatever their names; without labelled rows every text is `und`; of very long texts all words count.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .encoding import slices
from .shared import materialize, with_plain_names

UNDETERMINED = "und"
#: Bound on the labelled rows, on average, that a model is fitted on.
TRAIN_ROWS = 10_000
#: Words and n-grams that the sample holds less often are left to shorter n-grams.
MIN_COUNT = 2
LONGEST_GRAM = 4
SMOOTHING = 0.5
#: Words and their scores that a worker remembers.
CACHE_WORDS = 300_000
#: Bytes of text that are scored at once, but for a longer text.
SLICE_BYTES = 1_000_000

#: ASCII letters stay, other ASCII characters part words, all beyond ASCII stays.
_TABLE = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split()


def has_letter(text: str) -> bool:
    return next((True for c in text if c.isalpha()), False)


def grams(word: bytes, n: int) -> list[str]:
    padded = f"<{word.decode('utf-8', 'replace')}>"
    return [padded[k : k + n] for k in range(len(padded) - n + 1)] if n > 1 else list(padded[1:-1])


class Model:
    """Log frequencies of words and n-grams for each language, as rows of two matrices."""

    def __init__(self, languages: list[str], word_counts: list[tuple[str, list[int]]], gram_counts: list[tuple[str, list[int]]]) -> None:
        self.languages = languages
        self.words = {x.encode("utf-8", "surrogatepass"): k for k, (x, _) in enumerate(word_counts)}
        self.word_logs = self._logs([c for _, c in word_counts], np.zeros(len(word_counts), int))
        self.grams = {x: k for k, (x, _) in enumerate(gram_counts)}
        self.gram_logs = self._logs([c for _, c in gram_counts], np.array([len(x) for x, _ in gram_counts], int))

    def _logs(self, counts: list[list[int]], group: np.ndarray) -> np.ndarray:
        """Smoothed shares of each language within a group of keys."""
        out = np.array(counts, float).reshape(len(counts), len(self.languages)) + SMOOTHING
        for g in np.unique(group):
            out[group == g] /= out[group == g].sum(0)
        return np.log(out).astype(np.float32)

    def backed_off(self, word: bytes) -> list[int]:
        """The known n-grams of the longest n for which there are any."""
        get = self.grams.get
        for n in range(LONGEST_GRAM, 0, -1):
            found = [k for k in map(get, grams(word, n)) if k is not None]
            if found:
                return found
        return []

    def unseen(self, words: list[bytes]) -> np.ndarray:
        """A row for each word: the mean of its n-grams, the best language at 0; nothing known says nothing."""
        found = [self.backed_off(w) for w in words]
        sizes = np.array([len(x) for x in found])
        out = np.zeros((len(words), len(self.languages)), np.float32)
        some = np.flatnonzero(sizes)
        if len(some):
            flat = self.gram_logs[[k for x in found for k in x]]
            mean = np.add.reduceat(flat, (np.cumsum(sizes) - sizes)[some]) / sizes[some, None]
            out[some] = mean - mean.max(1, keepdims=True)
        return out


class Scorer:
    """A model with the words seen so far in a task."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.index = dict(self.model.words)
        self.matrix = self.model.word_logs

    def _learn(self, new: list[bytes]) -> None:
        n = len(self.index) - len(new)
        if len(self.matrix) < len(self.index):
            grown = np.zeros((2 * len(self.index), self.matrix.shape[1]), np.float32)
            grown[:n] = self.matrix[:n]
            self.matrix = grown
        self.matrix[n : len(self.index)] = self.model.unseen(new)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The best language of each text and its posterior."""
        if not self.model.languages:
            return [(UNDETERMINED, 0.0)] * len(texts)
        if len(self.index) > len(self.model.words) + CACHE_WORDS:
            self._reset()
        index, new, numbers, counts = self.index, [], [], []
        for text in texts:
            found = words(text) if text else []
            if found and not has_letter(text):
                found = []
            for w in found:
                k = index.get(w)
                if k is None:
                    k = index[w] = len(index)
                    new.append(w)
                numbers.append(k)
            counts.append(len(found))
        if new:
            self._learn(new)
        sizes = np.array(counts)
        some = np.flatnonzero(sizes)
        out = [(UNDETERMINED, 0.0)] * len(texts)
        if len(some):
            total = np.add.reduceat(self.matrix[numbers], (np.cumsum(sizes) - sizes)[some], dtype=np.float64)
            best = total.argmax(1)
            score = 1 / np.exp(total - total[np.arange(len(some)), best][:, None]).sum(1)
            for k, b, x in zip(some.tolist(), best.tolist(), score.tolist()):
                out[k] = (self.model.languages[b], x)
        return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Fits on (doc_id, text, lang). Which rows are sampled depends on doc_id's hash alone."""
    labelled = labelled.filter(F.col("lang").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    n = labelled.count()
    share = min(1.0, train_rows / max(1, n))
    sample = labelled if share == 1 else labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < math.ceil(1_000_000 * share))
    languages = sorted(r[0] for r in sample.select("lang").distinct().collect())
    number = {lang: k for k, lang in enumerate(languages)}

    def batch_of(found: dict[tuple[str, int], int]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([k for k, _ in found], pa.string()), pa.array([lang for _, lang in found], pa.int32()), pa.array(list(found.values()), pa.int64())], ["key", "lang", "n"])

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, texts in slices(batch, 0):
                found: dict[int, Counter[bytes]] = {}
                for text, lang in zip(texts, own.column(1).to_pylist()):
                    found.setdefault(number[lang], Counter()).update(words(text))
                yield batch_of({(w.decode("utf-8", "replace"), lang): n for lang, counts in found.items() for w, n in counts.items()})

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, int], int] = {}
            for w, lang, count in zip(*(c.to_pylist() for c in batch.columns)):
                for n in range(1, LONGEST_GRAM + 1):
                    for g in grams(w.encode("utf-8", "replace"), n):
                        found[g, lang] = found.get((g, lang), 0) + count
            yield batch_of(found)

    def summed(df: DataFrame) -> DataFrame:
        return df.groupBy("key", "lang").agg(F.sum("n").alias("n"))

    def repeated(df: DataFrame) -> list[tuple[str, list[int]]]:
        """Keys with their counts for each language: at most as many as the sample has."""
        rows = df.groupBy("key").agg(F.collect_list("lang").alias("langs"), F.collect_list("n").alias("counts"), F.sum("n").alias("total")).filter(F.col("total") >= MIN_COUNT).orderBy("key").toArrow()
        out = []
        for key, langs, counts in zip(*(rows.column(c).to_pylist() for c in ("key", "langs", "counts"))):
            of = [0] * len(languages)
            for lang, n in zip(langs, counts):
                of[lang] = n
            out.append((key, of))
        return out

    if not languages:
        return Model([], [], [])
    schema = "key string, lang int, n long"
    counted = materialize(summed(sample.select("text", "lang").mapInArrow(count_words, schema)), "words")
    return Model(languages, repeated(counted), repeated(summed(counted.mapInArrow(count_grams, schema))))


def predict(docs: DataFrame, model: Model, lang: str = "_tm_lang", score: str = "_tm_score") -> DataFrame:
    """All columns of docs and behind them the predicted language and its posterior with equal priors, by the names given."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain, names = with_plain_names(docs)
    columns = list(names.values())
    text = columns.index(names["text"])
    schema = ", ".join(f"{c} {t}" for c, t in plain.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for own, texts in slices(batch, text, SLICE_BYTES):
                got = scorer.predict(texts)
                yield pa.record_batch([*own.columns, pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], [*columns, "lang", "score"])

    return plain.mapInArrow(run, f"{schema}, lang string, score double").toDF(*docs.columns, lang, score)


def identify(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from the rows of docs that are not held out."""
    model = fit(docs.filter(~held_out(F.col("doc_id"))), train_rows)
    out = predict(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_tm_lang").alias("lang_pred"), F.col("_tm_score").alias("score"))
