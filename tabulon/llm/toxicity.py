"""Toxicity by subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is the average of the vectors of its character n-grams (three to five letters, with word marks) and of the whole word, all
hashed into one table; a bag of words is the average of its words; a linear softmax on the bag gives the two classes. A misspelling
that was never seen shares most n-grams with what was. Because everything after the table is linear, a word stands for one
number, and a text of any length is scored by running sums.

Training first takes whole texts as bags. A few toxic words in a long text would drown in such an average, so it then goes on with the
worst window of each text, of toxic and of clean ones; a text is scored by its worst window, over all its windows. The margin is
turned into a probability by logistic calibration on margins of texts that the calibrating model has not learnt from.

Defined results: a null text, or one without words, is an empty bag, scored by the intercept. Without labels of both classes the score is
their rate (0 if there are none). Repeated rows get equal scores; of conflicting labels the higher counts. Other columns are kept,
whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import itertools
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.labelled import calibrated, labelled_sample, logistic
from tabulon.llm.shared import ship, text_slices

BUCKET_BITS = 16
WIDTH = 8
GRAMS = (3, 4, 5)
WINDOW = 2  # words; chosen on rows that may be learnt from, see README.md
TRAIN_DOCUMENTS = 3000  # the most texts of each class that are learnt from
EPOCHS, WINDOW_ROUNDS, WINDOW_EPOCHS = 4, 4, 6
BATCH = 192
RATE = 0.02
SEED = 11
CACHE_WORDS = 400_000
WORDS_AT_ONCE = 20_000
WORD = re.compile(r"\w+")
_PRIME, _MIX = np.uint64(1_000_003), np.uint64(0x9E3779B97F4A7C15)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords, word after word, and how many each word has; some thousand words at a time."""
    parts = [_subwords(words[i:i + WORDS_AT_ONCE]) for i in range(0, len(words), WORDS_AT_ONCE)]
    none = np.zeros(0, np.int32)
    return np.concatenate([none, *(b for b, _ in parts)]), np.concatenate([none, *(n for _, n in parts)])


def _subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(w) + 2 for w in words])
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), lengths)
    starts = np.cumsum(lengths) - lengths
    powers = np.cumprod(np.full(64, _PRIME, np.uint64))
    place = np.arange(len(points)) - np.repeat(starts, lengths)
    hashes, owners = [np.add.reduceat(points * powers[place % 64], starts)], [np.arange(len(words))]
    for n in GRAMS:
        if len(points) < n:
            continue
        h = np.full(len(points) - n + 1, np.uint64(n))
        for k in range(n):
            h = h * _PRIME + points[k:len(points) - n + 1 + k]
        inside = word[:len(h)] == word[n - 1:]
        hashes.append(h[inside])
        owners.append(word[:len(h)][inside])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    buckets = ((np.concatenate(hashes) * _MIX) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
    return buckets[order], np.bincount(owner, minlength=len(words)).astype(np.int32)


def _spread(values: np.ndarray, index: np.ndarray, size: int) -> np.ndarray:
    """Sum of rows of values by index."""
    return np.stack([np.bincount(index, values[:, d], size) for d in range(values.shape[1])], axis=1)


class BagModel:
    """Subword table, softmax weights and intercepts; calibration of the margin."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.table = (rng.standard_normal((1 << BUCKET_BITS, WIDTH)) / WIDTH).astype(np.float32)
        self.weights = (rng.standard_normal((WIDTH, 2)) / WIDTH).astype(np.float32)
        self.intercept = np.zeros(2, np.float32)
        self.scale = (1.0, 0.0)
        self.rate: float | None = None  # a constant score, where nothing could be learnt

    def margins(self, words: list[str]) -> np.ndarray:
        """What each word adds to the margin of a bag, before averaging."""
        return self._margins(*subwords(words)) if words else np.zeros(0)

    def _margins(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        slope = self.table @ (self.weights[:, 1] - self.weights[:, 0])
        return np.add.reduceat(slope[buckets], np.cumsum(counts, dtype=np.int64) - counts) / counts

    def fit(self, texts: list[str], labels: np.ndarray, weights: np.ndarray | None = None) -> BagModel:
        weights = np.ones(len(labels)) if weights is None else weights
        if len(np.unique(labels)) < 2:
            self.rate = float(np.average(labels, weights=weights)) if len(labels) else 0.0
            return self
        # The margin of a text that was learnt from is too sure: each half is calibrated by a model of the other.
        fold, margin = np.zeros(len(labels), np.int64), np.full(len(labels), np.nan)
        for y in (0, 1):
            fold[labels == y] = np.arange(int((labels == y).sum())) % 2
        for k in (0, 1):
            if len(np.unique(labels[fold != k])) == 2:
                other = BagModel()._learn([texts[i] for i in np.flatnonzero(fold != k)], labels[fold != k])
                margin[fold == k] = Scorer(other).margins([texts[i] for i in np.flatnonzero(fold == k)])
        self._learn(texts, labels)
        if np.isnan(margin).any():
            margin = Scorer(self).margins(texts)
        self.scale = logistic(margin, labels, weights)
        return self

    def _learn(self, texts: list[str], labels: np.ndarray) -> BagModel:
        ids: dict[str, int] = {}
        bags = [np.array([ids.setdefault(w, len(ids)) for w in words_of(t)], np.int32) for t in texts]
        vocabulary = list(ids)
        buckets, counts = subwords(vocabulary)
        self._state = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.table, self.weights, self.intercept)]
        self._steps, rng = 0, np.random.default_rng(SEED)
        for _ in range(EPOCHS):
            self._epoch(bags, labels, buckets, counts, rng)
        for _ in range(WINDOW_ROUNDS):
            margin = self._margins(buckets, counts) if vocabulary else np.zeros(0)
            worst = [worst_window(margin[b])[1] for b in bags]
            for _ in range(WINDOW_EPOCHS):
                self._epoch([b[at:at + WINDOW] for b, at in zip(bags, worst)], labels, buckets, counts, rng)
        del self._state, self._steps
        return self

    def _epoch(self, bags: list[np.ndarray], labels: np.ndarray, buckets: np.ndarray, counts: np.ndarray, rng) -> None:
        starts = np.cumsum(counts, dtype=np.int64) - counts
        balance = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
        order = rng.permutation(len(bags))
        size = min(BATCH, max(16, len(order) // 16))  # few texts still give enough steps
        for at in range(0, len(order), size):
            pick = order[at:at + size]
            sizes = np.array([len(bags[i]) for i in pick])
            share = np.repeat(1 / np.maximum(sizes, 1), sizes)
            owner = np.repeat(np.arange(len(pick)), sizes)
            seen, place = np.unique(np.concatenate([bags[i] for i in pick]), return_inverse=True)
            n = counts[seen]
            inside = np.arange(int(n.sum())) + np.repeat(starts[seen] - (np.cumsum(n) - n), n)
            of_word = np.repeat(np.arange(len(seen)), n)
            bucket = buckets[inside]
            word = _spread(self.table[bucket], of_word, len(seen)) / np.maximum(n, 1)[:, None]
            bag = _spread(word[place] * share[:, None], owner, len(pick))
            scores = bag @ self.weights + self.intercept
            p = np.exp(scores - scores.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), labels[pick]] -= 1
            p *= (balance[pick] / len(pick))[:, None]
            d_word = _spread((p @ self.weights.T)[owner] * share[:, None], place, len(seen)) / np.maximum(n, 1)[:, None]
            d_table = _spread(d_word[of_word], bucket, len(self.table))
            self._steps += 1
            for value, (mean, square), g in zip((self.table, self.weights, self.intercept), self._state,
                                                (d_table, bag.T @ p, p.sum(axis=0))):
                g = g.astype(np.float32)
                mean += 0.1 * (g - mean)
                square += 0.001 * (g * g - square)
                value -= RATE * (mean / (1 - 0.9 ** self._steps)) / (np.sqrt(square / (1 - 0.999 ** self._steps)) + 1e-8)

    def offset(self) -> float:
        return float(self.intercept[1] - self.intercept[0])


def words_of(text: str) -> list[str]:
    """Words in lower case; a run of one word counts once, as one word alone would fill a window otherwise."""
    return [w for w, _ in itertools.groupby(WORD.findall(text.lower()))]


def worst_window(margin: np.ndarray) -> tuple[float, int]:
    """The highest average margin of a window, and where it starts; 0 without words."""
    if len(margin) <= WINDOW:
        return (float(margin.mean()) if len(margin) else 0.0), 0
    sums = np.cumsum(np.append(0.0, margin))
    averages = (sums[WINDOW:] - sums[:-WINDOW]) / WINDOW
    at = int(averages.argmax())
    return float(averages[at]), at


class Scorer:
    """Scores texts, remembering the margins of words up to a number of words."""

    def __init__(self, model: BagModel):
        self.model, self.known = model, {}

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self.model.rate is not None:
            return np.full(len(texts), self.model.rate)
        return calibrated(self.margins(texts), self.model.scale)

    def margins(self, texts: list[str]) -> np.ndarray:
        words = [words_of(t) for t in texts]
        flat = list(itertools.chain.from_iterable(words))
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        margin = np.fromiter(map(self.known.get, flat, itertools.repeat(np.nan)), np.float64, len(flat))
        missing = np.flatnonzero(np.isnan(margin)).tolist()
        if missing:
            new = list(dict.fromkeys(flat[i] for i in missing))
            self.known.update(zip(new, self.model.margins(new).tolist()))
            margin[missing] = [self.known[flat[i]] for i in missing]
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        worst = np.array([worst_window(margin[e - n:e])[0] for e, n in zip(ends.tolist(), sizes.tolist())], np.float64)
        return self.model.offset() + worst


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = TRAIN_DOCUMENTS) -> BagModel:
    """A model fitted on at most ``per_class`` labelled texts of each class, none of them held out."""
    sample = labelled_sample(docs, labels, label, per_class)
    return BagModel().fit(*sample)


@functools.lru_cache(2)
def _loaded(model: bytes) -> Scorer:
    return Scorer(pickle.loads(model))


def scorer(docs: DataFrame, model: BagModel):
    """A function of a text column that gives the score."""
    ship(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scores = _loaded(shipped.value)
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            yield pa.array(np.concatenate([*(scores(texts[a:b]) for a, b in text_slices(texts)), np.zeros(0)]))

    return score


def scored(docs: DataFrame, labels: DataFrame, text_col: str = "text", out: str = "toxicity", model: BagModel | None = None) -> DataFrame:
    """The table with the score of every text."""
    model = model or train(docs, labels)
    return docs.withColumn(out, scorer(docs, model)(F.col(f"`{text_col}`").cast("string")))
