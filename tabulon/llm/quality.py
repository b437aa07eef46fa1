"""Quality by compression: zstandard dictionaries of good and of bad text.

Two dictionaries are built from labelled texts. Every text is cut into pieces of a fixed length, so that a long text cannot serve
as its own dictionary, and each piece is compressed with both. The difference of the two sizes over their sum, for the whole text, is
turned into a probability by a logistic calibration on labelled texts that the dictionaries have not seen.

Defined results: a null or empty text has a difference of zero. Without labels of both classes the score is their rate (0 if
there are none). Repeated rows get equal scores; of conflicting labels the higher counts. Other columns are kept, whatever their names; an empty
table gives an empty table.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.labelled import calibrated, labelled_sample, logistic
from tabulon.llm.shared import ship, text_slices

PIECE = 256
DICTIONARY = 112_640
LEVEL = 3
SHORT = 500  # bytes added to the sum of sizes: a few words are weak evidence
TRAIN_DOCUMENTS = 3000  # the most texts of each class that are learnt from
SAMPLE_BYTES = 6_000_000  # the most bytes that a dictionary is built from


class CompressionModel:
    """Two dictionaries and the calibration of their difference."""

    def __init__(self):
        self.good, self.bad, self.scale = b"", b"", (1.0, 0.0)
        self.rate: float | None = None

    def fit(self, texts: list[str], labels: np.ndarray, weights: np.ndarray | None = None) -> CompressionModel:
        weights = np.ones(len(labels)) if weights is None else weights
        if len(np.unique(labels)) < 2:
            self.rate = float(np.average(labels, weights=weights)) if len(labels) else 0.0
            return self
        raw = [t.encode() for t in texts]
        # Texts come in the order of a hash: every other one of a class builds the dictionary, the rest calibrate.
        build, rest = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
        for y in (0, 1):
            own = np.flatnonzero(labels == y)
            build[own[::2]], rest[own[1::2] if len(own) > 1 else own] = True, True
        self.good, self.bad = (dictionary([raw[i] for i in np.flatnonzero(build & (labels == y))]) for y in (1, 0))
        self.scale = logistic(Differences(self)([raw[i] for i in np.flatnonzero(rest)]), labels[rest], weights[rest])
        return self


def dictionary(texts: list[bytes]) -> bytes:
    """A dictionary from pieces all over the texts; too little text is a dictionary as it is."""
    pieces = [t[i:i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    every = max(1, -(-sum(map(len, pieces)) // SAMPLE_BYTES))
    pieces = [p for p in pieces[::every] if len(p) >= 8]
    size = min(DICTIONARY, sum(map(len, pieces)) // 8)
    if len(pieces) >= 32 and size >= 4096:
        try:
            return zstandard.train_dictionary(size, pieces).as_bytes()
        except zstandard.ZstdError:  # the library's only answer to samples without anything in common
            pass
    return b"".join(pieces)[:DICTIONARY]


class Differences:
    """Normalised difference of compressed sizes: above zero for text that the good dictionary shortens more."""

    def __init__(self, model: CompressionModel):
        self.coders = []
        for data in (model.good, model.bad):
            shared = zstandard.ZstdCompressionDict(data)
            shared.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=False, write_dict_id=False))

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        for i, text in enumerate(texts):
            good, bad = (sum(len(c.compress(text[at:at + PIECE])) for at in range(0, len(text), PIECE)) for c in self.coders)
            if good + bad:
                out[i] = (bad - good) / (bad + good + SHORT)
        return out


class Scorer:
    def __init__(self, model: CompressionModel):
        self.model, self.differences = model, None if model.rate is not None else Differences(model)

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self.differences is None:
            return np.full(len(texts), self.model.rate)
        return calibrated(self.differences([t.encode() for t in texts]), self.model.scale)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = TRAIN_DOCUMENTS) -> CompressionModel:
    """A model fitted on at most ``per_class`` labelled texts of each class, none of them held out."""
    sample = labelled_sample(docs, labels, label, per_class)
    return CompressionModel().fit(*sample)


@functools.lru_cache(2)
def _loaded(model: bytes) -> Scorer:
    return Scorer(pickle.loads(model))


def scorer(docs: DataFrame, model: CompressionModel):
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


def scored(docs: DataFrame, labels: DataFrame, text_col: str = "text", out: str = "quality_score",
           model: CompressionModel | None = None) -> DataFrame:
    """The table with the score of every text."""
    model = model or train(docs, labels)
    return docs.withColumn(out, scorer(docs, model)(F.col(f"`{text_col}`").cast("string")))
