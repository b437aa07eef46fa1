"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read a stretch of bytes, one from each end; at every position their states give a softmax over the
languages. A document's probabilities are those of its positions, averaged in the logarithm over the whole text. Long texts are
read in stretches, each from a zero state, so a batch of documents is one matrix per step. Training is backpropagation through
time in numpy with Adam, on stretches of a bounded sample of labelled documents; the loss is that of every position.

Defined results: the language is ``und`` with score 0 if a text is null or has no letter, or if there was nothing to learn from.
Ties go to the language that is first in alphabetical order. Repeated rows get equal results. Other columns are kept, whatever
their names; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.shared import held_out, ship, text_slices

HIDDEN = 8
STRETCH = 32
TRAIN_DOCUMENTS = 2000  # the most labelled documents that are learnt from, per language
TRAIN_STRETCHES = 24_000
MOST_LANGUAGES = 200  # the most frequent ones are learnt
STEPS = 500
BATCH = 512
RATE = 0.02
SEED = 7
ROWS = 2048  # stretches at a time: their states stay in a core's cache


def stretches(texts: list[bytes], length: int = STRETCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes cut into rows of equal length: the bytes (0 past the end), bytes per row, and the text of each row."""
    sizes = np.array([len(t) for t in texts], np.int64)
    rows = -(-sizes // length)
    owner = np.repeat(np.arange(len(texts)), rows)
    out = np.zeros((len(owner), length), np.uint8)
    first = np.cumsum(rows) - rows
    data = np.frombuffer(b"".join(texts), np.uint8)
    place = np.arange(len(data)) + np.repeat(first * length - (np.cumsum(sizes) - sizes), sizes)
    out.ravel()[place] = data
    used = np.full(len(owner), length)
    last = (first + rows - 1)[rows > 0]
    used[last] = (sizes - (rows - 1) * length)[rows > 0]
    return out, used, owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Parameters: for each direction an input table (byte to three gates) and a recurrent matrix; an output layer."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden

        def start(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.weights = {
            "in0": start(256, 3 * hidden, scale=0.3), "in1": start(256, 3 * hidden, scale=0.3),
            "re0": start(hidden, 3 * hidden, scale=hidden ** -0.5), "re1": start(hidden, 3 * hidden, scale=hidden ** -0.5),
            "out": start(2 * hidden, len(languages), scale=0.3), "bias": np.zeros(len(languages), np.float32)}

    def _run(self, data: np.ndarray, way: int, keep: list | None) -> list[np.ndarray]:
        """States after each byte, in the order of the text; ``keep`` takes what the gradient needs."""
        h, table, recurrent = self.hidden, self.weights[f"in{way}"], self.weights[f"re{way}"]
        state, states = np.zeros((len(data), h), np.float32), [None] * data.shape[1]
        for t in range(data.shape[1])[::-1 if way else 1]:
            x, u = table[data[:, t]], state @ recurrent
            gates = _sigmoid(x[:, :2 * h] + u[:, :2 * h])
            reset, update = gates[:, :h], gates[:, h:]
            new = np.tanh(x[:, 2 * h:] + reset * u[:, 2 * h:])
            before, state = state, new + update * (state - new)
            if keep is not None:
                keep.append((t, before, u[:, 2 * h:], reset, update, new))
            states[t] = state
        return states

    def summed_log_odds(self, data: np.ndarray, used: np.ndarray) -> np.ndarray:
        """Log-probabilities of the languages, computed at every position and summed over those in use: (rows, languages).

        The same network as in ``_run``; arrays are kept transposed and reused, so that each step works on whole lines of memory.
        """
        n, steps, h, w = len(data), data.shape[1], self.hidden, self.weights
        columns = np.ascontiguousarray(data.T).astype(np.intp)
        gates, inner = np.empty((3 * h, n), np.float32), np.empty((3 * h, n), np.float32)
        ahead, total = np.empty((steps, len(self.languages), n), np.float32), np.zeros((len(self.languages), n), np.float32)
        for way in (0, 1):
            table, recurrent = np.ascontiguousarray(w[f"in{way}"].T), np.ascontiguousarray(w[f"re{way}"].T)
            out = np.ascontiguousarray(w["out"][way * h:(way + 1) * h].T)
            both, new, state = gates[:2 * h], inner[2 * h:], np.zeros((h, n), np.float32)
            for t in range(steps)[::-1 if way else 1]:
                np.take(table, columns[t], axis=1, out=gates, mode="clip")
                np.matmul(recurrent, state, out=inner)
                both += inner[:2 * h]
                np.negative(both, out=both)
                np.exp(both, out=both)
                both += 1
                np.reciprocal(both, out=both)
                new *= gates[:h]
                new += gates[2 * h:]
                np.tanh(new, out=new)
                state -= new
                state *= gates[h:2 * h]
                state += new
                if not way:
                    np.matmul(out, state, out=ahead[t])
                else:
                    scores = out @ state
                    scores += ahead[t]
                    scores += w["bias"][:, None]
                    scores -= scores.max(axis=0)
                    scores -= np.log(np.exp(scores).sum(axis=0))
                    scores *= t < used
                    total += scores
        return total.T

    def labels(self, text: bytes) -> np.ndarray:
        """The likeliest language at every byte of a text, as a number."""
        data, _, _ = stretches([text])
        states = np.concatenate([np.stack(self._run(data, way, None), axis=1) for way in (0, 1)], axis=2)
        return (states @ self.weights["out"] + self.weights["bias"]).argmax(axis=2).ravel()[:len(text)]

    def gradient(self, data: np.ndarray, used: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over all positions in use."""
        w, h = self.weights, self.hidden
        kept: tuple[list, list] = ([], [])
        ways = [self._run(data, way, kept[way]) for way in (0, 1)]
        states = np.stack([np.concatenate([a, b], axis=1) for a, b in zip(*ways)], axis=1)
        scores = states @ w["out"] + w["bias"]
        p = np.exp(scores - scores.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        p[np.arange(len(data)), :, target] -= 1
        p *= (np.arange(data.shape[1]) < used[:, None])[:, :, None] / used.sum()
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        grad["out"], grad["bias"] = np.tensordot(states, p, ((0, 1), (0, 1))), p.sum(axis=(0, 1))
        from_out = p @ w["out"].T
        for way in (0, 1):
            back = np.zeros((len(data), h), np.float32)
            for t, before, candidate, reset, update, new in reversed(kept[way]):
                back = back + from_out[:, t, way * h:(way + 1) * h]
                d_new = back * (1 - update) * (1 - new * new)
                d_update = back * (before - new) * update * (1 - update)
                d_reset = d_new * candidate * reset * (1 - reset)
                d_in = np.concatenate([d_reset, d_update, d_new], axis=1)
                d_re = np.concatenate([d_reset, d_update, d_new * reset], axis=1)
                order = np.argsort(data[:, t], kind="stable")
                opens = np.flatnonzero(np.diff(data[order, t].astype(np.int64), prepend=-1))
                grad[f"in{way}"][data[order, t][opens]] += np.add.reduceat(d_in[order], opens, axis=0)
                grad[f"re{way}"] += before.T @ d_re
                back = back * update + d_re @ w[f"re{way}"].T
        return grad

    def fit(self, data: np.ndarray, used: np.ndarray, target: np.ndarray, steps: int = STEPS) -> Network:
        rng = np.random.default_rng(SEED)
        mean = {k: np.zeros_like(v) for k, v in self.weights.items()}
        square = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(data), BATCH)
            rate = RATE * (1 - 0.9 * step / steps)
            for k, g in self.gradient(data[pick], used[pick], target[pick]).items():
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.01 * (g * g - square[k])
                self.weights[k] -= (rate * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
        return self

    def predict(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities of the languages for each text."""
        total = np.zeros((len(texts), len(self.languages)))
        count = np.array([max(1, len(t)) for t in texts])
        data, used, owner = stretches(texts)
        order = np.argsort(used, kind="stable")  # rows of one length together: little is read past an end
        for at in range(0, len(data), ROWS):
            rows = order[at:at + ROWS]
            longest = int(used[rows].max())
            np.add.at(total, owner[rows], self.summed_log_odds(data[rows, :longest], used[rows]))
        # Pooled as one opinion per text: the average of the log-probabilities, sharpened up to a bounded number of positions.
        pooled = total / count[:, None] * np.minimum(count, 2 * STRETCH)[:, None] / 8
        pooled -= pooled.max(axis=1, keepdims=True)
        p = np.exp(pooled)
        return p / p.sum(axis=1, keepdims=True)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_language: int = TRAIN_DOCUMENTS, most_languages: int = MOST_LANGUAGES) -> Network:
    """A network fitted on at most ``per_language`` different documents of each of the most frequent languages, none of them held out.

    Documents are chosen, and put in order, by a hash of id and text, so the sample is the same however files are cut and rows repeat, and
    rows of one id, or without ids, are chosen by their texts. The sample is bounded by the two parameters; of each of its texts at most
    TRAIN_STRETCHES / TRAIN_DOCUMENTS stretches (12 of 32 bytes) are learnt, spread evenly over the whole text.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))
    known = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id"))).select(
        "lang", "text", F.xxhash64(F.col("id").cast("string"), "text", F.lit("fit")).alias("order"))
    # Languages are bounded; their different documents are counted roughly, to thin them to a few times the sample before the exact cut.
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("order").alias("different"))
    shares = {r.lang: int(min(1.0, 2 * per_language / r.different) * (1 << 30))
              for r in counts.orderBy(F.desc("n"), "lang").limit(most_languages).collect()}
    if not shares:
        return Network([])
    share = F.create_map(*[F.lit(x) for pair in sorted(shares.items()) for x in pair])[F.col("lang")]
    thinned = known.where(F.pmod("order", F.lit(1 << 30)) < share).groupBy("lang", "order").agg(F.min("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("order"))
    sampled = thinned.withColumn("place", place).where(F.col("place") <= per_language).select(
        "lang", "order", _sampled_stretches(docs)("text").alias("parts"))
    rows = sorted(sampled.collect(), key=lambda r: (r.lang, r.order))
    languages = sorted({r.lang for r in rows})
    data, used, target = [], [], []
    for row in rows:
        part = np.frombuffer(row.parts, np.uint8).reshape(-1, STRETCH + 1)
        data.append(part[:, 1:])
        used.append(part[:, 0])
        target.append(np.full(len(part), languages.index(row.lang)))
    if not sum(map(len, data)):
        return Network([])
    return Network(languages).fit(np.concatenate(data), np.concatenate(used).astype(np.int64), np.concatenate(target))


def _sampled_stretches(docs: DataFrame, each: int = max(1, TRAIN_STRETCHES // TRAIN_DOCUMENTS)):
    """A function that draws stretches all over a text: rows of a length byte and the bytes."""
    ship(docs.sparkSession)

    @F.arrow_udf("binary")
    def draw(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for text in batch.to_pylist():
                data, used, _ = stretches([text.encode()])
                pick = np.unique(np.linspace(0, len(data) - 1, each).astype(np.int64)) if len(data) else np.zeros(0, np.int64)
                out.append(np.concatenate([used[pick, None].astype(np.uint8), data[pick]], axis=1).tobytes())
            yield pa.array(out, pa.binary())

    return draw


@functools.lru_cache(2)
def _loaded(model: bytes) -> Network:
    return pickle.loads(model)


def predictor(docs: DataFrame, network: Network):
    """A function of a text column that gives a struct of ``lang`` and ``score``."""
    ship(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(pickle.dumps(network))

    @F.arrow_udf("struct<lang: string, score: double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _loaded(shipped.value)
        for batch in batches:
            texts, lang, score = batch.to_pylist(), [], []
            sized = [t or "" for t in texts]
            for start, end in text_slices(sized):
                part = sized[start:end]
                p = model.predict([t.encode() for t in part]) if model.languages else np.zeros((len(part), 1))
                best = p.argmax(axis=1)
                for i, text in enumerate(part):
                    sure = bool(model.languages) and any(map(str.isalpha, text))
                    lang.append(model.languages[best[i]] if sure else "und")
                    score.append(float(p[i, best[i]]) if sure else 0.0)
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang", "score"])

    return predict


def labelled_positions(docs: DataFrame, network: Network, text_col: str = "text", out: str = "positions") -> DataFrame:
    """The table with the language of every position: runs (start, end, lang) over the text's bytes; none where nothing was learnt."""
    ship(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(pickle.dumps(network))
    schema = "array<struct<start: long, end: long, lang: string>>"

    @F.arrow_udf(schema)
    def runs(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _loaded(shipped.value)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
        for batch in batches:
            found = []
            for text in batch.to_pylist():
                label = model.labels(text.encode()) if text and model.languages else np.zeros(0, np.int64)
                first = np.flatnonzero(np.diff(label, prepend=-1))
                found.append([{"start": s, "end": e, "lang": model.languages[label[s]]}
                              for s, e in zip(first.tolist(), [*first[1:].tolist(), len(label)])])
            yield pa.array(found, kind)

    return docs.withColumn(out, runs(F.col(f"`{text_col}`").cast("string")))


def identified(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", out: str = "language",
               network: Network | None = None) -> DataFrame:
    """The table with a struct column (lang, score); trains on the table itself unless a network is given."""
    network = network or train(docs, text_col=text_col, lang_col=lang_col)
    text: Column = F.col(f"`{text_col}`").cast("string")
    return docs.withColumn(out, predictor(docs, network)(text))
