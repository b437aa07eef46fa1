"""Ids of the tokenizers library for whole documents, shared by packing and token files.

Text is split by the vectorised pre-tokeniser of ``byte_bpe``; each new slice is encoded by the model of the given tokenizer
file, and remembered. A file whose settings differ from a plain byte-level BPE is run by the library as a whole, and so is a text
that holds one of the file's added tokens: the library gives such a token its own id wherever it stands.
"""

from __future__ import annotations

import codecs
import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from tokenizers import Tokenizer

from tabulon.llm.byte_bpe import SliceCache
from tabulon.llm.shared import ship, small_batches

# Slices kept per worker: nothing else of size lives beside this encoder, so more fit than beside a decoder.
REMEMBERED = 1_000_000


def _byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class WholeTexts:
    """Encodes through the library's own pipeline."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter((i for x in ids for i in x), np.uint32), np.array([len(x) for x in ids], np.int64)


class Slices:
    """Encodes slices by the library's model and remembers them."""

    def __init__(self, tokenizer: Tokenizer, added: list[str]):
        self.added, self.whole = added, WholeTexts(tokenizer)
        model, alphabet = tokenizer.model, "".join(_byte_alphabet())
        self.cache = SliceCache(lambda words: [
            [t.id for t in model.tokenize(codecs.charmap_decode(w, "strict", alphabet)[0])] for w in words], limit=REMEMBERED)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        marked = [i for i, t in enumerate(texts) if any(mark in t for mark in self.added)]
        if not marked:
            return self.cache.encode(texts)[:2]
        own = set(marked)
        plain = [i for i in range(len(texts)) if i not in own]
        coded: list = [None] * len(texts)
        sizes = np.zeros(len(texts), np.int64)
        for encode, rows in ((self.whole.encode, marked), (lambda part: self.cache.encode(part)[:2], plain)):
            if rows:
                ids, sizes[rows] = encode([texts[i] for i in rows])
                for i, part in zip(rows, np.split(ids, np.cumsum(sizes[rows])[:-1])):
                    coded[i] = part
        return np.concatenate(coded), sizes


@functools.lru_cache(2)
def coder(tokenizer_json: str) -> Slices | WholeTexts:
    tokenizer = Tokenizer.from_str(tokenizer_json)
    settings = json.loads(tokenizer_json)
    split = settings.get("pre_tokenizer") or {}
    plain = (settings["model"].get("type") == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True)
             and not split.get("add_prefix_space") and not settings.get("normalizer"))
    added = [t["content"] for t in settings.get("added_tokens") or []]
    return Slices(tokenizer, added) if plain else WholeTexts(tokenizer)


def read_tokenizer(spark: SparkSession, path: str):
    """The tokenizer file, read by the driver and broadcast; its size is that of a vocabulary."""
    ship(spark)
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def encoded(batches: Iterator[pa.RecordBatch], tokenizer_json: str, end_id: int | None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Arrow batches with a text column, each with all its ids in a row and the ids per row, end mark included."""
    encode = coder(tokenizer_json).encode
    for batch, texts in small_batches(batches):
        ids, sizes = encode(texts)
        if end_id is not None:
            ids = np.insert(ids, np.cumsum(sizes), np.uint32(end_id))
            sizes = sizes + 1
        yield batch, ids.astype("<u4"), sizes
