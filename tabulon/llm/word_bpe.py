"""BPE with word ends: encoding by forced boundaries, and decoding.

Two neighbouring bytes that stand side by side inside no token of the vocabulary can never end up in one token, so a cut between
them is certain before any merge is tried. (A word's last byte counts as a byte of its own kind, since its tokens carry the word-end
mark; a word boundary is thus the plainest forced cut.) Texts are normalised and their words found with arrays of code
point classes, the forced cuts come from one look-up per pair of bytes, and the fragments between cuts are merged
independently: lowest rank first, leftmost of equals. Their ids are remembered by fragment and concatenated.

What cannot be proved to follow the arrays' rules goes through the library as a whole: tokenizer files with other settings, texts
that hold an added token (it has its own id wherever it stands), and texts with code points that Python's Unicode tables do not know.

Defined results: a null or empty text has no ids and decodes to the empty text. Texts of any length are read in windows cut
after white space. Repeated rows are encoded alike, an empty table gives an empty table. Other columns are kept, whatever their names.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tabulon.llm.byte_bpe import NUMBER, SPACE, code_point_classes
from tabulon.llm.shared import BATCH_CHARS, text_slices
from tabulon.llm.tokens import WholeTexts, _byte_alphabet, read_tokenizer

REMEMBERED = 300_000  # fragments kept per worker
LONG_FRAGMENT = 48  # symbols from which on a fragment is merged by a heap

# The settings of the tokenizer file that the arrays follow.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")


def normalised(text: str) -> str:
    """NFC and lower case, letter by letter (no final sigma); white space separates words whatever its kind, so it stays."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


@functools.cache
def _unassigned() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(i)) == "Cn" for i in range(0x110000)), bool, 0x110000)


def _unknown_to_python(text: str) -> bool:
    return not text.isascii() and bool(_unassigned()[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any())


def word_starts(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each code point whether it starts a word, and whether it belongs to one; the last one must be white space."""
    classes = code_point_classes()[points]
    inside = classes < SPACE
    starts = inside & ((classes != np.concatenate([[SPACE], classes[:-1]])) | (classes == NUMBER))
    for i in np.flatnonzero((points == 39) & starts).tolist():  # an apostrophe within a run of signs is one of them
        after = "".join(map(chr, points[i + 1:i + 3]))
        size = 2 if after[:1] and after[0] in ONE_LETTER else 3 if after in TWO_LETTERS else 0
        if size:
            starts[i + 1] = False
            starts[i + size] = inside[i + size]
    return starts, inside


class ForcedBoundaries:
    """The cuts that a vocabulary forces, and the merges between them."""

    def __init__(self, model: dict):
        alphabet, suffix = _byte_alphabet(), model["end_of_word_suffix"]
        byte, vocabulary = {c: b for b, c in enumerate(alphabet)}, model["vocab"]
        self.single = np.array([vocabulary[c] for c in alphabet] + [vocabulary[c + suffix] for c in alphabet])
        self.apart = np.ones((256, 512), bool)  # [byte, byte, plus 256 if it ends the word]
        for token in vocabulary:
            # A token that reads like a mark may be the sign itself, so both readings keep their pairs together.
            for ends_word in {token.endswith(suffix), False}:
                symbols = [byte.get(c, -1) for c in (token[:-len(suffix)] if ends_word else token)]
                if symbols and min(symbols) >= 0:
                    symbols[-1] += 256 * ends_word
                    self.apart[symbols[:-1], symbols[1:]] = False
        merges = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
        self.rank = {(vocabulary[a], vocabulary[b]): i for i, (a, b) in enumerate(merges)}
        self.merged = [vocabulary[a + b] for a, b in merges]

    def fragments(self, text: str) -> tuple[list[bytes], np.ndarray]:
        """The fragments of normalised text that ends in white space, and the code point at which each one starts.

        A fragment that does not end its word is written after a space, which no fragment holds.
        """
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts, inside = word_starts(points)
        data = text.encode()
        symbols = np.frombuffer(data, np.uint8).astype(np.int64)
        if len(data) == len(points):
            place = np.arange(len(points))
            inner = inside
        else:
            width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
            place = np.cumsum(width) - width
            inner = np.repeat(inside, width)
        first = np.zeros(len(data), bool)
        first[place[starts]] = True
        last = inner & np.append(first[1:] | ~inner[1:], True)
        symbols[last] += 256
        cut = first.copy()
        cut[1:] |= inner[1:] & inner[:-1] & ~last[:-1] & self.apart[symbols[:-1] & 255, symbols[1:]]
        begin = np.flatnonzero(cut)
        end = np.flatnonzero(inner & np.append(cut[1:] | ~inner[1:], True)) + 1
        found = [data[a:b] for a, b in zip(begin.tolist(), end.tolist())]
        for i in np.flatnonzero(~last[end - 1]).tolist():
            found[i] = b" " + found[i]
        return found, np.searchsorted(place, begin, side="right") - 1

    def merge(self, fragment: bytes) -> list[int]:
        """The ids of one fragment."""
        inner = fragment.startswith(b" ")
        body = np.frombuffer(fragment, np.uint8)[int(inner):].astype(np.int64)
        if not inner:
            body[-1] += 256
        ids = self.single[body].tolist()
        if len(ids) >= LONG_FRAGMENT:
            return self._merge_long(ids)
        rank, never = self.rank.get, len(self.merged)
        ranks = [rank(pair, never) for pair in itertools.pairwise(ids)]
        while ranks and (best := min(ranks)) < never:
            at = ranks.index(best)
            ids[at:at + 2] = [self.merged[best]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank((ids[at - 1], ids[at]), never)
            if at < len(ranks):
                ranks[at] = rank((ids[at], ids[at + 1]), never)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        size = len(ids)
        after, before, heap = list(range(1, size + 1)), list(range(-1, size - 1)), []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < size:
                pair = ids[i], ids[after[i]]
                if pair in self.rank:
                    heapq.heappush(heap, (self.rank[pair], i, pair))

        for i in range(size):
            offer(i)
        while heap:
            rank, i, (left, right) = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= size or ids[j] != right:
                continue  # one of the two has been merged since
            ids[i], ids[j], after[i] = self.merged[rank], -1, after[j]
            if after[j] < size:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [i for i in ids if i >= 0]


class FragmentCoder:
    """Ids of texts by fragments, which are remembered up to a number of them."""

    def __init__(self, tokenizer: Tokenizer, model: dict, added: list[str], limit: int = REMEMBERED):
        self.boundaries, self.added, self.limit, self.whole = ForcedBoundaries(model), added, limit, WholeTexts(tokenizer)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.ids, self.start = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _places(self, fragments: list[bytes]) -> np.ndarray:
        if len(self.index) > self.limit:
            self._forget()
        place = np.fromiter(map(self.index.get, fragments, itertools.repeat(-1)), np.int64, len(fragments))
        unknown = np.flatnonzero(place < 0).tolist()
        if unknown:
            new = list(dict.fromkeys(fragments[i] for i in unknown))
            coded = [self.boundaries.merge(f) for f in new]
            sizes = np.fromiter(map(len, coded), np.int64, len(coded))
            base = len(self.start) - 1
            self.index.update(zip(new, range(base, base + len(new))))
            self.start = np.append(self.start, self.start[-1] + np.cumsum(sizes))
            self.ids = np.append(self.ids, np.fromiter(itertools.chain.from_iterable(coded), np.uint32, int(sizes.sum())))
            place[unknown] = [self.index[fragments[i]] for i in unknown]
        return place

    def _window(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, the ids per fragment and the code point at which each fragment starts."""
        fragments, starts = self.boundaries.fragments(text)
        place = self._places(fragments)
        size = self.start[place + 1] - self.start[place]
        gather = np.arange(int(size.sum())) + np.repeat(self.start[place] - (np.cumsum(size) - size), size)
        return self.ids[gather], size, starts

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        normal = [normalised(t) for t in texts]
        joined = "\n".join(normal) + "\n"
        ends = np.cumsum([len(t) + 1 for t in normal])
        ids, sizes, owners = [], [], []
        for at, window in windows(joined):
            found, size, starts = self._window(window)
            ids.append(found)
            sizes.append(size)
            owners.append(np.searchsorted(ends, starts + at, side="right"))
        per_text = np.bincount(np.concatenate(owners), np.concatenate(sizes), minlength=len(texts)).astype(np.int64)
        return np.concatenate(ids), per_text

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the ids per text."""
        odd = {i for i, t in enumerate(texts) if any(mark in t for mark in self.added) or _unknown_to_python(t)}
        if not odd:
            return self._plain(texts)
        parts: list = [None] * len(texts)
        for rows, encode in ((sorted(odd), self.whole.encode), ([i for i in range(len(texts)) if i not in odd], self._plain)):
            if rows:
                ids, sizes = encode([texts[i] for i in rows])
                for i, part in zip(rows, np.split(ids, np.cumsum(sizes)[:-1])):
                    parts[i] = part
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


def windows(text: str) -> Iterator[tuple[int, str]]:
    """Consecutive parts of a text that ends in white space, each cut after white space, with their places."""
    blank = code_point_classes()
    at = 0
    while at < len(text):
        end = min(len(text), at + BATCH_CHARS)
        while end < len(text) and blank[ord(text[end - 1])] < SPACE:
            end += 1
        yield at, text[at:end]
        at = end


class WordDecoder:
    """What the library's ``decode`` gives with special tokens kept: without a decoder, the tokens with spaces between them."""

    def __init__(self, tokenizer: Tokenizer, plain: bool):
        self.tokenizer, self.plain = tokenizer, plain
        self.tokens = [tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size())] if plain else []

    def __call__(self, ids: np.ndarray) -> str:
        if not self.plain:
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


@functools.lru_cache(2)
def word_coder(tokenizer_json: str) -> FragmentCoder | WholeTexts:
    settings, tokenizer = json.loads(tokenizer_json), _library(tokenizer_json)
    model, split = settings["model"], (settings.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    plain = (
        model.get("type") == "BPE" and bool(model.get("end_of_word_suffix")) and not model.get("dropout")
        and not model.get("ignore_merges") and not model.get("continuing_subword_prefix")
        and (settings.get("normalizer") or {}).get("normalizers") == NORMALIZERS
        and [p.get("type") for p in split] == ["Split", "ByteLevel"] and split[0]["pattern"] == {"Regex": WORD_PATTERN}
        and split[0]["behavior"] == "Removed" and split[0]["invert"] and not split[1]["add_prefix_space"] and not split[1]["use_regex"])
    added = settings.get("added_tokens") or []
    if not plain or any(t["normalized"] for t in added):
        return WholeTexts(tokenizer)
    return FragmentCoder(tokenizer, model, [t["content"] for t in added])


@functools.lru_cache(2)
def word_decoder(tokenizer_json: str) -> WordDecoder:
    return WordDecoder(_library(tokenizer_json), not json.loads(tokenizer_json).get("decoder"))


@functools.lru_cache(2)
def _library(tokenizer_json: str) -> Tokenizer:
    tokenizer = Tokenizer.from_str(tokenizer_json)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def encoder(spark: SparkSession, tokenizer_file: str) -> Callable[[Column], Column]:
    """A function of a text column that gives its ids as unsigned little-endian 32-bit integers."""
    shipped = read_tokenizer(spark, tokenizer_file)

    @F.arrow_udf(T.BinaryType())
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = word_coder(shipped.value)
        for batch in batches:
            texts, out = [t or "" for t in batch.to_pylist()], []
            for start, end in text_slices(texts):
                ids, sizes = coder.encode(texts[start:end])
                raw, ends = ids.astype("<u4").tobytes(), np.cumsum(sizes) * 4
                out += [raw[a:b] for a, b in zip((ends - sizes * 4).tolist(), ends.tolist())]
            yield pa.array(out, pa.binary())

    return encode


def decoder(spark: SparkSession, tokenizer_file: str) -> Callable[[Column], Column]:
    """A function of a column of ids, as ``encoder`` writes them, that gives the text the library decodes them to."""
    shipped = read_tokenizer(spark, tokenizer_file)

    @F.arrow_udf(T.StringType())
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decode_one = word_decoder(shipped.value)
        for batch in batches:
            yield pa.array([None if x is None else decode_one(np.frombuffer(x, "<u4")) for x in batch.to_pylist()], pa.string())

    return decode


def encode_documents(docs: DataFrame, tokenizer_file: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """The table with a column of ids; rows and other columns stay as they are."""
    return docs.withColumn(out, encoder(docs.sparkSession, tokenizer_file)(F.col(f"`{text_col}`")))
