"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Text is split without regular expressions. Each code point has a class (letter, number, space, other white space, the
rest); with a look at the next two characters a class becomes a symbol, and a symbol stands for a function from the state
before a character to the state after it. These functions are closed under composition (a small table of
products is built once), so the state at every position is an associative scan over the symbols, done for whole
batches in blocks. A character starts a slice if its symbol does so in the state before it. The slices are looked up in a
cache, whole batches at a time: a slice of at most 15 bytes is two integers, its bytes and its length, and stands in a hash table
of arrays. Those not seen yet are merged together, one merge of every slice per step, as rank files prescribe: the lowest
rank first, the leftmost of equals.

Defined results: a null or empty text has no ids. Texts of any length are read in windows. Repeated rows are encoded alike.
Letters and numbers are those of Python's Unicode tables. Other columns are kept, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import heapq
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.shared import BATCH_CHARS, ship, text_slices

LETTER, NUMBER, REST, SPACE, BLANK = range(5)
# Symbols: letter, number, rest, apostrophe of a one- and of a two-letter contraction, last space and last
# other white space before a visible character, white space before white space or the end, the gap between texts.
LET, NUM, OTH, ONE, TWO, SP, WS, MID, GAP = range(9)
# States: what the open slice is. CLOSED: none; LEFT1, LEFT2: a contraction that lacks one or two letters.
CLOSED, LETTERS, NUMBERS, OTHERS, SPACED, BLANKS, LEFT1, LEFT2 = range(8)

# The code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

LONG_SLICE = 64
NO_RANK = 1 << 40
CACHE_SLICES = 400_000
BLOCK = 64
# Longest slice that two integers of eight bytes hold beside its length.
SHORT_SLICE = 15
# What is left of eight bytes by the number of those that count.
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


@functools.cache
def code_point_classes() -> np.ndarray:
    """The class of each code point."""
    kinds = {c: {"L": LETTER, "N": NUMBER}.get(c[0], REST) for c in set(map(unicodedata.category, map(chr, range(0x110000))))}
    table = np.fromiter(map(kinds.__getitem__, map(unicodedata.category, map(chr, range(0x110000)))), np.uint8, 0x110000)
    table[WHITE_SPACE] = BLANK
    table[0x20] = SPACE
    return table


def _step(symbol: int, state: int) -> tuple[int, bool]:
    """The state after a character, and whether it starts a slice."""
    if symbol == LET:
        if state in (LEFT1, LEFT2):
            return (CLOSED if state == LEFT1 else LEFT1), False
        return LETTERS, state not in (LETTERS, SPACED)
    if symbol == NUM:
        return NUMBERS, state not in (NUMBERS, SPACED)
    if symbol in (OTH, ONE, TWO):
        if state in (OTHERS, SPACED) or symbol == OTH:
            return OTHERS, state not in (OTHERS, SPACED)
        return (LEFT1 if symbol == ONE else LEFT2), True
    if symbol == MID:
        return BLANKS, state != BLANKS
    return {SP: SPACED, WS: CLOSED, GAP: CLOSED}[symbol], True


@functools.cache
def transition_monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All compositions of the symbols' functions, numbered; the symbols come first, the identity last.

    Returns the table of products (first, then), the state after each function by starting state, and which (symbol, state)
    starts a slice.
    """
    symbols, states = range(9), range(8)
    functions = {tuple(_step(x, s)[0] for s in states): None for x in symbols}
    numbered = [tuple(_step(x, s)[0] for s in states) for x in symbols]
    found = list(functions)
    for f in found:  # grows while new products turn up
        for g in numbered:
            if (h := tuple(g[s] for s in f)) not in functions:
                functions[h] = None
                found.append(h)
    everything = [*numbered, *(f for f in found if f not in numbered), tuple(states)]
    index = {f: i for i, f in reversed(list(enumerate(everything)))}
    products = np.array([[index[tuple(g[s] for s in f)] for g in everything] for f in everything], np.uint8)
    starts = np.array([[_step(x, s)[1] for s in states] for x in symbols])
    return products, np.array(everything, np.uint8), starts


def scanned(functions: np.ndarray) -> np.ndarray:
    """For each place the composition of all functions before it: an exclusive scan in blocks, and of the blocks in turn."""
    products, table, _ = transition_monoid()
    width, identity = len(table), len(table) - 1
    flat = products.ravel()
    if len(functions) <= BLOCK:
        out, now = np.empty(len(functions), np.uint8), identity
        for i, f in enumerate(functions.tolist()):
            out[i] = now
            now = int(flat[now * width + f])
        return out
    rows = -(-len(functions) // BLOCK)
    padded = np.full(rows * BLOCK, identity, np.uint8)
    padded[:len(functions)] = functions
    columns = np.ascontiguousarray(padded.reshape(rows, BLOCK).T)
    inside, whole = np.empty((BLOCK, rows), np.uint8), np.full(rows, identity, np.uint8)
    for i, column in enumerate(columns):
        inside[i] = whole
        whole = flat[whole.astype(np.intp) * width + column]
    before = scanned(whole).astype(np.intp) * width  # what comes before a block, then what comes before in it
    return flat.take((before + inside).T.ravel()[:len(functions)])


def _symbols(points: np.ndarray, classes: np.ndarray, n: int) -> np.ndarray:
    """Symbols of the first n code points; points and classes reach two further, with GAP's class past the end."""
    blank = (classes == SPACE) | (classes == BLANK) | (classes == GAP)
    symbol = np.array([LET, NUM, OTH, SP, WS, MID, MID, MID, GAP], np.uint8).take(classes[:n])
    symbol[blank[:n] & blank[1:n + 1] & (classes[:n] != GAP)] = MID
    for i in np.flatnonzero(points[:n] == 39).tolist():
        after = "".join(map(chr, points[i + 1:i + 3]))
        if after[:1] in ("s", "t", "m", "d"):
            symbol[i] = ONE
        elif after in ("re", "ve", "ll"):
            symbol[i] = TWO
    return symbol


def slices(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Split texts. Returns their joined bytes, the start and end of each slice in them, and the slices per text."""
    joined = "\n".join(texts) + "\n"
    gaps = np.cumsum([len(t) + 1 for t in texts]) - 1
    _, table, starts = transition_monoid()
    state, found, data, shift = CLOSED, [], [], 0
    classes_of, starts = code_point_classes(), starts.ravel()
    for at in range(0, len(joined), BATCH_CHARS):
        window = joined[at:at + BATCH_CHARS + 2]
        points = np.frombuffer((window + "\n\n").encode("utf-32-le"), np.uint32)
        n = min(BATCH_CHARS, len(joined) - at)
        classes = classes_of.take(points)
        here = gaps[(gaps >= at) & (gaps < at + len(window))] - at
        classes[here] = GAP
        classes[len(window):] = GAP
        symbol = _symbols(points, classes, n)
        before = table[:, state].take(scanned(symbol))
        first = np.flatnonzero(starts.take(symbol * np.uint8(table.shape[1]) + before))
        state = int(table[symbol[-1], before[-1]])
        raw = window[:n].encode()
        place = first if len(raw) == n else np.flatnonzero(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80).take(first)
        found.append((place + shift, symbol.take(first) == GAP))
        data.append(raw)
        shift += len(raw)
    place = np.concatenate([p for p, _ in found])
    gap = np.concatenate([g for _, g in found])
    ends = np.append(place[1:], shift)
    per_text = np.diff(np.flatnonzero(gap), prepend=-1) - 1
    return b"".join(data), place[~gap], ends[~gap], per_text


class RankMerger:
    """Merges slices by the ranks of a vocabulary, many at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)])
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[(left << 24) | right] = rank
        self.pairs = pairs
        # A hash table in two arrays, at most a quarter full; a key lies at its hash or at one of the next places.
        self.bits = max(4, len(pairs).bit_length() + 2)
        self.keys, self.merged = np.full(1 << self.bits, -1), np.full(1 << self.bits, NO_RANK)
        waiting = np.fromiter(pairs, np.int64, len(pairs))
        at = self._hash(waiting)
        while len(waiting):
            free = self.keys[at] < 0
            self.keys[at[free]] = waiting[free]
            waiting, at = waiting[self.keys[at] != waiting], at[self.keys[at] != waiting]
            at = (at + 1) & ((1 << self.bits) - 1)
        filled = np.flatnonzero(self.keys >= 0)
        self.merged[filled] = [pairs[k] for k in self.keys[filled].tolist()]

    def _hash(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 24) | right
        at = self._hash(key)
        found = self.keys[at]
        out = np.where(found == key, self.merged[at], NO_RANK)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.merged[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def long(self, word: bytes) -> list[int]:
        """One slice, by a heap of its pairs: for slices too long to redo all pairs at each merge."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(ids):
                rank = self.pairs.get((ids[i] << 24) | ids[after[i]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, ids[i], ids[after[i]]))

        for i in range(len(ids)):
            offer(i)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= len(ids) or ids[j] != right:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            offer(i)
            offer(before[i])
        return [i for i in ids if i >= 0]

    def __call__(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each slice."""
        out: list = [None] * len(words)
        short = []
        for i, word in enumerate(words):
            whole = self.ranks.get(word)
            if whole is not None:
                out[i] = [whole]
            elif len(word) > LONG_SLICE:
                out[i] = self.long(word)
            else:
                short.append(i)
        if not short:
            return out
        ids = self.byte_id[np.frombuffer(b"".join(words[i] for i in short), np.uint8)]
        word = np.repeat(np.array(short), [len(words[i]) for i in short])
        done_ids, done_words = [], []
        while len(ids):
            rank = np.full(len(ids), NO_RANK)
            rank[:-1] = np.where(word[:-1] == word[1:], self._pair_rank(ids[:-1], ids[1:]), NO_RANK)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            sizes = np.diff(np.append(first, len(word)))
            lowest = np.repeat(np.minimum.reduceat(rank, first), sizes)
            finished = lowest == NO_RANK
            done_ids.append(ids[finished])
            done_words.append(word[finished])
            best = np.flatnonzero((rank == lowest) & ~finished)
            best = best[np.diff(word[best], prepend=-1) != 0]  # the leftmost of each slice
            ids[best] = rank[best]
            keep = ~finished
            keep[best + 1] = False
            ids, word = ids[keep], word[keep]
        ids, word = np.concatenate(done_ids), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        ids, word = ids[order], word[order]
        first = np.flatnonzero(np.diff(word, prepend=-1))
        for i, start, end in zip(word[first].tolist(), first.tolist(), [*first[1:].tolist(), len(word)]):
            out[i] = ids[start:end].tolist()
        return out


def short_keys(data: bytes, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two integers for each slice of ``data``: its first eight bytes, and the next seven with its length; of longer ones the latter is 0.

    Slices of at most ``SHORT_SLICE`` bytes are equal if and only if both integers are.
    """
    raw = data + bytes(16)
    words = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))  # the eight bytes from each place on
    low = words[start] & FIRST_BYTES.take(np.minimum(length, 8))
    high = words[start + 8] & FIRST_BYTES.take(np.clip(length - 8, 0, 7))
    high |= length.astype(np.uint64) << np.uint64(56)
    high[length > SHORT_SLICE] = 0
    return low, high


class SliceCache:
    """Ids of slices, remembered up to a number of slices; ``merge`` encodes those that are new."""

    def __init__(self, merge: Callable[[list[bytes]], list[list[int]]], limit: int = CACHE_SLICES):
        self.merge, self.limit = merge, limit
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}  # the longer slices
        self.ids, self.start = np.empty(0, np.uint32), np.zeros(1, np.int64)
        # The two integers of each slice by its number (0 for longer ones), and numbers by hash, at most a quarter full.
        self.low, self.high = np.zeros(1 << 10, np.uint64), np.zeros(1 << 10, np.uint64)
        self.bits, self.table = 12, np.full(1 << 12, -1, np.int32)

    def _hash(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = low * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        mixed += high
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def _numbers(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The number of each slice, -1 for those not in the table."""
        at = self._hash(low, high)
        number = self.table.take(at)
        other = np.flatnonzero((number >= 0) & ((self.low.take(number, mode="wrap") != low) | (self.high.take(number, mode="wrap") != high)))
        while len(other):
            at[other] = (at[other] + 1) & ((1 << self.bits) - 1)
            here = number[other] = self.table[at[other]]
            other = other[(here >= 0) & ((self.low[here] != low[other]) | (self.high[here] != high[other]))]
        return number

    def _add(self, low: np.ndarray, high: np.ndarray) -> None:
        """Give the next numbers to slices that differ from each other and from all before."""
        base = len(self.start) - 1
        total = base + len(low)
        if total > len(self.low):
            while total > 1 << (self.bits - 2):
                self.bits += 1
            room = np.zeros((1 << (self.bits - 2)) - base, np.uint64)
            self.low, self.high = np.append(self.low[:base], room), np.append(self.high[:base], room)
            self.table, base = np.full(1 << self.bits, -1, np.int32), 0
        self.low[total - len(low):total], self.high[total - len(low):total] = low, high
        number = np.arange(base, total, dtype=np.int32)
        number = number[self.high[number] > 0]
        at = self._hash(self.low[number], self.high[number])
        while len(number):
            free = self.table[at] < 0
            self.table[at[free]] = number[free]
            left = self.table[at] != number
            number, at = number[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids in a row, the ids per text, and the ids per slice."""
        ids, per_slice, per_text, _ = self.encode_offsets(texts)
        ends = np.append(0, np.cumsum(per_slice))
        cut = np.append(0, np.cumsum(per_text))
        return ids, np.diff(ends[cut]), per_slice

    def encode_offsets(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids in a row, ids per slice, slices per text, and the byte at which each slice starts in the joined texts."""
        data, starts, ends, per_text = slices(texts)
        length = ends - starts
        if len(self.start) - 1 > self.limit:
            self._clear()
        low, high = short_keys(data, starts, length)
        place = self._numbers(low, high)
        longer = np.flatnonzero(length > SHORT_SLICE).tolist()
        if longer:
            place[longer] = [self.index.get(data[starts[i]:ends[i]], -1) for i in longer]
        unknown = np.flatnonzero(place < 0)
        if len(unknown):
            unseen = [data[a:b] for a, b in zip(starts[unknown].tolist(), ends[unknown].tolist())]
            one = dict(zip(unseen, unknown.tolist()))  # any place of each
            new, at = list(one), list(one.values())
            coded = self.merge(new)
            sizes = np.fromiter(map(len, coded), np.int64, len(coded))
            base = len(self.start) - 1
            number = dict(zip(new, range(base, base + len(new))))
            self.index.update((w, i) for w, i in number.items() if len(w) > SHORT_SLICE)
            self._add(low[at], high[at])
            self.start = np.append(self.start, self.start[-1] + np.cumsum(sizes))
            self.ids = np.append(self.ids, np.fromiter((i for c in coded for i in c), np.uint32, int(sizes.sum())))
            place[unknown] = [number[w] for w in unseen]
        size = self.start[place + 1] - self.start[place]
        total = int(size.sum())
        gather = np.arange(total) + np.repeat(self.start[place] - (np.cumsum(size) - size), size)
        return self.ids[gather], size, per_text, starts


class Decoder:
    """Bytes of ids by two table lookups."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.tokens = tokens

    def __call__(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def read_ranks(path: str) -> bytes:
    """The rank file, read on the driver; its size is that of a vocabulary."""
    with open(path, "rb") as file:
        return file.read()


@functools.lru_cache(2)
def _parsed(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


@functools.lru_cache(2)
def _coder(data: bytes) -> SliceCache:
    return SliceCache(RankMerger(_parsed(data)))


@functools.lru_cache(2)
def _decoder(data: bytes) -> Decoder:
    return Decoder(_parsed(data))


ENCODED = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("n_slices", T.LongType())])


def encoder(spark: SparkSession, rank_file: str, offsets: bool = False) -> Callable[[Column], Column]:
    """A function of a text column that gives a struct of ``ids`` and ``n_slices``.

    ``ids`` are unsigned little-endian 32-bit integers. With ``offsets`` the struct also has ``slice_ids``: for each slice, as such
    integers too, its number of ids, so that any slice can be found and decoded by itself (``slice_of``).
    """
    ship(spark)
    shipped = spark.sparkContext.broadcast(read_ranks(rank_file))
    schema = T.StructType([*ENCODED.fields, *([T.StructField("slice_ids", T.BinaryType())] if offsets else [])])

    @F.arrow_udf(schema)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = _coder(shipped.value)
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            ids_out, n_out, sizes_out = [], [], []
            for start, end in text_slices(texts):
                ids, size, per_text, _ = coder.encode_offsets(texts[start:end])
                cut = np.append(0, np.cumsum(per_text))
                ends = np.append(0, np.cumsum(size))[cut]
                raw = ids.astype("<u4").tobytes()
                ids_out += [raw[4 * a:4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                n_out.append(per_text)
                if offsets:
                    raw = size.astype("<u4").tobytes()
                    sizes_out += [raw[4 * a:4 * b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
            arrays = [pa.array(ids_out, pa.binary()), pa.array(np.concatenate(n_out) if n_out else [], pa.int64())]
            if offsets:
                arrays.append(pa.array(sizes_out, pa.binary()))
            yield pa.StructArray.from_arrays(arrays, schema.names)

    return encode


def slice_of(encoded: Column, place: Column) -> Column:
    """The ids of one slice (numbered from 0) of a struct that ``encoder`` wrote with offsets, to be decoded by itself; NULL past the last."""

    @F.arrow_udf(T.BinaryType())
    def cut(ids: pa.Array, sizes: pa.Array, places: pa.Array) -> pa.Array:
        out = []
        for raw, counts, at in zip(ids.to_pylist(), sizes.to_pylist(), places.to_pylist()):
            ends = np.cumsum(np.frombuffer(counts or b"", "<u4").astype(np.int64))
            inside = raw is not None and at is not None and 0 <= at < len(ends)
            out.append(raw[4 * int(ends[at - 1] if at else 0):4 * int(ends[at])] if inside else None)
        return pa.array(out, pa.binary())

    return cut(encoded["ids"], encoded["slice_ids"], place.cast("long"))


def decoder(spark: SparkSession, rank_file: str) -> Callable[[Column], Column]:
    """A function of a column of ids (as ``encoder`` writes them) that gives the bytes they stand for."""
    ship(spark)
    shipped = spark.sparkContext.broadcast(read_ranks(rank_file))

    @F.arrow_udf(T.BinaryType())
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decode_one = _decoder(shipped.value)
        for batch in batches:
            yield pa.array([None if x is None else decode_one(np.frombuffer(x, "<u4")) for x in batch.to_pylist()], pa.binary())

    return decode


def encode_documents(docs: DataFrame, rank_file: str, text_col: str = "text", out: str = "encoded", offsets: bool = False) -> DataFrame:
    """The table with a struct column of ids; rows and other columns stay as they are."""
    return docs.withColumn(out, encoder(docs.sparkSession, rank_file, offsets)(F.col(f"`{text_col}`")))
