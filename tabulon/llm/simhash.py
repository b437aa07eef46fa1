"""Near-duplicate documents by SimHash fingerprints and Golay-code fuzzy keys.

A fingerprint has 64 bits, cut into segments of 22, 21 and 21. Fingerprints that differ in at most four bits differ in at most two
in at least two of the three segments (two segments with three errors each would make six). A segment, padded to 23 bits, and every
word one bit away from it are decoded to the codewords of the perfect binary Golay code; segments at a distance of
two have a word between them, so they share one of these codewords. A segment has one or up to six of them. So the
pairs of codewords of two segments are keys of 26 bits that no link can miss. Equal fingerprints are merged first, the
distinct ones are shuffled by key, and each key's fingerprints are compared exactly.

Inside a key only a spanning set of the links is kept, one per fingerprint, so a large group of copies gives as many rows as it has
members. A key holds distinct fingerprints of eight bytes each that are near one of 2^24 pairs of codewords: copies of one text do not
add to it; a key with more than GROUP of them is dealt into pairs of tiles. Links become components by ``graph.components``.

Defined results: words are the runs without ASCII white space after lower-casing A-Z, shingles are four words, repeats
included; fewer words are one shingle; a text without words, or null, has fingerprint zero and is linked like any other. The
component id is the smallest id reached, nulls aside. Repeated rows are rows of one component. Empty tables give no rows; other
columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.graph import components, local_roots
from tabulon.llm.groups import pairs_in_groups
from tabulon.llm.shared import ship, text_slices, written

SHINGLE_WORDS = 4
SEED = 42
MAX_DISTANCE = 4
WINDOW = 65_535  # shingles at a time: counts of a window fit into 16 bits

# Fixed value: a generator polynomial of the binary Golay code of length 23.
GOLAY_GENERATOR = 0b101011100011
SEGMENTS = ((0, 22), (22, 21), (43, 21))
MOST_KEYS = 6

PAIRWISE = 64  # keys with at most so many fingerprints are compared by shifts, all keys of a batch at once
MATRIX = 2048  # larger keys go by breadth-first search instead of a matrix
GROUP = 8192  # keys with more fingerprints are dealt into tiles


def _shingles(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray, Callable[[slice], np.ndarray]]:
    """The text of each shingle, the shingles per text, and a function that hashes a range of them."""
    documents = [b" ".join(t.encode().lower().split()) for t in texts]
    data = b"\n".join(documents)
    raw = np.frombuffer(data, np.uint8)
    cuts = np.flatnonzero((raw == 0x20) | (raw == 0x0A))
    starts, ends = np.append(0, cuts + 1), np.append(cuts, len(raw))
    words = np.array([d.count(b" ") + 1 if d else 0 for d in documents])
    first = np.cumsum(np.maximum(words, 1)) - np.maximum(words, 1)  # an empty text still has a place between the cuts
    shingles = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    doc = np.repeat(np.arange(len(texts)), shingles)
    head = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    tail = np.minimum(head + size - 1, first[doc] + words[doc] - 1)
    begin, end = starts[head], ends[tail]

    def hashed(here: slice) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, [data[a:b] for a, b in zip(begin[here].tolist(), end[here].tolist())],
                               repeat(SEED)), np.uint64)

    return doc, shingles, hashed


def majority(doc: np.ndarray, shingles: np.ndarray, hashed: Callable[[slice], np.ndarray]) -> np.ndarray:
    """For each text the bits that more than half of its hashes have."""
    counts = np.zeros((len(shingles), 64), np.int64)
    lanes = np.uint64(0x0001000100010001)
    for at in range(0, len(doc), WINDOW):
        here = slice(at, at + WINDOW)
        h = hashed(here)
        opens = np.flatnonzero(np.diff(doc[here], prepend=-1))
        for shift in range(16):  # bits shift, shift + 16, ... are counted in the four 16-bit lanes of one sum
            sums = np.add.reduceat((h >> np.uint64(shift)) & lanes, opens)
            counts[doc[here][opens], shift::16] += sums.view(np.uint16).reshape(-1, 4)
    bits = 2 * counts > shingles[:, None]
    return (bits.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def fingerprints(texts: list[str]) -> np.ndarray:
    """SimHash of each text as unsigned 64-bit integers."""
    return majority(*_shingles(texts, SHINGLE_WORDS))


def shingle_sets(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different shingles of each text, sorted by text and hash, and their number per text."""
    doc, _, hashed = _shingles(texts, size)
    h = hashed(slice(None))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = (np.diff(doc, prepend=-1) != 0) | (np.append(True, h[1:] != h[:-1])[:len(h)])
    return h[new], np.bincount(doc[new], minlength=len(texts))


@functools.cache
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and of the high 11 bits of a word, and the error of each syndrome."""
    unit = []
    for i in range(23):
        rest = 1 << i
        for bit in range(22, 10, -1):
            if rest >> bit & 1:
                rest ^= GOLAY_GENERATOR << (bit - 11)
        unit.append(rest)

    def syndromes(bits: list[int]) -> np.ndarray:
        table = np.zeros(1 << len(bits), np.int64)
        for i, u in enumerate(bits):
            table[1 << i:2 << i] = table[:1 << i] ^ u
        return table

    errors = np.zeros(2048, np.int64)
    for i in range(23):
        for j in range(i, 23):
            for k in range(j, 23):
                error, syndrome = 0, 0
                for place in {i, j, k}:
                    error, syndrome = error | 1 << place, syndrome ^ unit[place]
                errors[syndrome] = error
    return syndromes(unit[:12]), syndromes(unit[12:]), errors


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The 12 message bits of the codeword nearest to each 23-bit word."""
    low, high, errors = golay_tables()
    return (words ^ errors[low[words & 0xFFF] ^ high[words >> 12]]) >> 11


def segment_keys(segment: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Codewords within reach of each segment as rows of MOST_KEYS places, and which places are used."""
    flips = np.append(0, 1 << np.arange(width))
    reached = np.sort(codeword_index(segment[:, None] ^ flips[None, :]), axis=1)
    new = np.diff(reached, axis=1, prepend=-1) != 0
    place = np.cumsum(new, axis=1) - 1
    keys = np.zeros((len(segment), MOST_KEYS), np.int64)
    row, column = np.nonzero(new)
    keys[row, place[row, column]] = reached[row, column]
    return keys, np.arange(MOST_KEYS) < new.sum(axis=1)[:, None]


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): all keys of unsigned 64-bit fingerprints."""
    parts = [segment_keys(((prints >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64), w) for s, w in SEGMENTS]
    rows, keys = [], []
    for pair, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        (a, has_a), (b, has_b) = parts[i], parts[j]
        both = (pair << 24) | (a[:, :, None] << 12) | b[:, None, :]
        row, x, y = np.nonzero(has_a[:, :, None] & has_b[:, None, :])
        rows.append(row)
        keys.append(both[row, x, y])
    return np.concatenate(rows), np.concatenate(keys)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def spanning_links(prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same fingerprints as all links between them; at most one per fingerprint."""
    if len(prints) <= MATRIX:
        a, b = np.nonzero(np.triu(_distance(prints[:, None], prints[None, :]) <= most, 1))
        root = local_roots(len(prints), a, b)
        moved = np.flatnonzero(root != np.arange(len(prints)))
        return prints[moved], prints[root[moved]]
    ends, heads, rest, front = [], [], prints[1:], prints[:1]
    while len(rest):
        block = front[:max(1, MATRIX * MATRIX // len(rest))]
        front = front[len(block):]
        near = _distance(block[:, None], rest[None, :]) <= most
        hit = near.any(axis=0)
        ends.append(rest[hit])
        heads.append(block[near.argmax(axis=0)[hit]])
        front, rest = np.concatenate([front, rest[hit]]), rest[~hit]
        if not len(front):
            front, rest = rest[:1], rest[1:]
    return np.concatenate(ends) if ends else prints[:0], np.concatenate(heads) if heads else prints[:0]


def _links_of_groups(keys: np.ndarray, prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each run of equal keys."""
    opens = np.flatnonzero(np.diff(keys, prepend=-1))
    sizes = np.diff(np.append(opens, len(keys)))
    found = [spanning_links(prints[s:s + n], most) for s, n in
             zip(opens[sizes > PAIRWISE].tolist(), sizes[sizes > PAIRWISE].tolist())]
    found.append((prints[:0], prints[:0]))
    small = np.repeat((sizes <= PAIRWISE) & (sizes > 1), sizes)
    k, p = keys[small], prints[small]
    at = np.arange(len(k))
    for shift in range(1, PAIRWISE):
        at = at[at + shift < len(k)]
        at = at[k[at] == k[at + shift]]
        if not len(at):
            break
        near = at[_distance(p[at], p[at + shift]) <= most]
        found.append((p[near], p[near + shift]))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _links_of_sides(keys: np.ndarray, prints: np.ndarray, sides: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each run of equal keys, between fingerprints of different sides; at most one per fingerprint."""
    found = [(prints[:0], prints[:0])]
    opens = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    for start, end in zip(opens.tolist(), [*opens[1:].tolist(), len(keys)]):
        own, low = prints[start:end], sides[start:end] == sides[start:end].min()
        first, second = np.flatnonzero(low), np.flatnonzero(~low)
        for at in range(0, len(first), MATRIX):
            part = first[at:at + MATRIX]
            i, j = np.nonzero(_distance(own[part][:, None], own[second][None, :]) <= most)
            root = local_roots(len(own), part[i], second[j])
            moved = np.flatnonzero(root != np.arange(len(own)))
            found.append((own[moved], own[root[moved]]))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def links(prints: DataFrame, most: int = MAX_DISTANCE) -> DataFrame:
    """(a, b): links that span all pairs of a table of distinct fingerprints (long column ``print``) at most ``most`` bits apart."""
    if most > MAX_DISTANCE:
        raise ValueError(f"the keys find distances up to {MAX_DISTANCE}")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("print").to_numpy()
            for at in range(0, len(own), 4096):
                part = own[at:at + 4096]
                row, key = fuzzy_keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), pa.array(part[row])], ["key", "print"])

    def compared(keys: np.ndarray, rows: pa.Table, sides: np.ndarray | None) -> Iterator[dict[str, np.ndarray]]:
        own = rows.column("print").to_numpy().view(np.uint64)
        a, b = _links_of_groups(keys, own, most) if sides is None else _links_of_sides(keys, own, sides, most)
        pairs = np.unique(np.stack([a, b], axis=1), axis=0).view(np.int64)
        yield {"a": pairs[:, 0], "b": pairs[:, 1]}

    keys = prints.select("print").mapInArrow(keyed, "key int, print long")
    return pairs_in_groups(keys, "key", "print", T.StructType.fromDDL("a long, b long"), compared, limit=GROUP)


def fingerprint(spark: SparkSession):
    """A function of a text column that gives its fingerprint as a long with the same bits."""
    ship(spark)

    @F.arrow_udf(T.LongType())
    def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            found = [fingerprints(texts[a:b]) for a, b in text_slices(texts)]
            yield pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64))

    return simhash


def hexadecimal(print_: Column) -> Column:
    return F.lower(F.lpad(F.hex(print_), 16, "0"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_DISTANCE,
                    tag_col: str | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document; with ``tag_col`` also that column as ``tag`` and ``component``.

    ``component`` tells components apart where ids are null or repeated.
    """
    tags = [F.col(f"`{tag_col}`").alias("tag")] if tag_col else []
    simhash = fingerprint(docs.sparkSession)
    rows = written(docs.select(F.col(f"`{id_col}`").alias("doc_id"),
                               simhash(F.col(f"`{text_col}`").cast("string")).alias("print"), *tags))
    distinct = written(rows.groupBy("print").agg(F.min("doc_id").alias("low")))
    found = written(components(links(distinct, most)).withColumnRenamed("node", "print"))
    lows = found.join(distinct, "print").groupBy("root").agg(F.min("low").alias("component_low"))
    members = found.join(lows, "root").select("print", "root", "component_low")
    resolved = written(distinct.join(members, "print", "left").select(
        "print", F.when(F.col("root").isNotNull(), F.col("component_low")).otherwise(F.col("low")).alias("component_id"),
        F.coalesce("root", "print").alias("component")))
    return rows.join(resolved, "print").select("doc_id", hexadecimal(F.col("print")).alias("fingerprint"), "component_id",
                                               *(["tag", "component"] if tag_col else []))
