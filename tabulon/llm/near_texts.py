"""Near-duplicate texts: components of all pairs whose sets of word shingles have a Jaccard similarity of at least ``least``.

No pair is missed. SimHash links (``simhash.links``) bring the closest copies together; they reach only few of the pairs near the
limit, so the rest is found by prefixes: with all shingles in one order, two sets of that similarity share one of the first
n - ceil(least * n) + 1 shingles of each. Shingles that a sample of the texts holds often come last in the order, so that the keys
are rare ones; the order decides how many pairs are compared, not which are found. Every candidate is verified on the whole sets.

Keys are shuffled once. Only those that several sets share go on, each member with a leader of its key (the smallest set that is
not too small for it). Every set is first verified against the leader that most of its keys name; the components of the verified links
leave only keys whose members lie in different components, one of those with the same members. In two rounds every member looks for
the nearest one of another component, which lets families grow together; then all members are compared pair by pair in
``groups.pairs_in_groups``, which deals a hot key into pairs of tiles. In all rounds a pair goes on only if its parity sketches allow the similarity: bit h of a sketch is set if an odd
number of the set's shingles hash to h, so two sketches differ in at most as many bits as the sets differ in shingles. The texts of the
pairs left meet at their first end, each once for a pair at most; ends with many pairs are salted.

Defined results: words are those of ``simhash``; a text with fewer words than a shingle is one shingle, one without words an empty
set, and empty sets equal each other. A set does not count repeats. Equal sets are told by a 64-bit digest. Null ids stay null;
``tag`` tells rows apart. An empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm import simhash
from tabulon.llm.graph import components
from tabulon.llm.groups import pairs_in_groups
from tabulon.llm.shared import ship, small_batches, written

WORDS = 5
LEAST = 0.8
SAMPLE = 10_000  # texts, chosen by hash, whose frequent shingles come last in the order
FREQUENT = 200_000  # shingles at most that are sent to the workers
GROUP = 2_048  # keys with more sets are dealt into tiles
PAIRS_HELD = 500_000  # pairs that a task collects before they go out
PAIRS_OF_END = 4_096  # pairs that one task verifies for one set
BROADCAST_ROWS = 500_000  # rows of two longs that may be broadcast, counted beforehand


def prefix_length(n: np.ndarray, least: float) -> np.ndarray:
    return np.minimum(n, n - np.ceil(least * n - 1e-9).astype(np.int64) + 1)


def _frequent(texts: DataFrame, words: int) -> np.ndarray:
    """Shingles that several texts of the sample hold, as rows of (shingle, number) in ascending order."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in small_batches(batches):
            yield pa.RecordBatch.from_arrays([pa.array(simhash.shingle_sets(part, words)[0].view(np.int64))], ["shingle"])

    share = SAMPLE / max(1, texts.count())
    drawn = texts.where(F.pmod(F.xxhash64("tag"), F.lit(1_000_000)) < math.ceil(share * 1_000_000)).select("text")
    found = drawn.mapInArrow(shingles, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    rows = found.orderBy(F.desc("n"), "shingle").limit(FREQUENT).collect()
    return np.array(sorted((r.shingle, r.n) for r in rows), np.int64).reshape(-1, 2)


def sketch_words(sizes: np.ndarray) -> np.ndarray:
    """64-bit words of each set's sketch: a power of two with at least two bits for each shingle."""
    return np.maximum(4, 1 << np.ceil(np.log2(np.maximum(sizes, 1) / 32)).clip(0).astype(np.int64))


def parity_sketches(shingles: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """For each set the bits that an odd number of its shingles (unsigned hashes) hit."""
    words = sketch_words(sizes)
    ends = np.cumsum(words)
    bit = shingles & np.repeat(words * 64 - 1, sizes).astype(np.uint64)
    out = np.zeros(int(words.sum()), np.uint64)
    np.bitwise_xor.at(out, np.repeat(ends - words, sizes) + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return np.split(out, ends[:-1])


class Sketches:
    """Sketches of many sets, compared in matrices; a longer one is folded to the length of a shorter one, which keeps the bound."""

    def __init__(self, sketches: list[np.ndarray]):
        self.words = np.array([len(s) for s in sketches])
        self.places: dict[int, np.ndarray] = {}
        self.rows: dict[int, np.ndarray] = {}
        lengths = sorted(set(self.words.tolist()))
        for length in lengths:
            near = np.flatnonzero((self.words == length) | (self.words == 2 * length))
            self.places[length] = np.full(len(sketches), -1)
            self.places[length][near] = np.arange(len(near))
            self.rows[length] = np.stack([s if len(s) == length else s[:length] ^ s[length:] for s in (sketches[i] for i in near.tolist())])

    def differing(self, one: int, others: np.ndarray) -> np.ndarray:
        """Differing bits, a lower bound of the shingles that only one of the two sets has; sketches of very different lengths count as 0."""
        out = np.zeros(len(others), np.int64)
        shared = np.minimum(self.words[one], self.words[others])
        for length in set(shared.tolist()):
            own, here = self.places[length][one], np.flatnonzero(shared == length)
            place = self.places[length][others[here]]
            here, place = here[place >= 0], place[place >= 0]
            if own >= 0 and len(here):
                out[here] = np.bitwise_count(self.rows[length][place] ^ self.rows[length][own]).sum(axis=1, dtype=np.int64)
        return out


def most_differing(size_a: np.ndarray, size_b: np.ndarray, least: float) -> np.ndarray:
    """Shingles that only one of two similar sets has, at most."""
    return (size_a + size_b) * (1 - least) / (1 + least) + 1e-9


def _sketched(texts: DataFrame, words: int, least: float) -> DataFrame:
    """(doc_id, tag, node, size, print, sketch, keys): digest and size of each set, its SimHash, parity sketch and prefix."""
    frequent = texts.sparkSession.sparkContext.broadcast(_frequent(texts, words))
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([texts.schema["doc_id"], texts.schema["tag"], T.StructField("node", T.LongType()),
                           T.StructField("size", T.LongType()), T.StructField("print", T.LongType()),
                           T.StructField("sketch", T.BinaryType()), T.StructField("keys", longs)])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, number = frequent.value[:, 0].copy(), frequent.value[:, 1].copy()
        for batch, part in small_batches(batches):
            shingles, sizes = simhash.shingle_sets(part, words)
            owner = np.repeat(np.arange(len(part)), sizes)
            prints = simhash.majority(owner, sizes, lambda here, all_=shingles: all_[here])
            signed, ends = shingles.view(np.int64), np.cumsum(sizes)
            place = np.minimum(np.searchsorted(often, signed), max(0, len(often) - 1))
            rank = np.where(often[place] == signed, number[place], 0) if len(often) else np.zeros(len(signed), np.int64)
            nodes = [xxhash.xxh64_intdigest(shingles[a:b].tobytes(), simhash.SEED) for a, b in zip(ends - sizes, ends)]
            ordered = signed[np.lexsort((signed, rank, owner))]
            length = prefix_length(sizes, least)
            keys = [ordered[a:a + k] for a, k in zip((ends - sizes).tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tag"), pa.array(np.array(nodes, np.uint64).view(np.int64)),
                 pa.array(sizes, pa.int64()), pa.array(prints.view(np.int64)),
                 pa.array([x.tobytes() for x in parity_sketches(shingles, sizes)], pa.binary()),
                 pa.array(keys, pa.list_(pa.int64()))], schema.names)

    return texts.select("doc_id", "tag", "text").mapInArrow(sketch, schema)


def _shared_keys(keyed: DataFrame, least: float) -> DataFrame:
    """(key, node, size, leader): the keys that several sets have. The leader is null for a set that leads."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = leader = leads = None  # the last row's key, its leader and the leader's size
        waiting: tuple | None = None  # a key's first row, which goes out when a second one comes

        for batch in batches:
            keys, sizes, nodes = (batch.column(c).to_numpy() for c in ("key", "size", "node"))
            if not len(keys):
                continue
            before = np.append(keys[0] if key is None else key, keys[:-1]) == keys
            before[0] = key is not None and key == keys[0]
            after = np.append(keys[:-1] == keys[1:], True)  # the last row may have a follower in the next batch
            out: list[tuple] = []
            for i in np.flatnonzero(before | after).tolist():
                k, s, n = int(keys[i]), int(sizes[i]), int(nodes[i])
                if not before[i]:
                    waiting, leader, leads = (k, n, s, None), n, s
                    continue
                if waiting is not None:
                    out.append(waiting)
                    waiting = None
                if leads >= s * least - 1e-9:
                    out.append((k, n, s, leader))
                else:
                    leader, leads = n, s
                    out.append((k, n, s, None))
            key = keys[-1]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4)], ["key", "node", "size", "leader"])

    return keyed.repartition("key").sortWithinPartitions("key", "size", "node").mapInArrow(
        shared, "key long, node long, size long, leader long")


def _verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, words: int, least: float) -> DataFrame:
    """Those of the stored pairs (a, b) of nodes whose sets are similar."""
    of_a, of_b = (pairs.groupBy(end).agg(F.count(F.lit(1)).alias("n")) for end in ("a", "b"))
    salts = F.ceil(F.col("n") / PAIRS_OF_END)
    zero = F.lit(0).cast("long")
    salted = pairs.join(of_a, "a").select("a", "b", F.pmod(F.xxhash64("b"), salts).alias("salt"))
    firsts = of_a.select(F.col("a").alias("node"), "a", F.explode(F.sequence(zero, salts - 1)).alias("salt"), F.lit(0).alias("role"), zero.alias("part"))
    seconds = salted.join(of_b, "b").select(F.col("b").alias("node"), "a", "salt", F.lit(1).alias("role"), F.pmod(F.xxhash64("a"), salts).alias("part"))
    # Where each set is wanted; one wanted very often is computed anew for every few thousand places.
    places = firsts.unionByName(seconds).groupBy("node", "part").agg(F.collect_list(F.struct("a", "salt", "role")).alias("places")).drop("part")
    wanted = written(nodes.select("node", "tag").join(places, "node"))
    few = wanted.agg(F.count(F.lit(1)), F.sum(F.size("places"))).first()
    small = max(few[0], few[1] or 0) <= BROADCAST_ROWS
    sent = texts.join(F.broadcast(wanted) if small else wanted, "tag").select(F.explode("places").alias("p"), "node", "text").select("p.*", "node", "text")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for batch, part in small_batches(batches):
            shingles, sizes = simhash.shingle_sets(part, words)
            found = []
            for a, role, b, some in zip(*(batch.column(c).to_pylist() for c in ("a", "role", "node")), np.split(shingles, np.cumsum(sizes)[:-1])):
                if not role:
                    own = some
                    continue
                common = len(np.intersect1d(own, some, assume_unique=True))
                either = len(own) + len(some) - common
                if not either or common / either >= least:
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else [[]] * 2)], ["a", "b"])

    # Texts travel, not sets of hashes: these are several times as long, and no shuffle can compress them.
    return written(sent.repartition("a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(compared, "a long, b long"))


def _close_copies(nodes: DataFrame) -> DataFrame:
    """(a, b): nodes with SimHashes that are equal or linked."""
    one = written(nodes.groupBy("print").agg(F.min("node").alias("node")))
    same = nodes.select("print", F.col("node").alias("b")).join(one.withColumnRenamed("node", "a"), "print").select("a", "b")
    linked = simhash.links(one.select("print")).withColumnsRenamed({"a": "p", "b": "q"})
    first = one.select(F.col("print").alias("p"), F.col("node").alias("a"))
    second = one.select(F.col("print").alias("q"), F.col("node").alias("b"))
    return same.unionByName(linked.join(first, "p").join(second, "q").select("a", "b"))


def near_duplicates(docs: DataFrame, tag_col: str, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                    least: float = LEAST) -> DataFrame:
    """(doc_id, tag, component) of every document of a stored table; ``tag_col`` is unique, ``component`` is no id of a document."""
    ship(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{tag_col}`").alias("tag"),
                        F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = written(_sketched(texts, words, least))
    first = F.min(F.struct("tag", "size", "print")).alias("first")  # equal sets have equal sizes and SimHashes
    nodes = written(rows.groupBy("node").agg(first).select("node", "first.*"))
    keyed = rows.join(nodes.select("tag"), "tag", "left_semi").select("node", "size", F.explode("keys").alias("key"))
    shared = written(_shared_keys(keyed, least))

    leaders = shared.where(F.col("leader").isNotNull()).groupBy("node", "leader").agg(F.count(F.lit(1)).alias("votes"))
    best = leaders.groupBy("node").agg(F.max(F.struct("votes", "leader")).alias("best")).select(
        F.col("best.leader").alias("a"), F.col("node").alias("b"))
    # The end that many pairs may share, a leader, comes first.
    tested = written(best.unionByName(_close_copies(nodes)).where("a <> b").groupBy(F.least("a", "b"), F.greatest("a", "b")).agg(
        F.min(F.struct("a", "b")).alias("pair")).select("pair.*"))
    found = _verified(tested, texts, nodes, words, least)

    sketches = rows.join(nodes.select("tag"), "tag", "left_semi").select("node", "sketch")
    known = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # First every set looks for the nearest one of another component, twice: families grow together, and few pairs are left to all of them.
    for salt in (1, 2, None):
        root = written(components(found))
        apart = written(_apart(shared, root, sketches, least, salt))
        if salt == 1:
            # A key none of whose pairs may be similar is done with; a hot one, of which a part was seen, is not.
            hot = shared.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP).select("key")
            shared = written(shared.join(apart.select("key").unionByName(hot).distinct(), "key", "left_semi"))
        rest = written(apart.select("a", "b").distinct().join(known, ["a", "b"], "left_anti"))
        found = found.unionByName(_verified(rest, texts, nodes, words, least))
        known = known.unionByName(rest)
    root = written(components(found))
    return rows.join(root, "node", "left").select("doc_id", "tag", F.coalesce("root", "node").alias("component"))


def _apart(shared: DataFrame, root: DataFrame, sketches: DataFrame, least: float, salt: int | None) -> DataFrame:
    """(key, a, b), a < b: sets that share a key, lie in different components and may be similar; with a salt only some, the nearest ones."""
    placed = written(shared.drop("leader").join(root, "node", "left").withColumn("root", F.coalesce("root", "node")))
    # Keys with the same members bring the same pairs: one of them is enough.
    members = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"members{i}") for i in range(2)]
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"), *members).where(
        "low <> high").groupBy("n", "members0", "members1").agg(F.min("key").alias("key")).select("key")
    # Cells of a hot key come under a key of their own, so the key goes along.
    wanted = placed.join(mixed, "key", "left_semi").join(sketches, "node").withColumn("of", F.col("key"))

    def compared(keys: np.ndarray, part: pa.Table, sides: np.ndarray | None) -> Iterator[dict[str, np.ndarray]]:
        return _similar_pairs(keys, part, sides, least, salt is not None)

    return pairs_in_groups(wanted, "key", "node", T.StructType.fromDDL("key long, a long, b long"), compared, limit=GROUP, salt=salt)


def _similar_pairs(keys: np.ndarray, rows: pa.Table, sides: np.ndarray | None, least: float, nearest: bool) -> Iterator[dict[str, np.ndarray]]:
    """Pairs a < b with one key, of different components and sides, that may be similar; or the nearest of them for each row."""
    node, size, root, key = (rows.column(c).to_numpy() for c in ("node", "size", "root", "of"))
    sketches = Sketches([np.frombuffer(x, np.uint64) for x in rows.column("sketch").to_pylist()])
    pairs, held = [np.zeros((0, 3), np.int64)], 0

    def unique() -> dict[str, np.ndarray]:
        found = np.concatenate(pairs)
        first = np.unique(found[:, 1:] if not nearest else found, axis=0, return_index=True)[1]
        return dict(zip(("key", "a", "b"), found[first].T))

    opens = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    for start, end in zip(opens.tolist(), [*opens[1:].tolist(), len(keys)]):
        order = start + np.argsort(size[start:end], kind="stable")
        own = size[order]
        # A row is compared with the rows behind it that are not too large for it.
        reach = np.searchsorted(own, own / least + 1e-9, side="right")
        for i in range(len(order) - 1):
            here, there = order[i], order[i + 1:reach[i]]
            there = there[root[there] != root[here]]
            if sides is not None:
                there = there[sides[there] != sides[here]]
            if not len(there):
                continue
            differing = sketches.differing(here, there)
            may = differing <= most_differing(size[here], size[there], least)
            if nearest and may.any():
                may = np.flatnonzero(may)[[np.argmin(differing[may])]]
            there = there[may]
            pairs.append(np.stack([np.full(len(there), key[here]), np.minimum(node[here], node[there]), np.maximum(node[here], node[there])], axis=1))
            held += len(there)
            if held > PAIRS_HELD:
                yield unique()
                pairs, held = [np.zeros((0, 3), np.int64)], 0
    yield unique()
