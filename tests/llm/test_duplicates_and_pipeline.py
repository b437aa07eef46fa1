"""Near and exact duplicates, preference formatting and the pipeline against brute force."""

import hashlib
import random
import re
import uuid

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from tabulon.llm import exact_dedup, groups, near_texts, preference, simhash, vector_dedup
from tabulon.llm.exact_dedup import DigestIndex
from tabulon.llm.graph import components, local_roots


def joined(n, pairs):
    """Smallest member of each component, by the plain method."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("pairs", [[], [(0, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)],
                                   [(i, (i * 7) % 90) for i in range(0, 90, 3)], [(5, 5), (9, 3), (3, 9), (3, 1)]])
def test_components(spark, pairs):
    found = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    expected = joined(100, pairs)
    assert all(found.get(i, i) == expected[i] for i in range(100))
    a, b = np.array(pairs, np.int64).reshape(-1, 2).T
    assert local_roots(100, a, b).tolist() == expected


def test_golay_keys_reach_all_near_words():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 500, dtype=np.uint64)
    changed = prints.copy()
    for i in range(500):
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            changed[i] ^= np.uint64(1) << np.uint64(bit)
    keys = [set() for _ in range(1000)]
    for row, key in zip(*simhash.fuzzy_keys(np.concatenate([prints, changed]))):
        keys[row].add(int(key))
    assert all(keys[i] & keys[i + 500] for i in range(500))
    assert max(map(len, keys)) <= 3 * simhash.MOST_KEYS ** 2


def test_large_groups_keep_a_spanning_set(monkeypatch):
    rng = np.random.default_rng(2)
    prints = np.unique(np.concatenate([np.uint64(7) ^ (np.uint64(1) << rng.integers(0, 64, 80).astype(np.uint64)),
                                       rng.integers(0, 1 << 63, 60, dtype=np.uint64)]))
    near = np.argwhere(np.triu(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4, 1))
    expected = joined(len(prints), near)
    place = {int(p): i for i, p in enumerate(prints)}
    for matrix in (10, 2048):
        monkeypatch.setattr(simhash, "MATRIX", matrix)
        a, b = simhash.spanning_links(prints, 4)
        assert len(a) < len(prints)
        assert joined(len(prints), [(place[int(x)], place[int(y)]) for x, y in zip(a, b)]) == expected


def brute_simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    counts = sum((np.array([xxhash.xxh64_intdigest(s, 42) >> b & 1 for b in range(64)]) for s in shingles), np.zeros(64, int))
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def test_near_duplicates(spark):
    rng = random.Random(1)
    texts = [None, "", " \n", "One two", "one TWO", "three\x0bwords here"]
    for _ in range(40):
        words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randint(1, 200))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
    rows = [(i, t, 0, 0) for i, t in enumerate(texts)] + [(3, texts[3], 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, print long, key long")
    prints = [brute_simhash(t) for t in texts]
    expected = joined(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", expected[r.doc_id])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    null = simhash.near_duplicates(docs.where("doc_id < 4").withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert {r.component_id for r in null} == {None}


def similar_components(texts):
    """Component of each text by five-word shingles and a Jaccard similarity of at least 0.8, by comparing all pairs."""
    sets = []
    for text in texts:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets.append(frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))))
    holders = {}
    for i, own in enumerate(sets):
        for shingle in own:
            holders.setdefault(shingle, []).append(i)
    pairs = set()
    for i, own in enumerate(sets):
        others = {j for shingle in own for j in holders[shingle] if j < i}
        pairs |= {(i, j) for j in others if len(own & sets[j]) >= 0.8 * len(own | sets[j])}
    return joined(len(texts), pairs)


def kept_by_stage(spark, sf, folder, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(folder)
    return sorted(r.doc_id for r in corpus_pipeline.simhash_dedup(spark, spark.read.parquet(folder), sf).collect())


@pytest.mark.parametrize("group", [3, 4096])
def test_near_dedup_stage_finds_all_similar_texts(spark, sf, tmp_path, monkeypatch, group):
    monkeypatch.setattr(near_texts, "GROUP", group)
    monkeypatch.setattr(simhash, "GROUP", group)
    monkeypatch.setattr(near_texts, "PAIRS_OF_END", group)
    monkeypatch.setattr(near_texts, "PAIRS_HELD", group)
    rng = random.Random(7)
    texts = [None, "", " \n", "One two", "one TWO", "one two three", "all rights reserved by the owner of these words"]
    for _ in range(60):
        words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randint(5, 300))]
        head = "all rights reserved by the owner of these words " * rng.randint(0, 3)
        texts += [head + " ".join(words), head * 5 + " ".join(words)]
        for _ in range(rng.randint(0, 5)):
            for _ in range(rng.randint(1, max(1, len(words) // 40))):
                words[rng.randrange(len(words))] = f"new{rng.randrange(1000)}"
            texts.append(" ".join(words))
    texts.append(" ".join(f"long{rng.randrange(5000)}" for _ in range(20_000)))
    texts.append(texts[-1] + " and a tail")
    expected = similar_components(texts)
    assert len(set(expected)) > 40 and len(texts) - len(set(expected)) > 20
    assert kept_by_stage(spark, sf, str(tmp_path / "docs"), texts) == sorted(set(expected))


def test_near_dedup_stage_with_a_hot_paragraph(spark, sf, tmp_path, monkeypatch):
    """Three thousand texts share one paragraph, most of them little else; no two of them are similar but for the copies."""
    monkeypatch.setattr(near_texts, "GROUP", 500)
    rng = random.Random(11)
    paragraph = " ".join(f"clause{i}" for i in range(60))
    texts = []
    for i in range(3000):
        own = " ".join(f"w{rng.randrange(10**6)}" for _ in range(30 if i % 3 else 12))
        texts.append(f"{own} {paragraph}" if i % 2 else f"{paragraph} {own}")
    texts += [f"{t} end" for t in texts[:200:2]]
    # Comparing all pairs of a part; the rest is built the same way.
    part = texts[:300] + texts[3000:]
    assert sorted(set(similar_components(part))) == list(range(300))
    assert kept_by_stage(spark, sf, str(tmp_path / "docs"), texts) == list(range(3000))


def test_pairs_in_groups_of_any_size(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 5, rng.randrange(40)]), i) for i in range(150)]
    frame = spark.createDataFrame([(k, i, "x") for k, i in rows], "k long, id long, n string").repartition(5)

    def compare(keys, table, sides):
        ids = table.column("id").to_numpy()
        found = [(ids[a], ids[b]) for a in range(len(ids)) for b in range(len(ids)) if ids[a] < ids[b] and keys[a] == keys[b]
                 and (sides is None or sides[a] != sides[b])]
        yield {"a": np.array([a for a, _ in found], np.int64), "b": np.array([b for _, b in found], np.int64)}

    expected = sorted((i, j) for k, i in rows for m, j in rows if k == m and i < j)
    for limit in (5, 40):
        out = groups.pairs_in_groups(frame, "k", "id", T.StructType.fromDDL("a long, b long"), compare, limit)
        assert sorted((r.a, r.b) for r in out.collect()) == expected
    assert groups.pairs_in_groups(frame.limit(0), "k", "id", T.StructType.fromDDL("a long, b long"), compare, 5).count() == 0


def test_parity_sketches_never_rule_out_similar_sets():
    rng = np.random.default_rng(5)
    for n in (1, 5, 50, 500, 5000):
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        for cut in {0, n // 20, n // 10, n // 9}:
            other = np.concatenate([base[cut:], rng.integers(0, 1 << 63, cut, dtype=np.uint64)])
            both = np.concatenate([base, other])
            sketches = near_texts.Sketches(near_texts.parity_sketches(both, np.array([n, len(other), n])[:2]))
            assert sketches.differing(0, np.array([1]))[0] <= 2 * cut


def test_sketches_of_different_lengths_fold():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 140, dtype=np.uint64)
    parts, sizes = [base, base[:120], base[:20]], np.array([140, 120, 20])
    sketches = near_texts.Sketches(near_texts.parity_sketches(np.concatenate(parts), sizes))
    assert sketches.words.tolist() == [8, 4, 4]
    assert 0 < sketches.differing(0, np.array([1]))[0] <= 20 and 60 < sketches.differing(1, np.array([2]))[0] <= 100


def brute_vectors(rows, threshold):
    sound = [v is not None and l is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, l in rows]
    units = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if s else None for (_, v, _), s in zip(rows, sound)]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sound[i] and sound[j] and rows[i][2] == rows[j][2]
             and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold]
    return pairs


@pytest.mark.parametrize("tile", [8, 1024])
def test_vectors(spark, tile):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 16))
    rows = [(i, (base[i % 30] + rng.normal(size=16) * rng.choice([0, 0.02, 0.05, 0.1])).astype(np.float32).tolist(), int(i % 3)) for i in range(240)]
    rows += [(i, rows[0][1], 0) for i in range(240, 260)]  # copies
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, [1.0] + [None] * 15, 1), (304, rows[0][1], None),
             (305, [1.0, 2.0], 1), (306, [2.0, 4.0], 1), (307, [float("inf")] * 16, 1), (308, [], 1)]
    frame = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<float>, label int, node int, digest string")
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(frame, tile=tile).collect()}
    pairs = brute_vectors(rows, 0.98)
    roots = joined(len(rows), pairs)
    assert len(got) == len(rows)
    for i, (key, _, _) in enumerate(rows):
        r = got[key]
        assert (r.n_links, r.component_id, r.kept) == (sum(i in p for p in pairs), rows[roots[i]][0], roots[i] == i)
    assert vector_dedup.near_duplicates(frame.limit(0)).count() == 0
    assert vector_dedup.near_duplicates(frame.where("vec_id = 300")).count() == 1


def test_vectors_of_any_magnitude(spark):
    shape = [[1.0, 2.0, -3.0, 0.5], [1.0, 2.0, -3.0, 0.5001], [3.0, -1.0, 0.5, 2.0]]
    rows = [(10 * k + i, [x * scale for x in v], 1) for k, scale in enumerate((1e200, 1e-200, 1.0, 5e-310)) for i, v in enumerate(shape)]
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert {(r.n_links, r.component_id) for k, r in got.items() if k % 10 < 2} == {(7, 0)}
    assert {(r.n_links, r.component_id) for k, r in got.items() if k % 10 == 2} == {(3, 2)}


def test_quantisation_bound_holds():
    rng = np.random.default_rng(4)
    unit = rng.normal(size=(200, 32))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    whole, scale, error, norm = vector_dedup.quantised(unit)
    approximate = (whole.astype(float) @ whole.T.astype(float)) * scale[:, None] * scale
    assert (np.abs(unit @ unit.T - approximate) <= error[:, None] + norm[:, None] * error + 1e-12).all()


def test_exact_index_keeps_over_batches(spark, tmp_path):
    index = DigestIndex(spark, f"digests_{uuid.uuid4().hex}", str(tmp_path / "index"), buckets=4)
    first = [(5, "a  b"), (2, "a b"), (2, "a\tb"), (None, "a b"), (None, "only null"), (7, None), (6, ""), (8, "c")]
    schema = "doc_id long, text string, digest string, row string"
    rows = spark.createDataFrame([(*r, "x", "y") for r in first], schema)
    got = index.deduplicate(rows, "one").collect()
    assert len(got) == 8
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    sizes = sorted((len(v), v[0].group_size, v[0].keep_id, sum(r.kept for r in v)) for v in by.values() if v[0].keep_id is not None)
    assert sizes == [(1, 1, 8, 1), (2, 2, 6, 1), (4, 4, 2, 1)]
    assert [r.kept for r in got if r.keep_id is None] == [True]
    # Given again, as after a lost driver, the batch decides as before and adds nothing.
    assert sorted(map(str, index.deduplicate(rows, "one").collect())) == sorted(map(str, got))
    assert index.read().count() == 4
    later = spark.createDataFrame([(1, "a b", "", ""), (9, "new", "", ""), (8, "c", "", "")], schema)
    for _ in range(2):
        second = index.deduplicate(later, "two").collect()
        assert {(r.doc_id, r.keep_id, r.kept) for r in second} == {(1, 2, False), (9, 9, True), (8, 8, False)}
    assert index.read().count() == 5
    plan = index.read().groupBy("digest").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # bucketed by digest
    assert index.deduplicate(spark.createDataFrame([], schema), "three").count() == 0
    index.drop()


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_batches_decide_like_the_whole(spark, batches):
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(40)]), rng.choice(["a", "a ", "a  ", None, "", f"t{rng.randrange(9)}"]), "x") for _ in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, batch string").repartition(3)
    tables = spark.catalog.listTables()
    got = exact_dedup.deduplicate_in_batches(frame, batches).collect()
    assert len(spark.catalog.listTables()) == len(tables)
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(re.sub("[ \t-\r]+", " ", t or ""), []).append(i)
    expected = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(got) == len(rows)
    for digest, ids in expected.items():
        own = [r for r in got if r.text_sha256 == digest]
        smallest = min((i for i in ids if i is not None), default=None)
        assert sorted(map(str, (r.doc_id for r in own))) == sorted(map(str, ids))
        assert {r.keep_id for r in own} == {smallest} and {r.group_size for r in own} == {len(ids)}
        assert [r.doc_id for r in own if r.kept] == [smallest]
    assert exact_dedup.deduplicate_in_batches(frame.limit(0), batches).count() == 0


def test_preference(spark):
    def side(pair, name, *turns):
        return [(pair, name, t, role, text) for t, (role, text) in enumerate(turns)]

    u, a = ("user", "q"), ("assistant", "one")
    rows = (side(1, "chosen", u, a) + side(1, "rejected", u, ("assistant", "two"), ("user", "more"))
            + side(2, "chosen", u, a) + side(2, "rejected", u, a)
            + side(3, "chosen", u) + side(4, "chosen", (None, None), a) + side(4, "rejected", (None, None), ("assistant", None)))
    parts = preference.preference_turns(spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string"))
    got = {(r.pair_id, r.part, r.turn): r.learnt for r in parts.collect()}
    assert got == {(1, "prompt", 0): False, (1, "chosen", 1): True, (1, "rejected", 1): True, (1, "rejected", 2): False,
                   (2, "prompt", 0): False, (2, "prompt", 1): False, (3, "chosen", 0): False,
                   (4, "prompt", 0): False, (4, "chosen", 1): True, (4, "rejected", 1): True}
    one = {r.pair_id: r for r in preference.assembled(parts).collect()}
    assert one[1].prompt == "<|user|>\nq<|end|>\n"
    assert one[1].rejected == "<|assistant|>\ntwo<|end|>\n<|user|>\nmore<|end|>\n"
    assert [(s.start, s.end) for s in one[1].rejected_learnt] == [(0, len("<|assistant|>\ntwo<|end|>\n"))]
    assert one[2].chosen == one[2].rejected == ""


def test_preference_of_odd_turns(spark):
    schema = "conv_id long, turn long, role string, text string, side string, sub int"
    rows = [(0, 0, "user", "hi"), (0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 2, "user", "why"),
            (2, 0, "user", "alone"), (None, 0, "user", "x"), (0, None, "user", "y"), (4, 0, "assistant", None), (4, 0, "assistant", "b"),
            (5, 0, "assistant", None), (7, 1, "assistant", "right side only")]
    frame = spark.createDataFrame([(*r, "s", 7) for r in rows], schema)
    parts = preference.preference_turns(preference.neighbour_pairs(frame))
    got = {(r.pair_id, r.part, r.turn, r.sub, r.rendered.split("\n")[1]) for r in parts.collect()}
    assert got == {(0, "prompt", 0, 1, "hi<|end|>"), (0, "chosen", 1, 1, "yes<|end|>"), (0, "rejected", 1, 1, "no<|end|>"),
                   (0, "rejected", 2, 1, "why<|end|>"), (2, "chosen", 0, 1, "alone<|end|>"),
                   (4, "prompt", 0, 1, "<|end|>"), (4, "chosen", 0, 2, "b<|end|>"), (6, "rejected", 1, 1, "right side only<|end|>")}
    assert preference.preference_turns(preference.neighbour_pairs(frame.limit(0))).count() == 0


def test_every_turn_is_in_one_pair(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    parts = preference.preference_turns(preference.neighbour_pairs(turns))
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 8
    # A prompt turn stands for one turn of both sides, any other for one of its side.
    counted = parts.groupBy("part").count().collect()
    assert sum(r["count"] * (2 if r.part == "prompt" else 1) for r in counted) == turns.distinct().count()
    whole = preference.assembled(parts).collect()
    assert {r.pair_id for r in whole} == {r.conv_id // 2 * 2 for r in turns.collect()}
    for r in whole:
        for side in ("chosen", "rejected"):
            for span in r[f"{side}_learnt"]:
                assert r[side][span.start:span.end].startswith("<|assistant|>\n") and r[side][:span.end].endswith("<|end|>\n")
    cut = preference.assembled(parts, block=2).orderBy("pair_id", "block").collect()
    for r in whole:
        own = [c for c in cut if c.pair_id == r.pair_id]
        assert all("".join(c[k] for c in own) == r[k] for k in ("prompt", "chosen", "rejected"))


def test_pipeline_stages(spark, sf, tmp_path):
    extra = spark.read.parquet(f"{sf}/documents.parquet").withColumns({"row": F.lit(1), "found": F.lit("x"), "score": F.lit(None).cast("int")})
    odd = spark.createDataFrame([(None, None), (9001, ""), (9002, "123"), (None, "the same words here, twice")] * 2, "doc_id long, text string")
    extra.unionByName(odd, allowMissingColumns=True).write.parquet(str(tmp_path / "0"))
    docs = spark.read.parquet(str(tmp_path / "0"))
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "quality classifier", "exact dedup", "SimHash near-dedup", "best-fit packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k + 1)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k + 1)))
        if name == "language ID":
            assert docs.where("text is null or text in ('', '123')").count() == 0
        if name == "exact dedup":
            normal = F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")
            assert docs.count() == before.select(normal).distinct().count()
        if name == "SimHash near-dedup":
            assert docs.count() == len(set(similar_components([r.text for r in before.collect()])))
    assert docs.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()


@pytest.mark.parametrize("stage", [corpus_pipeline.exact_dedup, corpus_pipeline.simhash_dedup])
def test_stages_drop_the_same_rows_however_files_are_cut(spark, sf, tmp_path, stage):
    words = [" ".join(f"w{i}x{k}" for k in range(30)) for i in range(20)]
    rows = [(i, words[i % 20].replace(" ", " " * (1 + i // 20))) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(7, "doc_id").write.parquet(str(tmp_path / "docs"))
    key = "spark.sql.files.minPartitionNum"
    try:
        spark.conf.set(key, "1")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        kept = stage(spark, spark.read.parquet(str(tmp_path / "docs")), sf)
        spark.conf.set(key, "50")  # as if executors had come before the last plan
        assert sorted(r.doc_id for r in kept.collect()) == list(range(20))
    finally:
        spark.conf.unset(key)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_pipeline_of_an_empty_table(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
