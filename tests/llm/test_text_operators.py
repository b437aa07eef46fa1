"""Tokens, packing, token files and classifiers against brute force, on small and odd inputs."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabulon.llm import byte_bpe, language, packing, quality, shared, simhash, token_files, toxicity
from tabulon.llm.labelled import logistic

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    (1, ""), (2, None), (3, "hello world"), (4, " \t\n "), (5, "It's we'll they'RE 're !'s"), (6, "naïve ½ ²³ 中文 👍🏽"),
    (7, "abc " * 3000), (8, "x" * 5000), (None, "null id"), (3, "hello world"), (9, "a b\u0085c\x1cd"), (10, "\n\n  x\n y"),
]


@pytest.fixture(scope="module")
def odd(spark):
    # An extra column whose name clashes with names used inside.
    return spark.createDataFrame([(i, t, i, "x") for i, t in ODD], "doc_id long, text string, row long, shard string")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(TOKENIZER)
    return lambda text: np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, np.uint32)


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe._parsed(byte_bpe.read_ranks(RANKS))


def test_slices_and_merges_equal_tiktoken(ranks, monkeypatch):
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder, decode = byte_bpe.SliceCache(byte_bpe.RankMerger(ranks), limit=50), byte_bpe.Decoder(ranks)
    signs = ["'", " ", "\n", "\t", "s", "t", "re", "ve", "ll", "'s", "a", "B", "é", "ß", "1", "²", "!", "　", "\xa0", "\x85", "中", "👍", "_"]
    rng = random.Random(3)
    for window in (17, shared.BATCH_CHARS):  # windows cut anywhere give the same slices
        monkeypatch.setattr(byte_bpe, "BATCH_CHARS", window)
        for _ in range(40):
            texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 50))) for _ in range(10)] + ["a" * 300, "!?" * 99]
            ids, sizes, _ = coder.encode(texts)
            for text, own in zip(texts, np.split(ids, np.cumsum(sizes)[:-1])):
                assert own.tolist() == encoding.encode_ordinary(text)
                assert decode(own) == text.encode()


def test_scan_equals_walk():
    products, table, starts = byte_bpe.transition_monoid()
    symbols = np.random.default_rng(0).integers(0, 9, 10_000).astype(np.uint8)
    state, walked = 0, []
    for x in symbols.tolist():
        walked.append(state)
        state = byte_bpe._step(x, state)[0]
    assert table[byte_bpe.scanned(symbols), 0].tolist() == walked


def test_encode_and_decode_columns(spark, odd, library):
    rows = byte_bpe.encode_documents(odd, RANKS, offsets=True).withColumn(
        "back", byte_bpe.decoder(spark, RANKS)("encoded.ids")).collect()
    assert len(rows) == len(ODD)
    for row in rows:
        assert np.frombuffer(row.encoded.ids, "<u4").tolist() == library(row.text).tolist()
        assert bytes(row.back) == (row.text or "").encode()
        assert np.frombuffer(row.encoded.slice_ids, "<u4").sum() * 4 == len(row.encoded.ids)
    assert byte_bpe.encode_documents(odd.limit(0), RANKS).count() == 0
    one = byte_bpe.encode_documents(spark.createDataFrame([("It's we'll go", k) for k in (0, 1, 4, 5, None)], "text string, k long"), RANKS, offsets=True)
    found = one.withColumn("back", byte_bpe.decoder(spark, RANKS)(byte_bpe.slice_of(F.col("encoded"), F.col("k")))).collect()
    assert [r.back and bytes(r.back) for r in found] == [b"It", b"'s", b" go", None, None]


def pieces_are_right(frame, texts, library, length):
    """Every document cut as stated, every sequence gapless and within its length."""
    rows = frame.collect()
    expected = {}
    for key, text in texts:
        ids = np.append(library(text), np.uint32(0))
        first = len(ids) - (-(-len(ids) // length) - 1) * length
        cuts = [0, *range(first, len(ids), length), len(ids)] if len(ids) > length else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            piece = (key, k, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes()))
            expected[piece] = expected.get(piece, 0) + 1
    got, places = {}, {}
    for r in rows:
        piece = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        got[piece] = got.get(piece, 0) + 1
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == expected
    for spans in places.values():
        at = 0
        for offset, size in sorted(spans):
            assert offset == at
            at += size
        assert at <= length
    return len(places)


def test_packing(spark, odd, library, monkeypatch):
    pieces_are_right(packing.pack_documents(odd, TOKENIZER), ODD, library, 2048)
    assert packing.pack_documents(odd.limit(0), TOKENIZER).count() == 0


def test_added_tokens_have_their_own_id(spark):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    mark = "<|endoftext|>"
    texts = [(1, f"a {mark} b"), (2, "plain text"), (3, mark), (4, f"x{mark}{mark} y\n"), (5, None), (6, "<|endoftext|"), (7, f"it's  {mark}")]

    def contract(text):
        return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, np.uint32)

    assert contract(texts[0][1]).tolist() == [64, 220, 50256, 275]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    pieces_are_right(packing.pack_documents(docs, TOKENIZER), texts, contract, 2048)
    start = 0
    for r, (key, text) in zip(token_files.round_trip(docs, TOKENIZER).orderBy("doc_id").collect(), texts):
        ids = np.append(contract(text), np.uint32(0))
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids)) == (key, start, len(ids), ids.astype("<u4").tobytes())
        start += len(ids)


def test_packing_in_rounds_wastes_little(spark):
    sizes = np.random.default_rng(5).integers(1, 1500, 4000)
    rows = spark.createDataFrame([(i, int(n)) for i, n in enumerate(sizes)], "row long, length long")
    placed = packing.pack(rows, 2048, shard_pieces=500).collect()
    fill = {}
    for r in placed:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(map(len, fill.values())) == 4000
    for spans in fill.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(spans), sorted(spans)[1:])) and sum(n for _, n in spans) <= 2048
    assert len(fill) <= 1.02 * sizes.sum() / 2048


def test_sum_of_squares_is_the_rule():
    sizes, capacity = np.random.default_rng(1).integers(1, 12, 300), 20
    bins, offsets = packing.sum_of_squares(sizes, capacity)
    fill = {}
    for size, b, offset in zip(sizes.tolist(), bins.tolist(), offsets.tolist()):
        assert fill.get(b, 0) == offset

        def cost(target, size=size):
            after = dict(fill)
            after[target] = after.get(target, 0) + size
            counts = np.bincount([f for f in after.values() if f < capacity], minlength=capacity)
            return int((counts ** 2).sum())

        choices = [k for k, f in fill.items() if f + size <= capacity and f < capacity] + [max(fill, default=-1) + 1]
        assert cost(b) == min(map(cost, choices))
        fill[b] = offset + size


def test_token_files(spark, odd, library, tmp_path):
    token_files.write_token_files(odd, str(tmp_path / "files"), TOKENIZER, block_tokens=500)
    rows = token_files.read_token_files(spark, str(tmp_path / "files")).orderBy("start").collect()
    at, key = 0, lambda r: (r[0] is not None, r[0] or 0)
    assert [r.doc_id for r in rows] == [i for i, _ in sorted(ODD, key=key)]
    texts = {}
    for i, t in ODD:
        texts.setdefault(i, []).append(np.append(library(t), np.uint32(0)).tolist())
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == at and r.n_tokens == len(ids)
        texts[r.doc_id].remove(ids)
        at += len(ids)
    assert token_files.round_trip(odd.limit(0), TOKENIZER).count() == 0


def test_control_bytes_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 3, 4, 5, 1000):
        values = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, data = token_files.pack_ids(values)
        assert len(control) == -(-n // 4)
        assert np.array_equal(token_files.unpack_ids(control, data, n), values)


def made_up(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        lang = "ab" if i % 2 else "xy"
        text = made_up(rng, "abcdefg" if i % 2 else "tuvwxyz", rng.randint(3, 60))
        toxic, good = int(i % 5 == 0), int(i % 3 > 0)
        if toxic:
            text = text.replace(" ", f" sc{'o' * rng.randint(1, 3)}undrel ", 1)
        if not good:
            text = text.upper().replace(" ", "!! ")
        rows.append((i, text, lang, "s"))
        labels.append((i, good, toxic))
    rows += [(None, "abc", None, "s"), (1000, None, None, "s"), (1001, "", "ab", None), (1002, "123 !?", None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    return docs, spark.createDataFrame(labels + [(None, 1, 1), (5000, 1, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers(labelled, module, label):
    docs, labels = labelled
    scored = module.scored(docs, labels, out="own").join(labels, "doc_id", "left").withColumn(
        "held", shared.held_out(docs["doc_id"])).collect()
    assert len(scored) == docs.count() and all(0 <= r.own <= 1 for r in scored)
    held = [r for r in scored if r.held and r[label] is not None]
    assert np.mean([(r.own >= 0.5) == (r[label] == 1) for r in held]) > 0.9


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_without_classes(labelled, module):
    docs, labels = labelled
    assert {r.own for r in module.scored(docs, labels.limit(0), out="own").collect()} == {0.0}
    one = labels.where("toxic = 1 and quality = 1 and doc_id is not null")
    assert {r.own for r in module.scored(docs, one, out="own").collect()} == {1.0}
    assert module.scored(docs.limit(0), labels, out="own").count() == 0


def test_language(labelled):
    docs, _ = labelled
    rows = language.identified(docs, out="own").withColumn("held", shared.held_out(docs["doc_id"])).collect()
    held = [r for r in rows if r.held and r.lang and r.text]
    assert np.mean([r.own.lang == r.lang for r in held]) > 0.95
    assert {r.own.lang for r in rows if r.doc_id in (1000, 1001, 1002)} == {"und"}
    assert {r.own.lang for r in language.identified(docs.drop("lang").selectExpr("*", "string(null) lang"), out="own").collect()} == {"und"}


def test_language_is_learnt_alike_however_rows_lie(spark, labelled, monkeypatch):
    """The same rows in one and in nine partitions, with repeats or without ids, give the same training data."""
    docs, _ = labelled
    seen = []

    class Recorder(language.Network):
        def fit(self, data, used, target, steps=0):
            seen.append((self.languages, data.tobytes(), used.tobytes(), target.tobytes()))
            return self

    monkeypatch.setattr(language, "Network", Recorder)
    for rows in (docs.repartition(1), docs.repartition(9), docs.unionByName(docs), docs.unionByName(docs.limit(5)).repartition(4)):
        language.train(rows, per_language=20)
    assert len(seen) == 4 and all(x == seen[0] for x in seen)
    same_id = docs.withColumn("doc_id", F.lit(3).cast("long"))
    no_id = docs.withColumn("doc_id", F.lit(None).cast("long"))
    for rows in (same_id, no_id):
        before = len(seen)
        language.train(rows, per_language=20)
        assert len(seen) == before + 1 and len(seen[-1][1]) > 0
    assert len(language.train(docs, per_language=20, most_languages=1).languages) == 1


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2)
    docs = spark.createDataFrame([(held, "some words", "en"), (held, "weitere Worte", "de")], "doc_id long, text string, lang string")
    assert {tuple(r.own) for r in language.identified(docs, out="own").collect()} == {("und", 0.0)}


def test_positions_are_labelled(labelled):
    docs, _ = labelled
    network = language.train(docs)
    rows = language.labelled_positions(docs, network, out="own").collect()
    agreed = total = 0
    for r in rows:
        assert [x.start for x in r.own] == [0, *[x.end for x in r.own]][:len(r.own)]
        assert sum(x.end - x.start for x in r.own) == len((r.text or "").encode())
        if r.lang in network.languages and r.text:
            agreed += sum(x.end - x.start for x in r.own if x.lang == r.lang)
            total += len(r.text.encode())
    assert agreed > 0.7 * total


def test_network_gradient():
    network = language.Network(["a", "b", "c"], hidden=3)
    network.weights = {k: v.astype(np.float64) for k, v in network.weights.items()}
    rng = np.random.default_rng(0)
    data, used, target = rng.integers(0, 256, (4, 6)).astype(np.uint8), np.array([6, 6, 4, 1]), np.array([0, 1, 2, 0])

    def loss():
        ways = [network._run(data, way, None) for way in (0, 1)]
        scores = np.stack([np.concatenate(x, axis=1) for x in zip(*ways)], axis=1) @ network.weights["out"] + network.weights["bias"]
        log_p = scores - np.log(np.exp(scores).sum(axis=2, keepdims=True))
        own = log_p[np.arange(4), :, target]
        return -(own * (np.arange(6) < used[:, None])).sum() / used.sum()

    grad = network.gradient(data, used, target)
    for name, place in (("out", (1, 2)), ("bias", (0,)), ("re0", (1, 4)), ("re1", (2, 7)), ("in0", (data[0, 2], 5)), ("in1", (data[1, 1], 1))):
        w, step = network.weights[name], 1e-4
        w[place] += step
        above = loss()
        w[place] -= 2 * step
        below = loss()
        w[place] += step
        assert grad[name][place] == pytest.approx((above - below) / (2 * step), rel=2e-2, abs=1e-5)


def test_fast_network_equals_plain():
    network, rng = language.Network(["a", "b"]), np.random.default_rng(1)
    data, used = rng.integers(0, 256, (5, 7)).astype(np.uint8), np.array([7, 7, 3, 1, 5])
    ways = [network._run(data, way, None) for way in (0, 1)]
    scores = np.stack([np.concatenate(x, axis=1) for x in zip(*ways)], axis=1) @ network.weights["out"] + network.weights["bias"]
    log_p = scores - np.log(np.exp(scores).sum(axis=2, keepdims=True))
    expected = (log_p * (np.arange(7) < used[:, None])[:, :, None]).sum(axis=1)
    assert network.summed_log_odds(data, used) == pytest.approx(expected, rel=1e-3, abs=1e-3)


def plain_margin(model, text):
    """The worst window of a text by loops over words and subwords, with buckets of one word at a time."""
    slope = model.weights[:, 1].astype(float) - model.weights[:, 0]
    each = []
    for word in toxicity.words_of(text):
        buckets, _ = toxicity.subwords([word])
        each.append(sum(float(model.table[b].astype(float) @ slope) for b in buckets.tolist()) / len(buckets))
    if len(each) <= toxicity.WINDOW:
        found = sum(each) / len(each) if each else 0.0
    else:
        found = max(sum(each[i:i + toxicity.WINDOW]) / toxicity.WINDOW for i in range(len(each) - toxicity.WINDOW + 1))
    return found + float(model.intercept[1]) - float(model.intercept[0])


def test_toxicity_scores_equal_plain_loops(labelled, spark):
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    texts = [r.text for r in docs.limit(40).collect()] + ["", None, "word " * 30, " ".join(f"w{i}" for i in range(20_000))]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.own for r in toxicity.scored(frame, labels, out="own", model=model).collect()}
    for i, text in enumerate(texts[:-1]):
        z = model.scale[0] * plain_margin(model, text or "") + model.scale[1]
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)
    assert 0 <= got[len(texts) - 1] <= 1


def test_toxicity_gradient():
    """One step's slopes against differences of the loss, written out for whole bags."""
    model = toxicity.BagModel()
    model.table, model.weights, model.intercept = (v.astype(np.float64) for v in (model.table, model.weights, model.intercept))
    bags, labels = [["bad", "word", "bad"], ["fine", "words", "here"], ["other", "fine"]], np.array([1, 0, 0])
    ids = {}
    coded = [np.array([ids.setdefault(w, len(ids)) for w in b], np.int32) for b in bags]
    buckets, counts = toxicity.subwords(list(ids))
    weights = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))

    def loss(table, out, intercept):
        total = 0.0
        for bag, y, w in zip(bags, labels, weights):
            means = [table[toxicity.subwords([word])[0]].mean(axis=0) for word in bag]
            scores = np.mean(means, axis=0) @ out + intercept
            total += w * (np.log(np.exp(scores).sum()) - scores[y])
        return total / len(bags)

    before = [v.copy() for v in (model.table, model.weights, model.intercept)]
    model._state = [[np.zeros_like(v), np.zeros_like(v)] for v in before]
    model._steps = 0
    model._epoch(coded, labels, buckets, counts, np.random.default_rng(0))
    used = int(toxicity.subwords(["bad"])[0][0])
    for k, places in ((0, [(used, 0), (used, 3)]), (1, [(0, 0), (3, 1)]), (2, [(0,), (1,)])):
        for place in places:
            ends = []
            for step in (1e-5, -1e-5):
                moved = [v.copy() for v in before]
                moved[k][place] += step
                ends.append(loss(*moved))
            assert model._state[k][0][place] / 0.1 == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-3, abs=1e-7)


def test_quality_scores_equal_plain_compression(labelled, spark):
    """Sizes by the library's plain calls, piece by piece over whole texts."""
    docs, labels = labelled
    model = quality.train(docs, labels)
    texts = [r.text for r in docs.limit(30).collect()] + ["", None, "the same few words " * 20_000]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.own for r in quality.scored(frame, labels, out="own", model=model).collect()}
    for i, text in enumerate(texts):
        data, sizes = (text or "").encode(), []
        for shared in (model.good, model.bad):
            coder = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(shared), write_content_size=False,
                                             write_dict_id=False)
            sizes.append(sum(len(coder.compress(data[k:k + quality.PIECE])) for k in range(0, len(data), quality.PIECE)))
        good, bad = sizes
        difference = (bad - good) / (bad + good + quality.SHORT) if good + bad else 0.0
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(model.scale[0] * difference + model.scale[1]))), abs=0.02)


def test_unseen_misspelling_is_caught():
    rng = random.Random(6)
    texts = [made_up(rng, "abcdefg", rng.choice([20, 200, 1000])) + (" villainous" if i % 2 else "") for i in range(400)]
    model = toxicity.BagModel().fit(texts, np.array([i % 2 for i in range(400)]))
    scores = toxicity.Scorer(model)([made_up(rng, "abcdefg", 2000) + " villlainouss", made_up(rng, "abcdefg", 2000), ""])
    assert scores[0] > 0.5 > scores[1] and 0 <= scores[2] <= 1


def test_logistic_recovers_a_slope():
    rng = np.random.default_rng(0)
    x = rng.normal(size=20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(int)
    assert logistic(x, y) == pytest.approx((2, -1), abs=0.1)


def test_simhash_windows(monkeypatch):
    rng = random.Random(8)
    texts = [made_up(rng, "abcdef", n) for n in (0, 1, 2, 3, 4, 5, 200, 1000)] + ["", "A b\x0bC  d e", None or "x"]
    expected = simhash.fingerprints(texts)
    monkeypatch.setattr(simhash, "WINDOW", 37)
    assert np.array_equal(simhash.fingerprints(texts), expected)
    assert [simhash.fingerprints([t])[0] for t in texts] == expected.tolist()


def test_scan_equals_plain_composition():
    rng = np.random.default_rng(7)
    products, table, _ = byte_bpe.transition_monoid()
    for n in (1, 64, 65, 4097, 5000):
        functions = rng.integers(0, 9, n).astype(np.uint8)
        now, plain = len(table) - 1, []
        for f in functions.tolist():
            plain.append(now)
            now = int(products[now, f])
        assert byte_bpe.scanned(functions).tolist() == plain


def test_ids_of_one_to_four_bytes_come_back():
    rng = np.random.default_rng(8)
    for n in (0, 1, 3, 4, 5, 1000):
        ids = (rng.integers(0, 1 << 32, n) >> rng.choice([0, 8, 16, 24], n)).astype(np.uint32)
        found = token_files.unpack_ids(*token_files.pack_ids(ids), n)
        assert found.tolist() == ids.tolist() and found.dtype == np.uint32


@pytest.mark.parametrize("hashed", ["own", "all alike"])
def test_short_slices_are_found_in_arrays(monkeypatch, hashed):
    if hashed == "all alike":  # every slice at the same place: they are still told apart
        monkeypatch.setattr(byte_bpe.SliceCache, "_hash", lambda self, low, high: np.full(len(low), (1 << self.bits) - 2))
    merged = []
    coder = byte_bpe.SliceCache(lambda words: merged.append(words) or [[*w, 1000 + len(w)] for w in words], limit=10_000)
    # Of 1 to 40 bytes; some differ only by a zero byte at the end, or after the eighth byte.
    words = ["!" * n + end for n in range(1, 38) for end in ("", "\0", "\0\0", "?", "—")]
    words += [] if hashed == "all alike" else ["x%s" % "".join(chr(97 + int(d)) for d in str(i)) for i in range(3000)]
    for _ in range(2):
        ids, per_text, per_slice = coder.encode(words)
        assert ids.tolist() == [i for w in words for i in (*w.encode(), 1000 + len(w.encode()))]
        assert per_text.tolist() == per_slice.tolist() == [len(w.encode()) + 1 for w in words]
    assert [w.decode() for w in merged[0]] == list(dict.fromkeys(words)) and len(merged) == 1
    assert {w.decode() for w in coder.index} == {w for w in words if len(w.encode()) > 15}
