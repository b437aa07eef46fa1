"""Conversation repair, BPE with word ends and vector codes against brute force, on small and odd inputs."""

import functools
import hashlib
import itertools
import json
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabulon.llm import catalog, conversation_repair, metric_trees, word_bpe

WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "hello world", " \t\n ", "Don't STOP 'stuff ''s 's's x'y're we'LL", "naïve ½ ²³ 中文 👍🏽 ΑΣ Σ", "x" * 9000, "the<|endoftext|>end",
       "<|startoftext|>", "a\u0085b\x1cc", "éÉ ẛ̣ İİ", "\U0001fae9 Ᲊ", "<w> </w> </ w>", "1234 5", "ﬁ Ǆ ß ẞ", "가각힣 ᄀ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def settings():
    with open(WORDS, encoding="utf-8") as file:
        return file.read()


# ---- BPE with word ends -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("window", [7, 1_000_000])
def test_fragments_equal_the_library(library, settings, monkeypatch, window):
    monkeypatch.setattr(word_bpe, "BATCH_CHARS", window)
    model = json.loads(settings)["model"]
    coder = word_bpe.FragmentCoder(library, model, ["<|startoftext|>", "<|endoftext|>"], limit=300)
    decode = word_bpe.word_decoder(settings)
    signs = ["'", "'s", "'re", " ", "\n", "S", "t", "é", "É", "Σ", "1", "½", "!", "?!", "中", "한", "👍", "_", "th", "ing", "\xa0", "é", "İ", "zq"]
    rng = random.Random(5)
    for _ in range(30):
        texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(12)] + ODD
        ids, sizes = coder.encode(texts)
        for text, own in zip(texts, np.split(ids, np.cumsum(sizes)[:-1])):
            want = library.encode(text, add_special_tokens=False).ids
            assert own.tolist() == want, text
            assert decode(own) == library.decode(want, skip_special_tokens=False)


def test_cuts_are_forced(settings):
    """No token of the vocabulary holds a pair that is cut, and pairs that are cut do occur in texts."""
    model = json.loads(settings)["model"]
    boundaries = word_bpe.ForcedBoundaries(model)
    found, _ = boundaries.fragments("zqxj qqzz hello the\n")
    assert b"the" in found and any(f.startswith(b" ") for f in found)
    for word in ("zqxj", "qqzz"):
        assert b"".join(f.strip() for f in boundaries.fragments(word + "\n")[0]) == word.encode()
    merge = boundaries._merge_long
    for fragment in (b"hello", b"internationalization", b" internationali", b"aaaaaaaaaaaaaaaaaaaaaaaaa"):
        body = np.frombuffer(fragment.strip(), np.uint8).astype(int)
        body[-1] += 256 * (not fragment.startswith(b" "))
        assert merge(boundaries.single[body].tolist()) == boundaries.merge(fragment)


def test_every_assigned_code_point(library, settings):
    coder = word_bpe.word_coder(settings)
    points = [chr(i) for i in [*range(0x3100), *range(0xA000, 0xD800, 7), *range(0xF900, 0x1F000, 5)]
              if not 0xD800 <= i < 0xE000]
    texts = [f"a{c}b '{c}s 1{c}{c}!{c}" for c in points]
    ids, sizes = coder.encode(texts)
    want = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want


def test_word_columns(spark, library):
    rows = [(i, t, "x") for i, t in enumerate([*ODD, None, "hello world"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    out = word_bpe.encode_documents(docs, WORDS).withColumn("back", word_bpe.decoder(spark, WORDS)("ids")).collect()
    assert len(out) == len(rows)
    for row in out:
        want = library.encode(row.text or "", add_special_tokens=False).ids
        assert np.frombuffer(row.ids, "<u4").tolist() == want
        assert row.back == library.decode(want, skip_special_tokens=False)
    assert word_bpe.encode_documents(docs.limit(0), WORDS).count() == 0


def test_other_settings_go_through_the_library(spark, settings, tmp_path):
    other = json.loads(settings)
    other["normalizer"], other["decoder"] = None, {"type": "BPEDecoder", "suffix": "</w>"}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(other), encoding="utf-8")
    library = Tokenizer.from_file(str(path))
    docs = spark.createDataFrame([("Hello World, ok",), ("",)], "text string")
    for row in word_bpe.encode_documents(docs, str(path)).withColumn("back", word_bpe.decoder(spark, str(path))("ids")).collect():
        want = library.encode(row.text, add_special_tokens=False).ids
        assert np.frombuffer(row.ids, "<u4").tolist() == want and row.back == library.decode(want, skip_special_tokens=False)


def test_word_query(spark, sf, library):
    rows = {r.doc_id: r for r in catalog.QUERIES["op12_word_bpe"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for doc in docs:
        ids = library.encode(doc.text, add_special_tokens=False).ids
        row = rows[doc.doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# ---- conversation repair ------------------------------------------------------------------------------------------------


def cheapest(symbols):
    """Smallest (cost, audit) over all sequences of edits with at most two insertions in a row."""
    after = {"0": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def edits(state, symbol):
        yield 2, "D", state
        if symbol != "x":
            extra = 5 if symbol.isupper() else 0
            for role, to in after[state].items():
                if role == symbol.lower():
                    yield extra, "K", to
                if role in "ua":
                    yield 1 + extra, "R", to

    @functools.cache
    def best(i, state, inserted):
        found = [(0, "")] if i == len(symbols) and state in "0a" else []
        if i < len(symbols):
            for cost, letter, to in edits(state, symbols[i]):
                if rest := best(i + 1, to, 0):
                    found.append((cost + rest[0], letter + rest[1]))
        if inserted < 2:
            for role, to in after[state].items():
                if role in "ua" and (rest := best(i, to, inserted + 1)):
                    found.append((5 + rest[0], "I" + rest[1]))
        return min(found, default=None)

    return best(0, "0", 0)


def test_lightest_derivations_equal_all_derivations():
    kinds = "suaoSUAOx"
    for n in range(4):
        for symbols in map("".join, itertools.product(kinds, repeat=n)):
            assert conversation_repair.repair(symbols) == cheapest(symbols)
    rng = random.Random(1)
    for _ in range(300):
        symbols = "".join(rng.choices(kinds, k=rng.randint(4, 14)))
        assert conversation_repair.repair(symbols) == cheapest(symbols)


def test_spans_join_to_the_whole(monkeypatch):
    rng = random.Random(2)
    for chunk in (1, 3):
        monkeypatch.setattr(conversation_repair, "CHUNK", chunk)
        for _ in range(200):
            symbols = "".join(rng.choices("suaoUAx", k=rng.randint(2, 20)))
            assert conversation_repair.repair(symbols) == cheapest(symbols)


TURNS = [
    (1, 0, "system", "Be brief."), (1, 1, "user", "Hi there"), (1, 2, "assistant", "Hello."), (1, 5, "user", "Bye!"), (1, 5, "user", "Bye!"),
    (2, None, "user", "What?"), (2, None, None, "Null role."), (2, 3, "assistant", None), (2, 4, "", "Empty role."), (3, 1, "user", " \t\r\n"),
    (None, 1, "user", "No id."), (None, 2, "assistant", "None at all. "), (4, 7, "assistant", "中文。 x!"), (5, None, "tool", "a\nb:c."),
    (6, 1, "user", "long " * 5000 + "."), (6, 2, "assistant", "long " * 5000)] + [
    (7, i, ["user", "assistant", "system", "other"][i * 7 % 4], ["Yes.", "No", "", f"Text {i}!"][i * 5 % 4]) for i in range(60)]


@pytest.fixture(scope="module")
def turns(spark):
    # Extra columns whose names clash with names used inside.
    return spark.createDataFrame([(*t, 1, "x") for t in TURNS], "conv_id long, turn long, role string, text string, times int, seq string")


def expected_summary(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode()))
    symbols, faults, seen = "", {"blank": 0, "duplicate": 0, "truncated": 0}, set()
    for _, _, role, text in rows:
        visible = text.strip(" \t\n\v\f\r")
        fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        kind = role[:1] if role[:1] and role[:1] in "sua" else "o"
        symbols += {"blank": "x", "duplicate": "x", "truncated": kind.upper()}.get(fault, kind)
    cost, audit = cheapest(symbols)
    lines, state, left = [], "0", list(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else left.pop(0)[2:]
        if edit in "RI":
            role = "assistant" if state == "u" else "user"
        if edit != "D":
            lines.append(f"{role}:{text}")
            state = role[0]
    known = {t for _, t, _, _ in rows if t is not None}
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    return (gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), lines


@pytest.mark.parametrize("limits", [{}, {"long_rows": 1, "segment_rows": 3}, {"long_bytes": 100, "segment_rows": 1}])
def test_conversations_short_and_long(spark, turns, limits):
    given = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in TURNS]
    rows = conversation_repair.read_turns(turns)
    found = {r.conv_id: tuple(r)[1:] for r in conversation_repair.repair_conversations(rows, **limits).collect()}
    places = {}
    for r in sorted(conversation_repair.repaired_turns(rows, **limits).collect(), key=lambda r: (str(r.conv_id), r.place)):
        places.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    ids = {c for c, *_ in TURNS}
    assert set(found) == ids
    for conv in ids:
        summary, lines = expected_summary([r for r in given if r[0] == conv])
        assert found[conv] == summary, conv
        assert places.get(conv, []) == lines


def test_damaged_conversations(spark, sf, turns):
    rows = conversation_repair.damaged(conversation_repair.read_turns(turns))
    assert rows.count() == len(TURNS)
    whole = conversation_repair.repair_conversations(rows).collect()
    assert {r.conv_id for r in whole} == {c for c, *_ in TURNS}
    assert sorted(map(str, whole)) == sorted(map(str, conversation_repair.repair_conversations(rows, long_rows=2, segment_rows=2).collect()))
    none = conversation_repair.read_turns(turns).withColumn("times", F.lit(0))
    row = conversation_repair.repair_conversations(none.where("conv_id = 1")).first()
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert conversation_repair.repair_conversations(rows.limit(0)).count() == 0


# ---- vector codes -------------------------------------------------------------------------------------------------------


def plain_codes(points, parts=4, entries=256, rounds=4):
    """By comparing everything; points are integers, ordered by id."""
    cut = points.reshape(len(points), parts, -1)
    books = cut[:entries].transpose(1, 0, 2).copy()
    for k in range(rounds + 1):
        squares = ((cut[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        codes = squares.argmin(axis=2)
        if k < rounds:
            for p in range(parts):
                for e in np.unique(codes[:, p]):
                    books[p, e] = cut[codes[:, p] == e, p].sum(axis=0) // (codes[:, p] == e).sum()
    return codes, squares.min(axis=2).sum(axis=1), books


def sample_points(kind, rng):
    if kind == "clusters":
        return rng.integers(-5000, 5000, (40, 8))[rng.integers(0, 40, 900)] + rng.integers(-3, 4, (900, 8))
    if kind == "ties":
        return rng.integers(0, 3, (700, 8))
    if kind == "copies":
        return np.repeat(rng.integers(-9, 9, (3, 8)), 300, axis=0)
    return rng.integers(-(1 << 26), 1 << 26, (500, 8)) if kind == "large" else rng.integers(-1000, 1000, (600, 8))


@pytest.mark.parametrize("kind", ["clusters", "ties", "copies", "large", "spread"])
def test_trees_equal_comparing_everything(kind):
    rng = np.random.default_rng(4)
    points = sample_points(kind, rng)
    tree = metric_trees.build_tree(points)
    assert sorted(tree.order.tolist()) == list(range(len(points)))
    for ball in range(len(tree.count)):
        inside = points[tree.order[tree.first[ball]:tree.first[ball] + tree.count[ball]]]
        assert (tree.sums[ball] == inside.sum(axis=0)).all()
        assert np.sqrt(((inside - tree.pivots[ball]) ** 2).sum(axis=1)).max() <= tree.radius[ball] * (1 + 1e-9) + 1e-9
    book = points[:100].copy()
    squares = ((points[:, None, :] - book[None]) ** 2).sum(axis=2)
    want = squares.argmin(axis=1)
    assert (metric_trees.assigned(tree, points, book) == want).all()
    counts, sums = metric_trees.round_sums(tree, points, book)
    assert (counts == np.bincount(want, minlength=100)).all()
    assert all((sums[e] == points[want == e].sum(axis=0)).all() for e in range(100))
    owned = sum(int(tree.count[b]) for b, c in metric_trees.owners(tree, book[:8]) if len(c) == 1)
    if kind in ("clusters", "copies"):
        assert owned > len(points) * 0.5  # whole balls are owned, their points never looked at


@pytest.mark.parametrize("block", [50, 8192])
def test_codes_equal_comparing_everything(spark, monkeypatch, block):
    monkeypatch.setattr(metric_trees, "BLOCK", block)
    rng = np.random.default_rng(6)
    vectors = np.round(rng.normal(0, 1, (400, 8)), 2)
    vectors[100:160] = vectors[7]
    rows = [(i, v.tolist(), None if i % 5 == 0 else i % 3) for i, v in enumerate(vectors)]
    odd = [(900, None, 1), (901, [1.0, None] * 4, 1), (902, [float("nan")] * 8, 1), (903, [float("-inf")] + [0.0] * 7, None), (904, [], 1),
           (None, vectors[3].tolist(), 1)]
    table = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<double>, label int, code string").repartition(3)
    out = {r.vec_id: r for r in metric_trees.vector_codes(table, entries=64).collect()}
    kept = rows + [odd[-1]]
    points = np.floor(1024 * np.array([v for _, v, _ in kept])).astype(np.int64)
    codes, errors, books = plain_codes(points, entries=64)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    assert len(out) == len(kept)
    for (vec, _, label), code, error in zip(kept, codes, errors):
        row = out[vec]
        assert row.code == "".join(f"{c:02x}" for c in code) and row.error == error and row.codebooks_sha256 == digest
        assert row.label_error == sum(e for (_, _, x), e in zip(kept, errors) if x == label)
    assert set(next(iter(out.values())).asDict()) == {"vec_id", "code", "error", "label_error", "codebooks_sha256"}


def test_few_no_and_unfit_vectors(spark):
    schema = "vec_id long, embedding array<double>, label int"
    few = spark.createDataFrame([(2, [0.5, 0.25, 1.0, -1.0], None), (1, [0.5, 0.25, 1.0, -1.0], None)], schema)
    assert [(r.code, r.error, r.label_error) for r in metric_trees.vector_codes(few).collect()] == [("00000000", 0, 0)] * 2
    assert metric_trees.vector_codes(few.limit(0)).count() == 0
    assert metric_trees.vector_codes(spark.createDataFrame([(1, None, 1)], schema)).count() == 0
    for rows in ([(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], [(1, [1.0] * 6, 1)], [(1, [1e30] * 4, 1)]):
        with pytest.raises(Exception, match="different lengths|equal parts|too large"):
            metric_trees.vector_codes(spark.createDataFrame(rows, schema)).collect()
