"""Language, quality, decontamination, pieces, sketches and extraction: held-out accuracy, brute force, round trips."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import time

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece

from folioweave.llm import decontaminate, language_id, line_quality, paragraph_sketch, piece_transducer, queries, wrapper_extract

SF = "/root/testdata/sf0.01"
SHAPE = "doc_id long, text string, lang string, id string, score string"


def frame(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, (langs or {}).get(i), "x", "y") for i, t in enumerate(texts)], SHAPE)


# Language identification


def test_language_held_out_accuracy(spark):
    got = queries.op8_language_id(spark, SF).toPandas()
    truth = duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").df()
    both = got.merge(truth, on="doc_id")
    held = both[both.held_out]
    assert len(got) == len(truth) and 0.2 < got.held_out.mean() < 0.3
    assert (held.lang == held.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()


def test_language_edge_cases(spark):
    words = {"en": "the cat sat on the warm mat and looked at the other cats", "de": "die katze schläft auf dem sofa und der hund bellt laut"}
    texts = [words["en"]] * 5 + [words["de"]] * 5
    model = language_id.learn(frame(spark, texts, {i: ("en" if i < 5 else "de") for i in range(10)}))
    probe = [None, "", "123 !!", "é", "the mat", "der hund", "ЖЖ"]
    found = {r.doc_id: r for r in language_id.identify(frame(spark, probe), model).collect()}
    assert [found[i].lang_pred for i in range(3)] == ["und"] * 3 and found[0].score == 0
    assert found[4].lang_pred == "en" and found[5].lang_pred == "de" and found[3].lang_pred in words
    assert sorted(r.doc_id for r in language_id.keep_known(frame(spark, probe), model).collect()) == [4, 5]
    assert language_id.learn(frame(spark, texts)) is None
    assert [r.lang_pred for r in language_id.identify(frame(spark, ["a text"]), None).collect()] == ["und"]
    assert language_id.identify(frame(spark, []), model).count() == 0


def test_language_counts_match_brute_force():
    texts = ["The cat", "", "Äh, 12", "a"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    grams, bounds, live = language_id.byte_grams(raw, offsets)
    for k, t in enumerate(texts):
        folded = b" " + bytes(language_id.FOLD[list(t.encode())].tolist() if t else []) + b" "
        want = [folded[i : i + 4] for i in range(len(folded) - 3)]
        assert [int(g).to_bytes(4, "little") for g in grams[bounds[k] : bounds[k + 1]]] == want
        assert list(live[bounds[k] : bounds[k + 1]]) == [w != b"    " for w in want]


def test_language_predictions_match_exact_sets(spark):
    """Plain sets of n-grams instead of filters: the same languages, shares within the filters' error."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.learn(docs)
    texts = {r.doc_id: (r.text, r.lang) for r in docs.collect()}
    grams_of = lambda t: [g for b in [b" " + language_id.FOLD[list(t.encode())].tobytes() + b" "] for g in (b[i : i + 4] for i in range(len(b) - 3)) if g != b"    "] if t else []
    counts = {}
    for t, x in texts.values():
        if t is not None and x is not None:
            counts.setdefault(x, collections.Counter()).update(grams_of(t))
    # Counts by batch of the library leave out what is rare in all of a language's sample only.
    counts = {x: {g: n for g, n in c.items() if n >= language_id.LEAST} for x, c in counts.items()}
    share = {x: {g: n / sum(c.values()) for g, n in c.items()} for x, c in counts.items()}
    most = {}
    for c in share.values():
        for g, f in c.items():
            most[g] = max(most.get(g, 0), f)
    own = {x: {g for g, f in c.items() if f >= language_id.SHARE * most[g]} for x, c in share.items()}
    for r in language_id.identify(docs.where("doc_id % 5 = 0"), model).collect():
        seen = grams_of(texts[r.doc_id][0] or "")
        if r.lang_pred != "und" and len(seen) > 30:
            got = {x: sum(g in s for g in seen) / len(seen) for x, s in own.items()}
            assert got[r.lang_pred] >= max(got.values()) - 0.02 and r.cover == pytest.approx(got[r.lang_pred], abs=0.02)


def test_more_than_64_languages_and_long_texts(spark):
    rng = random.Random(8)
    vocab = {f"l{k:03d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(15)] for k in range(150)}
    say = lambda x, n: " ".join(rng.choice(vocab[x]) for _ in range(n))
    model = language_id.learn(frame(spark, [say(x, 120) for x in vocab], dict(enumerate(vocab))))
    assert model.languages == sorted(vocab) and model.table.shape[0] == 3
    probe = [*[say(x, 20) for x in vocab], "12 " * 2_000_000 + say("l077", 400_000)]
    assert [r.lang_pred for r in language_id.identify(frame(spark, probe), model).orderBy("doc_id").collect()] == [*vocab, "l077"]


def test_language_runs_of_long_texts(monkeypatch):
    raw = np.frombuffer(b"Some words of a text, 12 of them  or more", np.uint8)
    offsets = np.array([0, len(raw)])
    whole = language_id.byte_grams(raw, offsets)[0]
    monkeypatch.setattr(language_id, "RUN", 7)
    assert np.concatenate([g for _, g, _, _ in language_id.gram_runs(raw, offsets)]).tolist() == whole.tolist()


# Quality


def test_quality_held_out_accuracy(spark):
    got = queries.op10_line_quality(spark, SF).toPandas()
    truth = duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").df()
    held = got[got.held_out].merge(truth, on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.95
    assert held[held.quality == 1].predicted.mean() > 0.98 and held[held.quality == 0].predicted.mean() < 0.5


def test_chain_marginals_match_enumeration():
    rng = np.random.default_rng(3)
    bounds = np.array([0, 1, 5, 8])
    emit, move = rng.normal(size=8), rng.normal(size=(2, 2))
    good, moves, z = line_quality.marginals(emit, move, bounds)
    want, want_moves, total = np.zeros(8), np.zeros((2, 2)), 0.0
    for a, b in zip(bounds, bounds[1:], strict=False):
        n, parts = b - a, []
        for bits in range(2**n):
            y = [bits >> k & 1 for k in range(n)]
            parts.append((y, np.exp(sum(emit[a + k] for k in range(n) if y[k]) + sum(move[y[k - 1], y[k]] for k in range(1, n)))))
        own = sum(w for _, w in parts)
        total += np.log(own)
        for y, w in parts:
            want[a:b] += np.array(y) * w / own
            for k in range(1, n):
                want_moves[y[k - 1], y[k]] += w / own
    assert np.allclose(good, want) and np.allclose(moves, want_moves) and np.isclose(z, total)


@pytest.mark.parametrize("sizes", [[1, 40, 3], [3000, 1, 2], [33, 1100]])
def test_long_chains_match_steps(sizes):
    """The segments' scan against the plain recursion in log space."""
    rng = np.random.default_rng(sum(sizes))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    emit, move = rng.normal(size=bounds[-1]) * 4, rng.normal(size=(2, 2)) * 2
    want = np.zeros(len(emit))
    for a, b in zip(bounds, bounds[1:], strict=False):
        alpha, beta = np.zeros((b - a, 2)), np.zeros((b - a, 2))
        alpha[0] = 0, emit[a]
        for t in range(1, b - a):
            alpha[t] = np.logaddexp(alpha[t - 1, 0] + move[0], alpha[t - 1, 1] + move[1]) + [0, emit[a + t]]
        for t in range(b - a - 2, -1, -1):
            ahead = beta[t + 1] + [0, emit[a + t + 1]]
            beta[t] = np.logaddexp(move[:, 0] + ahead[0], move[:, 1] + ahead[1])
        odds = (alpha + beta)[:, 1] - (alpha + beta)[:, 0]
        want[a:b] = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
    assert np.allclose(line_quality.good_lines(emit, move, bounds), want) and np.allclose(line_quality.marginals(emit, move, bounds)[0], want)


def test_quality_of_long_texts_by_parts(monkeypatch):
    raw = np.frombuffer(("One line. two\n\nthree THREE three!\n$$ 12\n" * 60).encode(), np.uint8)
    offsets = np.array([0, len(raw)])
    model = line_quality.QualityModel(np.linspace(-1, 1, line_quality.N_OWN * 3 + 3), np.array([[1.0, -1.0], [-0.5, 0.8]]), (1.0, 0.0))
    whole = model.share(raw, offsets)
    many = model.share(np.concatenate([raw, raw[:50]]), np.array([0, len(raw), len(raw) + 50]))
    monkeypatch.setattr(line_quality, "BLOCK", 7)
    assert np.allclose(model.share(raw, offsets), whole) and np.allclose(many[0], whole)
    lines = np.frombuffer(b"x\n" * 1_000_000, np.uint8)
    monkeypatch.undo()
    began = time.perf_counter()
    model.share(lines, np.array([0, len(lines)]))
    assert time.perf_counter() - began < 20


def test_quality_edge_cases(spark):
    docs = frame(spark, ["good clean line.\nmore text here."] * 6 + ["!!! $$$ %%%\n### @@@"] * 6)
    labels = spark.createDataFrame([(i, 1 if i < 6 else 0) for i in range(12)] + [(None, 1), (3, None), (4, 1)], "doc_id long, quality int")
    model = line_quality.learn(docs, labels)
    probe = frame(spark, [None, "", "\n\n", "clean text here.", "%%% !!! $$$", "x" * 200_000])
    found = {r.doc_id: r for r in line_quality.score_quality(probe, model).collect()}
    assert len(found) == 6 and all(0 <= r.score <= 1 for r in found.values()) and found[0].score == found[1].score
    assert found[3].score > found[4].score
    assert line_quality.learn(docs, labels.limit(0)) is None
    assert line_quality.score_quality(docs.limit(0), model).count() == 0


# Decontamination


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_matches_brute_force():
    rng = np.random.default_rng(1)
    items = [rng.integers(0, 6, rng.integers(1, 15)).astype(np.uint64) for _ in range(60)]
    texts = [rng.integers(0, 6, rng.integers(1, 30)).astype(np.uint64) for _ in range(60)]
    score, end = decontaminate.align(items, texts)
    assert [int(s) for s in score] == [smith_waterman(list(a), list(b)) for a, b in zip(items, texts, strict=True)]
    assert all(smith_waterman(list(a), list(b[:e])) == s for a, b, e, s in zip(items, texts, end, score, strict=True))


def planted():
    rng = random.Random(7)
    vocab = [f"w{k}" for k in range(400)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [text(rng.randint(12, 40)) for _ in range(12)] + [["one", "two"], []]
    docs, truth = [], set()
    for d in range(60):
        body = text(rng.randint(50, 150))
        if d % 3 == 0:
            k = rng.randrange(12)
            copy = list(items[k])
            for _ in range(len(copy) // 8):
                spot = rng.randrange(len(copy))
                copy[spot : spot + 1] = rng.choice([[], ["zz"], [copy[spot], "yy"]])
            body[20:20] = copy
            truth.add((d, k))
        docs.append(" ".join(body).upper() if d % 2 else ",\n".join(body))
    return docs, items, truth


@pytest.mark.parametrize("block", [8_000_000, 300])
def test_decontamination_finds_edited_copies(spark, block):
    docs, items, truth = planted()
    docs += [None, "", "One, two!"]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(99, None)], "item_id long, text string")
    found = decontaminate.contaminated(frame(spark, docs), bench, block=block).collect()
    assert {(r.doc_id, r.item_id) for r in found} == truth | {(62, 12)}
    for r in found:
        words = [w for w in re.split(r"[^0-9a-z]+", docs[r.doc_id].lower()) if w]
        want = smith_waterman(items[r.item_id], words) / (2 * len(items[r.item_id]))
        assert r.score == pytest.approx(want) and smith_waterman(items[r.item_id], words[r.first_word : r.last_word + 1]) == round(want * 2 * len(items[r.item_id]))
    clean = decontaminate.keep_clean(frame(spark, docs), bench, block=block)
    assert {r.doc_id for r in clean.collect()} == set(range(63)) - {d for d, _ in truth} - {62} and clean.columns[0] == "doc_id"


def edited(rng, words, how):
    """A copy with every ``how``-th word changed, or that share of words at random."""
    return [f"new{rng.randrange(10**6)}" if (k % how == how - 1 if how > 1 else rng.random() < how) else w for k, w in enumerate(words)]


@pytest.mark.parametrize("how", [3, 4, 0.2, 0.3])
def test_decontamination_finds_what_all_pairs_find(spark, how):
    rng = random.Random(11)
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet' ORDER BY item_id LIMIT 40").fetchall()
    docs = [t or "" for _, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' WHERE length(text) < 4000 ORDER BY doc_id").fetchall()]
    split = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t.lower())
    for k, (_, text) in enumerate(items):
        own = docs[17 * k].split(" ")
        own[len(own) // 2 : len(own) // 2] = edited(rng, split(text), how)
        docs[17 * k] = " ".join(own)
    code = {}
    hashed = lambda t: np.array([code.setdefault(w, len(code)) for w in split(t)], np.uint64)
    texts = [hashed(t) for t in docs]
    want = set()
    for i, text in items:
        own = hashed(text)
        score, _ = decontaminate.align([own] * len(texts), texts)
        want |= {(d, i) for d in np.flatnonzero(score >= len(own)).tolist()}
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, docs), bench).collect()}
    assert found == want and len(want) >= 25
    assert {r.doc_id for r in decontaminate.keep_clean(frame(spark, docs), bench, block=2000).collect()} == set(range(len(docs))) - {d for d, _ in want}


def test_decontamination_recall_does_not_depend_on_the_corpus(spark):
    """Edited copies of all benchmark items among 50,000 documents."""
    rng = random.Random(12)
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet' ORDER BY item_id LIMIT 40").fetchall()
    split = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t.lower())
    copies, want = [], set()
    for k, (i, text) in enumerate(items * 4):
        own = split(text)
        copy = edited(rng, own, [3, 4, 0.2, 0.3][k // len(items)])
        copies.append((-1 - k, "before it all " + " ".join(copy) + " and after", None, "", ""))
        if smith_waterman(own, copy) >= len(own):
            want.add((-1 - k, i))
    many = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").crossJoin(spark.range(50).withColumnRenamed("id", "n"))
    docs = many.selectExpr("doc_id", "concat(text, ' ', n) AS text").unionByName(spark.createDataFrame(copies, SHAPE).select("doc_id", "text"))
    assert docs.count() >= 50_000
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).where("doc_id < 0").collect()}
    assert found >= want and len(want) >= 120


def test_decontamination_short_items_and_long_texts(spark):
    bench = spark.createDataFrame([(1, "Yes"), (2, "not ever"), (3, "a b c d e f g h"), (4, "")], "item_id long, text string")
    long = "word " * 3_000_000 + "a b x d e f y h " + "tail " * 1_000_000
    docs = ["oh yes", "not so ever", "so not ever again", long, "z" * 6_000_000 + " yes"]
    found = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(frame(spark, docs), bench).collect()}
    assert set(found) == {(0, 1), (2, 2), (3, 3), (4, 1)}
    assert found[3, 3].first_word == 3_000_000 and found[3, 3].last_word == 3_000_007 and found[3, 3].score == pytest.approx(10 / 16)


def test_decontamination_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e", "q")], "item_id long, text string, item string")
    bench = spark.createDataFrame([("one", "a b c d", 5)], "item_id string, text string, score int")
    assert [tuple(r)[:3] for r in decontaminate.contaminated(docs.withColumnRenamed("item_id", "id"), bench, id_col="id").collect()] == [(1, "one", 1.0)]
    assert decontaminate.keep_clean(docs, bench).count() == 0


def test_decontamination_empty(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    docs = frame(spark, ["some text", None])
    assert decontaminate.contaminated(docs, bench).count() == 0 and decontaminate.keep_clean(docs, bench).count() == 2
    assert decontaminate.contaminated(docs.limit(0), spark.createDataFrame([(1, "a b c d")], "item_id long, text string")).count() == 0


# SentencePiece

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_pieces_match_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(2)
    bits = ["a", "the", " ", "  ", "\n", "▁", "é", "日本", "🙂", "ing", " th", "\t", "1", ".", "\x00", "́", "hello world", "        "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["x" * 30_000, None, "<s> <0x41> <unk>"]
    for r in piece_transducer.encode_pieces(frame(spark, texts), MODEL).collect():
        t = texts[r.doc_id]
        assert r.ids == library.encode(t or ""), t
        assert r.decoded == (None if t is None else t.replace("▁", " ")) and r.round_trip == (t is None or "▁" not in t) and r.n_tokens == len(r.ids)
    assert piece_transducer.encode_pieces(frame(spark, []), MODEL).count() == 0


def field_bytes(number, value):
    """A protocol-buffer field: an integer, bytes, or a float."""
    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    if isinstance(value, float):
        return varint(number << 3 | 5) + np.float32(value).tobytes()
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def model_file(path, pieces, charsmap=b"", kind=1, prefix=1, tidy=1, byte_fallback=False):
    """A model file with the given (piece, score, type)."""
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + ([(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if byte_fallback else []) + pieces
    out = b"".join(field_bytes(1, field_bytes(1, p.encode()) + field_bytes(2, float(s)) + field_bytes(3, k)) for p, s, k in rows)
    out += field_bytes(2, field_bytes(3, kind) + (field_bytes(35, 1) if byte_fallback else b""))
    out += field_bytes(3, (field_bytes(2, charsmap) if charsmap else b"") + field_bytes(3, prefix) + field_bytes(4, tidy) + field_bytes(5, 1))
    path.write_bytes(out)
    return str(path)


def nfkc_table():
    """The library's own table of the usual normaliser."""
    proto = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    normal = next(v for k, v in piece_transducer._fields(proto) if k == 3)
    return dict(piece_transducer._fields(normal))[2]


@pytest.mark.parametrize(("nfkc", "byte_fallback", "prefix", "tidy"), [(True, False, 1, 1), (True, True, 1, 1), (False, False, 1, 0), (False, True, 0, 0), (True, True, 0, 1)])
def test_unigram_and_nfkc_models_match_the_library(tmp_path, nfkc, byte_fallback, prefix, tidy):
    rng = random.Random(9)
    alphabet = "abcdeé▁日1."
    pieces = {c: -rng.uniform(3, 9) for c in alphabet if c != "日"}
    while len(pieces) < 150:
        p = ("▁" if rng.random() < 0.5 else "") + "".join(rng.choice("abcdeé1") for _ in range(rng.randint(1, 5)))
        pieces.setdefault(p, -rng.uniform(1, 12))
    own = [(p, s, 1) for p, s in pieces.items()] + [("bad", 0.0, 4)]
    path = model_file(tmp_path / "m.model", own, nfkc_table() if nfkc else b"", 1, prefix, tidy, byte_fallback)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    encoder = piece_transducer.PieceEncoder(piece_transducer.compile_model(path))
    bits = ["ab", "cde", "é", "e\u0301", "日", "ﬁ", "Ａｂ", "①", "  ", " ", "\n", "\t", "½", "\u3000", "bad", "1.", "▁", "\u200b", "ｶﾞ", "x", "㍿"]
    for _ in range(1500):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        ids = encoder.encode(t)
        assert ids.tolist() == library.encode(t), repr(t)
        assert encoder.machine.decode(ids).decode("utf-8", "replace") == library.decode(ids.tolist()), repr(t)


def test_normaliser_is_the_librarys():
    machine = piece_transducer.Normaliser(piece_transducer._rules(nfkc_table()), False, True)
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", remove_extra_whitespaces=True, add_dummy_prefix=False, escape_whitespaces=True)
    rng = random.Random(4)
    for _ in range(3000):
        t = "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x600), rng.randrange(0x1E00, 0x2600), rng.randrange(0x3000, 0x3400), rng.randrange(0xF900, 0xFFEF)])) for _ in range(rng.randint(0, 20)))
        assert machine.marked(t) == library.normalize(t), repr(t)


def test_weights_take_the_shortest_path():
    machine = piece_transducer.Transducer(
        tree=piece_transducer._tree({"a": 1, "b": 2, "ab": 3, "ba": 4}), cost={0: 20.0, 1: 3.0, 2: 3.0, 3: 5.0, 4: 2.0}, halves={}, joined={}, rank={}, text=[b""] * 5,
        byte=None, unknown=0, bpe=False, normal=piece_transducer.Normaliser({}, False, False), cuttable=True, runs={}, inner=set(),
    )
    assert machine.path("aba") == [1, 4] and machine.path("ab") == [3] and machine.part("xyb") == [0, 2]


def test_memory_of_pairs_is_bounded(monkeypatch):
    monkeypatch.setattr(piece_transducer, "REMEMBERED", 50)
    encoder = piece_transducer.PieceEncoder(piece_transducer.compile_model(MODEL))
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(1)
    for _ in range(60):
        t = " ".join("".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(20))
        assert encoder.encode(t).tolist() == library.encode(t) and len(encoder.machine._pairs) <= 51


# Fingerprints


def test_sketches_match_brute_force(spark):
    rng = random.Random(4)
    sentence = lambda: " ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(rng.randint(2, 9))) + "."
    texts = ["\n".join(" ".join(sentence() for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 12))) for _ in range(30)]
    texts += [texts[0], None, "", "one", "é" * 10, "\n".join(sentence() for _ in range(400)), texts[3] + " x"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = {r.doc_id: r for r in paragraph_sketch.fingerprint_versions(docs).collect()}
    of = {i: t or "" for i, t in zip(ids, texts, strict=True)}
    order = sorted(of, reverse=True)
    units = lambda t: set(re.findall(r"(?:[^.!?\n]*[.!?]+){1,3}|[^.!?\n]+", t))
    near = lambda a, b: 1 - len(units(a) ^ units(b)) / max(1, len(units(a)) + len(units(b)))
    assert len(got) == len(texts)
    for k, i in enumerate(order):
        own, following = of[i], of[order[(k + 1) % len(order)]]
        n = len(own) // 3
        edited = own[: len(own) - n] + following[:n]
        r = got[i]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(near(own, edited)) and r.near_next == pytest.approx(near(own, following))
    same = [got[i] for i, t in of.items() if t == texts[0]]
    assert len(same) == 2 and same[0].fingerprint == same[1].fingerprint
    assert sum(r.near_edited > r.near_next for r in got.values()) > 25


def test_sketches_of_string_ids_and_clashing_columns(spark):
    rows = [(f"k{k:02d}", f"Text {k}. And more of {k}.", "x", 1) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, band string, id int")
    got = {r.doc_id: r for r in paragraph_sketch.fingerprint_versions(docs).collect()}
    for k in range(40):
        own, following = rows[k][1], rows[k - 1 if k else 39][1]
        n = len(own) // 3
        assert got[f"k{k:02d}"].edited_sha256 == hashlib.sha256((own[: len(own) - n] + following[:n]).encode()).hexdigest()


def test_sketches_null_ids_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, "a. b."), (1, "a. b."), (None, "c."), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_chars) for r in paragraph_sketch.fingerprint_versions(docs).collect()))
    assert got == [(0, 0), (0, 2), (1, 5), (1, 5)]
    assert paragraph_sketch.fingerprint_versions(docs.where("doc_id = 9")).count() == 0
    one = paragraph_sketch.fingerprint_versions(docs.where("doc_id = 1")).first()
    assert one.near_next == 1.0


@pytest.mark.parametrize("ids", [[None] * 50 + [1, 2], [7] * 60 + [3, 9, 9], ["k"] * 40 + [None] * 10 + ["z"]])
def test_hot_ids_are_split_and_keep_their_order(spark, ids):
    rng = random.Random(len(ids))
    rows = [(i, " ".join(f"{rng.choice('abc')}{rng.randrange(50)}." for _ in range(rng.randint(1, 40)))) for i in ids]
    rows += rows[:3]
    kind = "string" if "k" in ids else "long"
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        with_next = paragraph_sketch.with_next(docs, "doc_id", "text").select("band", "place", "id", "text", "next").collect()
        got = paragraph_sketch.fingerprint_versions(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    # The order is one ring over all rows: each text follows exactly one other, descending ids, nulls last.
    with_next.sort(key=lambda r: (r.band, r.place))
    assert sorted(r.text for r in with_next) == sorted(t for _, t in rows) == sorted(r.next for r in with_next)
    assert all(a.next == b.text for a, b in zip(with_next, [*with_next[1:], with_next[0]], strict=True))
    there = [r.id for r in with_next]
    assert there == [*sorted((i for i in there if i is not None), reverse=True), *[None] * there.count(None)]
    assert max(collections.Counter(r.band for r in with_next).values()) < 0.6 * len(rows) and len(got) == len(rows)
    assert sorted(r.n_chars for r in got) == sorted(len(t) for _, t in rows)


# Extraction


def test_extraction_matches_the_pages(spark):
    import html

    got = {r.page_id: r for r in queries.op5_wrapper_extract(spark, SF).collect()}
    for i, source in duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall():
        body = re.search(r"<article>(.*?)</article>", source, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert got[i].text == "\n".join(b for b in blocks if b) and got[i].n_chars == len(got[i].text)


PAGE = """<!doctype html><html><head><title>T {k}</title><script>var a="<p>no</p>";</script></head><body>
<header><a href=/>Site</a></header><ul class="main-menu"><li>menu {k}<li>other</ul><div id=cookie-notice>We use cookies</div>
{body}<aside>see also {k}</aside><form><p>Your name {k}</p></form><div class="comments"><p>First! {k}</p></div><footer><p>&copy; {k}</p></footer></body></html>"""


def test_extraction_roles_and_wrappers(spark):
    article = "<article class=post><header><h1>Title {k}</h1><span>by A{k}</span></header><p>One &amp; {k}  <b>bold<p>Everywhere.<div class='share'>Share {k}</div><ul><li>x{k}<li>y{k}</ul></article>"
    plain = "<div><p>Subscribe now</p><p>Story {k} tells of many things</p><table><tr><td>a{k}<td>{k}b</table></div><div>Powered by X</div>"
    pages = [(k, f"http://a.example/{k}", PAGE.format(k=k, body=article.format(k=k))) for k in range(8)]
    pages += [(100 + k, f"https://b.example:80/{k}", PAGE.format(k=k, body=plain.format(k=k))) for k in range(8)]
    pages += [(200 + k, "http://c.example/", PAGE.format(k=1, body=plain.format(k=1))) for k in range(8)]
    pages += [(300, None, None), (301, "x", "just text &lt;here&gt;"), (302, None, "<p>a<p>b<br>c"), (302, None, "<p>a<p>b<br>c")]
    # Two pages are enough to tell their template; a near copy of a page isn't one.
    pages += [(400 + k, "http://d.example", f"<article><p>We use cookies.<p>{w} and {w} and then some more of it</article>") for k, w in enumerate(("one", "two"))]
    pages += [(500 + k, "http://e.example", f"<article><p>The very same paragraph of some length.<p>{w}</article>") for k, w in enumerate(("one", "two"))]
    got = {r.page_id: r for r in wrapper_extract.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for k in range(8):
        assert got[k].text == f"Title {k}\nOne & {k} bold\nShare {k}\nx{k}\ny{k}" and got[k].n_template == 1
        assert got[100 + k].text == f"Story {k} tells of many things\na{k}\n{k}b" and got[100 + k].n_template == 2
        assert got[200 + k].text.startswith("Subscribe now\nStory 1 tells") and got[200 + k].n_template == 0
    assert got[300].text == "" and got[300].n_chars == 0 and got[301].text == "just text <here>" and got[302].text == "a\nb c"
    assert [got[k].text for k in (400, 401)] == [f"{w} and {w} and then some more of it" for w in ("one", "two")]
    assert got[501].text == "The very same paragraph of some length.\ntwo"
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert wrapper_extract.extract_main_text(empty).count() == 0
    clash = spark.createDataFrame([("p", "u", "<p>a", "b", 1, "c")], "page_id string, url string, html string, text string, host int, wrapper string")
    assert [tuple(r) for r in wrapper_extract.extract_main_text(clash).collect()] == [("p", "u", "a", 1, 0)]


def test_extraction_drops_nothing_else():
    page = wrapper_extract.parse("<article><p>a<math><mi>x</mi></math><object>o</object><svg><text>s</text></svg><noscript>n</noscript><div class='related search widget'>r</div><script>no</script></article>")
    assert [t for (_, t), fine in zip(page.blocks, wrapper_extract.roles(page), strict=True) if fine] == ["axosn", "r"]


@pytest.mark.parametrize("source", [
    "<div>" * 100_000 + "text", "<b>" * 100_000 + "<p>text", "<a '" * 100_000 + "text", "<li>" * 100_000 + "text", "<!--" * 100_000 + "text", "<div>" * 50_000 + "</section></li>" * 50_000 + "text",
    "<ul>" + "".join(f"<li><a>{k}</a>" + "<p>q" * (k % 3) + "<div>z</div>" * (k % 7) for k in range(50_000)) + "<li>text</ul>",
], ids=["deep", "inline", "quotes", "items", "comments", "closers", "wide"])
def test_extraction_of_very_deep_and_wide_pages(source):
    began = time.perf_counter()
    page = wrapper_extract.parse(source)
    wrapper_extract.roles(page)
    wrapper_extract.match(page, wrapper_extract.Wrapper(source.replace("<p>q<p>q", "<p>q", 2) + "<p>more"))
    assert time.perf_counter() - began < 60 and ("<!--" in source or page.blocks[-1][1].endswith("text"))


@pytest.mark.parametrize("cells", [1, 60, 90 * 70])
def test_long_lists_are_aligned_exactly(monkeypatch, cells):
    rng = random.Random(6)
    for n, m in ((90, 130), (7, 200), (1, 9), (40, 1), (33, 33)):
        x, y = ([rng.randrange(5) for _ in range(k)] for k in (n, m))
        weight = np.diag([3, 1, 4, 1, 5]).astype(np.int32)
        weight[0, 1] = 2
        monkeypatch.setattr(wrapper_extract, "CELLS", 4_000_000)
        whole, _ = wrapper_extract._aligned(x, y, weight)
        monkeypatch.setattr(wrapper_extract, "CELLS", cells)
        part, pairs = wrapper_extract._aligned(x, y, weight)
        assert part == whole == sum(weight[x[i], y[j]] for i, j in pairs)
        assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:], strict=False))


def main_text(source):
    page = wrapper_extract.parse(source)
    return [t for (_, t), fine in zip(page.blocks, wrapper_extract.roles(page), strict=True) if fine]


def test_the_mark_with_most_of_the_text_is_followed():
    assert main_text("<article class='teaser'>teaser</article><main>the real story</main>") == ["the real story"]
    assert main_text("<main><article><p>story, all of it</p></article><p>more on it</p></main>") == ["story, all of it"]
    assert main_text("<article>one</article><article>two</article><main></main>") == ["one", "two"]
    assert main_text("<div class='content'>short</div><main>by far the longer text</main>") == ["by far the longer text"]
    assert main_text("<div>no mark</div><p>at all</p>") == ["no mark", "at all"]


def test_forms_and_sign_ups_in_an_article_go():
    source = "<article><p>story</p><label>your name</label><div class='newsletter-signup'><p>join us</p></div><div id='cookie-popup'>ok?</div><section class='promo'>buy</section><p>end of the story</p></article>"
    assert main_text(source) == ["story", "end of the story"]


def test_blocks_are_loaded_a_few_times_a_task():
    words = [[f"w{k % 7}" for k in range(n)] for n in (10, 30, 5, 100, 1, 1)]
    batches = [pa.RecordBatch.from_arrays([pa.array([" ".join(w)])], names=["text"]) for w in words]
    groups = list(decontaminate._held(iter(batches), 0, 50))
    assert [[sum(len(h) for _, h, _ in hashed) for _, hashed in g] for g in groups] == [[10, 30, 5], [100], [1, 1]]
    assert len(list(decontaminate._held(iter(batches), 0))) == 1 and list(decontaminate._held(iter([]), 0)) == []


def test_tree_matching_matches_brute_force():
    rng = random.Random(5)

    def tree(depth):
        tag = rng.choice(["p", "div", "ul"])
        inner = "".join(tree(depth - 1) for _ in range(rng.randint(0, 3))) if depth and tag != "p" else ""
        return f"<{tag}>{inner}</{tag}>"

    def brute(a, b):
        if a.tag != b.tag:
            return 0
        x, y = a.children, b.children
        m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + brute(x[i - 1], y[j - 1]))
        return 1 + m[-1][-1]

    for _ in range(60):
        one, two = (tree(3) + tree(3) + tree(2) for _ in range(2))
        a, b = wrapper_extract.parse(one), wrapper_extract.Wrapper(two)
        assert wrapper_extract.match(a, b) == brute(a.root, b.page.root) == 1 + sum(n.slot >= 0 for n in a.nodes)
        assert all(b.page.nodes[n.slot].tag == n.tag for n in a.nodes if n.slot >= 0)
