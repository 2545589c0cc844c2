"""Line dedup, SimHash, token records and license scans against brute force on small tables."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from folioweave.llm import bytewise, license_scan, line_dedup, set_links, simhash, token_records
from folioweave.llm.common import smallest_reachable

DOCS = "doc_id long, text string, lang string, n_lines string, id string, fp string"


def docs_frame(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, None, "x", "y", "z") for i, t in enumerate(texts)], DOCS)


def sample_texts(seed=5, n=60):
    rng = random.Random(seed)
    vocab = ["alpha", "Beta", "gamma", "Über", "é", "delta9", "x", "CC", "by", "license", "public", "general", "rights", "all", "reserved", "the"]
    line = lambda: " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 9)))
    shared = [line() for _ in range(6)]
    texts = ["\n".join(rng.choice(shared) if rng.random() < 0.5 else line() for _ in range(rng.randint(1, 9))) for _ in range(n)]
    return [*texts, "", None, " \t ", "one", "two words", texts[3], texts[3] + " more", "\n\n\n\n", "a\nb\nc\na\nb\nc", "  lead  double \n tail "]


# Line dedup


def brute_lines(rows, window=3, words=50):
    words = float("inf") if words is None else words
    seen, gone = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        ls = [] if t is None else t.split("\n")
        cover = set()
        for size in range(1, window + 1):
            for p in range(len(ls) - size + 1):
                w = tuple(ls[p : p + size])
                if not "".join(w).strip(" ") or size < window and sum(len(re.findall(r"[^\x09-\x0d ]+", x)) for x in w) <= words:
                    continue
                if w in seen:
                    cover |= set(range(p, p + size))
                seen.add(w)
        gone[i] = (len(ls), len(cover), None if t is None else "\n".join(x for k, x in enumerate(ls) if k not in cover))
    return gone


def test_line_dedup_matches_brute_force(spark):
    texts = sample_texts()
    out = line_dedup.dedup_lines(docs_frame(spark, texts))
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in out.collect()} == brute_lines(list(enumerate(texts)))
    assert set(out.columns) == {"doc_id", "text", "lang", "id", "fp", "n_lines", "n_removed"}


def test_line_dedup_finds_long_passages_of_few_lines(spark):
    words = lambda n, k: " ".join(f"w{k}x{i}" for i in range(n))
    one, two, short = words(51, 1), words(30, 2) + "\n" + words(25, 3), words(50, 4)
    texts = [one, f"a\n{one}\nb", f"{two}\nc", f"d\n{two}", short, f"{short}\ne", f"{one}\n{one}", "\t".join(["x"] * 51), "\t".join(["x"] * 51) + "\ny"]
    out = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.dedup_lines(docs_frame(spark, texts)).collect()}
    assert out == brute_lines(list(enumerate(texts)))
    assert [out[i][2] for i in (1, 3, 5, 6, 8)] == ["a\nb", "d", f"{short}\ne", "", "y"]


def test_line_dedup_nulls_repeats_and_empty(spark):
    rows = [(None, "a\nb\nc\nd"), (1, "a\nb\nc"), (1, "a\nb\nc"), (2, None)]
    out = sorted(map(tuple, line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_removed", "text").collect()), key=str)
    assert out == sorted([(None, 0, "a\nb\nc\nd"), (1, 3, ""), (1, 3, ""), (2, 0, None)], key=str)
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# SimHash


def brute_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_xxh64_of_slices():
    rng = np.random.default_rng(0)
    raw = rng.integers(0, 256, 4000, dtype=np.uint8)
    start, size = rng.integers(0, 3800, 500), rng.integers(0, 150, 500)
    got = bytewise.xxh64(raw, start, size)
    assert [int(x) for x in got] == [xxhash.xxh64_intdigest(raw[s : s + n].tobytes(), seed=42) for s, n in zip(start, size, strict=True)]


def test_simhash_matches_brute_force(spark):
    texts = [*sample_texts(), "long " * 5000 + "tail of it", *[f"base text number one and so on {i % 3}" for i in range(9)]]
    fps = [brute_fingerprint(t) for t in texts]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs_frame(spark, texts)).collect()}
    assert got == {i: (f"{f:016x}", c) for i, (f, c) in enumerate(zip(fps, brute_components(fps), strict=True))}


def test_fingerprints_of_long_texts_by_parts():
    rng = random.Random(3)
    texts = ["", "one", "two words", "  ", " ".join(rng.choice("abc") * rng.randint(1, 9) for _ in range(500)) + " ", "x" * 300 + " y " + "z" * 200]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for most in (1, 7, 64, 1 << 22):
        assert [int(f) for f in simhash.fingerprints(raw, offsets, 3, most)] == [brute_fingerprint(t) for t in texts]


def test_simhash_of_a_very_long_text(spark):
    words = [f"w{k % 977}" for k in range(2_000_000)]
    got = simhash.near_duplicates(docs_frame(spark, [" ".join(words)])).first()
    hs = np.array([xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), seed=42) for k in range(977)], np.uint64)
    count = np.bincount(np.arange(len(words) - 2) % 977)
    want = sum(1 << b for b in range(64) if 2 * int(((hs >> np.uint64(b)) & np.uint64(1)).astype(np.int64) @ count) > len(words) - 2)
    assert got.fingerprint == f"{want:016x}"


@pytest.mark.parametrize(("seed", "cell"), [(0, 64), (2, 3), (16, 64), (16, 2)])
def test_links_connect_what_all_pairs_connect(spark, seed, cell):
    rng = random.Random(seed)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            fps.add(x)
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    edges = simhash.links(frame, cell)
    got = {r.node % (1 << 64): r.root % (1 << 64) for r in smallest_reachable(edges, "a", "b").collect()}
    want = brute_components(fps)
    of = {}
    for f, c in zip(fps, want, strict=True):
        of.setdefault(c, set()).add(f)
    mine = {}
    for f in fps:
        mine.setdefault(got.get(f, f), set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, of.values()))


def test_keep_one(spark):
    texts = ["same old text of five words", "same old text of five words", "another text that has nothing alike in it", None, ""]
    kept = simhash.keep_one(docs_frame(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]
    assert kept.columns == ["doc_id", "text", "lang", "n_lines", "id", "fp"]
    twice = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "q r s"), (None, "q r s")], "doc_id long, text string")
    assert sorted((r.doc_id or -1) for r in simhash.keep_one(twice).collect()) == [-1, 1]
    assert simhash.keep_one(docs_frame(spark, [])).count() == 0


def brute_alike(texts):
    """For each text, the first that chains of five-word Jaccard similarity 0.8 or more reach."""
    sets = []
    for t in texts:
        words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
        sets.append({" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if not a | b or 5 * len(a & b) >= 4 * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


@pytest.mark.parametrize("growth", [2, 256])
def test_keep_one_matches_brute_force_similarity(spark, growth):
    rng = random.Random(growth)
    texts = ["", None, "one", "two words"]
    for _ in range(5):
        base = [f"w{rng.randrange(900)}" for _ in range(rng.randint(30, 120))]
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(900)}"
            texts.append(" ".join(copy))
    root = brute_alike(texts)
    kept = sorted(r.doc_id for r in simhash.keep_one(docs_frame(spark, texts), growth=growth).collect())
    assert kept == sorted(set(root)) and len(kept) < len(texts) - 10


def test_keep_one_tells_rows_of_null_and_repeated_ids_apart(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(20)) for x in "abcd")
    rows = [(1, a), (None, a), (None, b), (None, c), (None, c), (2, d), (2, "quite another text of this id"), (3, d)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, a), (None, b), (None, c), (2, d), (2, "quite another text of this id")], key=str)


def test_embedding_bounds_the_hamming_distance(spark):
    rng = random.Random(4)
    rows = [(rng.getrandbits(64) - (1 << 63), rng.getrandbits(64) - (1 << 63)) for _ in range(50)]
    rows += [(a, a ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60))) for a, _ in rows]
    e = simhash.embedding
    got = spark.createDataFrame(rows, "a long, b long").select("a", "b", F.bit_count(e(F.col("a")).bitwiseXOR(e(F.col("b")))).alias("apart"), simhash.nearby(e(F.col("a"))).alias("cells"), e(F.col("a")).alias("own"))
    for r in got.collect():
        counts = [[(x >> 2 * k & 3).bit_count() for k in range(32)] for x in (r.a, r.b)]
        assert r.apart == sum(abs(x - y) for x, y in zip(*counts, strict=True)) <= ((r.a ^ r.b) % (1 << 64)).bit_count()
        assert r.cells[0] == r.own and len(set(r.cells)) == len(r.cells) == 33 + counts[0].count(1)


def test_templated_pages_share_no_cell(spark):
    """Pages of 50 words of a template and 10 of their own meet in no cell: the work grows with the pages, not with their pairs."""
    rows = [(k, " ".join([f"t{i}" for i in range(50)] + [f"own{k}x{i}" for i in range(10)])) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = simhash.with_prefix(docs, "doc_id", "text", simhash._common(docs, "text"))
    two, members = set_links.cells(simhash.prefix_cells(nodes), nodes)
    assert two.isEmpty() and members.isEmpty()
    assert simhash.keep_one(docs).count() == 400


# Token records


def test_token_records_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tool = Tokenizer.from_file(path)
    texts = [*sample_texts(), "a <|endoftext|> b", "it's we'll  two", "\x00 \x00x", "tab\tx   y　z", "\x85 a \x1c b"]
    out = token_records.token_table(docs_frame(spark, texts), path, out=str(tmp_path / "rec"))
    start = 0
    rows = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(texts):
        ids = [*tool.encode(t or "", add_special_tokens=False).ids, 2]
        raw = np.asarray(ids, "<u4").tobytes()
        r = rows[i]
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (start, len(ids), zlib.crc32(raw), raw), t
        start += len(ids)


def test_token_records_index_damage_nulls_and_empty(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    frame = spark.createDataFrame([(5, "five"), (None, "none"), (-3, None), (5, "again")], "doc_id long, text string")
    out = str(tmp_path / "rec")
    manifest = token_records.write_records(frame, out, path, 2)
    rows = token_records.read_records(spark, out, manifest).orderBy("start").collect()
    assert [r.id for r in rows] == [None, -3, 5, 5] and rows[1].n_tokens == 1
    file = max(manifest.collect(), key=lambda r: r["documents"])
    assert len(token_records.shuffled_sample(out, file["file"], 1, 9)) == file["documents"]
    data = bytearray(open(f"{out}/{file['file']}.rec", "rb").read())
    data[-6] ^= 1
    open(f"{out}/{file['file']}.rec", "wb").write(data)
    with pytest.raises(Exception, match="damaged"):
        token_records.read_records(spark, out, manifest).collect()
    assert token_records.token_table(frame.limit(0), path, out=str(tmp_path / "none")).count() == 0


def test_token_records_clashing_columns_and_uris(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([("7", "seven", 1, "x", b"y"), ("5", "five", 2, "y", b"z")], "doc_id string, text string, start int, id string, ids binary")
    got = token_records.token_table(docs, path, out=f"file://{tmp_path}/rec").orderBy("doc_id").collect()
    assert [(r.doc_id, r.start) for r in got] == [(5, 0), (7, got[0].n_tokens)]


# License scans


def brute_base(text):
    words = [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    at = [(i, label) for phrase, label in license_scan.BASE.items() for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    at.sort()
    return len(words), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))


def test_license_base_matches_brute_force(spark):
    texts = [*sample_texts(9, 120), "CC BY cc by CC-BY 4.0", "general public license general public", "All Rights Reserved.", "\0doc cc \0doc"]
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.scan_licenses(docs_frame(spark, texts)).collect()}
    assert got == {i: brute_base(t) for i, t in enumerate(texts)}


def test_license_templates(spark):
    texts = [
        "x y. Licensed under the Apache License, Version 2.0. z", "Licensed now under the Apache License Version 2.0", "apache license",
        "released under the MIT license", "Licensed under CC BY-NC 4.0.", "nothing here",
    ]
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan_licenses(docs_frame(spark, texts)).collect()}
    assert got[0] == ("apache-2.0", 1.0) and got[1][0] == "apache-2.0" and 0.6 <= got[1][1] < 1
    assert got[2] == ("", 0.0) and got[3][0] == "mit" and got[4] == ("cc-by,cc-by-nc", 1.0) and got[5] == ("", 0.0)


def brute_templates(text, templates, cover=license_scan.COVER):
    """{template: best share} by the same rule in plain Python."""
    words, found = license_scan.template_words(text or ""), {}
    for k, (template, _) in enumerate(templates):
        t = license_scan.template_words(template)
        size, drift = len(t) - 1, max(license_scan.NEAR, int(len(t) * (1 - cover)))
        matches = [(i, j) for i in range(len(words) - 1) for j in range(size) if words[i : i + 2] == t[j : j + 2]]
        diagonals, runs = sorted({i - j for i, j in matches}), []
        for d in diagonals:
            if runs and d - runs[-1][-1] <= license_scan.NEAR:
                runs[-1].append(d)
            else:
                runs.append([d])
        for run in runs:
            stretches = [(run[0], run[-1])] if run[-1] - run[0] <= drift else [(run[0] + w * drift, run[0] + (w + 2) * drift - 1) for w in range((run[-1] - run[0]) // drift + 1)]
            for low, high in stretches:
                own = sorted((i, -j) for i, j in matches if low <= i - j <= high)
                longest = []
                for _, j in own:
                    at = next((x for x, y in enumerate(longest) if y >= -j), len(longest))
                    longest[at : at + 1] = [-j]
                if len(longest) / size >= cover:
                    found[k] = max(found.get(k, 0), len(longest) / size)
    return found


def test_license_templates_match_brute_force(spark):
    rng = random.Random(21)
    templates = license_scan.TEMPLATES
    texts = ["under the under the terms under the terms of the gnu lesser gnu lesser general public license " * 3, "of the " * 60, ""]
    for _ in range(60):
        words = license_scan.template_words(rng.choice(templates)[0])
        edits = rng.choice([0, 0.05, 0.15, 0.3])
        out = []
        for w in words:
            x = rng.random()
            out += [] if x < edits / 3 else [w, "zz"] if x < 2 * edits / 3 else ["yy"] if x < edits else [w]
        if rng.random() < 0.2:
            out = out[len(out) // 2 :] + out[: len(out) // 2]
        texts.append("See: " + " ".join(out).title() + ". And so on " + " ".join(license_scan.template_words(rng.choice(templates)[0])[:9]))
    want = [brute_templates(t, templates) for t in texts]
    base = [{x for x in brute_base(t)[4].split(",") if x} for t in texts]
    for part in (license_scan.PART, 40):
        for r in license_scan.scan_licenses(docs_frame(spark, texts), part=part).collect():
            found = want[r.doc_id]
            assert set(filter(None, r.labels.split(","))) == {templates[k][1] for k in found} | base[r.doc_id], texts[r.doc_id]
            assert r.score == pytest.approx(1.0 if base[r.doc_id] else max(found.values(), default=0.0))
            assert r.n_words == len(license_scan.template_words(texts[r.doc_id]))
            assert all(0 <= s.first < s.last < r.n_words for s in r.spans)
    assert sum(bool(f) for f in want) > 40


def test_license_spans_are_verified(spark):
    """Pairs of a template out of order, or spread over a long text, aren't a copy."""
    words = license_scan.template_words(license_scan.TEMPLATES[11][0])
    out_of_order = " ".join(" ".join(words[k : k + 4]) for k in range(len(words) - 4, -1, -3))
    spread = " ".join(w + " and then" * 2 if k % 5 == 4 else w for k, w in enumerate(words))
    whole = " ".join(words)
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs_frame(spark, [out_of_order, spread, whole, "x " * 7 + whole])).collect()}
    assert "mit" not in got[0].labels and "mit" not in got[1].labels and got[2].labels == "mit" == got[3].labels
    assert [(s.first, s.last, s.share) for s in got[3].spans] == [(7, 6 + len(words), 1.0)]


def test_license_words_and_parts(spark):
    texts = [*sample_texts(10, 40), "CC\u212ABY K\u212a cc by", "\u0130 CC BY", "w" * 500 + " cc by " + "-" * 300 + "all rights" + " " * 200 + "reserved"]
    want = {i: brute_base(t) for i, t in enumerate(texts)}
    for part in (3, 64):
        got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.scan_licenses(docs_frame(spark, texts), part=part).collect()}
        assert got == want
    long = docs_frame(spark, ["Word, " * 3_000_000 + "all rights reserved"])
    assert [(r.n_words, r.first_word) for r in license_scan.scan_licenses(long).collect()] == [(3_000_003, 3_000_000)]


def test_license_nulls_repeats_and_empty(spark):
    frame = spark.createDataFrame([(1, "cc by"), (1, "cc by"), (None, "cc by"), (2, None), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_base) for r in license_scan.scan_licenses(frame).collect()))
    assert got == [(0, 1), (1, 1), (1, 1), (2, 0), (2, 0)]
    assert license_scan.scan_licenses(frame.limit(0)).count() == 0
