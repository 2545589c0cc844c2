"""Periodic runs, centroid clusters and the Jaccard join against brute force on small tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from array import array
from fractions import Fraction

import numpy as np
import pytest

from folioweave.llm import jaccard_join, periodic_runs, queries, set_links, sort_means

SPACE = "[\x20\x09-\x0d]+"


def words_of(text):
    return [w for w in re.split(SPACE, text or "") if w]


# Periodic runs


def brute_runs(w, least=12):
    """Stretches of words equal to those q on, for each q, without those that a smaller q explains."""
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            e = i + q
            if e - s >= max(least, 2 * q) and not any(all(w[k] == w[k + d] for k in range(s, e - d)) for d in range(1, q)):
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_match_brute_force():
    rng = random.Random(5)
    for _ in range(1500):
        n, letters = rng.randrange(0, 80), rng.choice([1, 2, 3, 4, 8])
        w = [rng.randrange(1, letters + 1) for _ in range(n)]
        if rng.random() < 0.5 and n:
            s = rng.randrange(n)
            p = rng.randrange(1, max(2, (n - s) // 2 + 1))
            w = [x if i < s else w[s + (i - s) % p] for i, x in enumerate(w)]
            w = w[::-1] if rng.random() < 0.5 else w
        for least in (2, 5, 12):
            assert periodic_runs.find_runs(array("q", w), least) == brute_runs(w, least)


def test_runs_of_highly_periodic_words():
    fibonacci = "ab"
    for _ in range(11):
        fibonacci = "".join({"a": "ab", "b": "a"}[c] for c in fibonacci)
    thue = "".join("ab"[bin(k).count("1") % 2] for k in range(1 << 9))
    for text in (fibonacci[:300], thue, "a" * 200, "ab" * 40 + "ba" * 40, "abcab" * 30 + "abc"):
        w = array("q", [ord(c) for c in text])
        assert periodic_runs.find_runs(w, 4) == brute_runs(w, 4)


def test_colliding_hashes_are_noticed(monkeypatch):
    rng = random.Random(1)
    w = array("q", [rng.randrange(1, 3) for _ in range(400)] + [1, 2, 1, 2, 2] * 12)
    monkeypatch.setattr(periodic_runs, "BASES", (0, *periodic_runs.BASES))
    assert periodic_runs.find_runs(w) == brute_runs(w)


def brute_digest(i, text):
    w = words_of(text)
    h, n = zlib.crc32(str(i).encode()), len(w)
    g = h // 10
    if i is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    tail = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *tail, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_digests_match_brute_force(spark):
    rng = random.Random(3)
    texts = ["", None, "  \t\n ", "one", " lead\x0b" + "tick tock\u00a0 " * 9 + "\x0cend ", "\u2003 ".join(["wide"] * 40), "la " * 100]
    texts += [" ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(1, 120))) for _ in range(150)]
    texts += [" ".join([f"w{k}" for k in range(rng.randint(10, 90))] + ["x", "y", "z"] * rng.randint(3, 8)) for _ in range(40)]
    rows = [*enumerate(texts), (7, texts[7]), (None, "ho " * 20), (None, None)]
    docs = spark.createDataFrame([(i, t, "a", 1, 2) for i, t in rows], "doc_id long, text string, runs string, n_words int, id int")
    found = periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.with_loops(docs)))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert got == sorted(((i, *brute_digest(i, t)) for i, t in rows), key=str)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, t in rows if t) > 10
    assert periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.with_loops(docs.limit(0)))).count() == 0


def test_runs_of_a_very_long_text(spark):
    body = " ".join(f"w{k}" for k in range(300_000))
    text = f"{body} " + "again and again " * 400_000 + body
    r = periodic_runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.n_words == 1_800_000 and [tuple(x) for x in r.runs] == [(300_000, 1_200_000, 3)]
    assert r.collapsed == f"{body} again and again {body}"


# Centroid clusters


def brute_clusters(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (sha(f"1:{'' if r[0] is None else r[0]}"), r[1]))[:k]]
    apart = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    place = lambda: [min((apart(v, c), n) for n, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        of = place()
        for n in range(len(centroids)):
            own = [v for (_, v), (_, m) in zip(kept, of, strict=True) if m == n]
            if own:
                centroids[n] = [math.floor(Fraction(sum(c), len(own))) for c in zip(*own, strict=True)]
    of = place()
    each = {n: sum(d for d, m in of if m == n) for _, n in of}
    return sorted(((i, n, d, each[n], sum(each.values()), sha(",".join(map(str, centroids[n])))) for (i, _), (d, n) in zip(kept, of, strict=True)), key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, cluster int, v int")


def test_clusters_match_brute_force(spark):
    rng = random.Random(2)
    middle = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(9)]
    f32 = lambda v: [float(np.float32(x)) for x in v]
    rows = [(i, f32([x + rng.gauss(0, 0.4) for x in rng.choice(middle)])) for i in range(300)]
    # Ties: vectors of few values, repeated rows and ids.
    rows += [(1000 + i, [float(rng.randrange(2)) for _ in range(2)] + [0.0] * 62) for i in range(60)]
    rows += [rows[5], (5, rows[9][1]), (None, rows[7][1]), (None, [0.5] * 64)]
    bad = [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [1.0] * 65), (2004, [None] + [1.0] * 63), (2005, [float("nan")] + [0.0] * 63), (2006, [float("-inf")] + [0.0] * 63)]
    got = sort_means.with_inertia(*sort_means.cluster_vectors(vectors(spark, rows + bad)))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_clusters(rows)


def test_few_and_no_vectors(spark):
    rows = [(1, [0.25] * 64), (2, [-3.0] * 64), (3, [0.25] * 64)]
    got = sort_means.with_inertia(*sort_means.cluster_vectors(vectors(spark, rows)))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_clusters(rows)
    for none in ([], [(1, None)]):
        empty = sort_means.with_inertia(*sort_means.cluster_vectors(vectors(spark, none)))
        assert empty.count() == 0 and empty.columns[0] == "vec_id"


def test_scans_stop_early_and_lose_no_tie():
    rng = np.random.default_rng(7)
    for _ in range(200):
        x, c = rng.integers(-3, 4, (30, 2)), rng.integers(-3, 4, (rng.integers(1, 9), 2))
        cluster, distance = sort_means.assign(x, c.tolist(), rng.integers(0, len(c), 30))
        every = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert (distance == every.min(axis=1)).all() and (cluster == every.argmin(axis=1)).all()


def test_components_of_any_size(spark):
    rows = [(k, [3e30 * (k % 3)] + [float(k)] * 63) for k in range(20)] + [(50, [-3e38] * 64)]
    got = {r.vec_id: r for r in sort_means.with_inertia(*sort_means.cluster_vectors(vectors(spark, rows))).collect()}
    assert len(got) == 21 and all(r.distance >= 0 and r.inertia <= 2**63 - 1 for r in got.values())


# Jaccard join


def brute_join(rows):
    """(id, set size, smallest id reached) of each row, links being 100 * both >= 90 * union."""
    sets = []
    for _, t in rows:
        w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set())
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    ids = {r: [rows[k][0] for k in range(len(rows)) if root[k] == r and rows[k][0] is not None] for r in root}
    return sorted(((rows[k][0], len(sets[k]), min(ids[r], default=None)) for k, r in enumerate(root)), key=str)


def near_copies(rng, groups=7, size=12):
    texts = []
    for _ in range(groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([3, 9, 12, 21, 40, 120, 400]))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 40)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(4000)}"
            cut = rng.choice([0, 0, len(copy) // 15])
            texts.append(" ".join(copy[cut:]))
    return texts


@pytest.mark.parametrize("growth", [2, 256])
def test_join_matches_brute_force(spark, growth):
    rng = random.Random(growth)
    texts = near_copies(rng)
    # Copies of one another along a chain, templates, sets of few shingles, none.
    chain = [f"c{k}" for k in range(60)]
    texts += [" ".join(chain[k : k + 50]) for k in range(11)]
    texts += [" ".join([f"t{k}" for k in range(50)] + [f"own{j}x{k}" for k in range(5)]) for j in range(30)]
    texts += ["", None, " \t", "one", "ONE", "two words", "Two Words ", "a b c", "a b c d", "x " * 50, "x x x x", "\u00c4 b c", "\u00e4 b c"]
    rows = [*enumerate(texts), (3, texts[3]), (3, "quite another text"), (None, texts[8]), (None, "only nulls here"), (None, "only nulls here"), (None, "")]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, node string, id int, n int")
    found = jaccard_join.jaccard_components(docs, growth=growth)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_join(rows)
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(3)
    for rule in (jaccard_join.RULE, set_links.Alike(3, 4, 5)):
        for _ in range(300):
            n = int(rng.integers(1, 250))
            x = rng.integers(0, 2**63, n).astype(np.uint64)
            most = n * (rule.den - rule.num) // rule.den
            y = np.concatenate([x[int(rng.integers(0, most + 1)) :], rng.integers(0, 2**63, int(rng.integers(0, 2 + most // 2))).astype(np.uint64)])
            both, union = len(np.intersect1d(x, y)), len(np.union1d(x, y))
            if rule.den * both >= rule.num * union:
                sig, at = jaccard_join.signatures(np.concatenate([np.sort(x), np.sort(y)]), np.array([0, len(x), len(x) + len(y)]), rule)
                assert set(sig[: at[1]].tolist()) & set(sig[at[1] :].tolist())


def test_new_queries_run_on_whole_tables(spark):
    where = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((tuple(r) for r in queries.QUERIES["op13_jaccard_join"](spark, where).collect()), key=str)
    assert got == brute_join([(r.doc_id, r.text) for r in docs])
    rows = spark.read.parquet(f"{where}/embeddings.parquet").select("vec_id", "embedding").collect()
    got = sorted((tuple(r) for r in queries.QUERIES["op12_sort_means"](spark, where).collect()), key=str)
    assert got == brute_clusters([(r.vec_id, r.embedding) for r in rows])
