import random

import numpy as np
import pytest

from auxoline.llm import near_dedup as N
from auxoline.llm.components import components
from plain import ODD, links_of, odd_rows, roots, shingles


def family(rng, size, n, most):
    base = [rng.choice(["on", "re", "th", "an", "er"]) + rng.choice(["tion", "ing", "le", "ch"]) + str(rng.randrange(30)) for _ in range(n)]
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(rng.randrange(most)):
            i = rng.randrange(len(w))
            w[i : i + 1] = rng.choice([[], [f"New{rng.randrange(20)}"], [w[i], "x"]])
        out.append(" ".join(w))
    return out


def corpus(seed):
    rng = random.Random(seed)
    texts = [*family(rng, 150, 90, 9), *family(rng, 60, 30, 4), *family(rng, 40, 8, 3), *family(rng, 20, 3, 2), "one", "ONE", "one two", "", " \t", "é É", "line " * 300]
    for _ in range(60):
        texts.append(" ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(40))))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_matches_brute_force(spark, k, percent):
    rows = list(enumerate(corpus(k)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in N.near_duplicates(docs, k=k, percent=percent).collect()}
    root = roots([i for i, _ in rows], links_of(rows, k, percent))
    assert len(got) == len(rows)
    for i, t in rows:
        assert got[i].n_shingles == len(shingles(t, k))
        assert got[i].component_id == root[i] and got[i].kept == (root[i] == i)
    kept = {r.doc_id for r in N.keep_one(docs, k=k, percent=percent).collect()}
    assert kept == set(root.values())


def test_partner_search_alone_finds_every_link(spark):
    rows = [(i, t) for i, t in enumerate(corpus(8)) if shingles(t, 3)]
    docs = spark.createDataFrame(rows, "id long, text string")
    ids = docs.select("id").cache()
    sets = N.full_sets(docs, "id", "text", 3, ids).cache()
    members = ids.selectExpr("id", "id label", "true searching")
    found = {tuple(sorted(r)) for r in N.partner_pairs(members, sets, 85).collect()}
    assert {tuple(sorted(p)) for p in links_of(rows, 3, 85)} <= found


def test_repeated_null_and_odd_rows(spark):
    rows = odd_rows(corpus(4)[:80])
    docs = spark.createDataFrame(rows, ODD)
    numbered = [(n, r[1]) for n, r in enumerate(rows)]
    root = roots([n for n, _ in numbered], links_of(numbered, 3, 85))
    smallest = {}
    for n, r in enumerate(rows):
        old = smallest.get(root[n])
        smallest[root[n]] = r[0] if old is None else old if r[0] is None else min(old, r[0])
    got = sorted(((r.doc_id, r.component_id, r.n_shingles) for r in N.near_duplicates(docs).collect()), key=str)
    assert got == sorted(((r[0], smallest[root[n]], len(shingles(r[1], 3))) for n, r in enumerate(rows)), key=str)
    out = N.keep_one(docs, k=3, percent=85)
    assert out.schema == docs.schema and out.count() == len(set(root.values()))
    assert N.near_duplicates(docs.limit(0)).count() == 0 and N.keep_one(docs.limit(0)).count() == 0


def test_bounds_spare_similar_pairs():
    least = N.least_matches(0.85)
    rng = np.random.default_rng(1)
    matches = (rng.random((20_000, N.HASHES)) < 0.85).cumsum(1)[:, N.BATCH - 1 :: N.BATCH]
    assert ((matches >= least).all(1)).mean() > 0.9995
    far = (rng.random((20_000, N.HASHES)) < 0.4).cumsum(1)[:, N.BATCH - 1 :: N.BATCH]
    assert ((far >= least).all(1)).mean() < 0.001
    assert least == sorted(least)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 1 << 63, 9000, np.uint64))
    b = np.concatenate([a[:6000], np.unique(rng.integers(0, 1 << 63, 3000, np.uint64))])
    assert abs((N.signature(a) == N.signature(b)).mean() - 0.5) < 0.16


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5000 + i) for i in range(1, 60)] + [(4, 4), (7, 8), (7, 8)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots({x for e in edges for x in e}, edges)
    assert got == {n: r for n, r in want.items() if n != r}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("whole", [-1, 1 << 20])
def test_components_with_hubs_and_more_links(spark, monkeypatch, whole):
    from auxoline.llm import components as C

    monkeypatch.setattr(C, "HUB_LEAST", 5)
    monkeypatch.setattr(C, "WHOLE", whole)
    monkeypatch.setattr(C, "HUB_SHARE", 1 / 100)
    rng = random.Random(3)
    edges = [(5000, i) for i in range(100, 160)] + [(3, i) for i in range(200, 260)] + [(150, 230)] + [(rng.randrange(6000, 6100), rng.randrange(6000, 6100)) for _ in range(70)]
    more = [(6001, 6002), (160, 7000), (7000, 7001), (240, 6050), (8, 8), (9000, 9001)]
    found = C.components(spark.createDataFrame(edges, "a long, b long").repartition(7))
    want = roots({x for e in edges for x in e}, edges)
    assert {r.node: r.root for r in found.collect()} == {n: r for n, r in want.items() if n != r}
    if whole < 0:
        # Star rounds end on an empty graph too.
        assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0
    every = roots({x for e in edges + more for x in e}, edges + more)
    assert {r.node: r.root for r in C.joined(found, spark.createDataFrame(more, "a long, b long")).collect()} == {n: r for n, r in every.items() if n != r}


def test_odd_sketches_bound_the_difference():
    rng = np.random.default_rng(4)
    for n, gone in ((3, 1), (40, 12), (200, 80), (200, 20), (5000, 900)):
        a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 63, gone + n // 9, np.uint64)]))
        sets, words = [a, b], [N.odd_sketch(a), N.odd_sketch(b)]
        size = np.array([len(w) for w in words])
        assert [N.sketch_words(len(x)) for x in sets] == size.tolist()
        (far,) = N.sketch_distances(np.array([0]), np.array([1]), np.array([0, size[0]]), size, np.concatenate(words))
        true = len(np.setxor1d(a, b))
        assert far <= true and (true > n or far > 0.7 * true)


def test_frequent_shingles_are_dealt_over_tasks(spark):
    rows = [(i, t) for i, t in enumerate(corpus(9)) if shingles(t, 3)]
    ids = spark.createDataFrame(rows, "id long, text string")
    sets = N.stored(N.full_sets(ids, "id", "text", 3, ids.select("id")))
    members = ids.selectExpr("id", "id label", "id % 3 > 0 searching")
    every = {tuple(r) for r in N.partner_pairs(members, sets, 85).collect()}
    assert {tuple(r) for r in N.partner_pairs(members, sets, 85, hot=7).collect()} == every
    likeliest = {tuple(r) for r in N.partner_pairs(members, sets, 85, best=True, hot=7).collect()}
    linked = {x for p in every for x in p if x % 3}
    assert likeliest <= every and {x for p in likeliest for x in p if x % 3} == linked


@pytest.mark.parametrize("most", [3, 5])
def test_candidates_grow_with_the_classes(spark, monkeypatch, most):
    compared = []

    def counting(pairs, *rest, plain=N.verify):
        pairs = N.stored(pairs)
        compared.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(N, "verify", counting)
    each = []
    for size in (400, 1600, 6400):
        rng = random.Random(most)
        base = [f"w{i}" for i in range(120)]
        texts = []
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(most)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(w))
        rows = list(enumerate(texts))
        compared.clear()
        out = {r.doc_id: r.component_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=5, percent=80).collect()}
        each.append((sum(compared) / len(set(texts)), list(compared)))
        if size == 400:
            assert out == roots([i for i, _ in rows], links_of(rows, 5, 80))
    assert each[2][0] < 1.5 * each[0][0] + 2, each
