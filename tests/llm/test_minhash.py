import random
import re

import numpy as np

from glyphlake.llm import graph, minhash
from glyphlake.llm.minhash import keep_one, near_duplicates

from .conftest import prose


def sets_of(text, words):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()


def brute(rows, words, similarity=80):
    sets = {i: sets_of(t, words) for i, t in rows}
    up = {i: i for i in sets}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in sets}


def mutated(text, n, seed):
    rng = random.Random(str(seed))
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"w{rng.random()}"
    return " ".join(w)


def corpus():
    rows = []
    for f in range(6):
        base = prose(("f", f), 120)
        rows += [base, base.upper(), *(mutated(base, m, (f, m)) for m in range(1, 9)), *(mutated(base, 3, (f, m, "x")) for m in range(12))]
    rows += [prose(("c", k), 30 + k) for k in range(30)]
    rows += ["one two", "One  two", "one two three", "", None, " \n", "one two three four", "one two three four five", "x", "X"]
    random.Random(5).shuffle(rows)
    return list(enumerate(rows))


def test_against_brute_force(documents):
    rows = corpus()
    for words in (4, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(documents(rows), words).collect()}
        assert got == brute(rows, words)


def test_families_alone_find_the_links(documents, monkeypatch):
    """With no bucket small enough to be compared as a whole."""
    monkeypatch.setattr(minhash, "FEW", 1)
    monkeypatch.setattr(minhash, "BLOCK_ALL", 16)
    monkeypatch.setattr(minhash, "BLOCK_OUTSIDE", 8)
    base = prose("family", 150)
    rows = [(k, mutated(base, 4, k)) for k in range(60)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(documents(rows), 4).collect()}
    assert got == brute(rows, 4)


def test_bridges_between_families_are_found(spark, documents):
    """Buckets are made up: the ends of each bridge share one large bucket, but always choose other families."""
    texts, bands = {}, {}

    def add(text, *own):
        texts[len(texts)] = text
        bands[len(bands)] = list(own)
        return len(texts) - 1

    want = []
    for k in range(3):
        bridge, left, right = 10 * k, 10 * k + 1, 10 * k + 2
        base = prose(("bridge", k), 120)
        u, v = add(base, bridge, left), add(mutated(base, 2, k), bridge, right)
        for side, end in ((left, u), (right, v)):
            for m in range(40):
                add(prose(("hot", side, m), 60), side, side + 1000, side + 2000)  # met more often than all of the bridge
        cluster = prose(("cluster", k), 120)
        own = [add(mutated(cluster, 1, (k, m)), bridge) for m in range(4)]
        for m in range(4):
            add(prose(("filler", k, m), 60), bridge, *range(10_000 + 20 * k, 10_020 + 20 * k))  # centres of the bridge
        want += [(u, v), *((own[0], x) for x in own[1:])]
    rows = list(texts.items())
    sets = {i: len(sets_of(t, 4)) for i, t in rows}
    classes = spark.createDataFrame([(i, sets[i], b) for i, b in bands.items()], "node long, n long, bands array<long>")
    got = {r.node: r.component for r in minhash.link(classes, documents(rows), 4, 80).collect()}
    assert {i: c for i, c in got.items() if i != c} == {b: a for a, b in want}


def test_chains_join_end_to_end(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(70)] + [(100, 101)], "u long, v long")
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert got == {k: 0 for k in range(71)} | {100: 100, 101: 100}


def test_densified_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    for n in (5, 40, 900):
        both = rng.integers(0, 2**63, n * 2, dtype=np.uint64)
        a, b = np.unique(both[: n + n // 2]), np.unique(both[n // 2 :])
        want = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((minhash.signature(a) == minhash.signature(b)).mean() - want) < 0.3
        assert (minhash.signature(a) == minhash.signature(a.copy())).all()


def test_shared_counts():
    rng = np.random.default_rng(1)
    a, b = ([np.unique(rng.integers(0, 9000, 3000, dtype=np.uint64)) for _ in range(n)] for n in (3, 4))
    assert minhash.shared_counts(a, b).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]


def test_awkward_rows_and_empty_table(awkward, nothing):
    out = near_duplicates(awkward).collect()
    assert len(out) == awkward.count()
    assert all(r.kept and r.component_id is None for r in out if r.doc_id is None)
    assert {r.component_id for r in out if r.doc_id in (5, 6)} == {5}
    assert all(r.kept for r in out if r.n_shingles == 0)
    assert near_duplicates(nothing).count() == 0 and keep_one(nothing).count() == 0
    kept = keep_one(awkward)
    assert kept.columns == awkward.columns and sum(r.doc_id is None for r in kept.collect()) == 2
