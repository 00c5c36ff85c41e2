"""Iterative operators against plain Python over the same marks."""

import os
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphlake.functions import scores
from glyphlake.operators import clusters, extract, matching
from glyphlake.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
LIMIT = np.float32(catalog.THRESHOLD)


@pytest.fixture(scope="module")
def bitmaps(spark):
    """(label, bits) by mark_id."""
    return {r.mark_id: (r.label, np.array(r.bits)) for r in catalog.marks(spark, SF).select("mark_id", "label", "bits").collect()}


@pytest.fixture(scope="module")
def classes(spark):
    return {r.mark_id: r.class_id for r in catalog.QUERIES["equivalence_classes"](spark, SF).collect()}


def mm(bitmaps, a, b):
    return int((bitmaps[a][1] != bitmaps[b][1]).sum()) / 64


def grouped(bitmaps):
    out = defaultdict(list)
    for m in sorted(bitmaps):
        out[bitmaps[m][0]].append(m)
    return out


def test_leaders(spark, bitmaps):
    want = {}
    for members in grouped(bitmaps).values():
        heads = []
        for m in members:
            near = min(((mm(bitmaps, m, h), h) for h in heads), default=(2, None))
            if near[0] <= catalog.THRESHOLD:
                want[m] = (near[1], near[0])
            else:
                heads.append(m)
                want[m] = (m, 0.0)
    assert {r.mark_id: (r.leader_id, r.mm) for r in catalog.QUERIES["pms_dictionary"](spark, SF).collect()} == want


def test_forest_is_a_least_spanning_forest(spark, bitmaps):
    top, total, roots = {m: m for m in bitmaps}, 0.0, len(bitmaps)

    def find(n):
        while top[n] != n:
            n = top[n]
        return n

    edges = sorted((mm(bitmaps, i, j), i, j) for g in grouped(bitmaps).values() for i in g for j in g if j < i and np.float32(mm(bitmaps, i, j)) < LIMIT)
    for w, i, j in edges:
        a, b = find(i), find(j)
        if a != b:
            top[a], total, roots = b, total + w, roots - 1
    got = catalog.QUERIES["forest_totals"](spark, SF).first()
    assert got.total_mm == pytest.approx(total) and got.roots == roots
    assert got.leaves + got.one_child + got.two_children + got.more_children + got.roots == len(bitmaps)
    rows = catalog.marks(spark, SF)
    trees = {r.mark_id: r for r in clusters.forest(rows, matching.edges(rows, catalog.BY, catalog.THRESHOLD), catalog.BY).collect()}
    known, kids = {(i, j) for _, i, j in edges}, defaultdict(int)
    for r in trees.values():
        if r.parent is not None:
            kids[r.parent] += 1
            assert (max(r.mark_id, r.parent), min(r.mark_id, r.parent)) in known and r.depth == trees[r.parent].depth + 1
    assert all(r.children == kids[m] for m, r in trees.items())
    inner = [r for r in trees.values() if r.parent is not None]
    assert (got.leaves, got.one_child, got.most_children) == (sum(r.children == 0 for r in inner), sum(r.children == 1 for r in inner), max(r.children for r in inner))
    assert got.roots_alone == sum(r.children == 0 for r in trees.values() if r.parent is None)


def test_lloyd(spark, bitmaps, classes):
    own = dict(classes)

    def representatives():
        held = defaultdict(list)
        for m, c in own.items():
            held[c].append(m)
        out = {}
        for c, members in held.items():
            members.sort()
            out[c] = members[0]
            if len(members) > 2:
                out[c] = min((sum(mm(bitmaps, m, o) for o in members if o != m) / (len(members) - 1), m) for m in members)[1]
        return out, held

    for _ in range(100):
        reps, held = representatives()
        moves = {}
        for m, c in own.items():
            if len(held[c]) > 2 and reps[c] != m:
                near = min(((mm(bitmaps, m, r), k) for k, r in reps.items() if bitmaps[r][0] == bitmaps[m][0] and mm(bitmaps, m, r) < 1), default=(2, m))
                if near[1] != c:
                    moves[m] = near[1]
        if not moves:
            break
        own |= moves
    assert {r.mark_id: r.class_id for r in catalog.QUERIES["lloyd_classes"](spark, SF).collect()} == own


def test_superclasses(spark, bitmaps):
    near = defaultdict(list)
    for g in grouped(bitmaps).values():
        for i in g:
            for j in g:
                if i != j and np.float32(mm(bitmaps, i, j)) <= LIMIT:
                    near[i].append((mm(bitmaps, i, j), -j))
    cluster, parent = {m: m for m in bitmaps}, {}
    while True:
        choice = {}
        for m in bitmaps:
            if m not in parent:
                out = [x for x in near[m] if cluster[-x[1]] != cluster[m]]
                if out:
                    choice[cluster[m]] = (m, *min(out))
        if not choice:
            break
        goes = {c: cluster[-j] for c, (_, _, j) in choice.items()}
        barred = set()
        for c in goes:  # a circle's worst choice isn't taken
            path = [c]
            while path[-1] in goes and goes[path[-1]] not in path:
                path.append(goes[path[-1]])
            if path[-1] in goes:
                circle = path[path.index(goes[path[-1]]) :]
                barred.add(max((choice[x][1], choice[x][0], x) for x in circle)[2])
        for c, (m, _, j) in choice.items():
            if c not in barred:
                parent[m] = -j
        label = {c: c for c in set(cluster.values())}
        while True:
            before = dict(label)
            for a, b in goes.items():
                label[a] = label[b] = min(label[a], label[b])
            if label == before:
                break
        cluster = {m: label[c] for m, c in cluster.items()}
    got = {r.mark_id: (r.class_id, r.parent) for r in catalog.QUERIES["superclass_tree"](spark, SF).collect()}
    assert got == {m: (cluster[m], parent.get(m)) for m in bitmaps}


@pytest.mark.parametrize("seed", range(5))
def test_merging_classes(seed):
    rng = random.Random(seed)
    at = {n: rng.random() for n in range(14)}
    start = {n: [n] for n in at}

    def mean(members):
        if len(members) < 2:
            return members[0], 0.0
        return min(((sum(abs(at[m] - at[o]) for o in members) / (len(members) - 1)), m) for m in sorted(members))[::-1]

    allowed = lambda a, b: abs(at[a] - at[b]) < 0.5
    for target in (10, 4, 1):
        want = {c: list(m) for c, m in start.items()}
        while len(want) > target:
            options = [(mean(want[a] + want[b])[1], (a, b)) for a in want for b in want if b < a and allowed(mean(want[a])[0], mean(want[b])[0])]
            if not options:
                break
            _, (a, b) = min(options)
            want[b] = want[b] + want.pop(a)
        got = clusters.merge_classes(start, mean, allowed, target)
        assert {c: sorted(m) for c, m in got.items()} == {c: sorted(m) for c, m in want.items()}


@pytest.mark.parametrize("seed", range(8))
def test_trimming_trees(seed):
    rng = random.Random(seed)
    weight = {(a, b): rng.random() for a in range(25) for b in range(a)}
    score = lambda a, b: weight[max(a, b), min(a, b)]
    tree = {0: (None, 0.0)} | {n: ((p := rng.randrange(max(0, n - 4), n)), score(n, p)) for n in range(1, 25)}
    near = {n: sorted((score(n, o), o) for o in rng.sample([x for x in range(25) if x != n], 8)) for n in range(25)}
    inner = lambda t: {p for p, _ in t.values() if p is not None and t[p][0] is not None}
    for target in (12, 5, 0):
        out = clusters.trim_tree(tree, near, target)
        assert out.keys() == tree.keys() and out[0] == (None, 0.0) and len(inner(out)) <= max(target, len(inner(tree)))
        for n, (p, w) in out.items():
            seen = {n}
            while p is not None:  # every node still hangs from the root
                assert p not in seen
                seen.add(p)
                p = out[p][0]
            assert out[n][0] is None or w == pytest.approx(score(n, out[n][0]))
            assert out[n] == tree[n] or out[n][0] in [o for _, o in near[n]]
    assert clusters.trim_tree(tree, near, 25) == tree


def test_kept_graph_comes_back(spark, tmp_path):
    rows = catalog.marks(spark, SF)
    graph = matching.edges(rows, catalog.BY, catalog.THRESHOLD)
    matching.save_graph(graph, str(tmp_path / "graph"), catalog.THRESHOLD)
    again = matching.load_graph(spark, str(tmp_path / "graph"), catalog.THRESHOLD)
    assert sorted(map(tuple, again.select("i", "j", "mm").collect())) == sorted(map(tuple, graph.select("i", "j", "mm").collect()))
    with pytest.raises(ValueError):
        matching.load_graph(spark, str(tmp_path / "graph"), 0.3)


def test_letter_space():
    assert extract.letter_space({}) == 0
    assert extract.letter_space({2: 640, 1: 900, 5: 15, 6: 14, 9: 1}) == 5
    assert extract.letter_space({3: 10, 4: 10, 1: 2}) == 4


def test_scores_after_unification():
    a = np.zeros((9, 9), np.uint8)
    a[2:7, 2:7] = 1
    b = a.copy()
    b[2, 4] = 0  # one pixel alone is put right
    assert scores.after_unification(a, b) == 0.0
    c = a.copy()
    c[2:4, 3:6] = 0
    assert scores.after_unification(a, c) > 0
    assert scores.after_unification(a, a) == 0.0


def test_pages_partition_all_marks(spark, bitmaps):
    pages = catalog.paged_marks(spark, SF).groupBy("page").agg(F.count(F.lit(1)).alias("n")).orderBy("page").collect()
    assert [r.page for r in pages] == list(range(len(pages))) and sum(r.n for r in pages) == len(bitmaps) and {r.n for r in pages[:-1]} == {catalog.PAGE_MARKS}
