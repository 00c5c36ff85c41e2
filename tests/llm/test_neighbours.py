import numpy as np
import pytest

from glyphlake.llm import neighbours

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, every, k):
    rows = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    out = {}
    for q in rows:
        if q % every == 0:
            best = sorted((-float(rows[q] @ v), i) for i, v in rows.items() if i != q)[:k]
            out[q] = [i for _, i in best]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], KIND)


def test_small_tables_are_searched_exactly(spark):
    rng = np.random.default_rng(0)
    rows = [(k, rng.standard_normal(8).tolist()) for k in range(200)]
    got = {}
    for r in neighbours.nearest(table(spark, rows), 20, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == brute(rows, 20, 5)


def test_ties_and_copies_go_to_the_smaller_id(spark):
    rows = [(k, [1.0, 2.0, 3.0]) for k in range(60)]
    got = {}
    for r in neighbours.nearest(table(spark, rows), 20, 4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert {q: [v for _, v in sorted(x)] for q, x in got.items()} == {0: [1, 2, 3, 4], 20: [0, 1, 2, 3], 40: [0, 1, 2, 3]}


def test_unusable_vectors_take_no_part(spark):
    bad = [(0, None), (1, []), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, [1.0, 2.0, 3.0])]
    good = [(20, [1.0, 0.0]), (21, [0.5, 0.5]), (21, [0.5, 0.5]), (40, [0.0, 1.0])]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.nearest(table(spark, bad + good), 20, 20).collect())
    assert got == [(20, 1, 21, 0.5), (20, 2, 40, 0.0), (40, 1, 21, 0.5), (40, 2, 20, 0.0)]
    assert neighbours.nearest(table(spark, []), 20, 20).count() == 0
    assert neighbours.nearest(table(spark, bad[:5]), 20, 20).count() == 0


@pytest.mark.parametrize("block", [16_384, 100])
def test_learned_parts_reach_the_recall(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "PART_ROWS", 250)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", block)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", max(20, block // 10))
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 16)) * 2
    rows = [(k, (centres[k % 12] + rng.standard_normal(16)).tolist()) for k in range(2400)]
    rows = [(k, (np.array(v) / np.linalg.norm(v)).tolist()) for k, v in rows]
    usable = neighbours.usable(table(spark, rows))
    router = neighbours.fit(usable, 10)
    assert router.parts == 8 and router.probes < 8
    got = {}
    for r in neighbours.search(usable, usable.where("vec_id % 20 = 0"), 10, router).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(rows, 20, 10)
    assert np.mean([len(got[q] & set(w)) / 10 for q, w in want.items()]) >= 0.9


def test_parts_are_balanced():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((512, 8))
    part = neighbours.balanced_parts(x, neighbours.neighbours_of(x, 8), 8)
    assert np.bincount(part, minlength=8).max() <= 71 and np.bincount(part, minlength=8).min() >= 50
