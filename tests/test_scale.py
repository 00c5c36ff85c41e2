"""Work at size: comparisons shared by many tasks, few jobs, and the same results whichever way is taken."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glyphlake.functions import bits
from glyphlake.operators import clusters, matching


def table(spark, n=120, size=70, seed=5, kinds=1):
    """(rows, marks): bitmaps near five others; some repeat."""
    rng = random.Random(seed)
    base = [[rng.randint(0, 1) for _ in range(size)] for _ in range(5)]
    rows = []
    for k in range(n):
        own = list(rng.choice(base))
        for _ in range(rng.randint(0, 9)):
            own[rng.randrange(size)] ^= 1
        rows.append((k, k % kinds, own, k // 25))
    df = spark.createDataFrame(rows, "mark_id long, kind int, bits array<int>, page int")
    return rows, df.withColumns({"words": bits.pack(F.col("bits")), "area": F.size("bits")})


def distance(a, b):
    return sum(x != y for x, y in zip(a, b)) / len(a)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(matching, "BLOCK", 9)
    monkeypatch.setattr(matching, "TASK_PAIRS", 300)


@pytest.mark.parametrize("columns", [0, 8])
@pytest.mark.parametrize("most", [None, 0.05, 0.3])
def test_blocks_meet_once(spark, small_blocks, monkeypatch, most, columns):
    monkeypatch.setattr(matching, "COLUMNS", columns)
    rows, df = table(spark, kinds=2)
    got = Counter((r.kind, r.i, r.j, r.mm) for r in matching.scored(df, ["kind"], most).collect() if most is None or r.mm <= most)
    want = {(a[1], a[0], b[0], d) for a in rows for b in rows if b[0] < a[0] and a[1] == b[1] and ((d := distance(a[2], b[2])) <= (most or 1))}
    assert got == Counter(want)


def test_blocks_keep_the_order_of_pages(spark, small_blocks):
    rows, df = table(spark)
    got = Counter((r.i, r.j) for r in matching.matches(df, ["kind"], 0.2, "page").collect())
    assert got == Counter((a[0], b[0]) for a in rows for b in rows if b[3] < a[3] and distance(a[2], b[2]) <= 0.2)


def test_one_group_is_shared_by_tasks(spark, small_blocks):
    _, df = table(spark)
    rows = matching.scored(df, ["kind"]).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in rows) == 120 * 119 // 2 and max(r["count"] for r in rows) < 120 * 119 // 4


def jobs(spark, name, work):
    spark.sparkContext.setJobGroup(name, name)
    out = work()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_superclasses_take_few_jobs(spark, monkeypatch):
    _, df = table(spark)
    found = matching.matches(df, ["kind"], 0.3)
    near, few = jobs(spark, "few", lambda: sorted(map(str, clusters.superclasses(df, found).collect())))
    assert few < 60
    monkeypatch.setattr(clusters, "DRIVER_EDGES", 0)
    assert near == sorted(map(str, clusters.superclasses(df, found).collect()))


def test_components_either_way(spark, monkeypatch):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 460)]
    nodes = spark.range(500).withColumnRenamed("id", "mark_id")
    edges = spark.createDataFrame(pairs, "mark_id long, ref_id long")
    near = sorted(map(tuple, clusters.components(nodes, edges).collect()))
    monkeypatch.setattr(clusters, "DRIVER_EDGES", 0)
    assert near == sorted(map(tuple, clusters.components(nodes, edges).collect())) and len({c for _, c in near}) > 50
    none = spark.createDataFrame([], "mark_id long, ref_id long")
    monkeypatch.setattr(clusters, "DRIVER_EDGES", 10)
    assert all(m == c for m, c in clusters.components(nodes, none).collect())


def entropy(a, ref):
    black = sum(ref)
    if black in (0, len(ref)):
        return None

    def h(n, of):
        return 0.0 if n in (0, of) else -(n / of * math.log(n / of) + (1 - n / of) * math.log(1 - n / of)) * of

    lost, gained = sum(y > x for x, y in zip(a, ref)), sum(x > y for x, y in zip(a, ref))
    return (h(lost, black) + h(gained, len(ref) - black)) / len(a)


@pytest.mark.parametrize("most", [0, 4096])
def test_entropy_of_one_large_group(spark, small_blocks, monkeypatch, most):
    monkeypatch.setattr(bits, "TABLE", most)
    rows, df = table(spark, n=60, size=64)
    rows += [(60, 0, [0] * 64, 9), (61, 0, [1] * 64, 9), (62, 0, rows[3][2], 9)]
    df = spark.createDataFrame([r[:3] for r in rows], "mark_id long, kind int, bits array<int>").withColumns({"words": bits.pack(F.col("bits")), "area": F.size("bits")})
    got = matching.entropy_scores(df, ["kind"]).withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == 63 * 62 // 2 == len({(r.i, r.j) for r in got}) and max(Counter(r.task for r in got).values()) < len(got) // 2
    for r in got:
        want = entropy(rows[r.i][2], rows[r.j][2])
        assert r.i > r.j and (r.score == want if not want else r.score == pytest.approx(want, abs=1e-12))


def test_rounding_agrees_with_decimals(spark):
    rng = random.Random(1)
    values = [k / 128 for k in range(-300, 300)] + [(k + 0.5) / 1e6 for k in range(2000)] + [rng.uniform(-2, 2) for _ in range(5000)] + [0.6931471805599453, 1e-9, -1e-9, None]
    df = spark.createDataFrame([(v,) for v in values], "x double").select(bits.rounded(F.col("x"), 6).alias("a"), F.round("x", 6).alias("b"))
    assert df.where("NOT a <=> b").count() == 0


def most_joined(df):
    """The most rows that a join of ``df``'s plan made, and the rows of ``df``."""
    out = df.collect()

    def rows(p):
        kind, children = p.nodeName(), p.children()
        inner = [p.executedPlan()] if kind.startswith("AdaptiveSparkPlan") else [p.plan()] if "QueryStage" in kind else [children.apply(k) for k in range(children.size())]
        own = p.metrics().apply("numOutputRows").value() if "Join" in kind else 0
        return max([own, *map(rows, inner)])

    return rows(df._jdf.queryExecution().executedPlan()), out


@pytest.mark.parametrize("first_new", [0, 150, 500])
def test_copies_are_compared_once(spark, first_new):
    rng = random.Random(4)
    _, few = table(spark, n=12)
    base = [r.bits for r in few.collect()]
    rows = [(k, k % 2, rng.choice(base)) for k in range(400)]
    df = spark.createDataFrame(rows, "mark_id long, class_id long, bits array<int>").withColumns({"words": bits.pack(F.col("bits")), "area": F.size("bits")})
    most, got = most_joined(clusters.medoids(df, df.select("mark_id", "class_id"), first_new))
    want = {}
    for c in (0, 1):
        own = [r for r in rows if r[1] == c]
        means = [(round(sum(distance(a[2], b[2]) for b in near) / len(near), 9), a[0]) for a in own if (near := [b for b in own if b[0] >= first_new and b[0] != a[0]])]
        mean, at = min(means, default=(None, own[0][0]))
        want[c] = (at, 200, mean)
    assert {r.class_id: (r.repre, r.size, r.mean and round(r.mean, 9)) for r in got} == want and most <= 400


def test_closest_heads_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 8)
    rows, df = table(spark, kinds=2, n=150)
    df = df.withColumn("blocks", F.lit(9))
    heads = df.where("mark_id % 4 = 0").withColumn("to", F.col("mark_id") % 40 * 1000 + F.col("mark_id"))
    got = clusters.closest(df, heads, ["kind", "area"], 20).withColumn("task", F.spark_partition_id()).collect()
    own = [(b[0] % 40 * 1000 + b[0], b) for b in rows if b[0] % 4 == 0]
    want = {a[0]: min((distance(a[2], b[2]), to) for to, b in own if a[1] == b[1])[1] for a in rows if a[1] == 0}
    assert {r.mark_id: r.to for r in got} == want  # heads are even, and so of one kind; marks of the other find none


def test_lloyd_in_blocks(spark, small_blocks, monkeypatch):
    rows, df = table(spark, n=150, kinds=2)
    start = clusters.equivalence_classes(df, ["kind"], 0.3)
    whole = sorted(map(tuple, clusters.lloyd(df, start, ["kind"]).collect()))
    monkeypatch.setattr(clusters, "BLOCK", 10)
    assert whole == sorted(map(tuple, clusters.lloyd(df, start, ["kind"]).collect()))
    own = {r.mark_id: r.class_id for r in start.collect()}
    for _ in range(100):
        held, reps, moves = {}, {}, {}
        for m, c in sorted(own.items()):
            held.setdefault(c, []).append(m)
        for c, members in held.items():
            reps[c] = members[0] if len(members) < 3 else min((sum(round(70 * distance(rows[m][2], rows[o][2])) for o in members), m) for m in members)[1]
        for m, c in own.items():
            if len(held[c]) > 2 and reps[c] != m:
                to = min((distance(rows[m][2], rows[r][2]), k) for k, r in reps.items() if rows[r][1] == rows[m][1])[1]
                moves |= {m: to} if to != c else {}
        if not moves:
            break
        own |= moves
    assert dict(whole) == own


def test_copies_choose_each_other(spark):
    rng = random.Random(8)
    base, _ = table(spark, n=30)
    rows = [(k, k % 2, rng.choice(base)[2]) for k in range(120)]
    df = spark.createDataFrame(rows, "mark_id long, kind int, bits array<int>").withColumns({"words": bits.pack(F.col("bits")), "area": F.size("bits")})
    every = matching.matches(df, ["kind"], 0.3)
    alike = matching.copies(df, ["kind"], latest=True)
    alone = df.join(alike.where("mark_id <> first"), "mark_id", "left_anti")
    few = matching.matches(alone, ["kind"], 0.3)
    assert few.count() * 3 < every.count()
    assert sorted(map(str, clusters.superclasses(df, few, alike).collect())) == sorted(map(str, clusters.superclasses(df, every).collect()))
    classes = clusters.components(df, matching.best_both_ways(every, ["kind"]))
    assert sorted(clusters.equivalence_classes(df, ["kind"], 0.3).collect()) == sorted(classes.collect())
